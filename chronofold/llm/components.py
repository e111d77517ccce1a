"""Connected components of a distributed edge list by alternating large and small stars.

Every round joins edges with one minimum per node, so no node's neighbours are ever gathered, and each
round's edges are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    return r[0], r[1]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) of one orderable type -> (node, component), component the least node reachable.

    Only nodes with an edge to another node are returned; self loops and nulls are ignored.
    """
    least, most = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    current = written(edges.where("a <> b").select(least, most).distinct(), "edges", compact=True)
    state = _state(current)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("e"))
        after = written(small.select("e.a", "e.b").where("a <> b").select(least, most).distinct(), "edges", compact=True)
        dropped(current)
        current, before = after, state
        state = _state(current)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
