"""Connecting the nodes of a similarity join through the keys that they share, without listing a group's pairs.

Nodes post keys; similar nodes share one. Every link is checked on the whole payloads before it counts. First
each node of a key meets the one among them whose keys are shared most, so a group of copies is connected by a
star. Then, of the keys whose nodes are not one group yet, those of few nodes have the pairs of their different
groups compared, and the nodes of the others are dealt into tiles and compared tile against tile, which returns
forests. A node's payload moves to the chunks of partners that ask for it and to the tiles that its tile meets.
"""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

#: Nodes of a key whose pairs are listed; weight of a tile, and of its smallest node.
FEW, TILE_WEIGHT, LEAST_WEIGHT = 16, 1_000_000, 250
#: Partners to a chunk of a head, rows that make a key hot, rows that may be broadcast.
CHUNK_ROWS, HOT, BROADCAST_ROWS = 512, 4096, 1_000_000


class Test(Protocol):
    """What it takes to compare two nodes."""

    #: The least ratio of the sizes of similar nodes; 0 if their sizes say nothing.
    ratio: float

    def load(self, payload: memoryview): ...

    def same(self, x, y) -> bool: ...

    def forest(self, items: list, label: np.ndarray, own: int) -> list[tuple[int, int]]:
        """Pairs that connect all similar items beyond what ``label`` does; the first ``own`` meet the rest, or each
        other if there is no rest."""
        ...


def hot_limit(rows: int) -> int:
    """Keys of more rows than this are hot; there are at most ``BROADCAST_ROWS`` of them, however many rows."""
    return max(HOT, rows // BROADCAST_ROWS)


def by_key(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of many rows a key with one row a key; rows of ``hot`` keys (few by ``hot_limit``) do not move."""
    hot = F.broadcast(hot.select(key))
    cold = rows.join(hot, key, "left_anti").join(table.join(hot, key, "left_anti"), key)
    return cold.unionByName(rows.join(F.broadcast(table.join(hot, key, "left_semi")), key))


def small(df: DataFrame) -> DataFrame:
    """A written table, broadcast only behind its row count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shared_keys(posts: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Of ``posts`` (node, h, ...; a node posts a key once) the keys (h, n) of several nodes, and the hot ones."""
    shared = written(posts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shared-keys", compact=True)
    return shared, shared.where(F.col("n") > hot_limit(rows))


def verified(pairs: DataFrame, payloads: DataFrame, test: Test, rows: int) -> DataFrame:
    """The similar ones among ``pairs`` (a, b); a head's payload is sent once to each chunk of its partners."""
    # Heads of more than a chunk of partners: at most rows / CHUNK_ROWS of them.
    many = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks")).where("chunks > 1"), "many-partners", compact=True)
    many = F.broadcast(many) if rows // CHUNK_ROWS <= BROADCAST_ROWS else many
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("chunks", F.lit(1))).cast("int").alias("chunk"))
    head = dealt.select("a", "chunk").distinct().select("a", "chunk", F.lit(0).alias("place"), F.col("a").alias("node"))
    asked = small(written(head.unionByName(dealt.select("a", "chunk", F.lit(1).alias("place"), F.col("b").alias("node"))), "asked-payloads", compact=True))
    ordered = payloads.join(asked, "node").select("a", "chunk", "place", "node", "payload").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "place")

    def check(batches):
        own = None
        for batch in batches:
            good = []
            for place, raw in zip(batch.column(2).to_pylist(), batch.column(4), strict=True):
                x = test.load(raw.as_buffer())
                if place == 0:
                    own = x
                good.append(place == 1 and test.same(own, x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return ordered.mapInArrow(check, "a binary, b binary")


def tiled(rest: DataFrame, test: Test, tile_weight: int = TILE_WEIGHT) -> DataFrame:
    """Similar pairs (a, b) among ``rest`` (node, label, size, payload), a forest for each pair of tiles.

    Tiles have about ``tile_weight`` of one size class (a node weighs its size, at least ``LEAST_WEIGHT``, which
    bounds the rows too); only tiles of one class or of neighbouring classes meet.
    """
    band = F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(-math.log(min(test.ratio, 0.999)))).cast("int") if test.ratio else F.lit(0)
    classed = rest.withColumn("band", band)
    # One row for each power of the ratio: a few hundred at most, whatever the input.
    cuts = F.broadcast(classed.groupBy("band").agg(F.ceil(F.sum(F.greatest("size", F.lit(LEAST_WEIGHT))) / tile_weight).cast("int").alias("cuts")))
    cut = classed.join(cuts, "band").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(7)), F.col("cuts")).cast("int"))
    parts = ["node", "label", "payload"]
    tiles = written(cut.groupBy("band", "tile").agg(*[F.collect_list(c).alias(c) for c in parts]), "tiles")
    partners = tiles.select("band", "tile", F.explode(F.array("band", F.col("band") + 1)).alias("band2")).join(cuts.select(F.col("band").alias("band2"), F.col("cuts").alias("cuts2")), "band2")
    pairs = partners.select("band", "tile", "band2", F.explode(F.sequence(F.lit(0), F.col("cuts2") - 1)).alias("tile2")).where("band2 > band or tile2 >= tile")
    right = tiles.select(F.col("band").alias("band2"), F.col("tile").alias("tile2"), *[F.col(c).alias(f"r_{c}") for c in parts])
    work = pairs.repartition("band", "tile", "band2", "tile2").join(tiles, ["band", "tile"]).join(right, ["band2", "tile2"])
    work = work.select(((F.col("band") == F.col("band2")) & (F.col("tile") == F.col("tile2"))).alias("own"), *parts, *[f"r_{c}" for c in parts])

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                here = [batch.column(k)[i].values for k in range(1, 4)]
                own = len(here[0])
                if not batch.column(0)[i].as_py():
                    here = [pa.concat_arrays([x, batch.column(k)[i].values]) for k, x in enumerate(here, 4)]
                label = here[1].dictionary_encode().indices.to_numpy().astype(np.int64)
                found = test.forest([test.load(x.as_buffer()) for x in here[2]], label, own)
                ends = [here[0].take(pa.array([f[k] for f in found], pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return work.mapInArrow(compare, "a binary, b binary")


def star(held: DataFrame, test: Test, hot: DataFrame, linked: DataFrame | None = None, foremost: bool = False) -> DataFrame:
    """(a, b) of ``held`` (node, size, hs of n, h): each node with the one of a key whose keys are shared most.

    Pairs of one component of ``linked`` (node, component) are left out. With ``foremost`` a node meets, of those of
    all its keys, the one whose keys are shared most, so there are no more pairs than nodes."""
    known = held if linked is None else held.join(linked, "node", "left")
    label = F.col("node") if linked is None else F.coalesce("component", "node")
    at = known.withColumn("central", F.aggregate("hs", F.lit(0).cast("long"), lambda x, y: x + y["n"])).select("node", "size", "central", label.alias("label"), F.explode("hs").alias("x")).select("node", "size", "central", "label", "x.h")
    pivots = at.groupBy("h").agg(F.max(F.struct("central", "node", "size", "label")).alias("p")).select("h", "p")
    pairs = by_key(at.drop("central"), pivots, "h", hot).where("label <> p.label").where(_fits(test, F.col("size"), F.col("p.size")))
    if foremost:
        return pairs.groupBy("node").agg(F.max("p").alias("p")).select(F.col("p.node").alias("a"), F.col("node").alias("b"))
    return pairs.select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct()


def starred(held: DataFrame, payloads: DataFrame, test: Test, hot: DataFrame, rows: int, name: str) -> DataFrame:
    """(node, component) by the similar pairs of the stars. Most of a group hangs together by one pair a node, and
    only what these leave apart meets the foremost nodes of all its keys."""
    first = written(verified(written(star(held, test, hot, foremost=True), f"{name}-candidates", compact=True), payloads, test, rows), f"{name}-links", compact=True)
    linked = written(components(first), f"{name}-groups", compact=True)
    more = written(star(held, test, hot, linked), f"{name}-candidates", compact=True)
    return joined(linked, written(verified(more, payloads, test, rows), f"{name}-links", compact=True))


def joined(linked: DataFrame, pairs: DataFrame) -> DataFrame:
    """``linked`` (node, component) with further similar ``pairs`` (a, b): one edge a node and one for each two groups."""
    known = small(linked)
    of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    ends = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    edges = ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return components(linked.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b").unionByName(edges))


def _fits(test: Test, x: Column, y: Column) -> Column:
    return F.least(x, y) >= F.greatest(x, y) * F.lit(max(test.ratio - 1e-9, 0.0))


def connected(held: DataFrame, linked: DataFrame, payloads: DataFrame, test: Test, hot: DataFrame, rows: int, few: int = FEW, tile_weight: int = TILE_WEIGHT) -> DataFrame:
    """(node, component) of all similar nodes that share a key of ``held``; ``linked`` is what is known so far."""
    at = written(held.join(linked, "node", "left").select("node", "size", F.coalesce("component", "node").alias("label"), F.explode("hs").alias("x")).select("node", "size", "label", "x.h", "x.n"), "labelled", compact=True)
    split = written(at.groupBy("h", "n").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h", "n"), "open-keys", compact=True)
    if not split.limit(1).count():
        return linked
    meet = at.join(split.where(F.col("n") <= few).select("h"), "h", "left_semi").groupBy("h").agg(F.array_sort(F.collect_list(F.struct("node", "label", "size"))).alias("m"))
    other = lambda x: lambda y: (x["label"] != y["label"]) & _fits(test, x["size"], y["size"])
    both = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter(F.slice("m", i + 2, max(few, 1)), other(x)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    more = written(meet.select(F.explode(both).alias("p")).select("p.a", "p.b").distinct(), "candidates", compact=True)
    good = verified(more, payloads, test, rows)
    crowd = by_key(at, split.where(F.col("n") > few).select("h"), "h", hot).select("node", "label", "size").distinct()
    crowd = written(crowd.join(payloads, "node"), "crowded")
    if crowd.limit(1).count():
        good = good.unionByName(tiled(crowd, test, tile_weight))
    return joined(linked, written(good, "late-links", compact=True))


def named(nodes: DataFrame, linked: DataFrame, first: Column, rows: int) -> DataFrame:
    """``nodes`` (node, ...) with ``first``, an aggregate of the columns of each component's nodes (a lone node is one)."""
    labelled = nodes.join(linked, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    least = written(labelled.groupBy("label").agg(first.alias("first"), F.count("*").alias("n")), "component-names", compact=True)
    return by_key(labelled, least.select("label", "first"), "label", least.where(F.col("n") > hot_limit(rows)))
