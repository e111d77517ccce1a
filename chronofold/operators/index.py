"""A stored index: documents with their filterable fields and vectors, and postings by term.

Both are tables of a :class:`LogStore`. An upsert adds a new version of each document and its postings, a delete adds
a version that is gone; what counts is the last version of an id, so nothing is rewritten and a search is a snapshot.
Postings lie in ``BUCKETS`` folders by a hash of their term, so a query reads the folders of its terms; of the
documents it reads the filtered fields and lengths, no text. Filters stand below the statistics, as ever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans import filters
from ..sources.store import LogStore
from .retrieval import bm25_score, dense_topk, rrf

BUCKETS = 64


def _bucket(term) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class TextIndex:
    def __init__(self, store: LogStore, name: str = "index"):
        self.store, self.docs_table, self.postings_table = store, f"{name}_docs", f"{name}_postings"

    def upsert(self, rows: DataFrame) -> int:
        """Add ``rows`` (id, text, and fields or a vector of any name) or newer versions of them; the new generation."""
        version = self.store.generation(self.docs_table) + 1
        words = rows.withColumn("w", tokens(F.col("text")))
        postings = words.select("id", F.explode("w").alias("term")).groupBy("id", "term").agg(F.count("*").cast("int").alias("tf"))
        postings = postings.withColumn("version", F.lit(version)).withColumn("term_bucket", _bucket("term"))
        # A failed writer leaves postings of a version that no document has.
        self.store.commit(self.postings_table, postings.sortWithinPartitions("term"), by=("term_bucket",))
        docs = words.withColumns({"dl": F.size("w"), "version": F.lit(version), "gone": F.lit(False)}).drop("w", "text")
        return self.store.commit(self.docs_table, docs, version - 1)

    def delete(self, ids: DataFrame) -> int:
        """Remove ``ids`` (id); unknown ids do no harm."""
        version = self.store.generation(self.docs_table) + 1
        return self.store.commit(self.docs_table, ids.select("id").distinct().withColumns({"dl": F.lit(0), "version": F.lit(version), "gone": F.lit(True)}), version - 1)

    def documents(self, where: dict | None = None, excluded: DataFrame | None = None) -> DataFrame:
        """The live documents under a filter, without ``excluded`` (id)."""
        rows = self.store.read(self.docs_table)
        last = rows.groupBy("id").agg(F.max("version").alias("version"))
        # Only ids with several versions need the join, but each row decides by the same rule.
        live = rows.join(last, ["id", "version"], "left_semi").where(~F.col("gone")).drop("gone")
        out = filters.where(live, where)
        return out if excluded is None else out.join(excluded.select("id"), "id", "left_anti")

    def count(self, where: dict | None = None, excluded: DataFrame | None = None) -> int:
        return self.documents(where, excluded).count()

    def search(self, terms: dict[str, int], k: int, where: dict | None = None, excluded: DataFrame | None = None, least: float = 0.0) -> DataFrame:
        """id and tag_score of the k best documents by keywords."""
        docs = self.documents(where, excluded).select("id", "version", "dl")
        if not terms:
            return docs.select("id", F.lit(0.0).alias("tag_score")).where(F.lit(False))
        names = sorted(terms)
        stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        asked = self.store.read(self.postings_table).where(F.col("term_bucket").isin(*_buckets(self.store, names)) & F.col("term").isin(*names))
        hits = asked.select("id", "version", "term", "tf").join(docs, ["id", "version"])
        tf = [F.max(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(names)]
        rows = hits.groupBy("id", "dl").agg(*tf)
        df = rows.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(names))])
        # Two rows of statistics.
        joined = rows.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(df))
        scored = joined.select("id", bm25_score(terms, lambda i, t: F.col(f"tf{i}"), lambda i, t: F.col(f"df{i}")).alias("tag_score"))
        return scored.where((F.col("tag_score") > 0) & (F.col("tag_score") >= least)).orderBy(F.desc("tag_score"), "id").limit(k)

    def nearest(self, vector: list[float], k: int, where: dict | None = None, excluded: DataFrame | None = None, least: float = 0.0, column: str = "vector") -> DataFrame:
        """id and semantic_score of the k nearest documents."""
        return dense_topk(self.documents(where, excluded), column, vector, k, "id", least)

    def hybrid(self, terms: dict[str, int], vector: list[float], k: int, where: dict | None = None, excluded: DataFrame | None = None) -> DataFrame:
        """Both channels fused by rank."""
        return rrf(self.nearest(vector, k, where, excluded), self.search(terms, k, where, excluded), "id")


def _buckets(store: LogStore, terms: list[str]) -> list[int]:
    """The folders of some terms, as Spark hashes them."""
    df = store.spark.createDataFrame([(t,) for t in terms], "term string")
    return sorted({r.b for r in df.select(_bucket("term").alias("b")).collect()})
