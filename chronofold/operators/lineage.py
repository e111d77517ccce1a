"""The lineage graph raw <- episode <- semantic: closures, exclusion, de-duplication, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(episodes: DataFrame, semantics: DataFrame) -> DataFrame:
    """parent, child, pos over both derived tiers."""
    low = episodes.select(F.col("summary_id").alias("parent"), F.posexplode("source_ids").alias("pos", "child"))
    high = semantics.select(F.col("semantic_id").alias("parent"), F.posexplode("source_summary_ids").alias("pos", "child"))
    return low.unionByName(high)


def descendants(roots: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """root, id, depth, path (ordinals, for depth-first order) and cycle; ``roots`` has root.

    Tiers make the depth two; a deeper graph is followed ``depth`` levels, and an id that is already on its
    path ends there with cycle true.
    """
    level = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path"), F.array("root").alias("seen"), F.lit(False).alias("cycle"))
    out = level
    for d in range(1, depth + 1):
        e = edges.select(F.col("parent").alias("id"), F.col("child"), F.col("pos").cast("int").alias("pos"))
        level = level.where("not cycle").join(e, "id").select("root", F.col("child").alias("id"), F.lit(d).alias("depth"), F.concat("path", F.array("pos")).alias("path"), F.concat("seen", F.array("child")).alias("seen"), F.array_contains("seen", F.col("child")).alias("cycle"))
        out = out.unionByName(level)
    return out.drop("seen")


def ancestors(ids: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """start, id, depth of everything above ``ids`` (start); each ancestor once, at its least depth."""
    level = ids.select(F.col("start"), F.col("start").alias("id"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, depth + 1):
        level = level.join(edges.select(F.col("child").alias("id"), "parent"), "id").select("start", F.col("parent").alias("id"), F.lit(d).alias("depth")).distinct()
        out = out.unionByName(level)
    return out.groupBy("start", "id").agg(F.min("depth").alias("depth"))


def validity(episodes: DataFrame, timeline: DataFrame) -> DataFrame:
    """summary_id, n_sources, n_missing, lineage_status: valid only if every source exists in the same scope."""
    scope = ["tenant_id", "user_id", "domain_id"]
    rows = episodes.select("summary_id", *scope, F.explode_outer("source_ids").alias("source_id"))
    known = timeline.select("source_id", *scope, F.lit(True).alias("found"))
    joined = rows.join(known, ["source_id", *scope], "left").groupBy("summary_id").agg(F.count("source_id").alias("n_sources"), F.count_if(F.col("source_id").isNotNull() & F.col("found").isNull()).alias("n_missing"))
    return joined.withColumn("lineage_status", F.when((F.col("n_missing") == 0) & (F.col("n_sources") > 0), "valid").otherwise("invalid"))


def visible_exclusion(visible: DataFrame, edges: DataFrame) -> DataFrame:
    """id: what is visible and everything above it, never what lies below (``visible`` has start)."""
    return ancestors(visible, edges).select("id").distinct()


def exclude(candidates: DataFrame, excluded: DataFrame, id_col: str = "source_id") -> DataFrame:
    return candidates.join(excluded.select(F.col("id").alias(id_col)), id_col, "left_anti")


def drop_covered(derived: DataFrame, raw_hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Derived hits (source_id) none of whose descendants is a raw hit (source_id)."""
    below = descendants(derived.select(F.col("source_id").alias("root")), edges).where("depth > 0")
    covered = below.join(raw_hits.select(F.col("source_id").alias("id")), "id", "left_semi").select(F.col("root").alias("source_id")).distinct()
    return derived.join(covered, "source_id", "left_anti")


def expand_hits(hits: DataFrame, timeline: DataFrame) -> DataFrame:
    """A raw hit grows to its whole turn in order: hit, turn_id, source_ids. One row for each turn, best hit first."""
    found = hits.join(timeline.select("source_id", "turn_id"), "source_id").groupBy("turn_id").agg(F.max_by("source_id", F.struct("score", "source_id")).alias("hit"), F.max("score").alias("score"))
    rows = timeline.join(found, "turn_id").groupBy("turn_id", "hit", "score").agg(F.array_sort(F.collect_list(F.struct("seq_no", "source_id"))).alias("rows"))
    return rows.select("hit", "score", "turn_id", F.transform("rows", lambda r: r["source_id"]).alias("source_ids"))


def branches(trace: DataFrame) -> DataFrame:
    """turn_id, correlation_id, counts and completeness of call branches.

    ``trace`` has turn_id, correlation_id, turn_role, status. Complete: only calls and results, at least one
    of each, and a result whose status is final.
    """
    final = (F.col("turn_role") == "observation") & ~F.coalesce(F.col("status"), F.lit("")).isin("open", "pending", "running", "streaming")
    out = trace.groupBy("turn_id", "correlation_id").agg(F.count_if(F.col("turn_role") == "action").alias("n_actions"), F.count_if(F.col("turn_role") == "observation").alias("n_observations"), F.count_if(final).alias("n_final"), F.count("*").alias("n"))
    return out.withColumn("complete", (F.col("n_actions") > 0) & (F.col("n_final") > 0) & (F.col("n_actions") + F.col("n_observations") == F.col("n")))
