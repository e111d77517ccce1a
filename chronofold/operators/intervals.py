"""Intervals, islands and coverage, as ordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Union of half-open intervals for each key; touching ones merge. Adds n, the intervals inside."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.where(F.col(start) < F.col(end)).withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1))
    ids = flagged.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ids.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def components(df: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Adds component: closed ranges that share a number belong together."""
    w = Window.partitionBy(*keys).orderBy(first, last)
    reach = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("__new", F.when(F.col(first) <= reach, 0).otherwise(1))
    return flagged.withColumn("component", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def overlaps(start: Column, end: Column, lo: int, hi: int) -> Column:
    """A closed period meets the half-open request."""
    return (end >= lo) & (start < hi)


def coverage(timeline: DataFrame, lineage: DataFrame, lo: int, hi: int) -> DataFrame:
    """Per conversation and state (covered by a summary, or live) the clamped span and the entries.

    ``lineage`` (source_id, summarized): whether a summary still holds the entry; an entry whose summary is
    gone is a gap. Left join, since most entries have no summary.
    """
    rows = timeline.where((F.col("timestamp") >= lo) & (F.col("timestamp") < hi)).join(lineage, "source_id", "left")
    state = F.when(F.col("summarized").isNull(), "live").when(F.col("summarized"), "covered").otherwise("gap")
    return rows.withColumn("state", state).groupBy("user_id", "conversation_id", "state").agg(F.greatest(F.min("timestamp"), F.lit(lo)).alias("start_ts"), F.least(F.max("timestamp") + 1, F.lit(hi)).alias("end_ts"), F.count("*").alias("n"))


def contiguous(df: DataFrame, keys: list[str], order: list[str], chosen: Column) -> DataFrame:
    """Per key: how many rows are chosen and whether they stand in a row in the whole order."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(chosen)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), (F.max("__rank") - F.min("__rank") + 1 == F.count("*")).alias("contiguous"))
