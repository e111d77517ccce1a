"""Reads of the three tiers by id, by state, by turn and by relation, and the guards of ownership.

All of them take the tables as DataFrames and a scope as a Column, so that scope, state and id predicates reach the
scan together and only asked-for columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ("tenant_id", "user_id", "domain_id", "conversation_id")
#: Columns of a header: what navigation needs of an entry, without any body.
HEADER = (*SCOPE, "kind", "origin", "turn_role", "turn_id", "actor_id", "actor_display_name", "timestamp", "seq_no", "reply_to_source_id", "correlation_id")
#: The tiers in the order in which ids are looked up: name, id column.
TIERS = (("raw", "source_id"), ("summary", "summary_id"), ("semantic", "semantic_id"))
EPISODE = "memory.episode_summary"


def ids(spark, values) -> DataFrame:
    """id, pos: requested ids in order; blanks go, of a repeated id the first stays."""
    wanted = list(dict.fromkeys(v.strip() for v in values if v and v.strip()))
    return spark.createDataFrame([(v, i) for i, v in enumerate(wanted)], "id string, pos int")


def tiers(raw: DataFrame, summaries: DataFrame, semantics: DataFrame, *columns: str) -> DataFrame:
    """tier (0, 1, 2), layer, id and ``columns`` of all three tiers; a column that a tier lacks is null."""
    out = None
    for place, ((layer, key), df) in enumerate(zip(TIERS, (raw, summaries, semantics), strict=True)):
        one = df.select(F.lit(place).alias("tier"), F.lit(layer).alias("layer"), F.col(key).alias("id"), *[c for c in columns if c in df.columns])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def fetch(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records (id, ...) of ``wanted`` (id, pos) in request order; ids without a record are left out."""
    return records.join(F.broadcast(wanted), "id").orderBy("pos")


def unambiguous(records: DataFrame) -> DataFrame:
    """``records`` (id, layer, ...) if no id is in two layers, else an error when it is read."""
    n = F.count("*").over(Window.partitionBy("id"))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("ambiguous_memory_id: "), "id")).cast("string")).otherwise(F.col("layer"))
    return records.withColumn("layer", checked)


def first_of_tiers(records: DataFrame) -> DataFrame:
    """Lookup without a scope: of the records of an id the one of the first tier."""
    w = Window.partitionBy("id").orderBy("tier")
    return records.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def headers(timeline: DataFrame) -> DataFrame:
    """source_id and the header columns that the table has."""
    return timeline.select("source_id", *[c for c in HEADER if c in timeline.columns])


def owned(rows: DataFrame, owner: Column, label: str) -> DataFrame:
    """``rows`` if all are the owner's, else an error when they are read."""
    guard = F.when(F.coalesce(owner, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"{label} is owned by another namespace")).cast("boolean"))
    return rows.where(guard)


def relation_owners(timeline: DataFrame) -> DataFrame:
    """turn_id and the scope of its first entry, which owns the turn."""
    rows = timeline.where(F.coalesce("turn_id", F.lit("")) != "")
    return rows.groupBy("turn_id").agg(F.min_by(F.struct(*SCOPE), F.struct("seq_no", "source_id")).alias("owner")).select("turn_id", "owner.*")


def unsummarized(timeline: DataFrame) -> DataFrame:
    return timeline.where(~F.col("is_summarized"))


def prompt_visible(timeline: DataFrame) -> DataFrame:
    return timeline.where(~F.col("is_summarized") & F.col("prompt_visible"))


def first_timestamps(timeline: DataFrame, keys: tuple[str, ...] = SCOPE) -> DataFrame:
    return timeline.groupBy(*keys).agg(F.min("timestamp").alias("first_ts"))


def visible_episodes(episodes: DataFrame, limit: int, keys: tuple[str, ...] = SCOPE) -> DataFrame:
    """The newest episode summaries that no semantic summary has taken up, ``limit`` of each scope."""
    rows = episodes.where(~F.col("is_semanticized") & (F.col("kind") == EPISODE))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("timestamp"), "summary_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def recent_semantics(semantics: DataFrame, limit: int, keys: tuple[str, ...] = SCOPE[:3]) -> DataFrame:
    """The most recently reinforced semantic summaries, then the more important, then the newer."""
    order = [F.desc("last_reinforced_ts"), F.desc("importance"), F.desc("timestamp"), F.asc("semantic_id")]
    return semantics.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)


def uncompacted_episodes(episodes: DataFrame) -> DataFrame:
    return episodes.where(~F.col("is_semanticized") & (F.col("kind") == EPISODE))


def turn_entries(timeline: DataFrame, turn_id: str, roles: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """One turn in order, of some roles and kinds; an empty list of either is an error."""
    if roles == [] or kinds == []:
        raise ValueError("turn_entry_filter_invalid")
    out = timeline.where(F.col("turn_id") == turn_id)
    out = out.where(F.col("turn_role").isin(*roles)) if roles else out
    out = out.where(F.col("kind").isin(*kinds)) if kinds else out
    return out.orderBy("seq_no")


def correlation_entries(timeline: DataFrame, turn_id: str, correlation_id: str) -> DataFrame:
    return timeline.where((F.col("turn_id") == turn_id) & (F.col("correlation_id") == correlation_id)).orderBy("seq_no")


def pending_index(records: DataFrame, limit: int) -> DataFrame:
    """Of every tier the ``limit`` first records that are not indexed yet."""
    rank = F.row_number().over(Window.partitionBy("tier").orderBy("timestamp", "id"))
    return records.where("index_status = 'pending'").withColumn("rank", rank).where(F.col("rank") <= limit)


def index_records(records: DataFrame, limit: int | None = None) -> DataFrame:
    """What a re-index reads: the tiers in order, each by time, without skipped records, ``limit`` in all."""
    order = ["tier", "timestamp", "conversation_id", F.coalesce("seq_no", F.lit(0)), "id"]
    out = records.where("index_status <> 'skipped'").orderBy(*order)
    return out if limit is None else out.limit(max(0, limit))


def namespaces(rows: DataFrame) -> DataFrame:
    return rows.select(*SCOPE).distinct()


def decoded(raw: Column, schema: str, default: str) -> Column:
    """A JSON column as ``schema``; null, malformed and JSON null read as ``default``."""
    return F.coalesce(F.from_json(raw, schema), F.from_json(F.lit(default), schema))


def previous_episodes(episodes: DataFrame, timeline: DataFrame, before: DataFrame) -> DataFrame:
    """For each point of ``before`` (scope, key, seq_no, timestamp) the last episode that lies wholly before it.

    An episode counts only if it is valid, visible by default and all of its sources exist in its own scope,
    with lower numbers and no later times; the order is that of its last source.
    """
    scope = list(SCOPE)
    sound = episodes.where((F.col("kind") == EPISODE) & (F.col("lineage_status") == "valid") & (F.col("retrieval_visibility") == "default") & (F.size("source_ids") > 0))
    sources = sound.select(*scope, "summary_id", "period_end_ts", F.explode("source_ids").alias("source_id"))
    known = timeline.select(*scope, "source_id", "seq_no", "timestamp")
    spans = sources.join(known, [*scope, "source_id"], "left").groupBy(*scope, "summary_id", "period_end_ts").agg(F.max("seq_no").alias("last_seq"), F.max("timestamp").alias("last_ts"), F.count_if(F.col("seq_no").isNull()).alias("missing"))
    points = before.select(*scope, "key", F.col("seq_no").alias("at_seq"), F.col("timestamp").alias("at_ts"))
    fits = (F.col("missing") == 0) & (F.col("last_seq") < F.col("at_seq")) & (F.col("last_ts") <= F.col("at_ts")) & ((F.col("period_end_ts") == 0) | (F.col("period_end_ts") <= F.col("at_ts")))
    best = F.max_by("summary_id", F.struct("last_seq", F.expr("transform(split(summary_id, ''), c -> -ascii(c))")))
    return spans.join(points, scope).where(fits).groupBy("key").agg(best.alias("summary_id"), F.max("last_seq").alias("last_seq"))


def turn_handles(turns: DataFrame, timeline: DataFrame) -> DataFrame:
    """A turn's state with its stimuli in the order of their numbers: turn_id, status, stimuli (array of seq_no, source_id)."""
    linked = turns.select("turn_id", "status", F.explode_outer("stimulus_source_ids").alias("source_id"))
    rows = linked.join(timeline.select("source_id", "seq_no"), "source_id", "left")
    stimuli = F.array_sort(F.collect_list(F.when(F.col("seq_no").isNotNull(), F.struct("seq_no", "source_id"))))
    return rows.groupBy("turn_id", "status").agg(stimuli.alias("stimuli"))


def quarantined(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of sound lineage, and those that leave the index as ``invalid_lineage``."""
    broken = F.coalesce(F.col("lineage_status"), F.lit("")) == "invalid"
    return records.where(~broken), records.where(broken).withColumn("index_status", F.lit("invalid_lineage"))
