"""Typed timelines, derived tiers and index entries from the supplied tables and from provider messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..functions.times import seconds

EPOCH = 1_704_067_200
EPISODE_SIZE = 4
SEMANTIC_TRIGGER, SEMANTIC_BATCH = 10, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def legacy_role(role: Column) -> Column:
    """(kind, origin, turn_role, correlation_id) of a role label; unknown labels keep a digest of themselves."""
    raw = F.trim(F.coalesce(role, F.lit("")))
    parts = F.split(raw, r"\s+")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    segment = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.lower(c), r"[^a-z0-9_-]+", "_"), F.lit("")), F.lit("unknown"))
    made = lambda kind, origin, turn_role, correlation="": F.struct(kind.alias("kind"), F.lit(origin).alias("origin"), F.lit(turn_role).alias("turn_role"), (correlation if isinstance(correlation, Column) else F.lit(correlation)).alias("correlation_id"))
    return (
        F.when(raw == "user", made(F.lit("message.user"), "user", "stimulus"))
        .when(raw == "assistant", made(F.lit("message.assistant"), "assistant", "final"))
        .when(raw.startswith("event.") & ~raw.contains(" "), made(F.lower(raw), "environment", "stimulus"))
        .when((part(0) == "assistant.tool_call") & (F.size(parts) >= 2), made(F.concat(F.lit("tool."), segment(part(1)), F.lit(".call")), "assistant", "action", part(2)))
        .when(part(0).startswith("tool."), made(F.concat(F.lit("tool."), segment(F.substring(part(0), 6, 1 << 20)), F.lit(".result")), "environment", "observation", part(1)))
        .when(part(0) == "user.attachment", made(F.lit("material.reference"), "user", "stimulus"))
        .when(part(0) == "system.material_cleanup", made(F.lit("material.cleanup"), "environment", "observation"))
        .otherwise(made(F.concat(F.lit("legacy."), F.sha2(raw, 256)), "environment", ""))
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a typed timeline: one entry a row, two rows a turn."""
    c = table(spark, sf_dir, "conversations")
    role = legacy_role(F.col("role"))
    return c.select(
        F.lit("").alias("tenant_id"), F.concat(F.lit("u"), F.col("conv_id") % 10).alias("user_id"), F.lit("").alias("domain_id"), F.col("conv_id").cast("string").alias("conversation_id"),
        F.concat_ws(":", F.concat(F.lit("c"), F.col("conv_id")), F.col("turn")).alias("source_id"), (F.col("turn") + 1).alias("seq_no"),
        (F.lit(EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("timestamp"), role["kind"].alias("kind"), role["origin"].alias("origin"), role["turn_role"].alias("turn_role"),
        F.concat(F.lit("t"), F.col("conv_id"), F.lit(":"), F.floor(F.col("turn") / 2)).alias("turn_id"), F.col("role"), F.col("text").alias("content"), token_estimate(F.col("text")).alias("tokens"),
    )


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as standalone explicit entries with the user as actor."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("").alias("tenant_id"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("user_id"), F.lit("").alias("domain_id"), F.col("user_id").cast("string").alias("conversation_id"),
        F.concat(F.lit("e"), F.col("event_id")).alias("source_id"), F.col("event_id").alias("seq_no"), seconds(F.col("ts")).alias("timestamp"),
        F.concat(F.lit("event."), F.lower("event_type")).alias("kind"), F.lit("environment").alias("origin"), F.lit("").alias("turn_role"), F.lit("explicit").alias("visibility"),
        F.col("user_id").alias("actor_id"), F.col("event_type"), F.col("value"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def trace_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a timeline with turns: a click opens a user's turn, views are calls, signups results, a purchase ends it.

    State columns (summarised, visible to the prompt, index status, result status) come from the number in props.
    """
    e = event_entries(spark, sf_dir).drop("seq_no", "turn_role", "kind")
    order = Window.partitionBy("conversation_id").orderBy("timestamp", "event_id")
    e = e.withColumn("event_id", F.substring("source_id", 2, 20).cast("long"))
    no = F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).over(order)
    pick = lambda *pairs: F.element_at(F.create_map(*[F.lit(x) for x in pairs]), F.col("event_type"))
    k = F.coalesce("k", F.lit(0))
    return e.withColumn("no", no).select(
        "tenant_id", "user_id", "domain_id", "conversation_id", "source_id", F.row_number().over(order).cast("long").alias("seq_no"), "timestamp",
        pick("click", "message.user", "view", "tool.view.call", "signup", "tool.view.result", "purchase", "message.assistant", "error", "event.error").alias("kind"),
        pick("click", "user", "view", "assistant", "signup", "environment", "purchase", "assistant", "error", "environment").alias("origin"),
        pick("click", "stimulus", "view", "action", "signup", "observation", "purchase", "final", "error", "").alias("turn_role"),
        F.when(F.col("no") > 0, F.concat(F.lit("x"), "conversation_id", F.lit(":"), F.col("no"))).otherwise("").alias("turn_id"),
        F.when(F.col("event_type").isin("view", "signup"), F.concat(F.lit("k"), k % 4)).otherwise("").alias("correlation_id"),
        F.when(F.col("event_type") == "signup", F.when(k % 5 == 0, "pending").otherwise("completed")).otherwise("").alias("status"),
        F.concat(F.lit("user:"), "actor_id").alias("actor_id"), F.concat(F.lit("User "), F.col("actor_id"), F.when(k % 2 == 0, "").otherwise(" B")).alias("actor_display_name"),
        F.when(F.col("event_type") == "view", "tool:view").otherwise("").alias("target_actor_id"), F.lit("").alias("target_actor_display_name"),
        F.col("value"), k.alias("k"), (k % 3 == 0).alias("is_summarized"), (k % 5 != 0).alias("prompt_visible"),
        F.when(k % 7 == 0, "pending").when(k % 7 == 1, "skipped").otherwise("indexed").alias("index_status"),
        F.concat(F.lit("{\"k\":"), k, F.lit("}")).alias("content"),
    )


def trace_episodes(timeline: DataFrame, size: int = 8) -> DataFrame:
    """Runs of ``size`` entries of a conversation as episodes with state columns."""
    scope = ("tenant_id", "user_id", "domain_id", "conversation_id")
    rows = timeline.withColumn("batch", F.floor((F.col("seq_no") - 1) / size))
    made = rows.groupBy(*scope, "batch").agg(F.min("timestamp").alias("period_start_ts"), F.max("timestamp").alias("period_end_ts"), F.array_sort(F.collect_list(F.struct("seq_no", "source_id"))).alias("rows"), F.sum("k").alias("k"))
    return made.select(
        *scope, F.concat(F.lit("xe"), "conversation_id", F.lit(":"), "batch").alias("summary_id"), "period_start_ts", "period_end_ts", F.col("period_end_ts").alias("timestamp"),
        F.transform("rows", lambda r: r["source_id"]).alias("source_ids"), F.lit("memory.episode_summary").alias("kind"), (F.col("k") % 3 == 0).alias("is_semanticized"),
        F.when(F.col("k") % 11 == 0, "invalid").otherwise("valid").alias("lineage_status"), F.when(F.col("k") % 5 == 0, "explicit").otherwise("default").alias("retrieval_visibility"),
        F.when(F.col("k") % 7 == 0, "pending").otherwise("indexed").alias("index_status"), (F.col("k") % 100 / 100).alias("importance"),
    )


def trace_semantics(episodes: DataFrame, size: int = 5) -> DataFrame:
    """Runs of ``size`` episodes of a user, most recently reinforced by their last one."""
    rank = F.row_number().over(Window.partitionBy("tenant_id", "user_id", "domain_id").orderBy("timestamp", "summary_id")) - 1
    made = episodes.withColumn("batch", F.floor(rank / size)).groupBy("tenant_id", "user_id", "domain_id", "batch").agg(F.max("timestamp").alias("timestamp"), F.min("period_start_ts").alias("period_start_ts"), F.array_sort(F.collect_list(F.struct("timestamp", "summary_id"))).alias("rows"), F.round(F.avg("importance"), 6).alias("importance"))
    return made.select("tenant_id", "user_id", "domain_id", F.concat(F.lit("xs"), "user_id", F.lit(":"), "batch").alias("semantic_id"), "timestamp", "period_start_ts", F.col("timestamp").alias("last_reinforced_ts"), "importance", F.transform("rows", lambda r: r["summary_id"]).alias("source_summary_ids"), F.lit("indexed").alias("index_status"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as index entries: the source is the namespace, low quality is found only when asked for."""
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").join(quality, "doc_id", "left")
    return d.select(F.col("doc_id").alias("source_id"), "text", F.col("source").alias("namespace"), F.col("lang").alias("tag"), F.when(F.col("quality") == 0, "explicit").otherwise("default").alias("visibility"), F.col("n_chars"), F.col("quality"))


def episodes(timeline: DataFrame, size: int = EPISODE_SIZE) -> DataFrame:
    """First summary tier: fixed runs of a conversation's entries with ordered lineage."""
    rank = F.row_number().over(Window.partitionBy("tenant_id", "user_id", "domain_id", "conversation_id").orderBy("seq_no", "source_id")) - 1
    rows = timeline.withColumn("batch", F.floor(rank / size))
    keys = ("tenant_id", "user_id", "domain_id", "conversation_id", "batch")
    made = rows.groupBy(*keys).agg(
        F.min("timestamp").alias("period_start_ts"), F.max("timestamp").alias("period_end_ts"), F.count("*").alias("n_entries"), F.sum("tokens").alias("tokens"),
        F.array_sort(F.collect_list(F.struct("seq_no", "source_id", F.substring("content", 1, 200).alias("head"), "role"))).alias("rows"),
    )
    return made.select(
        *keys, F.concat(F.lit("ep"), F.col("conversation_id"), F.lit(":"), F.col("batch")).alias("summary_id"), "period_start_ts", "period_end_ts", F.col("period_end_ts").alias("timestamp"), "n_entries", "tokens",
        F.transform("rows", lambda r: r["source_id"]).alias("source_ids"), F.array_join(F.transform("rows", lambda r: r["head"]), "\n").alias("summary"), F.array_distinct(F.transform("rows", lambda r: r["role"])).alias("participants"),
    )


def semantics(episodes: DataFrame, trigger: int = SEMANTIC_TRIGGER, batch: int = SEMANTIC_BATCH) -> DataFrame:
    """Second tier: a user's oldest ``batch`` episodes whenever at least ``trigger`` are not yet rolled up."""
    who = Window.partitionBy("tenant_id", "user_id", "domain_id")
    ranked = episodes.withColumn("rank", F.row_number().over(who.orderBy("timestamp", "summary_id")) - 1).withColumn("n", F.count("*").over(who))
    # Batch b starts with n - b * batch episodes left, which must reach the trigger.
    ranked = ranked.withColumn("batch", F.floor(F.col("rank") / batch)).where(F.col("n") - F.col("batch") * batch >= trigger)
    made = ranked.groupBy("tenant_id", "user_id", "domain_id", "batch").agg(
        F.min("period_start_ts").alias("period_start_ts"), F.max("period_end_ts").alias("period_end_ts"), F.sum("tokens").alias("tokens"),
        F.array_sort(F.collect_list(F.struct("rank", "summary_id"))).alias("rows"),
    )
    return made.select("tenant_id", "user_id", "domain_id", F.concat(F.lit("sem"), F.col("user_id"), F.lit(":"), F.col("batch")).alias("semantic_id"), "period_start_ts", "period_end_ts", F.col("period_end_ts").alias("timestamp"), "tokens", F.transform("rows", lambda r: r["summary_id"]).alias("source_summary_ids"))


#: A chat message on the wire; the two tool fields cover the chat forms, content blocks the block form.
WIRE = "array<struct<role:string,content:string,name:string,tool_call_id:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>"
BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string>>"


def normalise_messages(df: DataFrame, messages: str, profile: str) -> DataFrame:
    """Wire messages (a JSON array column) as one normalised event a message, call, result or block.

    Profiles: openai_chat, deepseek_chat (both chat messages), anthropic_messages (content blocks) and
    openai_responses (typed items).
    """
    keep = [c for c in df.columns if c != messages]
    none = F.lit(None).cast("string")
    event = lambda kind, role, text=none, name=none, call=none, args=none: F.struct(F.lit(kind).alias("event"), (role if isinstance(role, Column) else F.lit(role)).alias("role"), text.alias("text"), name.alias("tool_name"), call.alias("call_id"), args.alias("arguments"))
    if profile == "openai_responses":
        items = F.from_json(messages, "array<struct<type:string,role:string,content:string,name:string,call_id:string,arguments:string,output:string>>")
        rows = df.select(*keep, F.posexplode(items).alias("position", "m"))
        m = lambda f: F.col(f"m.{f}")
        made = F.when(m("type") == "function_call", event("tool_call", "assistant", name=m("name"), call=m("call_id"), args=m("arguments"))).when(m("type") == "function_call_output", event("tool_result", "tool", text=m("output"), call=m("call_id"))).otherwise(event("message", m("role"), text=m("content")))
        return rows.select(*keep, "position", F.lit(0).alias("part"), made.alias("e")).select(*keep, "position", "part", "e.*")
    rows = df.select(*keep, F.posexplode(F.from_json(messages, WIRE)).alias("position", "m"))
    m = lambda f: F.col(f"m.{f}")
    none_of = F.array().cast("array<struct<event:string,role:string,text:string,tool_name:string,call_id:string,arguments:string>>")
    if profile == "anthropic_messages":
        blocks = F.from_json(m("content"), BLOCKS)
        part = lambda b: F.when(b["type"] == "tool_use", event("tool_call", "assistant", name=b["name"], call=b["id"], args=b["input"])).when(b["type"] == "tool_result", event("tool_result", "tool", text=b["content"], call=b["tool_use_id"])).otherwise(event("message", m("role"), text=b["text"]))
        parts = F.when(m("content").startswith("["), F.transform(blocks, part)).otherwise(F.array(event("message", m("role"), text=m("content"))))
    elif profile in ("openai_chat", "deepseek_chat"):
        calls = F.coalesce(F.transform(m("tool_calls"), lambda c: event("tool_call", "assistant", name=c["function"]["name"], call=c["id"], args=c["function"]["arguments"])), none_of)
        text = F.when(m("role") == "tool", F.array(event("tool_result", "tool", text=m("content"), call=m("tool_call_id")))).when(F.coalesce(m("content"), F.lit("")) != "", F.array(event("message", m("role"), text=m("content")))).otherwise(none_of)
        parts = F.concat(text, calls)
    else:
        raise ValueError("unknown_provider_profile")
    return rows.select(*keep, "position", F.posexplode(parts).alias("part", "e")).select(*keep, "position", "part", "e.*")
