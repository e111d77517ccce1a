"""Projection: timeline entries as provider messages, rendered text, the frozen ledger and its overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import full_label, range_label

PROFILES = ("canonical_user_assistant", "openai_chat", "deepseek_chat", "openai_responses", "anthropic_messages")


class Renderers:
    """Text of an entry by its kind: an exact kind wins, then the longest prefix, then the plain text."""

    def __init__(self, default: Column):
        self.default, self.exact, self.prefixes = default, {}, {}

    def register(self, kind: str, text: Column) -> Renderers:
        (self.prefixes if kind.endswith(".*") else self.exact)[kind.removesuffix(".*")] = text
        return self

    def column(self, kind: Column) -> Column:
        rules = [(kind == k, t) for k, t in sorted(self.exact.items())]
        rules += [((kind == k) | kind.startswith(k + "."), t) for k, t in sorted(self.prefixes.items(), key=lambda kv: (-len(kv[0]), kv[0]))]
        out = None
        for test, text in rules:
            out = F.when(test, text) if out is None else out.when(test, text)
        return self.default if out is None else out.otherwise(self.default)


def message_role(origin: Column) -> Column:
    return F.when(origin == "assistant", "assistant").otherwise("user")


def project(entries: DataFrame, profile: str, keys: list[str], order: str) -> DataFrame:
    """Provider messages: keys, position, payload (JSON), source_ids.

    ``entries`` has text, origin, turn_role, correlation_id, tool_name, arguments. Calls in a row share one
    assistant message; the block form also gathers results in a row into one user message.
    """
    if profile not in PROFILES:
        raise ValueError("projection_profile_unsupported")
    trace = F.col("turn_role").isin("action", "observation")
    group = F.when(F.col("turn_role") == "action", "call").when(F.col("turn_role") == "observation", "result").otherwise("text")
    joins = {"openai_chat": ["call"], "deepseek_chat": ["call"], "anthropic_messages": ["call", "result"]}.get(profile, [])
    w = Window.partitionBy(*keys).orderBy(order)
    staged = entries.withColumn("__g", group).withColumn("__new", F.when((F.col("__g") == F.lag("__g").over(w)) & F.col("__g").isin(joins or [""]), 0).otherwise(1))
    staged = staged.withColumn("position", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).where(trace | F.col("text").isNotNull())
    rows = staged.groupBy(*keys, "position", F.col("__g").alias("g")).agg(F.array_sort(F.collect_list(F.struct(order, "source_id", "text", "origin", "correlation_id", "tool_name", "arguments"))).alias("r"))
    first = F.col("r")[0]
    calls = F.transform("r", lambda x: F.struct(x["correlation_id"].alias("id"), F.lit("function").alias("type"), F.struct(x["tool_name"].alias("name"), x["arguments"].alias("arguments")).alias("function")))
    text = F.to_json(F.struct(message_role(first["origin"]).alias("role"), first["text"].alias("content")))
    if profile == "canonical_user_assistant":
        card = F.when(F.col("g") == "call", F.concat(F.lit("[call "), F.coalesce(first["tool_name"], F.lit("tool")), F.lit("] "), F.coalesce(first["arguments"], F.lit("")))).when(F.col("g") == "result", F.concat(F.lit("[result] "), F.coalesce(first["text"], F.lit("")))).otherwise(first["text"])
        payload = F.to_json(F.struct(message_role(first["origin"]).alias("role"), card.alias("content")))
    elif profile == "openai_responses":
        call = F.to_json(F.struct(F.lit("function_call").alias("type"), first["correlation_id"].alias("call_id"), first["tool_name"].alias("name"), first["arguments"].alias("arguments")))
        result = F.to_json(F.struct(F.lit("function_call_output").alias("type"), first["correlation_id"].alias("call_id"), first["text"].alias("output")))
        payload = F.when(F.col("g") == "call", call).when(F.col("g") == "result", result).otherwise(F.to_json(F.struct(F.lit("message").alias("type"), message_role(first["origin"]).alias("role"), first["text"].alias("content"))))
    elif profile == "anthropic_messages":
        uses = F.transform("r", lambda x: F.struct(F.lit("tool_use").alias("type"), x["correlation_id"].alias("id"), x["tool_name"].alias("name"), F.coalesce(F.try_parse_json(x["arguments"]), F.parse_json(F.lit("{}"))).alias("input")))
        results = F.transform("r", lambda x: F.struct(F.lit("tool_result").alias("type"), x["correlation_id"].alias("tool_use_id"), x["text"].alias("content")))
        block = F.array(F.struct(F.lit("text").alias("type"), first["text"].alias("text")))
        payload = F.when(F.col("g") == "call", F.to_json(F.struct(F.lit("assistant").alias("role"), uses.alias("content")))).when(F.col("g") == "result", F.to_json(F.struct(F.lit("user").alias("role"), results.alias("content")))).otherwise(F.to_json(F.struct(message_role(first["origin"]).alias("role"), block.alias("content"))))
    else:
        call = F.to_json(F.struct(F.lit("assistant").alias("role"), calls.alias("tool_calls")))
        result = F.to_json(F.struct(F.lit("tool").alias("role"), first["correlation_id"].alias("tool_call_id"), first["text"].alias("content")))
        payload = F.when(F.col("g") == "call", call).when(F.col("g") == "result", result).otherwise(text)
    return rows.select(*keys, "position", payload.alias("payload"), F.transform("r", lambda x: x["source_id"]).alias("source_ids"))


def chat_lines(timeline: DataFrame, keys: list[str], tz: str) -> DataFrame:
    """A conversation as text: one line an entry, ordered."""
    line = F.concat(F.lit("["), full_label(F.col("timestamp"), tz), F.lit("] "), F.col("role"), F.lit(": "), F.coalesce("content", F.lit("")))
    rows = timeline.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq_no", line.alias("line")))).alias("r"))
    return rows.select(*keys, F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("text"))


def memory_snippet(title: Column, body: Column, start: Column, end: Column, tz: str) -> Column:
    """A summary as it is shown: its time range, title and text; empty lines are left out."""
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws("\n", F.concat(F.lit("["), range_label(start, end, tz), F.lit("]")), empty(title), empty(body))


def frozen(ledger: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """What to append to an immutable ledger: keys, status (current, append, stale) and first new position.

    Both have keys, position, h. A ledger is stale if a frozen position has another hash or is gone.
    """
    both = ledger.select(*keys, "position", F.col("h").alias("old")).join(fresh.select(*keys, "position", F.col("h").alias("new")), [*keys, "position"], "full")
    broken = F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))
    out = both.groupBy(*keys).agg(F.bool_or(broken).alias("stale"), F.min(F.when(F.col("old").isNull(), F.col("position"))).alias("from_position"))
    return out.select(*keys, F.when(F.col("stale"), "stale").when(F.col("from_position").isNotNull(), "append").otherwise("current").alias("status"), "from_position")


def is_prefix(a: Column, b: Column) -> Column:
    """Array b starts with all of a."""
    return F.slice(b, F.lit(1), F.size(a)) == a


def overlaid(rows: DataFrame, overlays: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, position, payload) with ranges replaced: overlays have keys, first, last, payload.

    An overlay applies only where its whole range is present; it then stands at its first position.
    """
    o = overlays.select(*keys, "first", "last", F.col("payload").alias("__new"))
    met = rows.join(o, keys).where(F.col("position").between(F.col("first"), F.col("last"))).groupBy(*keys, "first", "last", "__new").agg(F.count("*").alias("n")).where(F.col("n") == F.col("last") - F.col("first") + 1).drop("n")
    hit = rows.join(met, keys).where(F.col("position").between(F.col("first"), F.col("last"))).select(*keys, "position").distinct()
    kept = rows.join(hit, [*keys, "position"], "left_anti").select(*keys, "position", "payload")
    return kept.unionByName(met.select(*keys, F.col("first").alias("position"), F.col("__new").alias("payload")))


def bound_sources(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Messages grouped by the turn they come from, groups in the order of their first message."""
    first = F.min("position").over(Window.partitionBy(*keys, "turn_id"))
    return messages.withColumn("__first", first).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("__first", "position"))).drop("__first")
