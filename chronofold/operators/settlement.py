"""Settlement: large tool outputs fold into small reloadable cards, and what that saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate, utf8_bytes
from ..functions.times import datetime_label

MIN_INLINE_BYTES = 256
SAVINGS = 0.5
MESSAGE_TOKENS = 4


def card(tool: Column, call_id: Column, source_id: Column, content: Column, status: Column | None = None, timestamp: Column | None = None, tz: str | None = None) -> Column:
    """The lines by which a folded output is recognised and read again; absent lines are left out."""
    none = F.lit(None).cast("string")
    lines = [
        F.lit("[compact_reloadable]"),
        F.when(timestamp > 0, F.concat(F.lit("time: "), datetime_label(timestamp, tz))) if timestamp is not None and tz else none,
        F.concat(F.lit("tool: "), F.coalesce(F.nullif(F.substring(tool, 1, 64), F.lit("")), F.lit("tool"))),
        F.concat(F.lit("call_id: "), F.coalesce(call_id, F.lit(""))),
        F.when(F.coalesce(status, F.lit("")) != "", F.concat(F.lit("status: "), status)) if status is not None else none,
        F.concat(F.lit("source_id: "), F.coalesce(source_id, F.lit(""))),
        F.concat(F.lit("stored_chars: "), F.length(F.coalesce(content, F.lit(""))).cast("string")),
    ]
    return F.concat_ws("\n", *lines)


def classified(df: DataFrame, content: str, folded: Column, min_inline: int = MIN_INLINE_BYTES, savings: float = SAVINGS) -> DataFrame:
    """Adds projection (explicit_empty, inline_full or compact_reloadable) and projected text; never grows a text."""
    text = F.coalesce(F.col(content), F.lit(""))
    ratio = min(0.99, max(0.0, savings))
    staged = df.withColumn("__card", folded)
    inline = (utf8_bytes(text) < min_inline) | (utf8_bytes(F.col("__card")) >= utf8_bytes(text) * (1.0 - ratio))
    kind = F.when(F.regexp_replace(text, r"\s", "") == "", "explicit_empty").when(inline, "inline_full").otherwise("compact_reloadable")
    out = staged.withColumn("projection", kind)
    return out.withColumn("projected", F.when(F.col("projection") == "compact_reloadable", F.col("__card")).otherwise(text)).drop("__card")


def metrics(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Tokens before and after (each message costs four more), what is saved, and its share."""
    before, after = token_estimate(F.col(content)) + MESSAGE_TOKENS, token_estimate(F.col("projected")) + MESSAGE_TOKENS
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("projection") == "compact_reloadable").alias("n_folded"), F.sum(before).alias("tokens_before"), F.sum(after).alias("tokens_after"))
    saved = F.col("tokens_before") - F.col("tokens_after")
    return out.withColumn("tokens_saved", saved).withColumn("saved_ratio", F.round(saved / F.col("tokens_before"), 4))


def plan(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Per key: the first folded position (the prefix before it stays byte-equal), hash of the result, status."""
    out = df.groupBy(*keys).agg(F.min(F.when(F.col("projection") == "compact_reloadable", F.col(position))).alias("first_changed"), F.array_sort(F.collect_list(F.struct(position, F.sha2("projected", 256).alias("h")))).alias("__h"))
    chain = F.sha2(F.array_join(F.transform("__h", lambda x: x["h"]), ""), 256)
    return out.select(*keys, "first_changed", chain.alias("prefix_hash"), F.when(F.col("first_changed").isNull(), "unchanged").otherwise("settled").alias("status"))
