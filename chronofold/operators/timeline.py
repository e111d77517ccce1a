"""Timeline reads: turns, windows around an anchor, pages under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ("tenant_id", "user_id", "domain_id", "conversation_id")


def group_key() -> Column:
    """The turn, or the entry itself where it belongs to none."""
    return F.coalesce(F.nullif("turn_id", F.lit("")), F.concat(F.lit("legacy."), F.sha2("source_id", 256)))


def turns(timeline: DataFrame) -> DataFrame:
    """One row a turn: range of sequence numbers and times, entries, tokens, ordered ids."""
    rows = timeline.withColumn("turn", group_key()).groupBy(*SCOPE, "turn").agg(
        F.min("seq_no").alias("first_seq"), F.max("seq_no").alias("last_seq"), F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count("*").alias("n_entries"), F.sum("tokens").alias("tokens"),
        F.array_sort(F.collect_list(F.struct("seq_no", "source_id"))).alias("rows"), F.bool_or(F.col("turn_role") == "final").alias("terminal"),
    )
    return rows.withColumn("source_ids", F.transform("rows", lambda r: r["source_id"])).drop("rows")


def anchor_window(timeline: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """Entries of the ``n`` turns before and after each anchor's turn (anchors: anchor, a source_id).

    Turns are ranked by their first entry, so interleaved turns stay whole; entries come out in the order
    (turn_rank, seq_no). Headers alone are ranked; bodies join last.
    """
    heads = timeline.select(*SCOPE, "source_id", "seq_no", group_key().alias("turn"))
    firsts = heads.groupBy(*SCOPE, "turn").agg(F.min("seq_no").alias("first_seq"))
    ranked = firsts.withColumn("turn_rank", F.row_number().over(Window.partitionBy(*SCOPE).orderBy("first_seq", "turn"))).drop("first_seq")
    at = heads.join(anchors.select(F.col("anchor").alias("source_id"), "anchor"), "source_id").join(ranked, [*SCOPE, "turn"]).select(*SCOPE, "anchor", F.col("turn_rank").alias("at"))
    near = ranked.join(at, list(SCOPE)).where(F.abs(F.col("turn_rank") - F.col("at")) <= n).select("anchor", *SCOPE, "turn", "turn_rank", (F.col("turn_rank") - F.col("at")).alias("distance"))
    return timeline.withColumn("turn", group_key()).join(near, [*SCOPE, "turn"])


def sequence_slice(timeline: DataFrame, seq_no: int, n: int) -> DataFrame:
    return timeline.where(F.col("seq_no").between(seq_no - n, seq_no + n))


def pages(units: DataFrame, budget: int, keys: list[str], order: list[str], tokens: str = "tokens") -> DataFrame:
    """Adds page: whole units packed greedily in order; a unit above the budget is a page of its own.

    Greedy packing carries a running sum from unit to unit, so a key's units (order and tokens alone, no text) are
    one group; its pages are found in one pass.
    """
    import numpy as np
    import pyarrow as pa

    rows = units.select(*keys, *order, F.col(tokens).cast("long").alias(tokens))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", page long, oversized boolean"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        sizes = table.column(tokens).to_numpy()
        page, used, out = 0, 0, np.empty(len(sizes), np.int64)
        for i, size in enumerate(sizes.tolist()):
            if not i or used + size > budget:
                page, used = page + 1, 0
            used += size
            out[i] = page
        return table.append_column("page", pa.array(out)).append_column("oversized", pa.array(sizes > budget))

    return rows.groupBy(*keys).applyInArrow(run, schema)


def date_headers(timeline: DataFrame, label: Column) -> DataFrame:
    """Adds date and header: true where the local date changes within a conversation."""
    w = Window.partitionBy(*SCOPE).orderBy("seq_no", "source_id")
    dated = timeline.withColumn("date", label)
    return dated.withColumn("header", ~F.col("date").eqNullSafe(F.lag("date").over(w)))


def sequence_numbers(new_rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds seq_no after the greatest one of each conversation."""
    top = existing.groupBy(*SCOPE).agg(F.max("seq_no").alias("__top"))
    rank = F.row_number().over(Window.partitionBy(*SCOPE).orderBy("timestamp", "source_id"))
    return new_rows.withColumn("__rank", rank).join(top, list(SCOPE), "left").withColumn("seq_no", F.coalesce("__top", F.lit(0)) + F.col("__rank")).drop("__rank", "__top")


def pending_calls(trace: DataFrame) -> DataFrame:
    """turn_id, correlation_id of calls without a final result."""
    final = (F.col("turn_role") == "observation") & ~F.coalesce(F.col("status"), F.lit("")).isin("open", "pending", "running", "streaming")
    g = trace.groupBy("turn_id", "correlation_id").agg(F.count_if(F.col("turn_role") == "action").alias("calls"), F.count_if(final).alias("results"))
    return g.where("calls > 0 and results = 0").select("turn_id", "correlation_id")


def paired_boundary(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Adds open_calls and safe_cut: after this message no call waits for its result (delta: +1 call, -1 result)."""
    w = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("open_calls", F.sum("delta").over(w)).withColumn("safe_cut", F.col("open_calls") == 0)
