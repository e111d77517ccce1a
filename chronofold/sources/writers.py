"""Rows that hosts write: chat, external events, tool exchanges, material, whole turns; and updates as new versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import date_label, time_of_day
from ..operators import snippets

#: What is compared when a row comes again.
IDENTITY = ("tenant_id", "user_id", "domain_id", "conversation_id", "kind", "origin", "turn_role", "turn_id", "correlation_id", "content", "timestamp")
_EMPTY = ("turn_id", "turn_role", "correlation_id", "actor_id", "actor_display_name", "reply_to_source_id")


def entry(rows: DataFrame, tz: str, kind: Column, origin: Column, content: Column, policy: str, visibility: str, **fields: Column) -> DataFrame:
    """Timeline rows from ``rows`` (scope, source_id, timestamp, ...) with all that a stored entry has."""
    given = {n: fields.get(n, F.lit("")) for n in _EMPTY}
    return rows.select(
        "tenant_id", "user_id", "domain_id", "conversation_id", fields.get("source_id", F.col("source_id")).alias("source_id"), fields.get("timestamp", F.col("timestamp")).alias("timestamp"),
        kind.alias("kind"), origin.alias("origin"), F.coalesce(content, F.lit("")).alias("content"), *[c.alias(n) for n, c in given.items()],
        F.lit(policy).alias("retrieval_policy"), F.lit(visibility).alias("retrieval_visibility"), fields.get("annotation_status", F.lit("unannotated")).alias("annotation_status"),
        fields.get("semanticize", F.lit(True)).alias("semanticize"), F.lit(False).alias("is_summarized"), fields.get("prompt_visible", F.lit(True)).alias("prompt_visible"),
        fields.get("index_status", F.lit("pending")).alias("index_status"), fields.get("payload", F.lit(None).cast("string")).alias("payload"),
    ).withColumns({"date_label": date_label(F.col("timestamp"), tz), "time_of_day": time_of_day(F.col("timestamp"), tz)})


def chat(rows: DataFrame, tz: str, role: Column, text: Column, indexed: Column | None = None) -> DataFrame:
    """User and assistant turns as messages that are always found; ``indexed`` false keeps one out of the index."""
    assistant = role == "assistant"
    status = F.when(F.coalesce(indexed, F.lit(True)), "pending").otherwise("skipped") if indexed is not None else F.lit("pending")
    return entry(rows, tz, F.when(assistant, "message.assistant").otherwise("message.user"), F.when(assistant, "assistant").otherwise("user"), text, "always", "default", annotation_status=F.lit("accepted_host"), index_status=status)


def host_event(kind: Column) -> Column:
    """The kind of a host's event, or an error: only ``event.*`` may come from a host."""
    low = F.lower(F.trim(kind))
    return F.when(low.rlike(r"^event(\.[a-z0-9_-]+)+$"), low).otherwise(F.raise_error(F.concat(F.lit("unsupported_host_event: "), F.coalesce(kind, F.lit("null")))).cast("string"))


def external_event(rows: DataFrame, tz: str, kind: Column, fields: list[str], source: Column | None = None) -> DataFrame:
    """Events as entries that are found only when asked for and are not summarised into memory."""
    text = snippets.event_text({f: F.col(f) for f in fields}, source)
    return entry(rows, tz, host_event(kind), F.lit("environment"), text, "explicit", "explicit", turn_role=F.lit("stimulus"), semanticize=F.lit(False), payload=F.to_json(F.struct(*fields)))


def tool_exchange(rows: DataFrame, tz: str, tool: Column, call_id: Column, arguments: Column, result: Column, status: Column) -> DataFrame:
    """A call and its result, a second apart, as two entries with one correlation."""
    both = rows.withColumn("__part", F.explode(F.array(F.lit(0), F.lit(1))))
    call = F.col("__part") == 0
    name = F.regexp_replace(F.lower(F.trim(tool)), "[^a-z0-9_-]+", "_")
    return entry(
        both, tz, F.concat(F.lit("tool."), name, F.when(call, ".call").otherwise(".result")), F.when(call, "assistant").otherwise("environment"), F.when(call, arguments).otherwise(result), "auto", "explicit",
        source_id=F.concat("source_id", F.when(call, ":call").otherwise(":result")), timestamp=F.col("timestamp") + F.col("__part"), turn_role=F.when(call, "action").otherwise("observation"), correlation_id=call_id,
        payload=F.when(call, F.to_json(F.struct(tool.alias("tool"), arguments.alias("arguments")))).otherwise(F.to_json(F.struct(tool.alias("tool"), status.alias("status")))),
    )


def material(rows: DataFrame, tz: str, handle: Column, name: Column, removed: Column) -> DataFrame:
    """A file that came in (as the user's), or that was cleaned up (as the environment's): text and payload say which."""
    kind = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    text = F.when(removed, snippets.material_text(handle, kind, name, F.lit("deleted"), removed=True)).otherwise(snippets.material_text(handle, kind, name, F.lit("available")))
    return entry(
        rows, tz, F.when(removed, "material.cleanup").otherwise("material.reference"), F.when(removed, "environment").otherwise("user"), text, "explicit", "explicit",
        turn_role=F.when(removed, "observation").otherwise("stimulus"), semanticize=F.lit(False), payload=F.to_json(F.struct(handle.alias("handle"), name.alias("name"), removed.alias("removed"))),
    )


def imported(rows: DataFrame, known: DataFrame) -> DataFrame:
    """What an import of whole turns does, per turn: turn_id, n, outcome.

    ``imported`` if no entry of the turn is known, ``already_imported`` if all are there unchanged and no others, else
    ``conflict``; a turn whose ids another turn or scope owns is a conflict too.
    """
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in IDENTITY]), 256)
    new = rows.select("turn_id", "source_id", h.alias("h"))
    old = known.select(F.col("turn_id").alias("old_turn"), "source_id", h.alias("old"))
    size = known.where("turn_id <> ''").groupBy("turn_id").agg(F.count("*").alias("n_known"))
    each = new.join(old, "source_id", "left").groupBy("turn_id").agg(F.count("*").alias("n"), F.count_if(F.col("old") == F.col("h")).alias("same"), F.count("old").alias("met"))
    joined = each.join(size, "turn_id", "left")
    n_known = F.coalesce("n_known", F.lit(0))
    outcome = F.when((F.col("met") == 0) & (n_known == 0), "imported").when((F.col("same") == F.col("n")) & (n_known == F.col("n")), "already_imported").otherwise("conflict")
    return joined.select("turn_id", "n", outcome.alias("outcome"))


def marked(table: DataFrame, ids: DataFrame, id_col: str, **values: Column) -> DataFrame:
    """New versions of the rows with these ids (id) with some columns set: what a bulk update appends."""
    rows = table.join(ids.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
    return rows.withColumns({**values, "row_version": F.coalesce(F.col("row_version"), F.lit(0)) + 1} if "row_version" in table.columns else values)


def staged_metadata(timeline: DataFrame, open_turns: DataFrame, new: DataFrame) -> DataFrame:
    """Metadata (source_id, metadata) that may be staged: only for stimuli of open turns; adds outcome."""
    rows = new.join(timeline.select("source_id", "turn_id", "turn_role"), "source_id", "left").join(open_turns.select("turn_id").distinct().withColumn("__open", F.lit(True)), "turn_id", "left")
    outcome = F.when(F.col("turn_role").isNull(), "entry_not_found").when(F.col("turn_role") != "stimulus", "not_a_stimulus").when(F.col("__open"), "staged").otherwise("turn_not_open")
    return rows.select("source_id", "metadata", outcome.alias("outcome"))


def visible_tokens(semantics: DataFrame, episodes: DataFrame, timeline: DataFrame, keys: list[str], extra: int = 4) -> DataFrame:
    """Per key the tokens of all that a prompt shows: each item costs ``extra`` more; each table has keys and tokens."""
    rows = semantics.select(*keys, "tokens").unionByName(episodes.select(*keys, "tokens")).unionByName(timeline.select(*keys, "tokens"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_items"), F.sum(F.col("tokens") + extra).cast("long").alias("tokens"))


def tenure(timeline: DataFrame, keys: list[str], now: int, tz: str) -> DataFrame:
    """Per key the local date of the first entry and how many days, at least one, have begun since."""
    first = timeline.groupBy(*keys).agg(F.min("timestamp").alias("first_ts"))
    day = F.to_date(date_label(F.col("first_ts"), tz))
    return first.select(*keys, date_label(F.col("first_ts"), tz).alias("since"), F.greatest(F.datediff(F.to_date(date_label(F.lit(now), tz)), day) + 1, F.lit(1)).alias("days"))
