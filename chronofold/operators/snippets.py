"""Texts by which records are shown to a model: blocks of labelled fields, calls and results, summaries of both tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import has_relative_time
from ..functions.times import range_label

#: Fields of an event that come first, in this order; the others follow by name.
EVENT_FIRST = ("published_at", "title", "summary", "url")
#: Headings and labels of shown summaries.
SUMMARY, SEMANTIC = "【摘要回忆】", "【长期语义记忆】"
PHASE, KIND, WEIGHT, MOOD = "阶段:", "类型:", "重要度:", "记忆情绪:"
SUMMARY_LISTS = (("key_events", "关键事件"), ("core_facts", "核心事实"))
SEMANTIC_LISTS = (("stable_facts", "稳定事实"), ("recurring_topics", "反复话题"), ("important_people", "重要人物"), ("open_loops", "待续线索"))


def scalar(value: Column) -> Column:
    """One line: control characters and runs of white space are one space."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\p{C}\s]+", " "))


def fields(pairs: list[tuple[str, Column]]) -> Column:
    """``name: value`` lines in order; empty values are left out."""
    return F.concat_ws("\n", *[F.when(scalar(v) != "", F.concat(F.lit(f"{n}: "), scalar(v))) for n, v in pairs])


def event_text(values: dict[str, Column], source: Column | None = None) -> Column:
    """An external event as data: its source, then its fields in their fixed order."""
    import re

    named = [n for n in values if re.fullmatch(r"[A-Za-z][A-Za-z0-9_.-]{0,63}", n) and n not in ("event_type", "source")]
    order = sorted(named, key=lambda n: (EVENT_FIRST.index(n) if n in EVENT_FIRST else len(EVENT_FIRST), n))
    return fields([*([("source", source)] if source is not None else []), *((n, values[n]) for n in order)])


def material_text(file_id: Column, kind: Column, filename: Column, status: Column, mime: Column | None = None, reason: Column | None = None, removed: bool = False) -> Column:
    """A file as a reference, or as one that was cleaned up."""
    none = F.lit("")
    head = [("source", F.lit("attachment_cleanup" if removed else "attachment")), ("file_id", file_id), ("kind", kind), ("filename", filename)]
    return fields([*head, *([] if removed else [("mime", mime if mime is not None else none)]), ("file_status", status), *([("reason", reason if reason is not None else none)] if removed else [])])


def call_text(arguments: Column) -> Column:
    """A call's input; null is an empty object."""
    return F.concat(F.lit("input:\n"), F.coalesce(arguments, F.lit("{}")))


def result_text(result: Column, source: Column | None = None) -> Column:
    out = [F.lit("output:"), F.nullif(F.trim(F.coalesce(result, F.lit(""))), F.lit(""))]
    head = [F.when(F.trim(F.coalesce(source, F.lit(""))) != "", F.concat(F.lit("source: "), F.trim(source)))] if source is not None else []
    return F.concat_ws("\n", *head, *out)


def _labels(parts: list[Column], title: str) -> Column:
    """The heading, with its labels if there are any."""
    joined = F.concat_ws(" | ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.when(joined != "", F.concat(F.lit(f"{title}["), joined, F.lit("] "))).otherwise(title)


def _lists(pairs: tuple[tuple[str, str], ...], have: set[str]) -> list[Column]:
    return [F.when(F.size(n) > 0, F.concat(F.lit(f"{label}:"), F.array_join(n, ";"))) for n, label in pairs if n in have]


def snippet(columns: list[str], layer: str, tz: str, anchor: str = "") -> Column:
    """A summary of either tier as it is shown, from the columns that its table has.

    ``anchor`` is the line that follows a text with relative times, with {} for its time range.
    """
    have = set(columns)
    semantic = layer == "semantic"
    body = F.coalesce(F.col("semantic_summary" if semantic else "diary_summary"), F.lit(""))
    when = range_label(F.col("period_start_ts"), F.col("period_end_ts"), tz)
    opt = lambda n, label: F.when(F.coalesce(F.col(n).cast("string"), F.lit("")) != "", F.concat(F.lit(label), F.col(n).cast("string")))
    if semantic:
        heads = [when, *([F.when(F.col("importance").isNotNull(), F.concat(F.lit(WEIGHT), F.format_number("importance", 2)))] if "importance" in have else [])]
    else:
        heads = [when, *[opt(n, label) for n, label in (("period_label", PHASE), ("event_type", KIND)) if n in have]]
    pairs, key = (SEMANTIC_LISTS, "semantic_id") if semantic else (SUMMARY_LISTS, "summary_id")
    said = F.concat_ws(" ", body, *[F.array_join(n, " ") for n, _ in pairs if n in have])
    relative = [F.when(has_relative_time(said), F.replace(F.lit(anchor), F.lit("{}"), when))] if anchor else []
    mood = [F.when(F.size("mood_tags") > 0, F.concat(F.lit(MOOD), F.array_join(F.slice("mood_tags", 1, 3), " / ")))] if "mood_tags" in have else []
    name = F.when(F.coalesce(F.col(key), F.lit("")) != "", F.concat(F.lit('memory_id: "'), F.replace(F.replace(F.col(key), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat_ws("\n", F.concat(_labels(heads, SEMANTIC if semantic else SUMMARY), body), *relative, *mood, *_lists(pairs, have), name)
