"""Model-written metadata, index entries and catalogue fields as Columns."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact, join_tags, kind_prefixes
from ..plans.filters import is_trace

#: What a metadata field may hold.
FACETS = ("profile", "preference", "viewpoint", "relationship", "event", "state", "plan", "decision", "constraint", "knowledge", "procedure")
ABOUT = ("user", "assistant", "third_party", "external")
PRIORITIES = ("low", "normal", "high", "critical")
INTENTS = ("memory_query",)
MOODS = ("calm", "warm", "affectionate", "happy", "playful", "curious", "thoughtful", "touched", "proud", "worried", "lonely", "sad", "embarrassed", "tense", "annoyed", "determined")
MOST_MOODS = 3
#: Characters of a card's title and hint, characters and number of its headings.
TITLE, HINT, HEADING, HEADINGS = 160, 500, 120, 12

_NO_STRINGS = "array<string>"


def _trimmed(values: Column) -> Column:
    none = F.array().cast(_NO_STRINGS)
    return F.filter(F.transform(F.coalesce(values, none), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")


def distinct_strings(values: Column) -> Column:
    """Trimmed and non-empty, in order, each once."""
    return F.array_distinct(_trimmed(values))


def allowed_strings(values: Column, allowed: tuple[str, ...]) -> Column:
    """Those of the distinct strings that are allowed, in order."""
    return F.filter(distinct_strings(values), lambda x: x.isin(*allowed))


def coerced(m: Column, flavor: bool = False) -> Column:
    """A metadata struct with only what its fields may hold; moods only with ``flavor``."""
    text = lambda f: F.trim(F.coalesce(m[f], F.lit("")))
    priority = F.lower(text("retrieval_priority"))
    moods = F.slice(allowed_strings(m["mood_tags"], MOODS), 1, MOST_MOODS) if flavor else F.array().cast(_NO_STRINGS)
    return F.struct(
        F.when(text("turn_intent").isin(*INTENTS), text("turn_intent")).otherwise("").alias("turn_intent"),
        allowed_strings(m["memory_facets"], FACETS).alias("memory_facets"), allowed_strings(m["about_roles"], ABOUT).alias("about_roles"),
        distinct_strings(m["entity_anchors"]).alias("entity_anchors"), distinct_strings(m["topic_terms"]).alias("topic_terms"),
        F.when(priority.isin(*PRIORITIES), priority).otherwise("normal").alias("retrieval_priority"), moods.alias("mood_tags"),
    )


def has_signal(m: Column) -> Column:
    """Whether coerced metadata says anything beyond its defaults."""
    out = (m["turn_intent"] != "") | (m["retrieval_priority"] != "normal")
    for f in ("memory_facets", "about_roles", "entity_anchors", "topic_terms", "mood_tags"):
        out = out | (F.size(m[f]) > 0)
    return out


def annotated(prior: Column, new: Column, status: Column, kind: Column) -> Column:
    """Metadata after an annotation: events and material keep theirs unless the new one was accepted."""
    keeps = F.split(kind, r"\.")[0].isin("event", "material") & ~F.coalesce(status.startswith("accepted"), F.lit(False))
    return F.when(keeps, prior).otherwise(new)


def flag_key(prefix: str, value: str) -> str:
    """A field name for one value of a filterable field, for stores that know only scalar fields."""
    raw = (value or "").strip()
    if not raw:
        return f"{prefix}__empty"
    safe = re.fullmatch(r"[A-Za-z0-9_]+", raw)
    return f"{prefix}__{raw}" if safe else f"{prefix}__h_{hashlib.sha1(raw.encode()).hexdigest()[:16]}"


def flags(m: Column, kind: Column) -> Column:
    """All filterable values of an entry in one array of prefixed strings, which replaces a field for each value."""
    named = lambda prefix, values: F.transform(values, lambda x: F.concat(F.lit(f"{prefix}:"), x))
    entity = F.transform(m["entity_anchors"], lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " ")))
    return F.array_sort(F.array_distinct(F.concat(named("facet", m["memory_facets"]), named("role", m["about_roles"]), named("entity", entity), named("kind", kind_prefixes(kind)))))


_ENTRY_TEXT = {
    "raw": ((), (), ("semantic_text", "content")),
    "summary": (("memory_title", "catalog_hint", "diary_summary"), ("topic_headings", "key_events", "core_facts"), ()),
    "semantic": (("memory_title", "catalog_hint", "semantic_summary"), ("topic_headings", "stable_facts", "recurring_topics", "important_people", "open_loops"), ()),
}


def entry_text(df: DataFrame, layer: str) -> Column:
    """What is indexed of a record: the first non-empty text of a raw one, all texts of a summary in order."""
    texts, lists, first = _ENTRY_TEXT[layer]
    have = lambda names: [F.col(c) for c in names if c in df.columns]
    if first:
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in have(first)], F.lit(""))
    parts = [F.array(F.coalesce(c, F.lit(""))) for c in have(texts)] + [F.coalesce(c, F.array().cast(_NO_STRINGS)) for c in have(lists)]
    return F.array_join(F.concat(*parts), " ") if parts else F.lit("")


def index_entries(df: DataFrame, layer: str, id_col: str, default_kind: str) -> DataFrame:
    """source_id, layer, text, keyword_text and the filterable fields of a tier's records; df has memory_metadata."""
    value = lambda c, other: F.lower(F.trim(F.coalesce(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string"), F.lit(other))))
    m, kind, role = F.col("memory_metadata"), value("kind", default_kind), value("turn_role", "")
    text = entry_text(df, layer)
    tags = [join_tags(m[f]) for f in ("entity_anchors", "topic_terms", "memory_facets", "about_roles", "mood_tags")]
    extra = [F.col("semantic_tags_text")] if "semantic_tags_text" in df.columns else []
    scope = [c for c in ("tenant_id", "user_id", "domain_id", "conversation_id", "timestamp") if c in df.columns]
    return df.select(
        F.col(id_col).alias("source_id"), F.lit(layer).alias("layer"), *scope, text.alias("text"), keyword_text(text, *extra, *tags).alias("keyword_text"), kind.alias("kind"),
        is_trace(kind, role).alias("is_trace"), value("retrieval_visibility", "explicit").alias("visibility"), value("annotation_status", "unannotated").alias("annotation_status"),
        value("trust", "untrusted_data").alias("trust"), value("lineage_status", "raw").alias("lineage_status"), role.alias("turn_role"), flags(m, kind).alias("flags"), m["retrieval_priority"].alias("priority"),
    )


def keyword_text(text: Column, *tags: Column) -> Column:
    """The text that keywords match: the document, then its tag fields."""
    return F.trim(F.concat_ws(" ", text, *tags))


def catalog_fields(title: Column, hint: Column, headings: Column) -> Column:
    """Bounded catalogue fields; version 1 where title and hint are there, else 0."""
    t, h = compact(title, TITLE), compact(hint, HINT)
    heads = F.transform(F.slice(distinct_strings(headings), 1, HEADINGS), lambda x: compact(x, HEADING))
    return F.struct(t.alias("memory_title"), h.alias("catalog_hint"), heads.alias("topic_headings"), F.when((t != "") & (h != ""), 1).otherwise(0).alias("catalog_schema_version"))


def has_content(df: DataFrame, layer: str) -> Column:
    """Whether a record has any text of its own, beyond title and hint."""
    own = {"raw": (("semantic_text", "content"), ()), "summary": (("diary_summary",), ("key_events", "core_facts")), "semantic": (("semantic_summary",), ("stable_facts", "recurring_topics", "important_people", "open_loops"))}
    texts, lists = own[layer]
    out = F.lit(False)
    for c in texts:
        out = out | (F.trim(F.coalesce(F.col(c), F.lit(""))) != "") if c in df.columns else out
    for c in lists:
        out = out | (F.size(distinct_strings(F.col(c))) > 0) if c in df.columns else out
    return out


def merged_metadata(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the ordered union of every list field and the highest priority of its rows (m is coerced metadata)."""
    lists = ("memory_facets", "about_roles", "entity_anchors", "topic_terms")
    ranked = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("m.retrieval_priority"))
    gathered = F.array_sort(F.collect_list(F.struct(*order, *[F.col(f"m.{f}").alias(f) for f in lists])))
    out = rows.groupBy(*keys).agg(gathered.alias("rows"), F.max_by("m.retrieval_priority", ranked).alias("retrieval_priority"))
    union = lambda f: F.array_distinct(F.flatten(F.transform("rows", lambda r: r[f]))).alias(f)
    return out.select(*keys, *[union(f) for f in lists], "retrieval_priority")


def catalog_backfill(episodes: DataFrame, timeline: DataFrame) -> DataFrame:
    """Per episode what its sources say: participants, logical turns, entries, first and last time."""
    rows = episodes.select("summary_id", F.posexplode("source_ids").alias("pos", "source_id")).join(timeline, "source_id")
    turn = F.coalesce(F.nullif("turn_id", F.lit("")), F.col("source_id"))
    actors = F.array_sort(F.collect_set(F.when(F.coalesce("actor_id", F.lit("")) != "", F.col("actor_id"))))
    return rows.groupBy("summary_id").agg(actors.alias("participants"), F.count_distinct(turn).alias("n_turns"), F.count("*").alias("n_entries"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def participants(timeline: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the actors and targets of its entries in order of first appearance, each with its latest name."""
    pair = lambda i, n: F.struct(F.coalesce(F.col(i), F.lit("")).alias("actor_id"), F.trim(F.coalesce(F.col(n), F.lit(""))).alias("display_name"))
    both = timeline.select(*keys, "timestamp", "seq_no", F.posexplode(F.array(pair("actor_id", "actor_display_name"), pair("target_actor_id", "target_actor_display_name"))).alias("place", "a"))
    at = F.struct("timestamp", "seq_no", "place")
    named = F.col("a.display_name") != ""
    rows = both.where("a.actor_id <> ''").groupBy(*keys, F.col("a.actor_id").alias("actor_id")).agg(F.min(at).alias("first"), F.max_by("a.display_name", F.when(named, at)).alias("display_name"))
    w = Window.partitionBy(*keys).orderBy("first")
    return rows.select(*keys, F.row_number().over(w).alias("place"), "actor_id", F.coalesce("display_name", F.lit("")).alias("display_name"))
