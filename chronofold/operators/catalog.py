"""The time-indexed catalogue: cards, browsing, keywords, participants, keyset pages and cursors."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, keyword_witness
from .intervals import overlaps

ORDER = ("period_start_ts", "period_end_ts", "node_type", "memory_id")


def cards(episodes: DataFrame, semantics: DataFrame) -> DataFrame:
    """One navigation row for each summary of either tier."""
    low = episodes.select(F.col("summary_id").alias("memory_id"), F.lit("summary").alias("node_type"), "tenant_id", "user_id", "domain_id", "period_start_ts", "period_end_ts", compact(F.col("summary"), 160).alias("title"), F.size("source_ids").alias("n_sources"), "participants")
    high = semantics.select(F.col("semantic_id").alias("memory_id"), F.lit("semantic_summary").alias("node_type"), "tenant_id", "user_id", "domain_id", "period_start_ts", "period_end_ts", F.lit("").alias("title"), F.size("source_summary_ids").alias("n_sources"), F.array().cast("array<string>").alias("participants"))
    return low.unionByName(high)


def browse(cards: DataFrame, lo: int | None = None, hi: int | None = None, node_types: list[str] | None = None) -> DataFrame:
    out = cards
    if lo is not None and hi is not None:
        out = out.where(overlaps(F.col("period_start_ts"), F.col("period_end_ts"), lo, hi))
    return out.where(F.col("node_type").isin(*node_types)) if node_types else out


def keyword_match(cards: DataFrame, pool: str, keywords: list[str], match_all: bool = False) -> DataFrame:
    """Cards whose term pool holds any (or all) of the keywords, with one stored witness for each."""
    names = [f"__w{i}" for i in range(len(keywords))]
    found = cards.select("*", *[keyword_witness(F.col(pool), F.lit(k)).alias(n) for k, n in zip(keywords, names, strict=True)])
    hits = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{k}="), F.col(n))) for k, n in zip(keywords, names, strict=True)]))
    out = found.withColumn("witnesses", hits).drop(*names)
    return out.where(F.size("witnesses") >= (len(keywords) if match_all else 1))


def term_pool(episodes: DataFrame, timeline_terms: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """summary_id, pool: distinct terms of an episode's sources in order of first appearance.

    ``timeline_terms``: (source_id, term). Terms are reduced to (summary, term) before they are gathered, so a
    pool is bounded by its distinct terms. With ``keywords`` only the terms that can witness one are pooled.
    """
    if keywords:
        held = F.lit(False)
        for k in keywords:
            held = held | F.contains(F.lower("term"), F.lit(k.lower()))
        timeline_terms = timeline_terms.where(held)
    rows = episodes.select("summary_id", F.posexplode("source_ids").alias("pos", "source_id")).join(timeline_terms, "source_id")
    firsts = rows.groupBy("summary_id", "term").agg(F.min("pos").alias("pos"))
    return firsts.groupBy("summary_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("pool"))


def participant_match(refs: Column, selectors: list[str], match_all: bool = False) -> Column:
    """``refs``: array of (actor_id, display_name). Ids match exactly, names but for case; a selector with a colon is an id."""
    ids, names = F.transform(refs, lambda r: r["actor_id"]), F.transform(refs, lambda r: F.lower(r["display_name"]))
    tests = [F.array_contains(ids, s) if ":" in s else F.array_contains(ids, s) | F.array_contains(names, s.casefold()) for s in selectors]
    out = F.lit(match_all)
    for t in tests:
        out = out & t if match_all else out | t
    return F.coalesce(out, F.lit(False))


def participant_refs(timeline: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the actors in order of first appearance, each with its latest non-empty name."""
    named = F.nullif(F.trim("display_name"), F.lit(""))
    rows = timeline.where("actor_id is not null").groupBy(*keys, "actor_id").agg(F.min(F.struct("timestamp", "seq_no")).alias("first"), F.max_by(named, F.when(named.isNotNull(), F.struct("timestamp", "seq_no"))).alias("display_name"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "actor_id", F.coalesce("display_name", F.lit("")).alias("display_name")))), lambda x: F.struct(x["actor_id"].alias("actor_id"), x["display_name"].alias("display_name"))).alias("refs"))


def page(df: DataFrame, size: int, after: tuple | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The next ``size`` rows beyond a key; one row more tells whether there is another page."""
    if not 1 <= size <= 200:
        raise ValueError("page_size_out_of_range")
    out = df
    if after is not None:
        types = [df.schema[c].dataType for c in order]
        out = out.where(F.struct(*order) > F.struct(*[F.lit(v).cast(t) for v, t in zip(after, types, strict=True)]))
    return out.orderBy(*order).limit(size)


def _sealed(body: dict) -> tuple[bytes, str]:
    raw = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    return raw, hashlib.sha256(b"chronofold-cursor:" + raw).hexdigest()


def encode_cursor(scope: list[str], mode: str, selector: dict, after: list) -> str:
    """A continuation token: readable, and broken tokens or other scopes are told apart on use."""
    raw, tag = _sealed({"s": scope, "m": mode, "q": selector, "k": after})
    return base64.urlsafe_b64encode(tag.encode() + b"." + raw).decode()


def decode_cursor(cursor: str, scope: list[str], mode: str, selector: dict) -> list:
    try:
        tag, _, raw = base64.urlsafe_b64decode(cursor.encode()).partition(b".")
        body = json.loads(raw)
    except (ValueError, UnicodeDecodeError):
        raise ValueError("invalid_cursor") from None
    if _sealed(body)[1].encode() != tag:
        raise ValueError("invalid_cursor")
    if [body["s"], body["m"], body["q"]] != [scope, mode, selector]:
        raise ValueError("cursor_scope_mismatch")
    return body["k"]
