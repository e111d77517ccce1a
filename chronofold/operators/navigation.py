"""Opening what a summary stands for: pages of sources over several trees, keyword sources, references, fingerprints."""

from __future__ import annotations

import base64
import hashlib
import json
import unicodedata
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.documents import stable_hash
from . import catalog

#: Characters of a preview, and how many of them stand before the hit.
PREVIEW, BEFORE = 80, 20
PAGE, MOST_TREES = 200, 32


def folded_places(text: str) -> tuple[str, list[int]]:
    """The normal form under which keywords match, and for each of its characters its place in the text."""
    out, at = [], []
    for i, c in enumerate(text):
        for f in unicodedata.normalize("NFKC", c).casefold():
            if f.isspace():
                if not out or out[-1] == " ":
                    continue
                f = " "
            out.append(f)
            at.append(i)
    return "".join(out).rstrip(), at


def preview(text: str | None, words: list[str]) -> str:
    """A window of the original text around the first keyword; the start of the text if none is in it."""
    text = text or ""
    low, places = folded_places(text)
    hits = [h for w in words if (k := folded_places(w)[0]) and (h := low.find(k)) >= 0]
    start = max(0, (places[min(hits)] if hits else 0) - BEFORE)
    end = min(len(text), start + PREVIEW)
    return ("…" if start else "") + text[start:end] + ("…" if end < len(text) else "")


def keyword_previews(text: Column, words: list[str]) -> Column:
    @F.pandas_udf(T.StringType())
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda t: preview(t, words))

    return of(text)


def keyword_sources(cards: DataFrame, timeline: DataFrame, words: list[str], match_all: bool = False) -> DataFrame:
    """memory_id, source_id, place: the sources of each card (memory_id, source_ids) whose text holds the keywords.

    ``place`` counts them in timeline order; a card's fingerprint is the hash of its sources in order.
    """
    held = [F.contains(F.lower("content"), F.lit(w.lower())) for w in words]
    test = held[0]
    for h in held[1:]:
        test = test & h if match_all else test | h
    rows = cards.select("memory_id", F.explode("source_ids").alias("source_id")).join(timeline.where(test).select("source_id", "timestamp", "seq_no"), "source_id")
    w = Window.partitionBy("memory_id").orderBy("timestamp", "seq_no", "source_id")
    return rows.select("memory_id", "source_id", (F.row_number().over(w) - 1).alias("place"))


def fingerprints(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, n, fingerprint: changes if any row of a key, its order by ``columns``, or a value does."""
    each = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    gathered = F.array_sort(F.collect_list(F.struct(*columns, each.alias("__h"))))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(gathered, lambda r: r["__h"]), ""), 256).alias("fingerprint"))


def encode_ref(scope: list[str], memory_id: str, selector: dict, fingerprint: str) -> str:
    """A short reference to a card's matches; it carries what it was made for and is checked on use."""
    raw = json.dumps({"s": scope, "m": memory_id, "q": selector, "f": fingerprint}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    return base64.urlsafe_b64encode(hashlib.sha256(b"ref:" + raw).digest()[:9] + zlib.compress(raw, 9)).decode().rstrip("=")


def decode_ref(ref: str, scope: list[str], fingerprint: str | None = None) -> tuple[str, dict]:
    """memory_id and selector; broken, foreign and outdated references are told apart."""
    try:
        body = base64.urlsafe_b64decode(ref + "=" * (-len(ref) % 4))
        raw = zlib.decompress(body[9:])
        value = json.loads(raw)
    except (ValueError, zlib.error, UnicodeDecodeError):
        raise ValueError("invalid_match_ref") from None
    if hashlib.sha256(b"ref:" + raw).digest()[:9] != body[:9]:
        raise ValueError("invalid_match_ref")
    if value["s"] != scope:
        raise ValueError("match_ref_scope_mismatch")
    if fingerprint is not None and value["f"] != fingerprint:
        raise ValueError("match_ref_restart_required")
    return value["m"], value["q"]


def timeline_cursor(scope: list[str], selector: dict, last: tuple) -> str:
    """Continues a timeline read after the unit (timestamp, conversation, first number, turn)."""
    if len(last) != 4:
        raise ValueError("invalid_cursor_key")
    return catalog.encode_cursor(scope, "timeline", selector, list(last))


def after_cursor(units: DataFrame, cursor: str, scope: list[str], selector: dict) -> DataFrame:
    """The units after a cursor, in order."""
    order = ("start_ts", "conversation_id", "first_seq", "turn")
    last = catalog.decode_cursor(cursor, scope, "timeline", selector)
    types = [units.schema[c].dataType for c in order]
    return units.where(F.struct(*order) > F.struct(*[F.lit(v).cast(t) for v, t in zip(last, types, strict=True)])).orderBy(*order)


@dataclass
class Tree:
    """One opened memory: its units (id, text) in order after the cursor, those of the page, and why it stopped."""

    memory_id: str
    units: list[tuple[str, str]]
    chosen: list[tuple[str, str]] = field(default_factory=list)
    error: str = ""
    blocked: bool = False


def source_page(trees: list[Tree], page_size: int, tokens: int, size: int, count: Callable[[str], int], compose: Callable[[list[Tree]], str]) -> dict:
    """Units of several trees in turn, one of each, until a shared budget of tokens or bytes (0: none) is used.

    ``compose`` renders the page; its whole text counts. A unit too large for the bytes on its own is an error of its
    tree; the first unit may exceed the tokens, and is then alone. Trees and units are a page of headers on the driver.
    """
    if not 1 <= page_size <= PAGE or not 1 <= len(trees) <= MOST_TREES:
        raise ValueError("page_size_out_of_range")
    taken, oversized = 0, False
    while not oversized:
        before = taken
        for tree in trees:
            n = len(tree.chosen)
            if tree.error or tree.blocked or n >= min(page_size, len(tree.units)):
                continue
            tree.chosen.append(tree.units[n])
            page = compose(trees)
            if size and len(page.encode()) > size:
                unit = tree.chosen.pop()
                alone = compose([Tree(tree.memory_id, tree.units, [unit])])
                tree.error = "source_unit_exceeds_byte_budget" if not tree.chosen and len(alone.encode()) > size else ""
                tree.blocked = not tree.error
            elif tokens and count(page) > tokens:
                if taken:
                    tree.chosen.pop()
                    tree.blocked = True
                    continue
                taken, oversized = taken + 1, True
                break
            else:
                taken += 1
        if taken == before:
            break
    more = {t.memory_id: len(t.units) - len(t.chosen) for t in trees if not t.error and len(t.chosen) < len(t.units)}
    text = compose(trees)
    if size and len(text.encode()) > size:
        return {"status": "unavailable", "reason": "source_page_metadata_exceeds_byte_budget"}
    return {"status": "ok", "units": {t.memory_id: [u for u, _ in t.chosen] for t in trees}, "errors": {t.memory_id: t.error for t in trees if t.error}, "more": more, "oversized": oversized, "tokens": count(text), "text": text}


def keyword_page(rows: list[tuple[str, str]], offset: int, tokens: int, size: int, count: Callable[[str], int], fingerprint: str, expected: str | None = None) -> dict:
    """A run of matched sources from an ordinal offset, as many as fit; the first may exceed the tokens, never the bytes."""
    if expected is not None and expected != fingerprint:
        return {"status": "restart_required"}
    out, used = [], ""
    for key, text in rows[offset:]:
        whole = used + text + "\n"
        if size and len(whole.encode()) > size or tokens and count(whole) > tokens and out:
            break
        out.append(key)
        used = whole
        if tokens and count(used) > tokens:
            break
    if not out and offset < len(rows):
        return {"status": "unavailable", "reason": "source_unit_exceeds_byte_budget"}
    return {"status": "ok", "ids": out, "next": offset + len(out) if offset + len(out) < len(rows) else None, "oversized": bool(out and tokens and count(used) > tokens)}


def speaker_excerpts(timeline: DataFrame, speakers: list[str]) -> tuple[DataFrame, DataFrame]:
    """What the named actors said as users, and how many entries of the rest lack an actor (conversation_id, n_unknown)."""
    if not speakers or any(not s.strip() or any(ord(c) < 32 or ord(c) == 127 for c in s) for s in speakers):
        raise ValueError("invalid_speaker_ids")
    said = F.col("kind").startswith("message.user") & (F.col("origin") == "user")
    unknown = timeline.where(said).groupBy("conversation_id").agg(F.count_if(F.coalesce("actor_id", F.lit("")) == "").alias("n_unknown"))
    return timeline.where(said & F.col("actor_id").isin(*speakers)), unknown


def partitioned(assigned: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row: missing, foreign and repeated sources of an assignment (source_id) against a snapshot; all 0 if exact."""
    n = assigned.groupBy("source_id").agg(F.count("*").alias("n"))
    both = n.join(snapshot.select("source_id", F.lit(True).alias("known")), "source_id", "full")
    return both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("known").isNull()).alias("foreign"), F.count_if(F.col("n") > 1).alias("repeated"))


def replaced(ids: DataFrame, journal: DataFrame) -> DataFrame:
    """id, replacements: what stands for a memory after repairs; the latest applied repair of an id wins, one that was
    rolled back does not. ``journal`` has repair_id, applied_at, status and replacements (map id -> ids)."""
    rows = journal.where("status = 'applied'").select("repair_id", "applied_at", F.explode("replacements").alias("id", "to"))
    last = rows.groupBy("id").agg(F.max_by("to", F.struct("applied_at", "repair_id")).alias("replacements"))
    return ids.join(last, "id", "left").withColumn("replacements", F.coalesce("replacements", F.array("id")))


def hit_rates(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """One row: queries, the share whose expected id is among the first ``k`` hits (query_id, source_id, rank), mean rank."""
    best = expected.join(hits.where(F.col("rank") <= k), ["query_id", "source_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return best.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("hit_rate"), F.round(F.avg("rank"), 6).alias("mean_rank"))


def leaks(texts: DataFrame, text: str, forbidden: list[str]) -> DataFrame:
    """forbidden, n: in how many texts each forbidden string stands."""
    found = F.filter(F.array(*[F.lit(f) for f in forbidden]), lambda f: F.contains(F.col(text), f))
    counted = texts.select(F.explode(found).alias("forbidden")).groupBy("forbidden").agg(F.count("*").alias("n"))
    every = texts.sparkSession.createDataFrame([(f,) for f in forbidden], "forbidden string")
    return every.join(counted, "forbidden", "left").select("forbidden", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def stable_id(kind: str, scope: list[str], ids: list[str], version: int, profile: str) -> str:
    """The same id for the same sources, version and profile, whoever makes it."""
    return stable_hash({"kind": kind, "namespace": list(scope), "source_ids": list(ids), "version": version, "profile": profile})


def stable_ids(kind: str, scope: list[Column], ids: Column, version: int, profile: str) -> Column:
    """:func:`stable_id` for every row without leaving the JVM: a hash of the same parts, joined by unit separators."""
    return F.sha2(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(s, F.lit("")) for s in scope], F.array_join(ids, "\x1e"), F.lit(str(version)), F.lit(profile)), 256)
