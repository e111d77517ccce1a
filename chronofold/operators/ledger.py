"""The projection ledger: provider payloads that are frozen, folded, checked and made safe to send again.

A provider's payload is JSON. Where it holds call arguments and call results depends on the provider, so each
profile has one function that lists these places as slots (call id, kind, value, and how to put another value there);
folding, checking and downgrading are written once, over slots. Tables of the ledger are append-only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.documents import UNSAFE, canonical, has_signature, sanitised_with_outcome, shortened

CANONICAL, OPENAI, ANTHROPIC = "canonical_user_assistant", "openai_chat", "anthropic_messages"
INLINE, FOLDED, EMPTY = "inline_full", "compact_reloadable", "explicit_empty"
DATA = "\ndata:\n"


class LedgerError(ValueError):
    """A payload or a set of rows that the ledger does not take."""


@dataclass
class Slot:
    """One place of a payload: the arguments or the result of a call."""

    call_id: str
    kind: str
    value: object
    put: Callable[[object], None]


def _openai_slots(payload: dict) -> Iterator[Slot]:
    for call in payload.get("tool_calls") or []:
        function = call["function"]
        yield Slot(str(call.get("id") or ""), "arguments", json.loads(function["arguments"]), lambda v, f=function: f.__setitem__("arguments", json.dumps(v, ensure_ascii=False, separators=(",", ":"))))
    if payload.get("role") == "tool":
        yield Slot(str(payload.get("tool_call_id") or ""), "result", payload["content"], lambda v: payload.__setitem__("content", v))


def _anthropic_slots(payload: dict) -> Iterator[Slot]:
    for block in payload["content"] if isinstance(payload.get("content"), list) else []:
        if block.get("type") == "tool_use":
            yield Slot(str(block.get("id") or ""), "arguments", block["input"], lambda v, b=block: b.__setitem__("input", v))
        elif block.get("type") == "tool_result":
            yield Slot(str(block.get("tool_use_id") or ""), "result", block["content"], lambda v, b=block: b.__setitem__("content", v))


def _canonical_slots(payload: dict, call_id: str, kind: str) -> Iterator[Slot]:
    text = payload["content"]
    if kind == "result":
        yield Slot(call_id, "result", text, lambda v: payload.__setitem__("content", v))
        return
    head, mark, data = text.rpartition(DATA)
    value = json.loads(data) if mark else None
    if not isinstance(value, dict):
        return
    name = next((n for n in ("input", "arguments") if n in value), "")

    def put(new):
        whole = value | {name: new} if name else new
        payload["content"] = head + mark + json.dumps(whole, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    yield Slot(call_id, "arguments", value[name] if name else value, put)


def slots(payload: dict, profile: str, calls: dict[str, str]) -> list[Slot]:
    """The places of ``calls`` (call id -> "arguments" or "result") in a payload; each must be there once."""
    try:
        if profile == OPENAI:
            found = list(_openai_slots(payload))
        elif profile == ANTHROPIC:
            found = list(_anthropic_slots(payload))
        elif profile == CANONICAL:
            ((call_id, kind),) = calls.items()
            found = list(_canonical_slots(payload, call_id, kind))
        else:
            raise LedgerError("settlement_provider_profile_unsupported")
    except LedgerError:
        raise
    except (KeyError, TypeError, AttributeError, ValueError) as error:
        raise LedgerError("settlement_projection_shape_unsupported") from error
    ids = [s.call_id for s in found]
    if profile != CANONICAL and (sorted(ids) != sorted(calls) or any(calls[s.call_id] != s.kind for s in found)):
        raise LedgerError("settlement_source_coverage_mismatch")
    if any(s.kind == "result" and not isinstance(s.value, str) for s in found):
        raise LedgerError("settlement_observation_content_must_be_text")
    return found


def settled(payload: dict, profile: str, calls: dict[str, str], sources: dict[str, str], cards: dict[str, str], least_bytes: int = 256, preview: int = 120, savings: float = 0.5) -> tuple[dict, dict[str, str]]:
    """The payload with long arguments and results folded, and what became of each call.

    ``sources`` names a call's entry, ``cards`` the card that may stand for a result. What a provider signed must be
    sent whole, so folding the arguments of a signed payload is an error.
    """
    out, kinds = json.loads(json.dumps(payload)), {}
    for slot in slots(out, profile, calls):
        if slot.kind == "arguments":
            new = shortened(slot.value, sources.get(slot.call_id, ""), least_bytes, preview, savings)
            kinds[slot.call_id] = FOLDED if new != slot.value else INLINE
        else:
            size, card = len(slot.value.encode()), cards.get(slot.call_id, "")
            small = size < least_bytes or not card or len(card.encode()) >= size * (1.0 - savings)
            kinds[slot.call_id] = EMPTY if not slot.value.strip() else INLINE if small else FOLDED
            new = card if kinds[slot.call_id] == FOLDED else slot.value
        if new != slot.value:
            slot.put(new)
    if any(kinds[c] == FOLDED and calls[c] == "arguments" for c in kinds) and has_signature(payload):
        raise LedgerError("settlement_signed_action_requires_full_replay")
    return out, kinds


def _json_map(raw: str | None) -> dict:
    return json.loads(raw) if raw else {}


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("payload", "kinds", "error")]))
def settled_json(payload: pd.Series, profile: pd.Series, calls: pd.Series, sources: pd.Series, cards: pd.Series) -> pd.DataFrame:
    """:func:`settled` over JSON columns; a payload that cannot be settled stays whole and has an error."""
    rows = []
    for raw, p, *maps in zip(payload, profile, calls, sources, cards, strict=True):
        try:
            new, kinds = settled(json.loads(raw), p, *map(_json_map, maps))
            rows.append((raw if set(kinds.values()) <= {INLINE, EMPTY} else json.dumps(new, ensure_ascii=False, separators=(",", ":")), canonical(kinds), None))
        except ValueError as error:
            rows.append((raw, None, str(error) if isinstance(error, LedgerError) else "settlement_payload_invalid"))
    return pd.DataFrame(rows, columns=["payload", "kinds", "error"])


def _object(raw) -> bool:
    try:
        return isinstance(raw, str) and isinstance(json.loads(raw), dict)
    except ValueError:
        return False


def _calls(payload: dict) -> list:
    return payload.get("tool_calls") or [] if str(payload.get("role") or "").strip().lower() == "assistant" and isinstance(payload.get("tool_calls"), list) else []


def _arguments(call) -> object:
    function = call.get("function") if isinstance(call, dict) else None
    return function.get("arguments") if isinstance(function, dict) else None


@F.pandas_udf(T.ArrayType(T.StringType()))
def broken_calls(payload: pd.Series) -> pd.Series:
    """Ids of the calls of a message in which some call's arguments are no JSON object; null if all are sound."""

    def one(raw):
        calls = _calls(json.loads(raw)) if raw else []
        if all(isinstance(c, dict) and _object(_arguments(c)) for c in calls):
            return None
        return [str(c.get("id") or "").strip() for c in calls if isinstance(c, dict)]

    return payload.map(one)


@F.pandas_udf(T.StringType())
def _call_card(payload: pd.Series, sources: pd.Series) -> pd.Series:
    def one(raw, ids):
        message = json.loads(raw)
        lines = ["[historical tool call retained as canonical trace]", "arguments_status: unavailable_after_safety_projection"]
        if isinstance(message.get("content"), str) and message["content"].strip():
            lines.append(f"assistant_preface: {message['content'].strip()}")
        for call in _calls(message):
            if isinstance(call, dict):
                function = call.get("function") if isinstance(call.get("function"), dict) else {}
                name = str(function.get("name") or "").strip() or "tool"
                lines.append(f"tool: {name}; call_id: {str(call.get('id') or '').strip() or 'unknown'}")
        if len(ids):
            lines.append("source_ids: " + ", ".join(ids))
        return "\n".join([*lines, "The original result remains available in the following canonical trace."])

    return pd.Series([one(r, i) for r, i in zip(payload, sources, strict=True)], dtype=object)


def _result_card(call_id: Column, sources: Column, content: Column) -> Column:
    listed = F.when(F.size(sources) > 0, F.concat(F.lit("source_ids: "), F.array_join(sources, ", ")))
    return F.concat_ws("\n", F.lit("[historical tool result retained as canonical trace]"), F.concat(F.lit("call_id: "), F.coalesce(F.nullif(F.trim(call_id), F.lit("")), F.lit("unknown"))), listed, F.lit("result:"), F.coalesce(content, F.lit("")))


def provider_safe(messages: DataFrame, keys: list[str], profile: str) -> DataFrame:
    """Frozen messages (keys, position, payload, source_ids) as a strict gateway takes them; adds downgraded.

    Chat profiles only: a message whose call arguments are no JSON object, and the results of its calls, become text.
    All else is returned byte for byte. Calls and results meet by a join on their id, not in one task.
    """
    if profile not in (OPENAI, "deepseek_chat"):
        return messages.withColumn("downgraded", F.lit(False))
    marked = messages.withColumn("__broken", broken_calls("payload"))
    ids = marked.where("__broken is not null").select(*keys, F.explode("__broken").alias("__call")).where("__call <> ''").distinct()
    role, call = F.lower(F.trim(F.get_json_object("payload", "$.role"))), F.trim(F.get_json_object("payload", "$.tool_call_id"))
    joined = marked.withColumn("__call", F.when(role == "tool", call)).join(ids.withColumn("__hit", F.lit(True)), [*keys, "__call"], "left")
    text = lambda r, c: F.to_json(F.struct(F.lit(r).alias("role"), c.alias("content")))
    card = F.when(F.col("__broken").isNotNull(), text("assistant", _call_card("payload", "source_ids"))).when(F.col("__hit"), text("user", _result_card(F.col("__call"), F.col("source_ids"), F.get_json_object("payload", "$.content"))))
    return joined.withColumn("downgraded", card.isNotNull()).withColumn("payload", F.coalesce(card, F.col("payload"))).select(*messages.columns, "downgraded")


def saved(ledger: DataFrame, fresh: DataFrame, open_turns: DataFrame, keys: list[str]) -> DataFrame:
    """What a save of ``fresh`` rows does to the ledger: keys, position, h, outcome.

    ``same``: already there; ``append``: new and right after what is there; ``replace``: another payload in an open
    turn that no request has frozen; ``projection_immutable_conflict``: another payload otherwise;
    ``projection_gap``: a new row that leaves a hole. ``ledger`` and ``fresh`` have position and h, ``ledger`` status.
    """
    top = ledger.groupBy(*keys).agg(F.max("position").alias("__top"))
    old = ledger.select(*keys, "position", F.col("h").alias("__old"), F.col("status").alias("__status"))
    live = open_turns.select(*keys).distinct().withColumn("__open", F.lit(True))
    rows = fresh.join(old, [*keys, "position"], "left").join(top, keys, "left").join(live, keys, "left")
    first_new = F.coalesce("__top", F.lit(-1))
    # New positions follow one another: the nth new row of a key stands n places after the last old one.
    from pyspark.sql import Window

    nth = F.sum(F.when(F.col("__old").isNull(), 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy("position"))
    outcome = (
        F.when(F.col("__old") == F.col("h"), "same").when(F.col("__old").isNull(), F.when(F.col("position") == first_new + nth, "append").otherwise("projection_gap"))
        .when(F.coalesce("__open", F.lit(False)) & (F.col("__status") != "request_frozen"), "replace").otherwise("projection_immutable_conflict")
    )
    return rows.select(*keys, "position", "h", outcome.alias("outcome"))


def first_write_wins(ledger: DataFrame, fresh: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``fresh`` to append, and those whose key is there with another hash (h): the first one stays."""
    known = ledger.select(*keys, F.col("h").alias("__old"))
    both = fresh.dropDuplicates(keys).join(known, keys, "left")
    return both.where("__old is null").drop("__old"), both.where("__old <> h").drop("__old")


def verified(headers: DataFrame, messages: DataFrame, keys: list[str]) -> DataFrame:
    """Per settlement whether its messages are all there, in order and unchanged: keys, n_messages, status.

    ``headers`` has keys, expected (number) and chain_hash; ``messages`` keys, position, payload, h. A chain hash is
    the hash of the messages' hashes in order.
    """
    ok = F.sha2("payload", 256) == F.col("h")
    rows = messages.groupBy(*keys).agg(
        F.count("*").alias("n_messages"), F.bool_and(ok).alias("whole"), (F.max("position") + 1 == F.count("*")).alias("dense"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "h"))), lambda x: x["h"]), ""), 256).alias("chain"),
    )
    joined = headers.join(rows, keys, "left")
    n = F.coalesce("n_messages", F.lit(0))
    status = F.when(n != F.col("expected"), "incomplete").when(~F.col("dense"), "incomplete").when(~F.col("whole"), "corrupt").when(F.col("chain") != F.col("chain_hash"), "corrupt").otherwise("valid")
    return joined.select(*keys, n.alias("n_messages"), status.alias("status"))


def effective_hashes(full: DataFrame, settled: DataFrame, keys: list[str]) -> DataFrame:
    """source_id, hashes: of each source the hashes of the messages that stand for it now, in order.

    A turn that is settled is read from its settled rows alone; both have keys, position, h, source_ids.
    """
    done = settled.select(*keys).distinct()
    rows = settled.select(*keys, "position", "h", "source_ids").unionByName(full.join(done, keys, "left_anti").select(*keys, "position", "h", "source_ids"))
    each = rows.select("position", "h", F.explode("source_ids").alias("source_id"), F.struct(*keys).alias("k"))
    return each.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "position", "h"))), lambda x: x["h"]).alias("hashes"))


def audits(requests: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("turn_id", "attempt", "profile")) -> DataFrame:
    """Request audits to append: one row for each key, a repeated one only if it differs, as ``conflict``."""
    stamped = requests.withColumn("audit_hash", F.sha2(F.concat_ws("\x1f", *keys, "prefix_hash", "tail_hash"), 256)).dropDuplicates([*keys, "audit_hash"])
    old = known.select(*keys, F.col("audit_hash").alias("__old"))
    both = stamped.join(old, list(keys), "left").where("__old is null or __old <> audit_hash")
    return both.withColumn("outcome", F.when(F.col("__old").isNull(), "append").otherwise("conflict")).drop("__old")


def retention_anchor(raw: str | None, most_bytes: int = 4096) -> dict:
    """A host's anchor for what must be kept: sanitised; one that is too large is kept and flagged."""
    value = json.loads(raw) if raw else {}
    if not isinstance(value, dict):
        raise LedgerError("retention_anchor_must_be_object")
    clean, outcome = sanitised_with_outcome(value)
    text = canonical(clean)
    return {"anchor": clean, "bytes": len(text.encode()), "oversized": len(text.encode()) > most_bytes, "redacted": outcome == UNSAFE}


def assembled(semantics: DataFrame, episodes: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """One context: semantic summaries from old to new, then episodes, then turns: keys, section, place, payload, h.

    ``semantics`` and ``episodes`` have timestamp, id and payload, ``turns`` position, id and payload; a strict prefix of
    the result stays byte-equal as long as its sections do.
    """
    from pyspark.sql import Window

    part = lambda df, n, at: df.select(*keys, F.lit(n).alias("section"), F.col(at).cast("long").alias("__at"), "id", "payload")
    rows = part(semantics, 0, "timestamp").unionByName(part(episodes, 1, "timestamp")).unionByName(part(turns, 2, "position"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("section", "__at", "id"))
    return rows.select(*keys, "section", "id", place.alias("place"), "payload", F.sha2("payload", 256).alias("h"))


def memory_message(kind: Column, snippet: Column) -> Column:
    """A summary as a user message."""
    return F.to_json(F.struct(F.lit("user").alias("role"), F.concat(F.lit("["), kind, F.lit("]\n"), snippet).alias("content")))
