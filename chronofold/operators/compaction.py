"""Compaction: which prefix of a conversation folds into episodes, roll-ups, and history repair."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import components
from .timeline import SCOPE

FACET_ORDER = ("low", "normal", "high", "critical")


def bundles(turns: DataFrame) -> DataFrame:
    """Overlapping turns as one bundle: component, its range, tokens, turns, and whether all are over."""
    c = components(turns, list(SCOPE), "first_seq", "last_seq")
    return c.groupBy(*SCOPE, "component").agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_turns"), F.bool_and("terminal").alias("terminal"))


def prefix(bundles: DataFrame, trigger: int, ratio: float, keep_recent: int) -> DataFrame:
    """Adds chosen: the bundles of the oldest prefix to compact.

    A conversation is due when its ended turns hold ``trigger`` tokens. Bundles are taken until ceil(trigger *
    ratio) tokens are reached; the last ``keep_recent`` turns stay, and the first open turn ends the prefix.
    """
    target = math.ceil(trigger * ratio)
    w = Window.partitionBy(*SCOPE).orderBy("first_seq")
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*SCOPE).orderBy(F.desc("first_seq")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(F.col("terminal"), F.col("tokens")).otherwise(0)).over(Window.partitionBy(*SCOPE))
    staged = bundles.withColumn("__cum", F.sum("tokens").over(upto)).withColumn("__open", F.max((~F.col("terminal")).cast("int")).over(upto)).withColumn("__total", total).withColumn("__later", F.sum("n_turns").over(after) - F.col("n_turns"))
    chosen = (F.col("__total") >= trigger) & (F.col("__open") == 0) & (F.col("__cum") - F.col("tokens") < target) & (F.col("__later") >= keep_recent)
    return staged.withColumn("chosen", chosen).drop("__cum", "__open", "__total", "__later")


def semantic_batch(episodes: DataFrame, trigger: int = 10, batch: int = 5) -> DataFrame:
    """The oldest ``batch`` episodes of each owner that has ``trigger`` or more, with their rank."""
    who = Window.partitionBy("tenant_id", "user_id", "domain_id")
    ranked = episodes.withColumn("n_open", F.count("*").over(who)).withColumn("rank", F.row_number().over(who.orderBy("timestamp", "summary_id")))
    return ranked.where((F.col("n_open") >= trigger) & (F.col("rank") <= batch))


def highest_priority(priority) -> F.Column:
    """Aggregate: the highest of low < normal < high < critical."""
    place = F.array_position(F.array(*map(F.lit, FACET_ORDER)), priority)
    return F.max_by(priority, place)


def merged_unique(values) -> F.Column:
    """Aggregate: ordered union of string arrays, by (position of row) then place."""
    return F.array_distinct(F.flatten(values))


def summarise(batches: DataFrame, key: str, texts: str, summariser) -> DataFrame:
    """Text of each batch by a pluggable ``summariser(list of texts) -> text``; a failing batch yields null and is not consumed."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            out = []
            for rows in frame[texts]:
                try:
                    out.append(summariser(list(rows)))
                except Exception:  # noqa: BLE001  the batch stays open and is tried again
                    out.append(None)
            yield pd.DataFrame({key: frame[key], "summary": out})

    return batches.select(key, texts).mapInPandas(run, f"{key} {batches.schema[key].dataType.simpleString()}, summary string")


def operation_digest(trace: DataFrame, keys: list[str], order: list[str], budget: int = 16_384) -> DataFrame:
    """Calls and results of each key as one deterministic digest: facts in order, anchors kept as they fit ``budget`` bytes.

    ``trace`` has kind, tool, status, correlation_id, anchor (JSON text or null). An anchor that does not fit what is
    left is replaced by its hash and size; a later, smaller one may fit again. A key is one compaction batch.
    """
    fields = [*order, "kind", "tool", "status", "correlation_id", "anchor"]
    rows = trace.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("r"))
    size = lambda x: F.coalesce(F.octet_length(x["anchor"]), F.lit(0))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<boolean>").alias("kept"))

    def step(acc, x):
        fits = acc["used"] + size(x) <= budget
        return F.struct((acc["used"] + F.when(fits, size(x)).otherwise(0)).alias("used"), F.concat(acc["kept"], F.array(fits)).alias("kept"))

    flagged = rows.withColumn("k", F.aggregate("r", start, step, lambda acc: acc["kept"]))
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f" {name}="), c)).otherwise("")

    def fact(x, i):
        omitted = F.concat(F.lit("omitted:"), F.sha2(x["anchor"], 256), F.lit(":"), size(x).cast("string"))
        anchor = F.when(x["anchor"].isNull(), "").otherwise(F.concat(F.lit(" retention_anchor="), F.when(F.get("k", i), x["anchor"]).otherwise(omitted)))
        return F.concat(F.coalesce(F.nullif(x["tool"], F.lit("")), x["kind"]), part("status", x["status"]), part("correlation", x["correlation_id"]), anchor)

    has = lambda x: x["anchor"].isNotNull()
    return flagged.select(
        *keys, F.array_join(F.transform("r", fact), "；").alias("digest"), F.size("r").alias("n_entries"), F.array_sort(F.array_distinct(F.transform("r", lambda x: x["kind"]))).alias("kinds"),
        F.size(F.filter("r", has)).alias("n_anchors"), F.size(F.filter("r", lambda x, i: has(x) & F.get("k", i))).alias("n_kept"), F.lit(0.2).alias("importance"),
    )


def is_episode_entry(kind, turn_role) -> F.Column:
    """Whether an entry goes into an episode's text; the others (calls, results, material) go into a digest."""
    return ~(turn_role.isin("action", "observation") | F.split(kind, r"\.")[0].isin("tool", "material"))


def repair_plan(episodes: list[dict], semantics: list[dict], raw_ids: set[str], generation: int, trigger: int = 10, batch: int = 5) -> dict:
    """The whole repair of one owner's semantic history: clean, unavailable or ready with groups and replacements.

    Defects are rows that were reinforced, hold no contiguous run, or disagree with their episodes about who owns
    them. Episodes that are still pending before the first defect are taken in; rows that reach across the cut too.
    Sources that are gone make a repair unavailable rather than lossy. Ids of an owner, in memory.
    """
    from ..functions.documents import stable_hash

    episodes = sorted(episodes, key=lambda e: (e.get("timestamp", 0), e["summary_id"]))
    place = {e["summary_id"]: i for i, e in enumerate(episodes)}
    held = {s["semantic_id"]: list(s.get("source_summary_ids") or []) for s in semantics}
    gone = sorted({i for ids in held.values() for i in ids if i not in place} | {f"semantic:{k}:sources" for k, ids in held.items() if not ids})
    owners: dict[str, list[str]] = {}
    for key, ids in held.items():
        for i in ids:
            owners.setdefault(i, []).append(key)
    spans = {k: sorted(place[i] for i in ids if i in place) for k, ids in held.items()}
    whole = lambda k: spans[k] and spans[k][-1] - spans[k][0] + 1 == len(spans[k]) == len(held[k])
    bad = {s["semantic_id"] for s in semantics if int(s.get("reinforcement_count") or 1) > 1 or not whole(s["semantic_id"])}
    defects = [i for k in bad for i in spans[k]]
    for i, e in enumerate(episodes):
        by = owners.get(e["summary_id"], [])
        if len(by) > 1 or bool(e.get("is_semanticized")) != bool(by) or by and e.get("semantic_id", by[0]) != by[0]:
            defects.append(i)
            bad.update(by)
    base = {"generation": generation, "fingerprint": stable_hash([episodes, semantics]), "problems": sorted(bad)}
    if gone:
        return base | {"status": "unavailable", "reason": "missing_episode_sources", "missing": gone}
    if not defects:
        return base | {"status": "clean", "groups": []}
    cut = min(defects)
    cut = min([cut, *(i for i in range(cut) if not episodes[i].get("is_semanticized"))])
    while (low := min((s[0] for s in spans.values() if s and s[-1] >= cut), default=cut)) < cut:
        cut = low
    ids = [e["summary_id"] for e in episodes[cut:]]
    sources = {str(x) for e in episodes[cut:] for x in e.get("source_ids") or []}
    if lost := sorted(sources - raw_ids):
        return base | {"status": "unavailable", "reason": "missing_raw_sources", "missing": lost}
    n = 0
    while len(ids) - n >= trigger:
        n += batch
    groups, pending = [ids[i : i + batch] for i in range(0, n, batch)], ids[n:]
    repair = stable_hash(base | {"affected": ids})
    made = [stable_hash({"repair_id": repair, "source_summary_ids": g}) for g in groups]
    old = [k for k, s in spans.items() if s and s[-1] >= cut]
    to = {k: [new for g, new in zip(groups, made, strict=True) if set(g) & set(held[k])] + [i for i in pending if i in held[k]] for k in old}
    return base | {"status": "ready", "repair_id": repair, "affected": old, "groups": groups, "new_ids": made, "pending": pending, "replacements": to}
