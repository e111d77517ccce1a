"""The engine as one object: every read and write is bound to a scope before anything else is planned."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import embedding
from .functions.text import token_estimate
from .functions.times import time_range
from .operators import catalog, compaction, lineage, navigation, retrieval, scans
from .operators import timeline as tl
from .plans import filters
from .sources.store import CommitConflict, LogStore


@dataclass(frozen=True)
class Namespace:
    """Three hard keys of isolation, and the conversation."""

    tenant_id: str = ""
    user_id: str = ""
    domain_id: str = ""
    conversation_id: str | None = None


@dataclass(frozen=True)
class RetrievalResult:
    """Ranked matches, which layers were searched without the entities, the filters applied, and where to go on."""

    status: str
    matches: list[dict]
    relaxed: dict[str, bool]
    applied: dict
    next_actions: list[dict]


class Engine:
    """Tables live in a :class:`LogStore`: ``timeline``, ``episodes``, ``semantics``."""

    def __init__(self, spark: SparkSession, root: str, namespace: Namespace, timezone: str):
        self.spark, self.store, self.namespace, self.timezone = spark, LogStore(spark, root), namespace, timezone

    def _scoped(self, table: str, cross: bool = True) -> DataFrame:
        n = self.namespace
        rows = self.store.read(table, scope=(n.tenant_id, n.user_id, n.domain_id))
        return rows if cross or n.conversation_id is None else rows.where(F.col("conversation_id") == n.conversation_id)

    def append(self, rows: DataFrame) -> int:
        """Append entries of this namespace; a repeated id is skipped, one of another namespace is an error."""
        n = self.namespace
        stamped = rows.withColumns({"tenant_id": F.lit(n.tenant_id), "user_id": F.lit(n.user_id), "domain_id": F.lit(n.domain_id)})
        if "tokens" not in rows.columns:
            stamped = stamped.withColumn("tokens", token_estimate(F.col("content")))
        if "seq_no" not in rows.columns:
            known = self.store.read("timeline") if self.store.generation("timeline") else stamped.withColumn("seq_no", F.lit(0).cast("long")).limit(0)
            stamped = tl.sequence_numbers(stamped, known).withColumn("seq_no", F.col("seq_no").cast("long"))
        return self.store.append_new("timeline", stamped)

    def _pool(self, layer: str, where: dict | None, selector: dict | None, within: DataFrame | None, excluded: DataFrame | None) -> DataFrame:
        """The candidates of one layer: source_id, content, and what hits are shown with."""
        table, key, text = {"raw": ("timeline", "source_id", "content"), "summary": ("episodes", "summary_id", "summary")}[layer]
        rows = filters.where(self._scoped(table), where if layer == "raw" else None)
        if selector:
            rows = rows.where(time_range(selector, self.timezone).predicate(F.col("timestamp"), self.timezone))
        columns = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("conversation_id", "role", "turn_id")]
        rows = rows.select(F.col(key).alias("source_id"), F.col(text).alias("content"), "timestamp", *columns, F.lit(layer).alias("layer"))
        if within is not None:
            rows = rows.join(within.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        return rows if excluded is None else lineage.exclude(rows, excluded)

    def _ranked(self, pool: DataFrame, query: str, entities: list[str], topics: list[str], k: int) -> DataFrame:
        """Both channels over a pool, fused: source_id, rrf_score, semantic_score, tag_score, dual_hit."""
        keyword = retrieval.bm25_topk(pool, "content", retrieval.query_terms(query, entities, topics), k)
        vectors = embedding.embed(pool.select("source_id", "content"), "content")
        return retrieval.rrf(retrieval.dense_topk(vectors, "embedding", embedding.hashed(query), k), keyword)

    def retrieve(self, query: str, entities: list[str] = (), topics: list[str] = (), where: dict | None = None, limit: int = 6, exclude_visible: DataFrame | None = None, selector: dict | None = None, within: str | None = None, layers: tuple[str, ...] = ("raw", "summary"), budget: int | None = None) -> RetrievalResult:
        """The best entries and summaries by meaning and keywords, under scope, time and filters.

        Entities are a soft filter: where no candidate of a layer has one, all are searched (``relaxed``). Raw hits come
        first; a summary goes if one of its sources is a hit; raw hits of one turn are one match. What is visible, or
        above it, is left out, as is what lies outside ``within``. With a ``budget`` of tokens matches are taken as
        they fit, and the first may be cut.
        """
        if not query.strip() or limit < 1 or not set(layers) <= {"raw", "summary"}:
            raise ValueError("invalid_retrieval_request")
        layers = [la for la in layers if la == "raw" or self.store.generation("episodes")]
        edges = self.edges() if self.store.generation("episodes") and self.store.generation("semantics") else None
        excluded = lineage.visible_exclusion(exclude_visible, edges) if exclude_visible is not None and edges is not None else exclude_visible and exclude_visible.select(F.col("start").alias("id"))
        inside = lineage.descendants(self.spark.createDataFrame([(within,)], "root string"), edges).select("id") if within and edges is not None else None
        found, relaxed = None, {}
        for tier, layer in enumerate(layers):
            pool = self._pool(layer, where, selector, inside, excluded)
            if entities:
                names = [F.lower(F.col("content")).contains(e.lower()) for e in entities]
                strict = pool.where(reduce(or_, names))
                relaxed[layer] = not strict.limit(1).count()
                pool = pool if relaxed[layer] else strict
            hits = self._ranked(pool, query, list(entities), list(topics), max(10, 10 * limit)).limit(max(10, 10 * limit))
            # Bodies join after the ranking.
            one = pool.join(F.broadcast(hits), "source_id").withColumn("tier", F.lit(tier))
            found = one if found is None else found.unionByName(one)
        rows = [r.asDict() for r in found.orderBy("tier", F.desc("rrf_score"), F.desc("semantic_score"), F.desc("tag_score"), "source_id").collect()]
        raw = {r["source_id"] for r in rows if r["layer"] == "raw"}
        covered = set()
        if edges is not None and raw:
            starts = self.spark.createDataFrame([(i,) for i in raw], "start string")
            covered = {r.id for r in lineage.ancestors(starts, edges).where("depth > 0").collect()}
        matches, groups = [], set()
        for r in rows:
            group = r["turn_id"] or r["source_id"]
            if r["source_id"] not in covered and group not in groups:
                groups.add(group)
                matches.append(r)
        matches = matches[:limit]
        if budget is not None:
            by_id = {r["source_id"]: r for r in matches}
            fits = retrieval.fits_budget([(r["source_id"], r["content"]) for r in matches], budget, lambda t: max(1, (len(t.encode()) + 3) // 4))
            matches = [by_id[key] | {"content": text, "truncated": cut} for key, text, cut in fits]
        status = "found" if matches else "empty"
        actions = [{"action": "read_timeline", "anchor": m["source_id"]} if m["layer"] == "raw" else {"action": "open", "memory_id": m["source_id"]} for m in matches]
        return RetrievalResult(status, matches, relaxed, {"entities": list(entities), "topics": list(topics), "where": where, "time": selector, "within": within, "layers": layers}, actions)

    def edges(self) -> DataFrame:
        return lineage.edges(self._scoped("episodes"), self._scoped("semantics"))

    def browse(self, selector: dict | None = None, node_types: list[str] | None = None, page_size: int = 50, cursor: str | None = None, keywords: list[str] | None = None, match: str = "any") -> tuple[DataFrame, str | None]:
        """A page of cards and the cursor of the next one, or None.

        With keywords only cards whose own text or whose sources' text holds any, or all, of them.
        """
        n = self.namespace
        scope, key = [n.tenant_id, n.user_id, n.domain_id], {"time": selector or {}, "types": node_types or [], "words": keywords or [], "match": match}
        r = time_range(selector, self.timezone) if selector else None
        cards = catalog.browse(catalog.cards(self._scoped("episodes"), self._scoped("semantics")), r and r.start, r and r.end, node_types)
        if keywords:
            words = [w.lower() for w in keywords]
            low, high = self._scoped("episodes"), self._scoped("semantics")
            lines = low.select("summary_id", F.explode("source_ids").alias("source_id")).join(self._scoped("timeline").select("source_id", F.lower("content").alias("text")), "source_id").select(F.col("summary_id").alias("memory_id"), "text")
            lines = lines.unionByName(low.select(F.col("summary_id").alias("memory_id"), F.lower("summary").alias("text")))
            held = [F.max(F.contains("text", F.lit(w))).alias(f"w{i}") for i, w in enumerate(words)]
            found = lines.groupBy("memory_id").agg(*held)
            up = high.select(F.col("semantic_id").alias("top"), F.explode("source_summary_ids").alias("memory_id")).join(found, "memory_id").groupBy("top").agg(*[F.max(f"w{i}").alias(f"w{i}") for i in range(len(words))]).withColumnRenamed("top", "memory_id")
            tests = [F.col(f"w{i}") for i in range(len(words))]
            hits = found.unionByName(up).where(reduce(and_ if match == "all" else or_, tests)).select("memory_id")
            cards = cards.join(hits, "memory_id", "left_semi")
        after = tuple(catalog.decode_cursor(cursor, scope, "browse", key)) if cursor else None
        rows = catalog.page(cards, page_size, after)
        keys = [tuple(x) for x in rows.select(*catalog.ORDER).collect()]
        more = len(keys) == page_size and bool(catalog.page(cards, 1, keys[-1]).count())
        return rows, catalog.encode_cursor(scope, "browse", key, list(keys[-1])) if more else None

    def open(self, memory_id: str) -> dict:
        """A summary or entry with its sources' ids; an id in more than one tier is an error."""
        tiers = (("timeline", "source_id"), ("episodes", "summary_id"), ("semantics", "semantic_id"))
        found = [(t, r.asDict(True)) for t, k in tiers if self.store.generation(t) for r in self._scoped(t).where(F.col(k) == memory_id).limit(2).collect()]
        if len(found) > 1:
            raise ValueError("ambiguous_memory_id")
        if not found:
            raise KeyError(memory_id)
        tier, row = found[0]
        return row | {"tier": tier, "children": row.get("source_ids") or row.get("source_summary_ids") or []}

    def read_entry(self, source_id: str) -> dict:
        """One entry of this namespace; one of another namespace is an error, an unknown one too."""
        n = self.namespace
        rows = self.store.read("timeline").where(F.col("source_id") == source_id).limit(1).collect()
        if not rows:
            raise KeyError(source_id)
        if (rows[0].tenant_id, rows[0].user_id, rows[0].domain_id) != (n.tenant_id, n.user_id, n.domain_id):
            raise PermissionError("owned_by_another_namespace")
        return rows[0].asDict(True)

    def open_many(self, memory_ids: list[str]) -> list[dict]:
        """Each id in order with its record or why there is none, by one join a tier."""
        wanted = scans.ids(self.spark, memory_ids)
        found: dict[str, list[dict]] = {}
        for tier, key in (("timeline", "source_id"), ("episodes", "summary_id"), ("semantics", "semantic_id")):
            if self.store.generation(tier):
                for r in self._scoped(tier).join(F.broadcast(wanted.select(F.col("id").alias(key))), key).collect():
                    found.setdefault(r[key], []).append(r.asDict(True) | {"tier": tier})
        state = lambda rows: "not_found" if not rows else "ambiguous_memory_id" if len(rows) > 1 else "ok"
        return [{"memory_id": i, "status": state(found.get(i, [])), "record": found[i][0] if len(found.get(i, [])) == 1 else None} for i in [r.id for r in wanted.orderBy("pos").collect()]]

    def open_sources(self, memory_ids: list[str], page_size: int = 50, tokens: int = 0, size: int = 0, speakers: list[str] | None = None, after: dict[str, int] | None = None) -> dict:
        """What summaries stand for, a page of each in turn under a shared budget: an episode's turns, a semantic
        summary's episodes. ``after`` says how many units of each were read; the answer's ``next`` goes there.
        """
        opened, trees, after = self.open_many(memory_ids), [], after or {}
        for node in opened:
            tree = navigation.Tree(node["memory_id"], [], error="" if node["status"] == "ok" else node["status"])
            if node["status"] == "ok" and node["record"]["tier"] == "timeline":
                tree.error = "entry_has_no_sources"
            trees.append(tree)
        ids = {n["memory_id"]: n["record"] for n in opened if n["status"] == "ok"}
        links = [(k, c) for k, r in ids.items() for c in r.get("source_ids") or r.get("source_summary_ids") or []]
        if links:
            edges = self.spark.createDataFrame(links, "memory_id string, id string")
            entries = self._scoped("timeline").withColumn("unit", tl.group_key())
            if speakers:
                entries, _ = navigation.speaker_excerpts(entries, speakers)
            rows = edges.join(entries.select(F.col("source_id").alias("id"), "unit", "seq_no", "timestamp", "role", "content"), "id")
            line = F.concat("role", F.lit(": "), F.coalesce("content", F.lit("")))
            units = rows.groupBy("memory_id", "unit").agg(F.min("timestamp").alias("at"), F.min("seq_no").alias("seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
            if self.store.generation("episodes"):
                cards = edges.join(self._scoped("episodes").select(F.col("summary_id").alias("id"), F.col("period_start_ts").alias("at"), "summary"), "id")
                units = units.unionByName(cards.select("memory_id", F.col("id").alias("unit"), "at", F.lit(0).cast("long").alias("seq"), F.col("summary").alias("text")))
            # A page's worth of each tree beyond what was read.
            rank = F.row_number().over(Window.partitionBy("memory_id").orderBy("at", "seq", "unit"))
            first = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for t in trees for x in (t.memory_id, int(after.get(t.memory_id, 0)))]), "memory_id"), F.lit(0))
            page = units.withColumn("n", rank).where((F.col("n") > first) & (F.col("n") <= first + page_size + 1)).orderBy("memory_id", "n").collect()
            for tree in trees:
                tree.units = [(r.unit, r.text) for r in page if r.memory_id == tree.memory_id]
        compose = lambda ts: "\n".join(f"[{t.memory_id}]\n" + "\n".join(x for _, x in t.chosen) for t in ts if t.chosen)
        out = navigation.source_page(trees, page_size, tokens, size, lambda t: max(1, (len(t.encode()) + 3) // 4), compose)
        if out["status"] == "ok":
            out["next"] = {t.memory_id: int(after.get(t.memory_id, 0)) + len(t.chosen) for t in trees if not t.error and len(t.chosen) < len(t.units)}
        return out

    def read_timeline(self, selector: dict | None = None, anchor: str | None = None, turns: int = 2, budget: int = 4000) -> DataFrame:
        """Whole turns in pages of at most ``budget`` tokens, of a time range or around an entry."""
        rows = self._scoped("timeline", cross=self.namespace.conversation_id is None)
        if anchor:
            rows = tl.anchor_window(rows, self.spark.createDataFrame([(anchor,)], "anchor string"), turns).drop("anchor", "turn", "turn_rank", "distance")
        elif selector:
            rows = rows.where(time_range(selector, self.timezone).predicate(F.col("timestamp"), self.timezone))
        units = tl.turns(rows).withColumn("tokens", F.col("tokens").cast("long"))
        paged = tl.pages(units, budget, ["conversation_id"], ["first_seq", "turn"])
        return paged.join(units.select("conversation_id", "first_seq", "turn", "source_ids", "start_ts"), ["conversation_id", "first_seq", "turn"]).orderBy("start_ts", "conversation_id", "first_seq")

    def live(self) -> DataFrame:
        """Entries that no episode has taken up: what is summarised follows from the episodes, no row is changed."""
        rows = self._scoped("timeline", cross=self.namespace.conversation_id is None)
        if not self.store.generation("episodes"):
            return rows
        return rows.join(self._scoped("episodes").select(F.explode("source_ids").alias("source_id")), "source_id", "left_anti")

    def build_context(self, episodes: int = 8, semantics: int = 4) -> dict[str, DataFrame]:
        """The three tiers as a prompt shows them: the newest semantic summaries and pending episodes, and live entries."""
        out = {"entries": self.live().orderBy("conversation_id", "seq_no")}
        if self.store.generation("episodes"):
            rows = self._scoped("episodes")
            if self.store.generation("semantics"):
                taken = self._scoped("semantics").select(F.explode("source_summary_ids").alias("summary_id"))
                rows = rows.join(taken, "summary_id", "left_anti")
                out["semantics"] = self._scoped("semantics").orderBy(F.desc("timestamp"), "semantic_id").limit(semantics)
            out["episodes"] = rows.orderBy(F.desc("timestamp"), "summary_id").limit(episodes)
        return out

    def run_due(self, trigger: int, summariser, ratio: float = 0.7, keep_recent: int = 2, attempts: int = 2) -> dict:
        """Fold the due prefix of every conversation into episodes, in one commit on the generation that was planned on.

        Another writer's commit in between makes the plan stale: it is made anew, ``attempts`` times in all. A prefix
        whose summariser fails stays as it is. The plan's turns and the episodes' sources are the same rows.
        """
        for _ in range(attempts):
            base, seen = self.store.generation("episodes"), self.store.generation("timeline")
            rows = self.live()
            bundles = compaction.prefix(compaction.bundles(tl.turns(rows)), trigger, ratio, keep_recent).where("chosen")
            keys = ["tenant_id", "user_id", "domain_id", "conversation_id"]
            taken = rows.join(bundles.groupBy(*keys).agg(F.max("last_seq").alias("upto")), keys).where("seq_no <= upto")
            line = F.concat("role", F.lit(": "), F.coalesce("content", F.lit("")))
            batch = taken.groupBy(*keys).agg(F.min("timestamp").alias("period_start_ts"), F.max("timestamp").alias("period_end_ts"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_entries"), F.array_sort(F.collect_list(F.struct("seq_no", "source_id", line.alias("line"), "role"))).alias("r"))
            batch = batch.withColumns({"source_ids": F.transform("r", lambda x: x["source_id"]), "lines": F.transform("r", lambda x: x["line"]), "participants": F.array_distinct(F.transform("r", lambda x: x["role"])), "timestamp": F.col("period_end_ts")})
            batch = batch.withColumn("summary_id", navigation.stable_ids("summary", [F.col(k) for k in keys], F.col("source_ids"), 1, "episode"))
            made = batch.join(compaction.summarise(batch, "summary_id", "lines", summariser), "summary_id").where("summary is not null").drop("r", "lines")
            if not made.limit(1).count():
                return {"status": "nothing_due", "generation": base}
            if self.store.generation("timeline") != seen:
                continue
            try:
                return {"status": "compacted", "generation": self.store.commit("episodes", made, base)}
            except CommitConflict:
                continue
        return {"status": "conflict", "generation": self.store.generation("episodes")}

    def repair(self, summariser, now: int, trigger: int = 10, batch: int = 5) -> dict:
        """Bring this owner's semantic summaries back to contiguous runs of episodes, in one commit with a journal entry.

        The plan is made of ids alone and tells what it found; nothing is written unless it is ready and every group
        has a text. The commit holds only on the generation that was planned on.
        """
        base, n = self.store.generation("semantics"), self.namespace
        mine = self._scoped("episodes").select("summary_id", "timestamp", "source_ids", "summary")
        old = [r.asDict(True) for r in self._scoped("semantics").collect()]
        held = {i for r in old for i in r["source_summary_ids"]}
        episodes = [r.asDict(True) | {"is_semanticized": r.summary_id in held} for r in mine.drop("summary").collect()]
        ids = self.spark.createDataFrame([(i,) for i in sorted({i for e in episodes for i in e["source_ids"]})], "source_id string")
        raw = {r.source_id for r in self._scoped("timeline").join(F.broadcast(ids), "source_id", "left_semi").select("source_id").collect()}
        plan = compaction.repair_plan(episodes, old, raw, base, trigger, batch)
        if plan["status"] != "ready":
            return plan
        span = mine.join(F.broadcast(self.spark.createDataFrame([(g, i, p) for g, ids in zip(plan["new_ids"], plan["groups"], strict=True) for p, i in enumerate(ids)], "semantic_id string, summary_id string, place int")), "summary_id") if plan["groups"] else None
        table = self.store.read("semantics", base)
        kept = table.where(~F.col("semantic_id").isin(plan["affected"]))
        if span is not None:
            rows = span.groupBy("semantic_id").agg(F.max("timestamp").alias("timestamp"), F.array_sort(F.collect_list(F.struct("place", "summary_id", "summary"))).alias("r"))
            rows = rows.withColumns({"source_summary_ids": F.transform("r", lambda x: x["summary_id"]), "lines": F.transform("r", lambda x: x["summary"])})
            made = rows.join(compaction.summarise(rows, "semantic_id", "lines", summariser), "semantic_id").where("summary is not null")
            if made.count() < len(plan["groups"]):
                return plan | {"status": "unavailable", "reason": "summariser_failed"}
            stamped = made.drop("r", "lines").withColumns({"tenant_id": F.lit(n.tenant_id), "user_id": F.lit(n.user_id), "domain_id": F.lit(n.domain_id)})
            kept = kept.unionByName(stamped, allowMissingColumns=True)
        try:
            generation = self.store.commit("semantics", kept, base, replace=True)
        except CommitConflict:
            return plan | {"status": "conflict"}
        gone = [r for r in old if r["semantic_id"] in plan["affected"]]
        self._journal(plan["repair_id"], now, "applied", plan["replacements"], base, plan["new_ids"])
        return plan | {"generation": generation, "removed": [r["semantic_id"] for r in gone]}

    def _journal(self, repair_id: str, now: int, status: str, replacements: dict, base: int, made: list[str]) -> None:
        n = self.namespace
        row = [(n.tenant_id, n.user_id, n.domain_id, repair_id, now, status, replacements, base, made)]
        self.store.commit("repairs", self.spark.createDataFrame(row, "tenant_id string, user_id string, domain_id string, repair_id string, applied_at long, status string, replacements map<string,array<string>>, base long, made array<string>"))

    def rollback(self, repair_id: str, now: int) -> int:
        """Undo a repair: its rows go, those of the generation that it was made on come back; the new generation."""
        rows = self._scoped("repairs").where(F.col("repair_id") == repair_id).collect()
        if not rows or any(r.status == "rolled_back" for r in rows):
            raise KeyError(repair_id)
        entry, base = rows[0], self.store.generation("semantics")
        n = self.namespace
        before = self.store.read("semantics", entry.base, (n.tenant_id, n.user_id, n.domain_id)).where(F.col("semantic_id").isin(list(entry.replacements)))
        after = self.store.read("semantics", base).where(~F.col("semantic_id").isin(entry.made))
        generation = self.store.commit("semantics", after.unionByName(before, allowMissingColumns=True), base, replace=True)
        self._journal(repair_id, now, "rolled_back", entry.replacements, base, entry.made)
        return generation

    def replacements(self, ids: list[str]) -> dict[str, list[str]]:
        """What stands for these memories after the repairs that hold."""
        wanted = scans.ids(self.spark, ids).select("id")
        if not self.store.generation("repairs"):
            return {i: [i] for i in ids}
        journal = self._scoped("repairs")
        undone = journal.where("status = 'rolled_back'").select("repair_id")
        return {r.id: r.replacements for r in navigation.replaced(wanted, journal.where("status = 'applied'").join(undone, "repair_id", "left_anti")).collect()}

    def embedding_status(self) -> dict:
        return {"provider": "hashed", "dimension": embedding.DIMENSION, "degraded": False}

    def compaction_plan(self, trigger: int, ratio: float = 0.7, keep_recent: int = 2) -> DataFrame:
        return compaction.prefix(compaction.bundles(tl.turns(self._scoped("timeline"))), trigger, ratio, keep_recent)

    def forget(self) -> dict[str, int]:
        """Remove the namespace from every table, older versions included; the new generations."""
        n = self.namespace
        gone = filters.scope(n.tenant_id, n.user_id, n.domain_id, n.conversation_id)
        return {t: self.store.forget(t, gone) for t in ("timeline", "episodes", "semantics") if self.store.generation(t) and (n.conversation_id is None or "conversation_id" in self.store.read(t).columns)}
