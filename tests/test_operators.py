import json
import math

import pytest
from pyspark.sql import functions as F

from chronofold.operators import catalog, compaction, guards, intervals, ledger, lineage, navigation, projection, retrieval, scans, settlement, upkeep
from chronofold.operators import timeline as tl
from chronofold.plans import filters
from chronofold.sources import adapters, writers


def match(meta, where):
    """The filter rules, written out on a plain dict."""

    def field(v, cond):
        if not isinstance(cond, dict):
            return v == cond
        for op, x in cond.items():
            if op in ("$gt", "$gte", "$lt", "$lte"):
                if v is None or isinstance(v, str) != isinstance(x, str) or isinstance(v, list):
                    return False
                if not {"$gt": v > x, "$gte": v >= x, "$lt": v < x, "$lte": v <= x}[op]:
                    return False
            elif op in ("$in", "$nin"):
                inside = any(i in x for i in v) if isinstance(v, list) else v in x
                if inside != (op == "$in"):
                    return False
            elif op == "$eq":
                if v != x:
                    return False
            elif op == "$ne":
                if v == x:
                    return False
            else:
                return False
        return True

    for k, c in where.items():
        if k == "$and":
            if not isinstance(c, list) or not all(isinstance(i, dict) and match(meta, i) for i in c):
                return False
        elif k == "$or":
            if not isinstance(c, list) or not any(isinstance(i, dict) and match(meta, i) for i in c):
                return False
        elif not field(meta.get(k), c):
            return False
    return True


WHERES = [
    {}, {"s": "a"}, {"s": None}, {"n": 2}, {"n": "2"}, {"missing": None}, {"missing": 1}, {"s": {"$ne": "a"}}, {"s": {"$nin": ["a"]}}, {"s": {"$in": ["a", "b"]}}, {"s": {"$in": []}}, {"s": {"$in": [None, "b"]}},
    {"n": {"$gte": 2}}, {"n": {"$lt": 3, "$gt": 1}}, {"n": {"$gt": "x"}}, {"s": {"$gt": "a"}}, {"missing": {"$lte": 1}}, {"missing": {"$ne": 1}}, {"l": {"$in": ["x"]}}, {"l": {"$nin": ["x"]}}, {"l": {"$in": ["q", 5]}}, {"l": "x"},
    {"$and": []}, {"$or": []}, {"$and": "x"}, {"$or": {"s": "a"}}, {"$or": [{"s": "a"}, {"n": 3}]}, {"$and": [{"s": "a"}, {"$or": [{"n": 1}, {"n": 2}]}]}, {"s": {"$like": "a"}}, {"$and": [1]}, {"$or": [1, {"s": "a"}]}, {"s": {"$eq": "a", "$ne": "b"}}, {"s": {"$nin": [None]}},
]


@pytest.mark.parametrize("where", WHERES, ids=str)
def test_filters_follow_the_rules(spark, where):
    rows = [(0, "a", 1, ["x"]), (1, "b", 2, ["y", "x"]), (2, None, 3, []), (3, "a", None, None), (4, "c", 2, ["z"])]
    df = spark.createDataFrame(rows, "id int, s string, n int, l array<string>")
    want = [r[0] for r in rows if match(dict(zip(("s", "n", "l"), r[1:], strict=True)), where)]
    # A null list is a missing field to both.
    assert [r.id for r in filters.where(df, where).orderBy("id").collect()] == want


def test_filter_reaches_the_scan(spark, sf_dir):
    df = filters.where(spark.read.parquet(f"{sf_dir}/documents.parquet"), {"lang": "en", "n_chars": {"$lt": 500}}).select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThan(n_chars,500)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_kinds_and_admission(spark):
    rows = [("event.click", "", "explicit"), ("event", "", "default"), ("events.x", "", "default"), ("tool.a.call", "action", "default"), ("tool.b.result", "observation", "never")]
    df = spark.createDataFrame(rows, "kind string, turn_role string, visibility string")
    assert [r.kind for r in df.where(filters.kind_matches(F.col("kind"), "event.*")).collect()] == ["event.click", "event"]
    c = F.col("visibility"), F.col("kind"), F.col("turn_role")
    assert [r.kind for r in df.where(filters.admitted(*c)).collect()] == ["event", "events.x"]
    assert [r.kind for r in df.where(filters.admitted(*c, ["tool.*", "event.click"])).collect()] == ["event.click", "event", "events.x", "tool.a.call"]


def bm25(docs, terms):
    n, avg = len(docs), sum(len(d.split()) for d in docs.values()) / len(docs)
    out = {}
    for k, d in docs.items():
        w, s = d.split(), 0.0
        for t, weight in terms.items():
            df = sum(t in x.split() for x in docs.values())
            if tf := w.count(t):
                s += weight * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avg))
        if s > 0:
            out[k] = round(s, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


DOCS = {1: "red apple pie", 2: "green apple", 3: "slow red train to town", 4: "nothing here", 5: "apple apple apple", 6: ""}


def test_bm25(spark):
    df = spark.createDataFrame(list(DOCS.items()), "source_id long, t string")
    terms = retrieval.query_terms("red apple", ["Apple"], ["town"])
    assert terms == {"red": 1, "apple": 4, "town": 1}
    assert [tuple(r) for r in retrieval.bm25_topk(df, "t", terms, 10).collect()] == bm25(DOCS, terms)
    assert retrieval.bm25_topk(df, "t", {}, 10).count() == 0
    # Statistics are those of the filtered rows.
    some = {k: v for k, v in DOCS.items() if k != 5}
    assert [tuple(r) for r in retrieval.bm25_topk(df.where("source_id <> 5"), "t", terms, 10).collect()] == bm25(some, terms)
    q = spark.createDataFrame([(7, "red", 1), (7, "apple", 4), (7, "town", 1), (8, "slow", 1)], "query_id long, term string, weight int")
    got = retrieval.bm25_batch(df, "t", q, 3).orderBy("query_id", "rank").collect()
    assert [(r.source_id, r.tag_score) for r in got if r.query_id == 7] == bm25(DOCS, terms)[:3] and [r.source_id for r in got if r.query_id == 8] == [3]


def test_dense_fusion_and_merging(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, [-1.0, 0.0])], "source_id long, v array<float>")
    dense = retrieval.dense_topk(df, "v", [1.0, 0.0], 10)
    assert [tuple(r) for r in dense.collect()] == [(1, 1.0), (3, 0.707107)]
    kw = spark.createDataFrame([(3, 5.0), (9, 2.0)], "source_id long, tag_score double")
    got = retrieval.rrf(dense, kw).collect()
    assert [r.source_id for r in got] == [3, 1, 9] and got[0].dual_hit and got[0].rrf_score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    raw, derived = (spark.createDataFrame(r, "source_id long, score double") for r in ([(1, 0.1), (2, 0.2)], [(8, 0.9), (9, 0.8)]))
    assert [r.source_id for r in retrieval.raw_first(raw, derived, 3, "score").orderBy("place").collect()] == [2, 1, 8]
    assert retrieval.relaxed(raw, F.col("source_id") == 1).count() == 1 and retrieval.relaxed(raw, F.col("source_id") == 7).where("relaxed").count() == 2
    s = spark.createDataFrame([(1.0,), (0.2,), (0.0,), (None,), (float("nan"),), (float("inf"),)], "s double")
    assert tuple(retrieval.score_filter(s, "s", 0.5).first()) == (1, 1, 4)
    d = spark.createDataFrame([(1, 1.0, 0), (2, 0.6, 86400)], "id long, imp double, ts long")
    assert [r.id for r in retrieval.decayed(d, "imp", "ts", 86400, 1.0, 5, "id").collect()] == [2, 1]


def test_result_budget():
    fits = lambda m, b: retrieval.fits_budget(m, b, len)
    assert fits([("a", "xxxx"), ("b", "xxxxxxxx"), ("c", "xx")], 6) == [("a", "xxxx", False), ("c", "xx", False)]
    assert fits([("a", "x" * 10), ("b", "y")], 4) == [("a", "xxxx", True)]


def timeline_rows(spark):
    rows = [("", "u", "", "c1", f"s{i}", i, 1000 + i, "message", turn, role, tokens) for i, (turn, role, tokens) in enumerate([("t1", "stimulus", 5), ("t2", "stimulus", 4), ("t1", "final", 5), ("t2", "final", 3), ("", "", 20), ("t3", "stimulus", 1)], 1)]
    return spark.createDataFrame(rows, "tenant_id string, user_id string, domain_id string, conversation_id string, source_id string, seq_no long, timestamp long, kind string, turn_id string, turn_role string, tokens long")


def test_turns_windows_and_pages(spark):
    t = timeline_rows(spark)
    turns = {r.turn[:6]: r for r in tl.turns(t).collect()}
    assert turns["t1"].source_ids == ["s1", "s3"] and turns["t1"].terminal and not turns["t3"].terminal and "legacy" in turns
    near = tl.anchor_window(t, spark.createDataFrame([("s2",)], "anchor string"), 1).orderBy("turn_rank", "seq_no").collect()
    assert [r.source_id for r in near] == ["s1", "s3", "s2", "s4", "s5"]
    pages = tl.pages(tl.turns(t), 18, ["conversation_id"], ["first_seq"]).orderBy("first_seq").collect()
    assert [(r.page, r.oversized) for r in pages] == [(1, False), (1, False), (2, True), (3, False)]
    new = t.limit(2).drop("seq_no").withColumn("source_id", F.concat(F.lit("n"), "source_id"))
    assert sorted(r.seq_no for r in tl.sequence_numbers(new, t).collect()) == [7, 8]
    m = spark.createDataFrame([("k", 1, 1), ("k", 2, 1), ("k", 3, -1), ("k", 4, -1)], "k string, position int, delta int")
    assert [r.safe_cut for r in tl.paired_boundary(m, ["k"]).orderBy("position").collect()] == [False, False, False, True]


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 7, 9), ("a", 8, 8), ("b", 0, 1)], "k string, s int, e int")
    assert sorted(tuple(r) for r in intervals.merged(df, ["k"], "s", "e").collect()) == [("a", 1, 5, 2), ("a", 7, 9, 1), ("b", 0, 1, 1)]
    c = intervals.components(df, ["k"], "s", "e").orderBy("k", "s").collect()
    assert [r.component for r in c] == [1, 1, 2, 2, 1]


def tiers(spark):
    e = spark.createDataFrame([("e1", ["r1", "r2"]), ("e2", ["r3", "gone"]), ("e3", [])], "summary_id string, source_ids array<string>")
    s = spark.createDataFrame([("m1", ["e1", "e2"])], "semantic_id string, source_summary_ids array<string>")
    return e, s, lineage.edges(e, s)


def test_lineage(spark):
    e, s, g = tiers(spark)
    down = lineage.descendants(spark.createDataFrame([("m1",)], "root string"), g)
    assert [r.id for r in down.orderBy("path").collect()] == ["m1", "e1", "r1", "r2", "e2", "r3", "gone"]
    up = lineage.ancestors(spark.createDataFrame([("r1",)], "start string"), g)
    assert {(r.id, r.depth) for r in up.collect()} == {("r1", 0), ("e1", 1), ("m1", 2)}
    out = lineage.visible_exclusion(spark.createDataFrame([("e1",)], "start string"), g)
    assert {r.id for r in out.collect()} == {"e1", "m1"}
    loop = spark.createDataFrame([("a", 0, "b"), ("b", 0, "a")], "parent string, pos int, child string")
    assert [(r.id, r.cycle) for r in lineage.descendants(spark.createDataFrame([("a",)], "root string"), loop, 5).orderBy("depth").collect()] == [("a", False), ("b", False), ("a", True)]
    hits = spark.createDataFrame([("e1",), ("e2",)], "source_id string")
    assert [r.source_id for r in lineage.drop_covered(hits, spark.createDataFrame([("r3",)], "source_id string"), g).collect()] == ["e1"]
    scoped = e.withColumns({c: F.lit("") for c in ("tenant_id", "user_id", "domain_id")})
    raw = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "source_id string").withColumns({c: F.lit("") for c in ("tenant_id", "user_id", "domain_id")})
    assert {r.summary_id: r.lineage_status for r in lineage.validity(scoped, raw).collect()} == {"e1": "valid", "e2": "invalid", "e3": "invalid"}


def test_branches_and_pending(spark):
    rows = [("t", "c1", "action", None), ("t", "c1", "observation", "pending"), ("t", "c2", "action", None), ("t", "c2", "observation", "success"), ("t", "c3", "observation", "success")]
    df = spark.createDataFrame(rows, "turn_id string, correlation_id string, turn_role string, status string")
    assert {r.correlation_id: r.complete for r in lineage.branches(df).collect()} == {"c1": False, "c2": True, "c3": False}
    assert [r.correlation_id for r in tl.pending_calls(df).collect()] == ["c1"]


def test_catalogue_pages_and_cursors(spark):
    rows = [(f"m{i:02d}", "summary", i // 3, i // 3 + 1) for i in range(23)]
    cards = spark.createDataFrame(rows, "memory_id string, node_type string, period_start_ts long, period_end_ts long")
    seen, after = [], None
    while batch := catalog.page(cards, 5, after).select(*catalog.ORDER).collect():
        seen += [r.memory_id for r in batch]
        after = tuple(batch[-1])
    assert seen == [r[0] for r in rows]
    assert catalog.browse(cards, 3, 4).count() == 6
    cursor = catalog.encode_cursor(["", "u", ""], "browse", {"a": 1}, [1, 2, "summary", "m"])
    assert catalog.decode_cursor(cursor, ["", "u", ""], "browse", {"a": 1}) == [1, 2, "summary", "m"]
    with pytest.raises(ValueError, match="scope"):
        catalog.decode_cursor(cursor, ["", "v", ""], "browse", {"a": 1})
    with pytest.raises(ValueError, match="invalid"):
        catalog.decode_cursor(cursor[:-6] + "AAAA==", ["", "u", ""], "browse", {"a": 1})
    refs = spark.createDataFrame([("k", "id:1", "Ann", 1, 1), ("k", "id:2", "Bob", 2, 2), ("k", "id:1", " ", 3, 3), ("k", "id:1", "Anna", 2, 4)], "k string, actor_id string, display_name string, timestamp long, seq_no long")
    r = catalog.participant_refs(refs, ["k"])
    assert [tuple(x) for x in r.first().refs] == [("id:1", "Anna"), ("id:2", "Bob")]
    hit = lambda sel, every=False: r.where(catalog.participant_match(F.col("refs"), sel, every)).count()
    assert (hit(["anna"]), hit(["ann"]), hit(["id:2", "x"]), hit(["id:2", "x"], True), hit(["ID:2"])) == (1, 0, 1, 0, 0)


def test_settlement(spark):
    df = spark.createDataFrame([(1, ""), (2, "short"), (3, "x" * 300), (4, "y" * 3000), (5, " \n")], "id int, t string")
    card = settlement.card(F.lit("search"), F.lit("c1"), F.concat(F.lit("s"), "id"), F.col("t"), F.lit("ok"))
    rows = {r.id: r for r in settlement.classified(df, "t", card).collect()}
    assert [rows[i].projection for i in range(1, 6)] == ["explicit_empty", "inline_full", "compact_reloadable", "compact_reloadable", "explicit_empty"]
    assert rows[4].projected == "[compact_reloadable]\ntool: search\ncall_id: c1\nstatus: ok\nsource_id: s4\nstored_chars: 3000"
    assert all(len(r.projected) <= len(r.t) for r in rows.values())


def test_compaction(spark):
    b = compaction.bundles(tl.turns(timeline_rows(spark)))
    assert sorted((r.first_seq, r.n_turns, r.tokens) for r in b.collect()) == [(1, 2, 17), (5, 1, 20), (6, 1, 1)]
    done = b.withColumn("terminal", F.lit(True))
    assert [r.chosen for r in compaction.prefix(done, 20, 0.8, 1).orderBy("first_seq").collect()] == [True, False, False]
    assert [r.chosen for r in compaction.prefix(done, 20, 1.0, 1).orderBy("first_seq").collect()] == [True, True, False]
    assert not any(r.chosen for r in compaction.prefix(b.withColumn("terminal", F.lit(False)), 1, 1.0, 0).collect())
    failing = compaction.summarise(spark.createDataFrame([(1, ["a", "b"]), (2, ["bad"])], "k long, ts array<string>"), "k", "ts", lambda ts: "+".join(ts) if "bad" not in ts else 1 / 0)
    assert {r.k: r.summary for r in failing.collect()} == {1: "a+b", 2: None}


def history(n, groups, **changed):
    eps = [{"summary_id": f"e{i:02d}", "timestamp": i, "source_ids": [f"r{i}"], "is_semanticized": any(i in g for g in groups.values())} for i in range(n)]
    for e in eps:
        e.update(changed.get(e["summary_id"], {}))
    return eps, [{"semantic_id": k, "source_summary_ids": [f"e{i:02d}" for i in g]} for k, g in groups.items()]


def test_repair_plan():
    raw = {f"r{i}" for i in range(40)}
    plan = lambda *a, **k: compaction.repair_plan(*history(*a, **k), raw, 3, trigger=4, batch=2)
    assert plan(6, {"a": [0, 1], "b": [2, 3]})["status"] == "clean"
    # A hole in b: everything from its first episode on is regrouped while four remain, and a row that reaches over the cut too.
    hole = plan(9, {"a": [0, 1], "b": [2, 4]})
    assert (hole["status"], hole["problems"], hole["groups"], hole["pending"]) == ("ready", ["b"], [["e02", "e03"], ["e04", "e05"]], ["e06", "e07", "e08"])
    assert hole["replacements"] == {"b": hole["new_ids"]} and hole["affected"] == ["b"]
    across = plan(9, {"a": [0, 1, 2, 3], "b": [3, 4]})
    assert across["problems"] == ["a", "b"] and across["groups"][0] == ["e00", "e01"]
    # Pending episodes before the defect are taken in; a row that says it is summarised but is not is a defect.
    pending = plan(9, {"b": [4, 6]})
    assert pending["groups"][0] == ["e00", "e01"]
    assert plan(6, {"a": [0, 1]}, e03={"is_semanticized": True})["status"] == "ready" and plan(6, {"a": [0, 1]}, e00={"semantic_id": "other"})["problems"] == ["a"]
    again = history(6, {"a": [0, 1]})
    again[1][0]["reinforcement_count"] = 2
    assert compaction.repair_plan(*again, raw, 3)["problems"] == ["a"]
    # Nothing is lost: missing sources make a repair unavailable.
    assert plan(3, {"a": [0, 1, 7]})["missing"] == ["e07"] and plan(3, {"a": []})["reason"] == "missing_episode_sources"
    assert compaction.repair_plan(*history(9, {"b": [2, 4]}), raw - {"r5"}, 3)["reason"] == "missing_raw_sources"
    assert plan(9, {"a": [0, 1], "b": [2, 4]})["repair_id"] == hole["repair_id"]


def compose(trees):
    return "|".join(f"{t.memory_id}:" + ",".join(text for _, text in t.chosen) for t in trees)


def test_sources_of_several_trees_share_a_page():
    trees = lambda: [navigation.Tree("a", [(f"a{i}", "x" * 10) for i in range(5)]), navigation.Tree("b", [("b0", "y" * 10), ("b1", "z" * 500)]), navigation.Tree("c", [])]
    whole = navigation.source_page(trees(), 50, 0, 0, len, compose)
    assert whole["units"] == {"a": [f"a{i}" for i in range(5)], "b": ["b0", "b1"], "c": []} and not whole["more"]
    some = navigation.source_page(trees(), 50, 60, 0, len, compose)
    assert some["units"] == {"a": ["a0", "a1", "a2"], "b": ["b0"], "c": []} and some["more"] == {"a": 2, "b": 1} and some["tokens"] <= 60
    small = navigation.source_page(trees(), 2, 0, 200, len, compose)
    assert small["units"] == {"a": ["a0", "a1"], "b": ["b0"], "c": []} and len(small["text"].encode()) <= 200
    first = navigation.source_page([navigation.Tree("b", [("b1", "z" * 500)])], 5, 100, 0, len, compose)
    assert first["oversized"] and first["units"] == {"b": ["b1"]}
    large = navigation.source_page([navigation.Tree("b", [("b1", "z" * 500)])], 5, 0, 100, len, compose)
    assert large["errors"] == {"b": "source_unit_exceeds_byte_budget"} and large["units"] == {"b": []}
    assert navigation.source_page([navigation.Tree("m" * 50, [])], 5, 0, 10, len, compose)["status"] == "unavailable"
    with pytest.raises(ValueError):
        navigation.source_page([], 5, 0, 0, len, compose)


def test_keyword_pages_and_references():
    rows = [(f"s{i}", "w" * 9) for i in range(6)]
    page = navigation.keyword_page(rows, 0, 25, 0, len, "f")
    assert page["ids"] == ["s0", "s1"] and page["next"] == 2 and navigation.keyword_page(rows, 4, 0, 0, len, "f")["next"] is None
    assert navigation.keyword_page(rows, 0, 3, 0, len, "f") == {"status": "ok", "ids": ["s0"], "next": 1, "oversized": True}
    assert navigation.keyword_page(rows, 0, 0, 5, len, "f")["status"] == "unavailable" and navigation.keyword_page(rows, 0, 0, 0, len, "f", "g") == {"status": "restart_required"}
    ref = navigation.encode_ref(["", "u", ""], "m", {"keywords": ["ä"]}, "f")
    assert navigation.decode_ref(ref, ["", "u", ""], "f") == ("m", {"keywords": ["ä"]})
    for scope, f, error in ((["", "v", ""], "f", "scope"), (["", "u", ""], "g", "restart")):
        with pytest.raises(ValueError, match=error):
            navigation.decode_ref(ref, scope, f)
    with pytest.raises(ValueError, match="invalid"):
        navigation.decode_ref("A" + ref[1:], ["", "u", ""])


def test_previews_keep_the_original_text():
    assert navigation.preview("ＡＢＣ　Straße  here", ["STRASSE"]) == "ＡＢＣ　Straße  here"
    long = "x" * 60 + " needle " + "y" * 100
    assert navigation.preview(long, ["Needle"]) == "…" + long[41:121] + "…" and navigation.preview(None, ["a"]) == "" and navigation.preview("abc", ["zz"]) == "abc"


def test_settled_payloads():
    call = {"role": "assistant", "tool_calls": [{"id": "c1", "type": "function", "function": {"name": "f", "arguments": json.dumps({"q": "x" * 900, "n": 1})}}]}
    done, kinds = ledger.settled(call, ledger.OPENAI, {"c1": "arguments"}, {"c1": "s1"}, {})
    cut = json.loads(done["tool_calls"][0]["function"]["arguments"])
    assert kinds == {"c1": ledger.FOLDED} and cut["n"] == 1 and cut["q"].endswith("source_id=s1]") and len(call["tool_calls"][0]["function"]["arguments"]) > 900
    use = {"role": "assistant", "content": [{"type": "text", "text": "t"}, {"type": "tool_use", "id": "c1", "name": "f", "input": {"q": "x" * 900}}]}
    done, _ = ledger.settled(use, ledger.ANTHROPIC, {"c1": "arguments"}, {"c1": "s1"}, {})
    assert isinstance(done["content"][1]["input"], dict) and len(done["content"][1]["input"]["q"]) < 200
    text = {"role": "assistant", "content": "head\ndata:\n" + json.dumps({"input": {"q": "x" * 900}})}
    done, kinds = ledger.settled(text, ledger.CANONICAL, {"c1": "arguments"}, {"c1": "s1"}, {})
    assert kinds == {"c1": ledger.FOLDED} and done["content"].startswith("head\ndata:\n{")
    results = {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "a", "content": "r" * 900}, {"type": "tool_result", "tool_use_id": "b", "content": " "}]}
    done, kinds = ledger.settled(results, ledger.ANTHROPIC, {"a": "result", "b": "result"}, {}, {"a": "card"})
    assert kinds == {"a": ledger.FOLDED, "b": ledger.EMPTY} and done["content"][0]["content"] == "card" and done["content"][1]["content"] == " "
    signed = use | {"content": [*use["content"], {"type": "thinking", "signature": "z"}]}
    for payload, profile, calls, error in (
        (signed, ledger.ANTHROPIC, {"c1": "arguments"}, "signed"), (use, ledger.ANTHROPIC, {"c2": "arguments"}, "coverage"), (call, "other", {"c1": "arguments"}, "profile"),
        ({"role": "assistant", "tool_calls": [{"id": "c1", "function": {"arguments": "{"}}]}, ledger.OPENAI, {"c1": "arguments"}, "shape"),
    ):
        with pytest.raises(ledger.LedgerError, match=error):
            ledger.settled(payload, profile, calls, {}, {})
    anchor = ledger.retention_anchor(json.dumps({"api_key": "k", "big": "x" * 5000}))
    assert anchor["oversized"] and anchor["redacted"] and len(anchor["anchor"]["big"]) == 5000
    assert navigation.stable_id("summary", ["", "u"], ["a"], 1, "p") != navigation.stable_id("summary", ["", "u"], ["a"], 2, "p")


def test_ambiguous_and_foreign_ids_are_errors(spark):
    raw = spark.createDataFrame([("x", 1)], "source_id string, n int")
    low = spark.createDataFrame([("x", 2)], "summary_id string, n int")
    high = spark.createDataFrame([("z", 3)], "semantic_id string, n int")
    both = scans.tiers(raw, low, high, "n")
    assert scans.first_of_tiers(both).where("id = 'x'").first().n == 1
    with pytest.raises(Exception, match="ambiguous_memory_id"):
        scans.unambiguous(both).collect()
    with pytest.raises(Exception, match="owned by another"):
        scans.owned(raw, F.col("n") == 2, "x").collect()
    assert scans.owned(raw, F.col("n") == 1, "x").count() == 1
    with pytest.raises(Exception, match="unsupported_host_event"):
        raw.select(writers.host_event(F.lit("message.user"))).collect()
    with pytest.raises(ValueError):
        scans.turn_entries(raw, "t", roles=[])


def test_first_write_wins_and_assembly(spark):
    old = spark.createDataFrame([("t", 0, "a")], "turn string, position int, h string")
    new = spark.createDataFrame([("t", 0, "b"), ("t", 1, "c"), ("t", 1, "c")], "turn string, position int, h string")
    append, conflict = ledger.first_write_wins(old, new, ["turn", "position"])
    assert [(r.position, r.h) for r in append.collect()] == [(1, "c")] and [(r.position, r.h) for r in conflict.collect()] == [(0, "b")]
    row = lambda at, *r: spark.createDataFrame(r, f"k string, {at} long, id string, payload string")
    out = ledger.assembled(row("timestamp", ("k", 9, "s2", "p"), ("k", 1, "s1", "p")), row("timestamp", ("k", 5, "e1", "p")), row("position", ("k", 0, "t0", "p"), ("k", 1, "t1", "p")), ["k"])
    assert [r.id for r in out.orderBy("place").collect()] == ["s1", "s2", "e1", "t0", "t1"]

def test_projection(spark):
    rows = [(1, "s1", "hi", "user", "stimulus", None, None, None), (2, "s2", None, "assistant", "action", "c1", "find", "{}"), (3, "s3", None, "assistant", "action", "c2", "find", "{}"), (4, "s4", "r1", "environment", "observation", "c1", None, None), (5, "s5", "r2", "environment", "observation", "c2", None, None), (6, "s6", "done", "assistant", "final", None, None, None)]
    df = spark.createDataFrame(rows, "seq_no long, source_id string, text string, origin string, turn_role string, correlation_id string, tool_name string, arguments string").withColumn("k", F.lit("k"))
    n = {p: [r.source_ids for r in projection.project(df, p, ["k"], "seq_no").orderBy("position").collect()] for p in projection.PROFILES}
    assert n["openai_chat"] == [["s1"], ["s2", "s3"], ["s4"], ["s5"], ["s6"]] and n["anthropic_messages"] == [["s1"], ["s2", "s3"], ["s4", "s5"], ["s6"]] and len(n["openai_responses"]) == len(n["canonical_user_assistant"]) == 6
    first = projection.project(df, "openai_chat", ["k"], "seq_no").orderBy("position").collect()[1].payload
    assert '"tool_calls":[{"id":"c1"' in first
    with pytest.raises(ValueError):
        projection.project(df, "other", ["k"], "seq_no")
    base = spark.createDataFrame([("k", i, f"h{i}") for i in range(4)], "k string, position int, h string")
    status = lambda a, b: projection.frozen(a, b, ["k"]).first().status
    assert status(base, base) == "current" and status(base.where("position < 2"), base) == "append" and status(base, base.where("position < 2")) == "stale" and status(base.withColumn("h", F.lit("z")), base) == "stale"
    o = spark.createDataFrame([("k", 1, 2, "NEW"), ("k", 3, 9, "NO")], "k string, first int, last int, payload string")
    assert [(r.position, r.payload) for r in projection.overlaid(base.withColumnRenamed("h", "payload"), o, ["k"]).orderBy("position").collect()] == [(0, "h0"), (1, "NEW"), (3, "h3")]
    reg = projection.Renderers(F.lit("plain")).register("event.*", F.lit("event")).register("event.click.*", F.lit("clicks")).register("event.click.left", F.lit("left"))
    k = spark.createDataFrame([("event.x",), ("event.click.right",), ("event.click.left",), ("other.x",)], "kind string")
    assert [r[0] for r in k.select(reg.column(F.col("kind"))).collect()] == ["event", "clicks", "left", "plain"]


def test_wire_messages(spark):
    chat = '[{"role":"user","content":"hi"},{"role":"assistant","content":"","tool_calls":[{"id":"c1","type":"function","function":{"name":"f","arguments":"{}"}}]},{"role":"tool","tool_call_id":"c1","content":"out"}]'
    blocks = '[{"role":"user","content":"hi"},{"role":"assistant","content":[{"type":"text","text":"so"},{"type":"tool_use","id":"c1","name":"f","input":{"a":1}}]},{"role":"user","content":[{"type":"tool_result","tool_use_id":"c1","content":"out"}]}]'
    items = '[{"type":"message","role":"user","content":"hi"},{"type":"function_call","call_id":"c1","name":"f","arguments":"{}"},{"type":"function_call_output","call_id":"c1","output":"out"}]'
    for profile, raw, want in (("openai_chat", chat, ["message", "tool_call", "tool_result"]), ("anthropic_messages", blocks, ["message", "message", "tool_call", "tool_result"]), ("openai_responses", items, ["message", "tool_call", "tool_result"])):
        got = adapters.normalise_messages(spark.createDataFrame([(1, raw)], "id long, m string"), "m", profile).orderBy("position", "part").collect()
        assert [r.event for r in got] == want and got[-1].call_id == "c1" and got[-1].text == "out"


def test_legacy_roles(spark):
    roles = {"user": ("message.user", "stimulus"), "assistant.tool_call search c9": ("tool.search.call", "action"), "tool.search c9": ("tool.search.result", "observation"), "event.door_open": ("event.door_open", "stimulus"), "user.attachment pdf f1": ("material.reference", "stimulus")}
    df = spark.createDataFrame([(k,) for k in [*roles, "weird"]], "r string").select("r", adapters.legacy_role(F.col("r")).alias("x"))
    got = {r.r: r.x for r in df.collect()}
    assert all((got[k].kind, got[k].turn_role) == v for k, v in roles.items()) and got["weird"].kind.startswith("legacy.") and got["tool.search c9"].correlation_id == "c9"


def test_reindex_finds_what_fails(spark):
    records, seen = spark.range(300).selectExpr("concat('r', id) as id"), []

    def upsert(part):
        ids = [r.id for r in part.collect()]
        if {"r7", "r250"} & set(ids):
            raise RuntimeError
        seen.extend(ids)

    assert upkeep.reindexed(records, upsert) == ["r250", "r7"] and sorted(seen) == sorted(f"r{i}" for i in range(300) if i not in (7, 250))
    assert upkeep.reindexed(records.limit(0), upsert) == []


def test_request_ranges():
    m = lambda text: {"role": "user", "content": text}
    frozen = [(m("a"), ("s1",)), (m("b"), ("s2",))]
    sent = [(m("system"), ()), (m("old"), ("s0",)), (m("a"), ("s1",)), (m("note"), ()), (m("b"), ("s2",)), (m("new"), ("s3",))]
    none = lambda messages: 0
    assert upkeep.request_range(sent, frozen, none) == (2, 5)
    assert upkeep.request_range(sent, frozen, lambda messages: 1) is None and upkeep.request_range(sent[:4], frozen, none) is None and upkeep.request_range(sent, [], none) is None
    for changed in ([*sent[:2], (m("A"), ("s1",)), *sent[3:]], [*sent[:3], (m("x"), ("s9",)), *sent[4:]], [*sent[:2], (m("a"), ("s1", "s9")), *sent[3:]]):
        assert upkeep.request_range(changed, frozen, none) is None


def test_prompts():
    text = upkeep.prompt("episode", "a </material> b", {"language": "German"})
    assert text.count("</material>") == 1 and "language: German" in text
    for bad in ({"other": "x"}, {"language": "x" * 201}):
        with pytest.raises(ValueError):
            upkeep.prompt("semantic", "x", bad)


def test_hard_plans_are_checked():
    plan = guards.HardPlan(user_id="u", entities=(" a ", "a", "", "b"), kinds=("tool.*", "event.click"))
    assert plan.entities == ("a", "b") and plan.echo()["kinds"] == ["tool.*", "event.click"]
    assert guards.kind_pattern(" Tool.* ") == ("tool", True) and guards.kind_pattern("a.b") == ("a.b", False)
    for bad in ("tool", "*.a", "a.*.b", "a..b", ""):
        with pytest.raises(ValueError):
            guards.HardPlan(kinds=(bad,))
    for bad in ({"layers": ()}, {"layers": ("other",)}, {"limit": 0}, {"limit": 51}):
        with pytest.raises(ValueError):
            guards.HardPlan(**bad)
