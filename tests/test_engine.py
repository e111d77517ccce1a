import json
import os
import random
import time
import warnings
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronofold.api import Engine, Namespace
from chronofold.operators.index import TextIndex
from chronofold.plans import registry
from chronofold.session import Session
from chronofold.sources import adapters, migrations
from chronofold.sources.store import CommitConflict, LogStore
from chronofold.streaming import turns
from chronofold.tools import TOOLS, Dispatcher


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, sf_dir, oracle, name):
    got = registry.QUERIES[name](spark, sf_dir).toArrow()
    if name not in registry.ORACLE_SQL:
        assert got.num_rows >= 0
        return
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = oracle.execute(registry.ORACLE_SQL[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*[t[c].to_pylist() for c in cols], strict=True)))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(registry.QUERIES) <= set(entry.queries())


def test_store_commits(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    scope = {"tenant_id": "", "user_id": "u", "domain_id": "", "conversation_id": "c"}
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "source_id string").withColumns({k: F.lit(v) for k, v in scope.items()})
    assert store.append_new("t", rows("a", "b")) == 1 and store.append_new("t", rows("b", "c")) == 2
    assert sorted(r.source_id for r in store.read("t").collect()) == ["a", "b", "c"] and store.read("t", 1).count() == 2
    with pytest.raises(PermissionError):
        store.append_new("t", rows("a").withColumn("user_id", F.lit("other")))
    with pytest.raises(CommitConflict):
        store.commit("t", rows("z"), expected=1)
    assert store.read("t").count() == 3
    v = lambda i, x: spark.createDataFrame([(i, x)], "id string, x int")
    store.upsert("v", v("a", 1), "id"), store.upsert("v", v("a", 2), "id"), store.upsert("v", v("b", 5), "id")
    assert {(r.id, r.x, r.row_version) for r in store.current("v", "id").collect()} == {("a", 2, 2), ("b", 5, 1)}
    assert store.pending("t", "index").count() == 3
    store.commit("index", rows("a"))
    assert store.pending("t", "index").count() == 2
    store.forget("t", F.col("source_id") == "a")
    assert store.read("t").count() == 2


def test_forget_leaves_nothing(spark, tmp_path):
    """Neither old generations nor files keep what was forgotten; commits go on after it."""
    store = LogStore(spark, str(tmp_path))
    rows = lambda user, *ids: spark.createDataFrame([("", user, "", i, f"secret of {i}") for i in ids], "tenant_id string, user_id string, domain_id string, source_id string, text string")
    for i in range(20):
        store.commit("t", rows("u1" if i % 2 else "u2", f"s{i}"))
    assert store.read("t", 7).count() == 7 and store.read("t").count() == 20
    new = store.forget("t", F.col("user_id") == "u1")
    assert {r.user_id for r in store.read("t").collect()} == {"u2"} and store.read("t").count() == 10
    for generation in range(1, new):
        with pytest.raises(FileNotFoundError):
            store.read("t", generation)
    kept = [p for p in (tmp_path / "t").rglob("*.parquet")]
    assert kept and spark.read.parquet(*map(str, kept)).where("user_id = 'u1'").count() == 0
    assert store.commit("t", rows("u3", "z")) == new + 1 and store.read("t").count() == 11
    store._fs.mkdirs(store._path(f"{tmp_path}/t/commit=cabandoned"))
    assert store.sweep("t") == ["commit=cabandoned"] and store.read("t").count() == 11


def test_scoped_reads_prune_folders_and_manifests_are_created_once(spark, tmp_path):
    store = LogStore(spark, str(tmp_path))
    rows = spark.range(200).selectExpr("'' as tenant_id", "concat('u', id % 50) as user_id", "'' as domain_id", "id as source_id")
    store.commit("t", rows)
    one = store.read("t", scope=("", "u7", ""))
    assert one.count() == 4 and one.columns == rows.columns
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scope_bucket" in plan and "xxhash64" not in plan
    path = store._manifest("t", "000000000002.json")
    assert [store._create(path, "a"), store._create(path, "b")] == [True, False]
    with pytest.raises(CommitConflict):
        store.commit("t", rows, expected=1)


def test_engine_end_to_end(spark, sf_dir, tmp_path):
    t = adapters.timeline(spark, sf_dir)
    e = adapters.episodes(t)
    s = adapters.semantics(e, 2, 1)
    for user in ("u1", "u2"):
        engine = Engine(spark, str(tmp_path), Namespace(user_id=user), "Asia/Shanghai")
        engine.append(t.where(F.col("user_id") == user))
    engine.append(t.where(F.col("user_id") == "u2"))
    engine.store.commit("episodes", e)
    engine.store.commit("semantics", s)
    assert engine.store.read("timeline").count() == t.where("user_id in ('u1', 'u2')").count()
    word = t.where("user_id = 'u2'").select(F.explode(F.split("content", r"\W+")).alias("w")).where("length(w) > 5").first().w
    found = engine.retrieve(word, layers=("raw",))
    hits = [SimpleNamespace(**m) for m in found.matches]
    mine = {r.source_id for r in t.where("user_id = 'u2'").collect()}
    assert hits and {h.source_id for h in hits} <= mine
    # What is visible is not found again, nor is anything of another scope.
    seen = spark.createDataFrame([(h.source_id,) for h in hits], "start string")
    again = engine.retrieve(word, exclude_visible=seen)
    assert not {h.source_id for h in hits} & {m["source_id"] for m in again.matches}
    # Both layers: no summary of a raw hit, one match a turn, raw first, a budget that holds.
    both = engine.retrieve(word, entities=[word], limit=8, budget=120)
    children = {r.summary_id: set(r.source_ids) for r in e.collect()}
    raw = {m["source_id"] for m in both.matches if m["layer"] == "raw"}
    assert all(not children[m["source_id"]] & raw for m in both.matches if m["layer"] == "summary") and [m["layer"] for m in both.matches] == sorted(m["layer"] for m in both.matches)
    assert sum(max(1, (len(m["content"].encode()) + 3) // 4) for m in both.matches) <= 120 and both.relaxed["raw"] is False
    assert engine.retrieve(word, entities=["nosuchname"]).relaxed == {"raw": True, "summary": True}
    part = e.where("user_id = 'u2'").first()
    inside = engine.retrieve("the", within=part.summary_id, limit=50)
    assert {m["source_id"] for m in inside.matches} <= {*part.source_ids, part.summary_id}
    with pytest.raises(ValueError):
        engine.retrieve(" ")
    ids, cursor = [], None
    for _ in range(100):
        rows, cursor = engine.browse(page_size=3, cursor=cursor)
        ids += [r.memory_id for r in rows.collect()]
        if cursor is None:
            break
    want = e.where("user_id = 'u2'").count() + s.where("user_id = 'u2'").count()
    assert len(ids) == len(set(ids)) == want
    opened = engine.open(e.where("user_id = 'u2'").first().summary_id)
    assert opened["tier"] == "episodes" and opened["children"]
    with pytest.raises(KeyError):
        engine.open(e.where("user_id = 'u1'").first().summary_id)
    pages = engine.read_timeline(budget=300).collect()
    assert {x for p in pages for x in p.source_ids} == mine
    assert engine.read_timeline(anchor=sorted(mine)[0], turns=0).count() == 1
    assert engine.compaction_plan(50, keep_recent=0).count() > 0
    # Opening, sources in turn, tools and their receipts.
    top = s.where("user_id = 'u2'").first()
    opened = engine.open_many([part.summary_id, "nosuch", top.semantic_id, part.source_ids[0]])
    assert [(o["status"], o["record"] and o["record"]["tier"]) for o in opened] == [("ok", "episodes"), ("not_found", None), ("ok", "semantics"), ("ok", "timeline")]
    first = engine.open_sources([part.summary_id, top.semantic_id, "nosuch"], page_size=1)
    assert first["errors"] == {"nosuch": "not_found"} and first["units"][top.semantic_id] == [top.source_summary_ids[0]] and len(first["units"][part.summary_id]) == 1
    seen, after = [], {}
    for _ in range(20):
        page = engine.open_sources([part.summary_id], page_size=1, after=after)
        seen += page["units"][part.summary_id]
        after = page["next"]
        if not after:
            break
    assert len(seen) == len(set(seen)) == t.where(F.col("source_id").isin(part.source_ids)).select("turn_id").distinct().count()
    assert engine.read_entry(part.source_ids[0])["source_id"] == part.source_ids[0]
    theirs = t.where("user_id = 'u1'").first().source_id
    words = t.where(F.col("source_id").isin(part.source_ids)).select(F.explode(F.split("content", r"\W+")).alias("w")).where("length(w) > 6").first().w
    cards, _ = engine.browse(page_size=200, keywords=[words.upper()])
    assert part.summary_id in {r.memory_id for r in cards.collect()} and not engine.browse(keywords=[words, "nosuchword"], match="all")[0].count()
    tools = Dispatcher(engine)
    assert tools.call("read_entry", json.dumps({"source_id": theirs}))["status"] == "forbidden" and tools.call("read_entry", {"source_id": "nosuch"})["status"] == "not_found"
    assert tools.call("browse", {"page_size": 2})["status"] == "ok" and tools.call("browse", {"page_size": 0})["error"] == "argument_out_of_range:page_size"
    assert tools.call("load_material", {"handle": "h"})["status"] == "forbidden" and tools.call("nosuch", {})["error"] == "unknown_tool"
    assert Dispatcher(engine, frozenset({"read", "material"}), lambda h: h * 2).call("load_material", {"handle": "h"})["result"] == "hh"
    assert [r["status"] for r in tools.receipts] == ["forbidden", "not_found", "ok", "invalid", "forbidden", "invalid"] and all(len(r["result_hash"]) == 64 for r in tools.receipts)
    engine.forget()
    assert engine.store.read("timeline").where("user_id = 'u2'").count() == 0 and engine.store.read("timeline").count() > 0


def test_tool_specifications():
    tool = TOOLS["browse"]
    assert tool.spec("openai_chat", strict=True)["function"]["strict"] and tool.spec("anthropic_messages")["input_schema"]["additionalProperties"] is False
    assert set(tool.schema(strict=True)["required"]) == set(tool.parameters) and tool.schema()["required"] == [] and tool.spec("openai_responses")["name"] == "browse" == tool.spec("plain")["name"]
    assert tool.arguments('{"page_size": 3, "cursor": null}') == {"page_size": 3}
    for bad, error in (({"page_size": "3"}, "invalid_argument"), ({"x": 1}, "unknown_argument"), ("[]", "must_be_object"), ({"match": "some"}, "invalid_argument")):
        with pytest.raises(ValueError, match=error):
            tool.arguments(bad)
    with pytest.raises(ValueError):
        TOOLS["open"].arguments({})


def test_sessions_store_items_and_survive_the_store(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), Namespace(user_id="u", conversation_id="c"), "UTC")
    session = Session(engine, lambda: 1_700_000_000)
    session.add_items([{"role": "user", "content": "one"}, {"role": "assistant", "content": "two"}])
    session.add_items([{"role": "user", "content": [{"type": "text", "text": "three"}]}])
    again = Session(engine, lambda: 1_700_000_001)
    assert [i["content"] for i in again.get_items()] == ["one", "two", [{"type": "text", "text": "three"}]] and again.get_items(1)[0]["role"] == "user" and again.get_items(0) == []
    assert again.pop_item()["content"][0]["text"] == "three" and len(again.get_items()) == 2
    again.clear_session()
    assert again.get_items() == [] and again.pop_item() is None and engine.store.read("timeline").count() == 3
    engine.store.read = lambda *a, **k: 1 / 0
    session.add_items([{"role": "user", "content": "four"}])
    assert session.degraded and session.get_items()[-1]["content"] == "four" and session.pop_item()["content"] == "four"
    with pytest.raises(ValueError):
        Session(Engine(spark, str(tmp_path), Namespace(user_id="u"), "UTC"), lambda: 0)


def test_migrations(spark, tmp_path):
    old = spark.createDataFrame(
        [("a", "user", json.dumps({"categories": ["plan_goal", "memory_query"], "subject_scopes": ["other", "user"], "keywords": ["k", "t"], "topic_terms": ["t"], "importance": 0.7})), ("b", "tool.x c1", "{broken"), ("c", "assistant", None)],
        "source_id string, role string, memory_metadata_json string",
    )
    rows = {r.source_id: r for r in migrations.migrated(old, 1).collect()}
    m = rows["a"].memory_metadata
    assert (m.turn_intent, m.memory_facets, m.about_roles, m.topic_terms, m.retrieval_priority) == ("memory_query", ["plan"], ["third_party", "external", "user"], ["t", "k"], "high")
    assert rows["b"].kind == "tool.x.result" and rows["b"].retrieval_visibility == "explicit" and rows["b"].memory_metadata.retrieval_priority == "low"
    assert rows["c"].origin == "assistant" and rows["c"].retrieval_visibility == "default" and rows["c"].row_version == 1 and rows["c"].index_status == "pending"
    kept = old.withColumn("kind", F.lit("message.other"))
    assert {r.kind for r in migrations.migrated(kept, 1, 2).collect()} == {"message.other"}
    with pytest.raises(ValueError):
        migrations.migrated(old, 9)
    store = LogStore(spark, str(tmp_path))
    store.commit("timeline", old)
    assert migrations.migrate(store, "timeline", 1) == 2 and "memory_metadata" in store.read("timeline").columns and "memory_metadata_json" not in store.read("timeline").columns


def test_run_due_folds_each_entry_once(spark, sf_dir, tmp_path):
    t = adapters.timeline(spark, sf_dir).where("user_id = 'u1'")
    engine = Engine(spark, str(tmp_path), Namespace(user_id="u1"), "UTC")
    engine.append(t)
    before = {r.source_id for r in engine.live().collect()}
    calls = lambda lines: f"{len(lines)} lines"
    assert engine.run_due(10**9, calls)["status"] == "nothing_due"
    assert engine.run_due(20, lambda lines: 1 / 0)["status"] == "nothing_due"
    done = engine.run_due(20, calls, keep_recent=0)
    assert done["status"] == "compacted"
    folded = [i for r in engine.store.read("episodes").collect() for i in r.source_ids]
    assert len(folded) == len(set(folded)) and set(folded) | {r.source_id for r in engine.live().collect()} == before and not set(folded) & {r.source_id for r in engine.live().collect()}
    assert all(r.summary == f"{r.n_entries} lines" for r in engine.store.read("episodes").collect())
    context = engine.build_context()
    assert set(context) == {"entries", "episodes"} and context["episodes"].count() > 0
    # A writer in between: the plan is made anew, and in the end given up.
    engine.store.commit = lambda *a, **k: (_ for _ in ()).throw(CommitConflict("t"))
    assert engine.run_due(1, calls, keep_recent=0)["status"] in ("conflict", "nothing_due") and engine.embedding_status()["dimension"] == 128


def test_repairs_are_committed_and_undone(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), Namespace(user_id="u"), "UTC")
    scope = "'' as tenant_id, 'u' as user_id, '' as domain_id"
    engine.store.commit("timeline", spark.range(30).selectExpr(*scope.split(", "), "'c' as conversation_id", "concat('r', id) as source_id", "id as seq_no"))
    engine.store.commit("episodes", spark.range(12).selectExpr(*scope.split(", "), "'c' as conversation_id", "concat('e', lpad(id, 2, '0')) as summary_id", "id as timestamp", "array(concat('r', id)) as source_ids", "concat('text ', id) as summary"))
    rows = [("", "u", "", "m0", ["e00", "e01"]), ("", "u", "", "m1", ["e02", "e04"]), ("", "other", "", "x0", ["e00"])]
    engine.store.commit("semantics", spark.createDataFrame(rows, "tenant_id string, user_id string, domain_id string, semantic_id string, source_summary_ids array<string>"))
    assert engine.replacements(["m1"]) == {"m1": ["m1"]}
    assert engine.repair(lambda lines: 1 / 0, 1, trigger=4, batch=2)["reason"] == "summariser_failed" and engine.store.generation("semantics") == 1
    done = engine.repair(lambda lines: "+".join(lines), 1, trigger=4, batch=2)
    table = {r.semantic_id: r for r in engine.store.read("semantics").collect()}
    assert done["status"] == "ready" and set(table) == {"m0", "x0", *done["new_ids"]} and table[done["new_ids"][0]].source_summary_ids == ["e02", "e03"] and table[done["new_ids"][0]].summary == "text 2+text 3"
    assert engine.repair(lambda lines: "x", 2, trigger=4, batch=2)["status"] == "clean"
    assert engine.replacements(["m1", "m0"]) == {"m1": done["replacements"]["m1"], "m0": ["m0"]}
    engine.rollback(done["repair_id"], 3)
    assert {r.semantic_id: r.source_summary_ids for r in engine.store.read("semantics").collect()} == {"m0": ["e00", "e01"], "m1": ["e02", "e04"], "x0": ["e00"]}
    assert engine.replacements(["m1"]) == {"m1": ["m1"]}
    with pytest.raises(KeyError):
        engine.rollback(done["repair_id"], 4)


def test_index_versions(spark, tmp_path):
    index = TextIndex(LogStore(spark, str(tmp_path)))
    rows = lambda *r: spark.createDataFrame(r, "id string, text string, lang string, vector array<double>")
    index.upsert(rows(("a", "red apple red", "en", [1.0, 0.0]), ("b", "green apple", "en", [0.0, 1.0]), ("c", "red pear", "fr", [1.0, 1.0])))
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(index.search({"red": 1}, 5)) == ["a", "c"] and ids(index.search({"apple": 1}, 5, {"lang": "en"})) == ["b", "a"] and ids(index.search({}, 5)) == []
    assert index.count() == 3 and index.count({"lang": "en"}) == 2 and ids(index.nearest([1.0, 0.0], 2)) == ["a", "c"]
    index.upsert(rows(("a", "blue plum", "en", [0.0, 1.0])))
    assert ids(index.search({"red": 1}, 5)) == ["c"] and ids(index.search({"plum": 1}, 5)) == ["a"] and index.count() == 3
    index.delete(spark.createDataFrame([("c",), ("zz",)], "id string"))
    assert index.count() == 2 and ids(index.search({"red": 1}, 5)) == []
    assert ids(index.search({"apple": 1, "plum": 1}, 5, excluded=spark.createDataFrame([("a",)], "id string"))) == ["b"]
    fused = index.hybrid({"plum": 1}, [0.0, 1.0], 5).collect()
    assert [r.id for r in fused] == ["a", "b"] and fused[0].dual_hit
    plan = index.search({"plum": 1}, 5)._jdf.queryExecution().executedPlan().toString()
    assert "term_bucket" in plan and "PartitionFilters: [term_bucket" in plan.replace("isnotnull(term_bucket#", "term_bucket#")


EVENTS = [
    ("t1", "begin", "", "", 1, 1), ("t1", "action", "c1", "", 2, 2), ("t1", "complete", "", "", 3, 3), ("t1", "observation", "c1", "success", 4, 4), ("t1", "complete", "", "", 5, 5), ("t1", "complete", "", "", 6, 6), ("t1", "action", "c2", "", 7, 7),
    ("t2", "begin", "", "", 1, 1), ("t2", "begin", "", "", 2, 2), ("t2", "observation", "x", "success", 3, 3), ("t2", "action", "a", "", 4, 4), ("t2", "action", "a", "", 5, 5), ("t2", "abort", "", "", 6, 6), ("t2", "complete", "", "", 7, 7), ("t3", "action", "q", "", 1, 1),
]
OUTCOMES = {
    "t1": ["accepted", "accepted", "calls_pending", "accepted", "accepted", "already_completed", "turn_not_open"],
    "t2": ["accepted", "repeated", "call_not_found", "accepted", "duplicate_call", "accepted", "conflict"],
    "t3": ["turn_not_open"],
}
SCHEMA = "turn_key string, event string, correlation_id string, status string, timestamp long, seq long"


def test_turn_rules():
    for key, want in OUTCOMES.items():
        turn = turns.TurnState()
        assert [turn.apply(e[1], e[2], e[3]) for e in EVENTS if e[0] == key] == want


def test_live_turns_equal_replay(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, SCHEMA)
    source = str(tmp_path / "in")
    df.where("seq <= 3").write.parquet(source)
    df.where("seq > 3").write.mode("append").parquet(source)
    stream = turns.turns(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 100).parquet(source))
    q = stream.writeStream.format("memory").queryName("live_turns").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    # Processing-time timers keep the query alive, so it is stopped once every event has its outcome.
    try:
        until = time.time() + 90
        while time.time() < until and q.isActive and spark.sql("select * from live_turns").count() < len(EVENTS):
            time.sleep(0.5)
    finally:
        q.stop()
    live = sorted(map(tuple, spark.sql("select * from live_turns").collect()))
    assert live == sorted(map(tuple, turns.replay(df).collect()))


def test_replay_of_many_turns_and_of_a_long_one(spark):
    """Turns go over batch borders, one turn has very many calls, and no turn costs a Python call of its own."""
    rng = random.Random(5)
    rows = [(f"t{i % 300}" if i % 301 else None, rng.choice(["begin", "action", "observation", "complete", "abort", "note"]), rng.choice(["a", "b", "", None]), rng.choice(["success", "pending", None]), rng.choice([i, i, None]), i) for i in range(6_000)]
    n = 20_000
    rows += [("long", "begin", "", "", 0, 0), *(("long", "action", f"c{i}", "", 1, i) for i in range(n)), *(("long", "observation", f"c{i}", "success", 2, i) for i in range(n)), ("long", "complete", "", "", 3, 0)]
    want, state = [], {}
    for key, event, call, status, *_ in sorted(rows, key=lambda r: (r[4] is None, r[4] or 0, r[5])):
        turn = state.setdefault(key, turns.TurnState())
        outcome = turn.apply(event, call or "", status or "")
        want.append((key, event, call, outcome, turn.status or "", turn.pending))
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        made = turns.replay(spark.createDataFrame(rows, SCHEMA))
        got = list(map(tuple, made.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [g[5] for g in got if g[0] == "long"] == [0, *range(1, n + 1), *range(n - 1, -1, -1), 0]
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()


def test_outbox_and_windows(spark, tmp_path, sf_dir):
    store = LogStore(spark, str(tmp_path / "store"))
    source = str(tmp_path / "in")
    spark.range(10).selectExpr("cast(id as string) as source_id", "'' as tenant_id", "'' as user_id", "'' as domain_id", "'' as conversation_id").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    for _ in range(2):
        turns.outbox(stream, lambda batch: store.append_new("index", batch), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert store.read("index").count() == 10
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert turns.activity(e).agg(F.sum("n")).first()[0] == e.count() == turns.activity(e, gap="30 minutes").agg(F.sum("n")).first()[0]
    assert turns.stale(spark.createDataFrame([("open", 5), ("open", 95), ("closed", 5)], "status string, opened_at long"), 100, 50).count() == 1
