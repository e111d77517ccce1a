"""Queries of writers, digests, navigation and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compaction, navigation, snippets, upkeep
from ..operators import timeline as tl
from ..sources import adapters as src
from ..sources import writers
from ..streaming import turns
from .queries import EP, EV, SEM, TZ, T, query
from .read_queries import TR, XE

_DATE = "strftime(make_timestamp(({0} + 28800) * 1000000), '%Y-%m-%d')"
_TOD = "case when (({0} + 28800) // 3600) % 24 < 5 then 'midnight' when (({0} + 28800) // 3600) % 24 < 12 then 'morning' when (({0} + 28800) // 3600) % 24 < 18 then 'afternoon' else 'night' end"


def _events(spark, sf_dir):
    return src.event_entries(spark, sf_dir)


@query(f"with {T} select source_id, case role when 'assistant' then 'message.assistant' else 'message.user' end as kind, 'default' as retrieval_visibility, case when role = 'system' then 'skipped' else 'pending' end as index_status, md5(coalesce(content, '')) as h, {_DATE.format('timestamp')} as date_label, {_TOD.format('timestamp')} as time_of_day from timeline")
def chat_writer(spark, sf_dir):
    t = src.timeline(spark, sf_dir)
    out = writers.chat(t, TZ, F.col("role"), F.col("content"), F.col("role") != "system")
    return out.select("source_id", "kind", "retrieval_visibility", "index_status", F.md5("content").alias("h"), "date_label", "time_of_day")


@query(f"with {EV} select source_id, kind, 'source: ' || event_type || chr(10) || 'k: ' || k || chr(10) || 'value: ' || event_id as content, 'explicit' as retrieval_visibility, false as semanticize, {_DATE.format('timestamp')} as date_label from ev")
def external_event_writer(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("value", F.substring("source_id", 2, 20))
    out = writers.external_event(e, TZ, F.concat(F.lit(" EVENT."), F.upper("event_type")), ["value", "k"], F.concat("event_type", F.lit("\t ")))
    return out.select("source_id", "kind", "content", "retrieval_visibility", "semanticize", "date_label")


@query(f"""with {EV} select source_id || ':call' as source_id, 'tool.get_' || event_type || '.call' as kind, timestamp, 'action' as turn_role, 'c' || event_id as correlation_id, '{{"k":' || k || '}}' as content from ev
union all select source_id || ':result', 'tool.get_' || event_type || '.result', timestamp + 1, 'observation', 'c' || event_id, 'value ' || k from ev""")
def tool_exchange_writer(spark, sf_dir):
    e = _events(spark, sf_dir)
    call = F.concat(F.lit("c"), F.substring("source_id", 2, 20))
    out = writers.tool_exchange(e, TZ, F.concat(F.lit("Get "), "event_type"), call, F.to_json(F.struct("k")), F.concat(F.lit("value "), "k"), F.lit("ok"))
    return out.select("source_id", "kind", "timestamp", "turn_role", "correlation_id", "content")


@query(f"with {EV} select source_id, case when k % 2 = 0 then 'material.cleanup' else 'material.reference' end as kind, case when k % 2 = 0 then 'environment' else 'user' end as origin, case when k % 2 = 0 then 'source: attachment_cleanup' else 'source: attachment' end || chr(10) || 'file_id: h' || event_id || chr(10) || 'kind: pdf' || chr(10) || 'filename: f' || k || '.PDF' || chr(10) || case when k % 2 = 0 then 'file_status: deleted' else 'file_status: available' end as content from ev")
def material_writer(spark, sf_dir):
    e = _events(spark, sf_dir)
    out = writers.material(e, TZ, F.concat(F.lit("h"), F.substring("source_id", 2, 20)), F.concat(F.lit("f"), "k", F.lit(".PDF")), F.col("k") % 2 == 0)
    return out.select("source_id", "kind", "origin", "content")


@query(f"""with {T}, n as (select turn_id, cast(right(turn_id, 1) as integer) % 4 as g, count(*) as n from timeline group by 1)
select turn_id, n, case when g = 0 then 'imported' when g = 1 then 'already_imported' when g = 2 then 'conflict' else case when n = 1 then 'imported' else 'conflict' end end as outcome from n""")
def completed_turn_import(spark, sf_dir):
    """Turns of which some are unknown, some known, some changed, some known in part."""
    t = src.timeline(spark, sf_dir).withColumn("correlation_id", F.lit("")).withColumn("g", F.substring("turn_id", -1, 1).cast("int") % 4)
    first = F.col("seq_no") % 2 == 1
    known = t.where((F.col("g").isin(1, 2)) | ((F.col("g") == 3) & ~first)).withColumn("content", F.when(F.col("g") == 2, F.lit("other")).otherwise(F.col("content")))
    return writers.imported(t, known)


@query(f"with {XE} select summary_id, true as is_semanticized, lineage_status from xe where lineage_status = 'invalid'")
def marked_rows(spark, sf_dir):
    e = src.trace_episodes(src.trace_timeline(spark, sf_dir))
    ids = e.where("lineage_status = 'invalid'").select(F.col("summary_id").alias("id"))
    return writers.marked(e, ids, "summary_id", is_semanticized=F.lit(True)).select("summary_id", "is_semanticized", "lineage_status")


@query(f"with {TR}, op as (select turn_id from tr where turn_id <> '' group by 1 having not bool_or(turn_role = 'final')) select source_id, case when turn_role <> 'stimulus' then 'not_a_stimulus' when op.turn_id is not null then 'staged' else 'turn_not_open' end as outcome from tr left join op using (turn_id) union all select 'nobody', 'entry_not_found'")
def staged_metadata(spark, sf_dir):
    t = src.trace_timeline(spark, sf_dir)
    live = t.where("turn_id <> ''").groupBy("turn_id").agg(F.bool_or(F.col("turn_role") == "final").alias("done")).where("not done")
    new = t.select("source_id", F.lit("{}").alias("metadata")).unionByName(spark.createDataFrame([("nobody", "{}")], "source_id string, metadata string"))
    return writers.staged_metadata(t, live, new).select("source_id", "outcome")


@query(f"with {SEM}, x as (select user_id, tokens from semantics union all select user_id, tokens from episodes union all select user_id, tokens from timeline) select user_id, count(*) as n_items, cast(sum(tokens + 4) as bigint) as tokens from x group by 1")
def visible_tokens(spark, sf_dir):
    t = src.timeline(spark, sf_dir)
    e = src.episodes(t)
    return writers.visible_tokens(src.semantics(e), e, t, ["user_id"])


@query(f"with {T} select user_id, {_DATE.format('min(timestamp)')} as since, greatest(1, date_diff('day', cast({_DATE.format('min(timestamp)')} as date), date '2024-03-01') + 1) as days from timeline group by 1")
def tenure_note(spark, sf_dir):
    return writers.tenure(src.timeline(spark, sf_dir), ["user_id"], 1_709_251_200, TZ).select("user_id", "since", F.col("days").cast("long").alias("days"))


@query(f"""with {TR} select turn_id, string_agg(kind || case when status <> '' then ' status=' || status else '' end || case when correlation_id <> '' then ' correlation=' || correlation_id else '' end || case when k % 2 = 0 then ' retention_anchor={{"k":' || k || '}}' else '' end, '；' order by seq_no) as digest, cast(count(*) as integer) as n_entries, cast(0.2 as double) as importance
from tr where turn_id <> '' and turn_role in ('action', 'observation') group by 1""")
def digest_of_operations(spark, sf_dir):
    t = src.trace_timeline(spark, sf_dir).where("turn_id <> ''").where(~compaction.is_episode_entry(F.col("kind"), F.col("turn_role")))
    rows = t.withColumn("tool", F.lit("")).withColumn("anchor", F.when(F.col("k") % 2 == 0, F.to_json(F.struct("k"))))
    return compaction.operation_digest(rows, ["turn_id"], ["seq_no"]).select("turn_id", "digest", "n_entries", "importance")


@query(f"""with {TR} select conversation_id, cast(count(*) filter (where k % 2 = 0) as integer) as n_anchors, cast(least(count(*) filter (where k % 2 = 0), 3) as integer) as n_kept from (select * from tr where k >= 10 or k % 2 = 1) where turn_role in ('action', 'observation') group by 1""")
def digest_budget(spark, sf_dir):
    """A budget of three anchors of eight bytes each: the first ones that fit are kept."""
    t = src.trace_timeline(spark, sf_dir).where("turn_role in ('action', 'observation')").where("k >= 10 or k % 2 = 1")
    rows = t.withColumn("tool", F.lit("")).withColumn("anchor", F.when(F.col("k") % 2 == 0, F.to_json(F.struct("k"))))
    return compaction.operation_digest(rows, ["conversation_id"], ["seq_no"], 24).select("conversation_id", "n_anchors", "n_kept")


@query(f"""with {EP}, s as (select summary_id as memory_id, unnest(source_ids) as source_id from episodes), h as (select memory_id, source_id, timestamp, seq_no from s join timeline using (source_id) where contains(lower(content), 'ther') or contains(lower(content), 'ing'))
select memory_id, source_id, row_number() over (partition by memory_id order by timestamp, seq_no, source_id) - 1 as place from h""")
def keyword_sources(spark, sf_dir):
    t = src.timeline(spark, sf_dir)
    cards = src.episodes(t).select(F.col("summary_id").alias("memory_id"), "source_ids")
    return navigation.keyword_sources(cards, t, ["ther", "ING"]).withColumn("place", F.col("place").cast("long"))


_PREV = "greatest(0, instr(lower(text), 'ing') - 21)"


@query(f"with d as (select doc_id, text, {_PREV} as s from documents where text is not null and lang = 'en' and strlen(text) = length(text) and not regexp_matches(text, '[ \\t\\r\\n]{{2,}}|^\\s') and contains(lower(text), 'ing')) select doc_id, (case when s > 0 then '…' else '' end) || substr(text, s + 1, 80) || (case when s + 80 < length(text) then '…' else '' end) as preview from d")
def keyword_previews(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").where("text is not null and lang = 'en' and octet_length(text) = length(text)").where(~F.col("text").rlike(r"[ \t\r\n]{2,}|^\s") & F.contains(F.lower("text"), F.lit("ing")))
    return d.select("doc_id", navigation.keyword_previews(F.col("text"), ["ING"]).alias("preview"))


@query("""with g as (select conv_id, count(*) as n, sha256(string_agg(sha256(concat_ws(chr(31), cast(turn as varchar), role, coalesce(text, chr(0)))), '' order by turn, role, text)) as fingerprint from conversations group by 1) select * from g""")
def history_fingerprints(spark, sf_dir):
    return navigation.fingerprints(src.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role", "text"])


@query(f"with {TR} select conversation_id, count(*) as n_said from tr where kind = 'message.user' and origin = 'user' and actor_id in ('user:3', 'user:7') group by 1")
def speaker_excerpts(spark, sf_dir):
    said, _ = navigation.speaker_excerpts(src.trace_timeline(spark, sf_dir), ["user:3", "user:7"])
    return said.groupBy("conversation_id").agg(F.count("*").alias("n_said"))


@query(f"with {XE}, a as (select unnest(source_ids) as source_id from xe where lineage_status = 'valid' union all select source_id from tr where k = 5 union all select 'zzz'), n as (select source_id, count(*) as n from a group by 1) select count(*) filter (where n is null) as missing, count(*) filter (where tr.source_id is null) as foreign, count(*) filter (where n > 1) as repeated from n full join tr using (source_id)".replace("as foreign", 'as "foreign"'))
def partition_check(spark, sf_dir):
    t = src.trace_timeline(spark, sf_dir)
    given = src.trace_episodes(t).where("lineage_status = 'valid'").select(F.explode("source_ids").alias("source_id"))
    extra = t.where("k = 5").select("source_id").unionByName(spark.createDataFrame([("zzz",)], "source_id string"))
    return navigation.partitioned(given.unionByName(extra), t)


@query(f"with {XE}, j as (select summary_id as id, max(period_start_ts) as at from xe where retrieval_visibility = 'default' group by 1) select summary_id as id, case when retrieval_visibility = 'default' then 'new-' || summary_id else summary_id end as stands_for from xe")
def replacement_map(spark, sf_dir):
    """Every episode was repaired twice; of explicit ones the last repair was rolled back and so was the first."""
    e = src.trace_episodes(src.trace_timeline(spark, sf_dir))
    row = lambda at, to, status: e.select(F.lit(f"r{at}").alias("repair_id"), F.lit(at).alias("applied_at"), status.alias("status"), F.create_map("summary_id", F.array(F.concat(F.lit(to), "summary_id"))).alias("replacements"))
    visible = F.when(F.col("retrieval_visibility") == "default", "applied").otherwise("rolled_back")
    journal = row(1, "old-", visible).unionByName(row(2, "new-", visible))
    return navigation.replaced(e.select(F.col("summary_id").alias("id")), journal).select("id", F.array_join("replacements", ",").alias("stands_for"))


@query(f"with {T}, h as (select conversation_id as query_id, source_id, row_number() over (partition by conversation_id order by tokens desc, source_id) as rank from timeline), x as (select conversation_id as query_id, source_id from timeline where seq_no = 1), b as (select x.query_id, min(rank) as rank from x left join h on h.query_id = x.query_id and h.source_id = x.source_id and rank <= 2 group by 1) select count(*) as n_queries, round(avg(case when rank is not null then 1.0 else 0.0 end), 6) as hit_rate, round(avg(rank), 6) as mean_rank from b")
def evaluation(spark, sf_dir):
    from pyspark.sql import Window

    t = src.timeline(spark, sf_dir).withColumn("query_id", F.col("conversation_id"))
    hits = t.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("tokens"), "source_id")))
    return navigation.hit_rates(hits, t.where("seq_no = 1").select("query_id", "source_id"), 2)


@query("select f as forbidden, count(*) filter (where contains(text, f)) as n from documents, (values ('token ='), ('License'), ('nowhere at all')) as v(f) group by 1")
def leak_counts(spark, sf_dir):
    return navigation.leaks(src.table(spark, sf_dir, "documents"), "text", ["token =", "License", "nowhere at all"])


@query(f"with {EP} select summary_id, sha256('summary' || chr(31) || '' || chr(31) || user_id || chr(31) || '' || chr(31) || conversation_id || chr(31) || array_to_string(source_ids, chr(30)) || chr(31) || '2' || chr(31) || 'default') as stable_id from episodes")
def stable_ids(spark, sf_dir):
    e = src.episodes(src.timeline(spark, sf_dir))
    return e.select("summary_id", navigation.stable_ids("summary", [F.col(c) for c in ("tenant_id", "user_id", "domain_id", "conversation_id")], F.col("source_ids"), 2, "default").alias("stable_id"))


@query(f"with {T}, u as (select conversation_id, turn_id as turn, min(seq_no) as first_seq, min(timestamp) as start_ts from timeline group by 1, 2) select conversation_id, turn, first_seq, start_ts from u where (start_ts, conversation_id, first_seq, turn) > (1704070800, '1', 1, 't1:0')")
def timeline_after_cursor(spark, sf_dir):
    units = tl.turns(src.timeline(spark, sf_dir))
    cursor = navigation.timeline_cursor([""], {"time": 1}, (1_704_070_800, "1", 1, "t1:0"))
    return navigation.after_cursor(units, cursor, [""], {"time": 1}).select("conversation_id", "turn", "first_seq", "start_ts")


@query(f"""with recursive {TR}, e as (select turn_id, row_number() over (partition by turn_id order by timestamp, seq_no) as i, case turn_role when 'stimulus' then 'begin' when 'final' then 'complete' when '' then 'note' else turn_role end as event, correlation_id as call, status from tr where turn_id <> ''),
s as (select turn_id, cast(0 as bigint) as i, cast(null as varchar) as state, cast([] as varchar[]) as called, cast([] as varchar[]) as done, '' as event, '' as call, '' as outcome from e where i = 1
union all select turn_id, i, case when outcome = 'accepted' and event = 'begin' then 'open' when outcome = 'accepted' and event = 'complete' then 'closed' else state end,
  case when outcome = 'accepted' and event = 'action' then list_append(called, call) else called end, case when outcome = 'accepted' and event = 'observation' and status = 'completed' and not list_contains(done, call) then list_append(done, call) else done end, event, call, outcome
from (select s.turn_id, e.i, s.state, s.called, s.done, e.event, e.call, e.status, case when e.event = 'begin' then case when s.state is null then 'accepted' when s.state = 'open' then 'repeated' else 'conflict' end
  when e.event = 'complete' and s.state = 'closed' then 'already_completed' when s.state is distinct from 'open' then case when e.event = 'complete' and s.state is not null then 'conflict' else 'turn_not_open' end
  when e.event = 'action' then case when list_contains(s.called, e.call) then 'duplicate_call' else 'accepted' end when e.event = 'observation' then case when list_contains(s.called, e.call) then 'accepted' else 'call_not_found' end
  when e.event = 'complete' then case when len(s.called) > len(s.done) then 'calls_pending' else 'accepted' end else 'unknown_event' end as outcome from s join e on e.turn_id = s.turn_id and e.i = s.i + 1))
select turn_id as turn_key, event, call as correlation_id, outcome, coalesce(state, '') as status, case when state = 'open' then len(called) - len(done) else 0 end as pending from s where i > 0""")
def turn_replay(spark, sf_dir):
    """The turn state machine over events of all kinds: openings, calls, results, ends, and what is none of them."""
    t = src.trace_timeline(spark, sf_dir).where("turn_id <> ''")
    role = F.col("turn_role")
    event = F.when(role == "stimulus", "begin").when(role == "final", "complete").when(role == "", "note").otherwise(role)
    return turns.replay(t.select(F.col("turn_id").alias("turn_key"), event.alias("event"), "correlation_id", F.when(F.col("status") == "completed", "success").otherwise(F.col("status")).alias("status"), "timestamp", F.col("seq_no").alias("seq")))


@query()
def spoken_events(spark, sf_dir):
    """Messages as streams of chunks: spoken chunks, sentences as they are certain, and the result."""
    c = src.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("stream"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = F.regexp_extract_all("text", F.lit(r"(?s).{1,16}"), F.lit(0))
    return turns.spoken(c.select("stream", F.posexplode(pieces).alias("seq", "chunk")))


_W = "w as (select conversation_id, source_id, seq_no as position, 10 + k % 7 as tokens, k % 11 = 0 as folded, turn_role = 'stimulus' as stimulus, case turn_role when 'action' then 1 when 'observation' then -1 else 0 end as calls, turn_role = 'action' as has_call from tr)"


@query(f"""with {TR}, {_W}, a as (select *, sum(case when not folded then tokens else 0 end) over (partition by conversation_id) as total from w), b as (select *, sum(case when stimulus then 1 else 0 end) over (partition by conversation_id order by position) as run from a where total >= 200 and not folded),
c as (select * from b where not stimulus qualify run = min(run) over (partition by conversation_id)), d as (select *, sum(tokens) over (partition by conversation_id order by position) as cum, sum(calls) over (partition by conversation_id order by position) as opened, greatest(1, floor(total * 0.02)) as target from c),
e as (select *, coalesce(min(case when opened = 0 and cum >= target then position end) over (partition by conversation_id), max(case when opened = 0 then position end) over (partition by conversation_id)) as cut from d),
f as (select * from e where position <= cut qualify bool_or(has_call) over (partition by conversation_id)) select conversation_id, source_id, position from f""")
def working_segments(spark, sf_dir):
    t = src.trace_timeline(spark, sf_dir)
    role = F.col("turn_role")
    rows = t.select("conversation_id", "source_id", F.col("seq_no").alias("position"), (10 + F.col("k") % 7).alias("tokens"), (F.col("k") % 11 == 0).alias("folded"), (role == "stimulus").alias("stimulus"), F.when(role == "action", 1).when(role == "observation", -1).otherwise(0).alias("calls"), (role == "action").alias("has_call"))
    return upkeep.working_segments(rows, ["conversation_id"], 200, 0.02).select("conversation_id", "source_id", "position")


@query(f"with {TR} select source_id, case when k % 17 = 0 then 'owned_by_another_namespace' when turn_id <> '' then 'already_in_turn' when k % 2 = 0 then 'already_frozen' else 'adopted' end as outcome from tr union all select 'nobody', 'entry_not_found'")
def adopted_entries(spark, sf_dir):
    t = src.trace_timeline(spark, sf_dir)
    scope = ["tenant_id", "user_id", "domain_id", "conversation_id"]
    ids = t.withColumn("user_id", F.when(F.col("k") % 17 == 0, "other").otherwise(F.col("user_id"))).select(*scope, "source_id")
    ids = ids.unionByName(t.limit(1).select(*scope, F.lit("nobody").alias("source_id")))
    return upkeep.adopted(ids, t, t.where("k % 2 = 0").select("source_id"))


@query(f"with {TR} select source_id, case when k % 3 = 0 then 'append' when k % 3 = 1 then 'same' else 'conflict' end as outcome from tr")
def standalone_entries(spark, sf_dir):
    t = src.trace_timeline(spark, sf_dir).select("source_id", "kind", "content", "k")
    known = t.where("k % 3 <> 0").withColumn("content", F.when(F.col("k") % 3 == 2, "other").otherwise(F.col("content")))
    return upkeep.appended(t, known, ("kind", "content"))


@query(f"with {TR}, c as (select conversation_id, correlation_id as call_id, count(*) filter (where turn_role = 'action') as calls, count(*) filter (where turn_role = 'observation') as results, count(*) filter (where turn_role <> 'action' and k % 10 = 0) as empty from tr group by 1, 2) select conversation_id, count(*) filter (where results > 0 and calls = 0) as unpaired_results, count(*) filter (where calls > 1) as repeated_calls, cast(sum(empty) as bigint) as empty_events, count(*) filter (where calls > 0 and results = 0) as open_calls from c group by 1")
def wire_conformance(spark, sf_dir):
    t = src.trace_timeline(spark, sf_dir)
    event = F.when(F.col("turn_role") == "action", "tool_call").when(F.col("turn_role") == "observation", "tool_result").otherwise("message")
    return upkeep.conformance(t.select("conversation_id", event.alias("event"), F.col("correlation_id").alias("call_id"), F.when(F.col("k") % 10 == 0, "").otherwise("x").alias("text")), ["conversation_id"])


@query(f"with {TR}, w as (select distinct turn_id from tr where k = 7 and turn_id <> '') select tr.turn_id, source_id, seq_no as position from tr join w using (turn_id)")
def ledger_rows(spark, sf_dir):
    t = src.trace_timeline(spark, sf_dir).withColumn("position", F.col("seq_no"))
    return upkeep.rows_of_turns(t.where("turn_id <> ''"), t.where("k = 7")).select("turn_id", "source_id", "position")


@query(f"""with {XE}, r as (select *, 'said ' || summary_id as body from xe) select summary_id, '【摘要回忆】[类型:trip] ' || body || chr(10) || '记忆情绪:calm / warm / sad' || chr(10) || '关键事件:' || array_to_string(source_ids, ';') || chr(10) || 'memory_id: "' || summary_id || '"' as text from r""")
def summary_snippets(spark, sf_dir):
    """Summaries as they are shown, but for the time label, which has a query of its own."""
    e = src.trace_episodes(src.trace_timeline(spark, sf_dir))
    rows = e.select("summary_id", "period_start_ts", "period_end_ts", F.concat(F.lit("said "), "summary_id").alias("diary_summary"), F.lit("trip").alias("event_type"), F.col("source_ids").alias("key_events"), F.array().cast("array<string>").alias("core_facts"), F.array(*map(F.lit, ("calm", "warm", "sad", "happy"))).alias("mood_tags"))
    text = snippets.snippet(rows.columns, "summary", TZ)
    return rows.select("summary_id", F.regexp_replace(text, r"^(【摘要回忆】\[).*? \| (类型:)", "$1$2").alias("text"))


@query("select doc_id, md5('input:' || chr(10) || '{\"l\":' || length(text) || '}') as call_md5, md5('source: ' || source || chr(10) || 'output:' || case when trim(text, ' ') <> '' then chr(10) || trim(text, ' ') else '' end) as result_md5 from documents where text is not null")
def call_texts(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.md5(snippets.call_text(F.to_json(F.struct(F.length("text").alias("l"))))).alias("call_md5"), F.md5(snippets.result_text(F.col("text"), F.concat(F.lit(" "), "source"))).alias("result_md5"))
