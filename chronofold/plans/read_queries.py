"""Queries of reads by id, state, turn and relation, of metadata and of catalogue fields, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import metadata, scans
from ..sources import adapters as src

from ..operators.index import TextIndex
from ..sources.store import LogStore, shared_root
from .queries import EV, _bm25_sql, _candidates, _CAND, _TERMS, query

TR = f"""{EV}, o as (select *, 'u' || (user_id % 10) as scope_user, cast(user_id as varchar) as conversation_id, coalesce(k, 0) as kk,
  sum(case when event_type = 'click' then 1 else 0 end) over (partition by user_id order by timestamp, event_id) as no, row_number() over (partition by user_id order by timestamp, event_id) as seq_no from ev),
tr as (select scope_user as user_id, conversation_id, source_id, seq_no, timestamp,
  case event_type when 'click' then 'message.user' when 'view' then 'tool.view.call' when 'signup' then 'tool.view.result' when 'purchase' then 'message.assistant' else 'event.error' end as kind,
  case event_type when 'click' then 'user' when 'view' then 'assistant' when 'purchase' then 'assistant' else 'environment' end as origin,
  case event_type when 'click' then 'stimulus' when 'view' then 'action' when 'signup' then 'observation' when 'purchase' then 'final' else '' end as turn_role,
  case when no > 0 then 'x' || conversation_id || ':' || no else '' end as turn_id, case when event_type in ('view', 'signup') then 'k' || (kk % 4) else '' end as correlation_id,
  case when event_type = 'signup' then case when kk % 5 = 0 then 'pending' else 'completed' end else '' end as status, 'user:' || conversation_id as actor_id,
  'User ' || conversation_id || case when kk % 2 = 0 then '' else ' B' end as actor_display_name, case when event_type = 'view' then 'tool:view' else '' end as target_actor_id,
  value, kk as k, kk % 3 = 0 as is_summarized, kk % 5 <> 0 as prompt_visible, case when kk % 7 = 0 then 'pending' when kk % 7 = 1 then 'skipped' else 'indexed' end as index_status from o)"""
XE = f"""{TR}, xe as (select user_id, conversation_id, 'xe' || conversation_id || ':' || ((seq_no - 1) // 8) as summary_id, min(timestamp) as period_start_ts, max(timestamp) as period_end_ts, max(timestamp) as timestamp,
  list(source_id order by seq_no) as source_ids, sum(k) % 3 = 0 as is_semanticized, case when sum(k) % 11 = 0 then 'invalid' else 'valid' end as lineage_status,
  case when sum(k) % 5 = 0 then 'explicit' else 'default' end as retrieval_visibility, case when sum(k) % 7 = 0 then 'pending' else 'indexed' end as index_status, (sum(k) % 100) / 100 as importance
  from tr group by user_id, conversation_id, (seq_no - 1) // 8)"""
XS = f"""{XE}, xr as (select *, (row_number() over (partition by user_id order by timestamp, summary_id) - 1) // 5 as batch from xe),
xs as (select user_id, 'xs' || user_id || ':' || batch as semantic_id, max(timestamp) as timestamp, max(timestamp) as last_reinforced_ts, round(avg(importance), 6) as importance, list(summary_id order by timestamp, summary_id) as source_summary_ids from xr group by user_id, batch)"""
_IDS = ["e5", "xe3:0", "e2", "xsu3:1", "none", "e5", " e7 ", "xe9:1"]
_WANTED = "wanted as (select * from (values ('e5', 0), ('xe3:0', 1), ('e2', 2), ('xsu3:1', 3), ('none', 4), ('e7', 5), ('xe9:1', 6)) as t(id, pos))"
_ALL = "every as (select 0 as tier, 'raw' as layer, source_id as id, timestamp from tr union all select 1, 'summary', summary_id, timestamp from xe union all select 2, 'semantic', semantic_id, timestamp from xs)"


def _tiers(spark, sf_dir):
    t = src.trace_timeline(spark, sf_dir)
    e = src.trace_episodes(t)
    return t, e, src.trace_semantics(e)


@query(f"with {TR} select source_id, seq_no, kind, origin, turn_role, turn_id, correlation_id, status, is_summarized, prompt_visible, index_status from tr")
def trace_timeline(spark, sf_dir):
    return src.trace_timeline(spark, sf_dir).select("source_id", "seq_no", "kind", "origin", "turn_role", "turn_id", "correlation_id", "status", "is_summarized", "prompt_visible", "index_status")


@query(f"with {XS}, {_WANTED}, {_ALL} select id, pos, tier, layer, timestamp from every join wanted using (id)")
def fetch_by_ids(spark, sf_dir):
    records = scans.unambiguous(scans.tiers(*_tiers(spark, sf_dir), "timestamp"))
    return scans.fetch(records, scans.ids(spark, _IDS)).select("id", "pos", "tier", "layer", "timestamp")


@query(f"with {XS}, {_WANTED}, {_ALL}, r as (select *, row_number() over (partition by id order by tier) as n from every join wanted using (id)) select id, layer from r where n = 1")
def lookup_unscoped(spark, sf_dir):
    return scans.first_of_tiers(scans.fetch(scans.tiers(*_tiers(spark, sf_dir)), scans.ids(spark, _IDS))).select("id", "layer")


@query(f"with {TR}, {_WANTED} select source_id, pos, user_id, conversation_id, kind, origin, turn_role, turn_id, actor_id, actor_display_name, timestamp, seq_no, correlation_id from tr join wanted on source_id = id")
def entry_headers(spark, sf_dir):
    heads = scans.headers(src.trace_timeline(spark, sf_dir)).withColumnRenamed("source_id", "id")
    return scans.fetch(heads, scans.ids(spark, _IDS)).drop("tenant_id", "domain_id").withColumnRenamed("id", "source_id")


@query(f"with {TR} select source_id, prompt_visible from tr where not is_summarized")
def unsummarized_scan(spark, sf_dir):
    return scans.unsummarized(src.trace_timeline(spark, sf_dir)).select("source_id", "prompt_visible")


@query(f"with {TR} select source_id, seq_no from tr where not is_summarized and prompt_visible")
def prompt_visible_scan(spark, sf_dir):
    return scans.prompt_visible(src.trace_timeline(spark, sf_dir)).select("source_id", "seq_no")


@query(f"with {TR} select conversation_id, min(timestamp) as first_ts from tr group by 1")
def first_timestamps(spark, sf_dir):
    return scans.first_timestamps(src.trace_timeline(spark, sf_dir)).select("conversation_id", "first_ts")


@query(f"with {XE}, r as (select *, row_number() over (partition by conversation_id order by timestamp desc, summary_id) as rank from xe where not is_semanticized) select summary_id, rank from r where rank <= 3")
def visible_episodes(spark, sf_dir):
    return scans.visible_episodes(_tiers(spark, sf_dir)[1], 3).select("summary_id", F.col("rank").cast("long").alias("rank"))


@query(f"with {XS}, r as (select *, row_number() over (partition by user_id order by last_reinforced_ts desc, importance desc, timestamp desc, semantic_id) as rank from xs) select semantic_id, rank from r where rank <= 4")
def recent_semantics(spark, sf_dir):
    return scans.recent_semantics(_tiers(spark, sf_dir)[2], 4).select("semantic_id", F.col("rank").cast("long").alias("rank"))


@query(f"with {XE} select summary_id, timestamp from xe where not is_semanticized")
def uncompacted_episodes(spark, sf_dir):
    return scans.uncompacted_episodes(_tiers(spark, sf_dir)[1]).select("summary_id", "timestamp")


@query(f"with {TR} select source_id, seq_no, turn_role from tr where turn_id = 'x3:10' and turn_role in ('action', 'observation')")
def turn_entries(spark, sf_dir):
    return scans.turn_entries(src.trace_timeline(spark, sf_dir), "x3:10", ["action", "observation"]).select("source_id", "seq_no", "turn_role")


@query(f"with {TR} select turn_id, correlation_id, string_agg(source_id, ',' order by seq_no) as branch from tr where turn_id = 'x3:10' and correlation_id = 'k2' group by 1, 2")
def correlation_branch(spark, sf_dir):
    rows = scans.correlation_entries(src.trace_timeline(spark, sf_dir), "x3:10", "k2")
    return rows.groupBy("turn_id", "correlation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_no", "source_id"))), lambda x: x["source_id"]), ",").alias("branch"))


_STATE = "st as (select 0 as tier, source_id as id, timestamp, conversation_id, seq_no, index_status from tr union all select 1, summary_id, timestamp, conversation_id, 0, index_status from xe union all select 2, semantic_id, timestamp, null, 0, 'indexed' from xs)"


def _records(spark, sf_dir):
    return scans.tiers(*_tiers(spark, sf_dir), "timestamp", "conversation_id", "seq_no", "index_status")


@query(f"with {XS}, {_STATE}, r as (select *, row_number() over (partition by tier order by timestamp, id) as rank from st where index_status = 'pending') select tier, id, rank from r where rank <= 100")
def outbox_scan(spark, sf_dir):
    return scans.pending_index(_records(spark, sf_dir), 100).select("tier", "id", F.col("rank").cast("long").alias("rank"))


@query(f"with {XS}, {_STATE} select tier, id from (select * from st where index_status <> 'skipped' order by tier, timestamp, conversation_id nulls first, coalesce(seq_no, 0), id limit 9000)")
def reindex_scan(spark, sf_dir):
    return scans.index_records(_records(spark, sf_dir), 9000).select("tier", "id")


@query(f"with {TR} select distinct '' as tenant_id, user_id, '' as domain_id, conversation_id from tr")
def distinct_namespaces(spark, sf_dir):
    return scans.namespaces(src.trace_timeline(spark, sf_dir))


@query("select event_id, coalesce(try_cast(json_extract_string(case when event_id % 3 = 0 then '{' when event_id % 3 = 1 then null else props end, '$.k') as bigint), -1) as k from events where event_id % 3 <> 0 union all select event_id, -1 from events where event_id % 3 = 0")
def decoded_json(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 3 == 0, "{").when(F.col("event_id") % 3 == 2, F.col("props"))
    return e.select("event_id", F.coalesce(scans.decoded(raw, "struct<k:bigint>", '{"k":-1}')["k"], F.lit(-1)).alias("k"))


@query(f"with {TR}, f as (select turn_id, min(seq_no) as s from tr where turn_id <> '' group by 1) select tr.turn_id, user_id, conversation_id from tr join f on tr.turn_id = f.turn_id and seq_no = s")
def relation_owners(spark, sf_dir):
    return scans.relation_owners(src.trace_timeline(spark, sf_dir)).select("turn_id", "user_id", "conversation_id")


@query(f"""with {XE}, p as (select source_id as key, conversation_id, seq_no, timestamp from tr),
sp as (select summary_id, conversation_id, period_end_ts, unnest(source_ids) as source_id from xe where lineage_status = 'valid' and retrieval_visibility = 'default'),
g as (select summary_id, sp.conversation_id, period_end_ts, max(seq_no) as last_seq, max(timestamp) as last_ts, count(*) filter (where seq_no is null) as missing from sp left join tr on sp.source_id = tr.source_id and sp.conversation_id = tr.conversation_id group by 1, 2, 3),
m as (select key, summary_id, last_seq, row_number() over (partition by key order by last_seq desc, summary_id) as r from p join g using (conversation_id) where missing = 0 and last_seq < p.seq_no and last_ts <= p.timestamp and period_end_ts <= p.timestamp)
select key, summary_id, last_seq from m where r = 1""")
def previous_episodes(spark, sf_dir):
    t, e, _ = _tiers(spark, sf_dir)
    before = t.withColumn("key", F.col("source_id"))
    return scans.previous_episodes(e, t, before).select("key", "summary_id", "last_seq")


@query(f"with {TR}, tu as (select turn_id, bool_or(turn_role = 'final') as done from tr where turn_id <> '' group by 1) select turn_id, case when done then 'completed' else 'open' end as status, coalesce(string_agg(source_id, ',' order by seq_no) filter (where turn_role = 'stimulus'), '') as stimuli from tu join tr using (turn_id) group by 1, 2")
def turn_handles(spark, sf_dir):
    t = src.trace_timeline(spark, sf_dir)
    stimuli = F.collect_list(F.when(F.col("turn_role") == "stimulus", F.col("source_id"))).alias("stimulus_source_ids")
    turns = t.where("turn_id <> ''").groupBy("turn_id").agg(F.when(F.bool_or(F.col("turn_role") == "final"), "completed").otherwise("open").alias("status"), stimuli)
    return scans.turn_handles(turns, t).select("turn_id", "status", F.array_join(F.transform("stimuli", lambda x: x["source_id"]), ",").alias("stimuli"))


@query(f"with {XE} select summary_id, lineage_status, case when lineage_status = 'invalid' then 'invalid_lineage' else index_status end as index_status from xe")
def quarantine(spark, sf_dir):
    good, broken = scans.quarantined(_tiers(spark, sf_dir)[1])
    return good.unionByName(broken).select("summary_id", "lineage_status", "index_status")


# Metadata: documents' languages, sources and labels stand for what a model wrote.
_MD = """md as (select d.doc_id, d.source, case when l.toxic = 1 then 'HIGH ' when l.quality = 0 then 'none' else 'normal' end as priority, case when d.doc_id % 50 = 0 then ' memory_query ' else 'chat' end as intent,
  d.lang, d.doc_id % 3 as a, d.doc_id % 4 as b, upper(d.lang) as e from documents d left join (select doc_id, min(quality) as quality, max(toxic) as toxic from labels group by 1) l using (doc_id)),
cm as (select doc_id, case when trim(intent) = 'memory_query' then 'memory_query' else '' end as turn_intent, case when a = 0 then ['plan', 'event'] when a = 1 then ['event'] else [] end as memory_facets,
  case when b = 0 then ['user'] when b = 1 then ['external', 'user'] else [] end as about_roles, case when lang is null then [] when lang = 'fr' then ['Fr  x'] else [e] end as entity_anchors, case when source is null then [] else [source] end as topic_terms,
  case when priority = 'HIGH ' then 'high' else 'normal' end as retrieval_priority from md)"""


def _metadata(spark, sf_dir):
    quality = src.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = src.table(spark, sf_dir, "documents").join(quality, "doc_id", "left")
    a, b = F.col("doc_id") % 3, F.col("doc_id") % 4
    lists = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    m = F.struct(
        F.when(F.col("doc_id") % 50 == 0, " memory_query ").otherwise("chat").alias("turn_intent"),
        F.when(a == 0, lists("plan", " event", "plan", "other")).when(a == 1, lists("event", "")).otherwise(lists("nothing")).alias("memory_facets"),
        F.when(b == 0, lists("user")).when(b == 1, lists("external", "user", "external")).alias("about_roles"),
        F.when(F.col("lang") == "fr", lists("Fr  x", "Fr  x")).otherwise(lists(F.upper("lang"), " ")).alias("entity_anchors"), lists(F.col("source")).alias("topic_terms"),
        F.when(F.col("toxic") == 1, "HIGH ").when(F.col("quality") == 0, "none").otherwise("normal").alias("retrieval_priority"), lists("calm", "warm", "sad", "happy").alias("mood_tags"),
    )
    return d.select("doc_id", "text", "source", metadata.coerced(m).alias("memory_metadata"), m.alias("raw"))


@query(f"with {_MD} select doc_id, turn_intent, array_to_string(memory_facets, ',') as facets, array_to_string(about_roles, ',') as roles, array_to_string(entity_anchors, ',') as entities, array_to_string(topic_terms, ',') as topics, retrieval_priority, turn_intent <> '' or retrieval_priority <> 'normal' or len(memory_facets) + len(about_roles) + len(entity_anchors) + len(topic_terms) > 0 as has_signal, 'calm,warm,sad' as moods from cm")
def coerced_metadata(spark, sf_dir):
    m, joined = F.col("memory_metadata"), lambda c: F.array_join(c, ",")
    d = _metadata(spark, sf_dir)
    moods = joined(metadata.coerced(F.col("raw"), flavor=True)["mood_tags"]).alias("moods")
    return d.select("doc_id", m["turn_intent"].alias("turn_intent"), joined(m["memory_facets"]).alias("facets"), joined(m["about_roles"]).alias("roles"), joined(m["entity_anchors"]).alias("entities"), joined(m["topic_terms"]).alias("topics"), m["retrieval_priority"].alias("retrieval_priority"), metadata.has_signal(m).alias("has_signal"), moods)


@query(f"""with {_MD}, x as (select doc_id, text, cm.* exclude (doc_id) from documents join cm using (doc_id))
select doc_id as source_id, md5(coalesce(text, '')) as text_md5, md5(trim(coalesce(text, '') || ' ' || array_to_string(entity_anchors, ' ') || ' ' || array_to_string(topic_terms, ' ') || ' ' || array_to_string(memory_facets, ' ') || ' ' || array_to_string(about_roles, ' ') || ' ')) as keyword_md5, false as is_trace,
array_to_string(list_sort(list_distinct(list_concat(list_transform(memory_facets, lambda f: 'facet:' || f), list_transform(about_roles, lambda f: 'role:' || f), list_transform(entity_anchors, lambda f: 'entity:' || lower(regexp_replace(f, '\\s+', ' ', 'g'))), ['kind:document', 'kind:document.text']))), ',') as flags, retrieval_priority as priority from x""")
def index_entries(spark, sf_dir):
    d = _metadata(spark, sf_dir).select("doc_id", F.col("text").alias("content"), "memory_metadata", F.lit("document.text").alias("kind"))
    out = metadata.index_entries(d, "raw", "doc_id", "legacy.unknown")
    return out.select("source_id", F.md5("text").alias("text_md5"), F.md5("keyword_text").alias("keyword_md5"), "is_trace", F.array_join("flags", ",").alias("flags"), "priority")


_COMPACT = "case when length(trim(regexp_replace(coalesce({0}, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) > {1} then rtrim(substr(trim(regexp_replace(coalesce({0}, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, {1} - 1)) || '…' else trim(regexp_replace(coalesce({0}, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) end"


@query(f"select doc_id, md5({_COMPACT.format('text', 160)}) as title, md5({_COMPACT.format('text', 500)}) as hint, case when trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) <> '' then 1 else 0 end as version, trim(coalesce(text, '')) <> '' as has_content from documents")
def catalog_fields(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").withColumnRenamed("text", "content")
    c = metadata.catalog_fields(F.col("content"), F.col("content"), F.array(F.col("source")))
    return d.select("doc_id", F.md5(c["memory_title"]).alias("title"), F.md5(c["catalog_hint"]).alias("hint"), c["catalog_schema_version"].alias("version"), metadata.has_content(d, "raw").alias("has_content"))


@query(f"""with {_MD}, g as (select doc_id % 40 as g, doc_id, cm.* exclude (doc_id) from cm)
select g, array_to_string(list_sort(list_distinct(flatten(list(memory_facets)))), ',') as facets, array_to_string(list_sort(list_distinct(flatten(list(topic_terms)))), ',') as topics, case when bool_or(retrieval_priority = 'high') then 'high' else 'normal' end as retrieval_priority from g group by g""")
def merged_metadata(spark, sf_dir):
    rows = _metadata(spark, sf_dir).select((F.col("doc_id") % 40).alias("g"), "doc_id", F.col("memory_metadata").alias("m"))
    out = metadata.merged_metadata(rows, ["g"], ["doc_id"])
    return out.select("g", F.array_join(F.array_sort("memory_facets"), ",").alias("facets"), F.array_join(F.array_sort("topic_terms"), ",").alias("topics"), "retrieval_priority")


@query(f"with {XE}, l as (select summary_id, unnest(source_ids) as source_id from xe) select summary_id, array_to_string(list_sort(list_distinct(list(actor_id))), ',') as participants, count(distinct case when turn_id = '' then source_id else turn_id end) as n_turns, count(*) as n_entries, min(timestamp) as first_ts, max(timestamp) as last_ts from l join tr using (source_id) group by 1")
def catalog_backfill(spark, sf_dir):
    t, e, _ = _tiers(spark, sf_dir)
    return metadata.catalog_backfill(e, t).withColumn("participants", F.array_join("participants", ","))


@query(f"""with {TR}, a as (select turn_id, actor_id, actor_display_name as name, timestamp, seq_no, 0 as place from tr where turn_id <> '' union all select turn_id, target_actor_id, '', timestamp, seq_no, 1 from tr where turn_id <> '' and target_actor_id <> ''),
g as (select turn_id, actor_id, min((timestamp, seq_no, place)) as first, coalesce(arg_max(name, (timestamp, seq_no, place)) filter (where name <> ''), '') as display_name from a group by 1, 2)
select turn_id, row_number() over (partition by turn_id order by first) as place, actor_id, display_name from g""")
def turn_participants(spark, sf_dir):
    t = src.trace_timeline(spark, sf_dir).where("turn_id <> ''")
    return metadata.participants(t, ["turn_id"]).withColumn("place", F.col("place").cast("long"))


@query(f"with {TR} select kind = 'event.error' as is_event, kind, count(*) as n, cast(sum(case when kind = 'event.error' and k % 2 = 0 then 0 else 1 end) as bigint) as n_new from tr group by 1, 2")
def annotation_merge(spark, sf_dir):
    t = src.trace_timeline(spark, sf_dir)
    status = F.when(F.col("k") % 2 == 0, "pending").otherwise("accepted_host")
    kept = metadata.annotated(F.lit("prior"), F.lit("new"), status, F.col("kind"))
    return t.groupBy((F.col("kind") == "event.error").alias("is_event"), "kind").agg(F.count("*").alias("n"), F.sum(F.when(kept == "new", 1).otherwise(0)).alias("n_new"))


@query(f"with {_bm25_sql(_TERMS, _CAND + ' and source <> $$src3$$', 20)} select * from top")
def indexed_search(spark, sf_dir):
    """The stored index after two versions of half of the documents and a source's deletion: as if built of what is left."""
    docs = _candidates(spark, sf_dir).select(F.col("source_id").alias("id"), "text", "namespace")
    index = TextIndex(LogStore(spark, shared_root(spark, "index")))
    index.upsert(docs.withColumn("text", F.when(F.col("id") % 2 == 0, F.lit("the license token")).otherwise(F.col("text"))))
    index.upsert(docs.where("id % 2 = 0"))
    index.delete(docs.where("namespace = 'src3'").select("id"))
    return index.search(_TERMS, 20).withColumnRenamed("id", "source_id")
