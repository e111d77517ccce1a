"""One query for each operator on the supplied tables, and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions import times as tm
from ..functions import speech
from ..operators import catalog, compaction, intervals, lineage, projection, retrieval, settlement
from ..operators import timeline as tl
from ..sources import adapters as src
from . import filters as flt

TZ = "Asia/Shanghai"
LO, HI = 1_704_067_200 + 6 * 3600, 1_704_067_200 + 40 * 3600
QUERY = "the and licensed under license token"
ENTITIES = ["version"]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Common table expressions of the adapters.
T = f"""timeline as (select 'u' || (conv_id % 10) as user_id, cast(conv_id as varchar) as conversation_id, 'c' || conv_id || ':' || turn as source_id, turn + 1 as seq_no,
  {src.EPOCH} + conv_id * 3600 + turn * 60 as timestamp, role, text as content, 't' || conv_id || ':' || (turn // 2) as turn_id,
  case role when 'user' then 'message.user' when 'assistant' then 'message.assistant' else 'legacy.' || sha256(role) end as kind,
  case role when 'user' then 'stimulus' when 'assistant' then 'final' else '' end as turn_role,
  greatest(1, (strlen(coalesce(text, '')) + 3) // 4) as tokens from conversations)"""
EP = f"""{T}, ranked as (select *, (row_number() over (partition by conversation_id order by seq_no) - 1) // {src.EPISODE_SIZE} as batch from timeline),
episodes as (select user_id, conversation_id, batch, 'ep' || conversation_id || ':' || batch as summary_id, min(timestamp) as period_start_ts, max(timestamp) as period_end_ts, max(timestamp) as timestamp,
  count(*) as n_entries, sum(tokens) as tokens, list(source_id order by seq_no) as source_ids from ranked group by user_id, conversation_id, batch)"""
SEM = f"""{EP}, er as (select *, row_number() over (partition by user_id order by timestamp, summary_id) - 1 as rank, count(*) over (partition by user_id) as n from episodes),
semantics as (select user_id, rank // 5 as b, 'sem' || user_id || ':' || (rank // 5) as semantic_id, min(period_start_ts) as period_start_ts, max(period_end_ts) as period_end_ts, sum(tokens) as tokens, list(summary_id order by rank) as source_summary_ids
  from er where n - (rank // 5) * 5 >= 10 group by user_id, rank // 5)"""
EDGES = f"""{SEM}, edges as (select summary_id as parent, unnest(source_ids) as child from episodes union all select semantic_id, unnest(source_summary_ids) from semantics)"""
EV = """ev as (select 'e' || event_id as source_id, event_id, user_id, cast(floor(epoch(ts)) as bigint) as timestamp, 'event.' || lower(event_type) as kind, event_type, value, cast(json_extract_string(props, '$.k') as bigint) as k from events)"""


def _tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = src.timeline(spark, sf_dir)
    e = src.episodes(t)
    return t, e, src.semantics(e)


# Scans, filters, time.
@query(f"with {T} select source_id, user_id, conversation_id, seq_no, timestamp, kind, turn_role, turn_id, tokens from timeline")
def timeline_scan(spark, sf_dir):
    return src.timeline(spark, sf_dir).select("source_id", "user_id", "conversation_id", "seq_no", "timestamp", "kind", "turn_role", "turn_id", "tokens")


@query(f"with {T} select source_id, seq_no, timestamp from timeline where user_id = 'u3' and timestamp >= {LO} and timestamp < {HI}")
def time_range_scan(spark, sf_dir):
    t = src.timeline(spark, sf_dir)
    return t.where(flt.scope("", "u3", "") & tm.TimeRange(LO, HI).predicate(F.col("timestamp"), TZ)).select("source_id", "seq_no", "timestamp")


_TOD = "case when ((timestamp + 28800) // 3600) % 24 < 5 then 'midnight' when ((timestamp + 28800) // 3600) % 24 < 12 then 'morning' when ((timestamp + 28800) // 3600) % 24 < 18 then 'afternoon' else 'night' end"


@query(f"with {EV} select {_TOD} as period, strftime(make_timestamp((timestamp + 28800) * 1000000), '%Y-%m-%d') as date, count(*) as n, round(sum(value), 4) as total from ev group by 1, 2")
def time_of_day_buckets(spark, sf_dir):
    e = src.event_entries(spark, sf_dir)
    return e.groupBy(tm.time_of_day(F.col("timestamp"), TZ).alias("period"), tm.date_label(F.col("timestamp"), TZ).alias("date")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"with {EV} select source_id, timestamp from ev where {_TOD} in ('morning', 'night') and timestamp >= 1704153600 and timestamp < 1704412800")
def time_period_filter(spark, sf_dir):
    e = src.event_entries(spark, sf_dir)
    return e.where(tm.TimeRange(1_704_153_600, 1_704_412_800, ("morning", "night")).predicate(F.col("timestamp"), TZ)).select("source_id", "timestamp")


@query(f"with {T} select source_id, strftime(make_timestamp((timestamp + 28800) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+08:00' as iso, strftime(make_timestamp((timestamp + 28800) * 1000000), '%Y-%m-%d %H:%M') as label from timeline")
def time_labels(spark, sf_dir):
    t = src.timeline(spark, sf_dir)
    return t.select("source_id", tm.iso_label(F.col("timestamp"), TZ).alias("iso"), tm.datetime_label(F.col("timestamp"), TZ).alias("label"))


@query(f"with {EV} select source_id, kind, value, k from ev where (kind = 'event.click' or k >= 90) and kind not in ('event.error') and value > 5 and value <= 80")
def where_dsl_mixed(spark, sf_dir):
    e = src.event_entries(spark, sf_dir)
    return flt.where(e, {"$or": [{"kind": "event.click"}, {"k": {"$gte": 90}}], "kind": {"$nin": ["event.error"]}, "value": {"$gt": 5, "$lte": 80}}).select("source_id", "kind", "value", "k")


@query("select d.doc_id as source_id, quality from documents d left join (select doc_id, min(quality) as quality from labels group by 1) l using (doc_id) where (quality is null or quality <> 1) and (lang in ('fr', 'de'))")
def where_dsl_nulls(spark, sf_dir):
    return flt.where(src.entries(spark, sf_dir), {"$and": [{"quality": {"$ne": 1}}, {"tag": {"$in": ["fr", "de"]}}]}).select("source_id", "quality")


@query(f"with {EV} select kind, count(*) as n from ev where kind = 'event.click' or kind like 'event.v%' group by 1")
def kind_prefix(spark, sf_dir):
    e = src.event_entries(spark, sf_dir)
    return e.where(flt.kind_matches(F.col("kind"), "event.*") & (flt.kind_matches(F.col("kind"), "event.click") | F.col("kind").startswith("event.v"))).groupBy("kind").agg(F.count("*").alias("n"))


# Text functions.
_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"


@query(f"select doc_id, len({_TOK.format('text')}) as n_tokens, greatest(1, (strlen(coalesce(text, '')) + 3) // 4) as estimate from documents")
def tokenize_counts(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(fx.tokens(F.col("text"))).cast("long").alias("n_tokens"), fx.token_estimate(F.col("text")).alias("estimate"))


@query("with c as (select conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ') as t from conversations) select conv_id, turn, case when length(t) > 60 then rtrim(substr(t, 1, 59), ' ') || '…' else t end as compacted from c")
def compact_texts(spark, sf_dir):
    return src.table(spark, sf_dir, "conversations").select("conv_id", "turn", fx.compact(F.col("text"), 60).alias("compacted"))


# Retrieval.
def _bm25_sql(terms: dict[str, int], cand: str, k: int) -> str:
    values = ", ".join(f"('{t}', {w})" for t, w in sorted(terms.items()))
    return f"""cand as ({cand}), tok as (select id, {_TOK.format("text")} as w from cand), st as (select count(*) as n, avg(len(w)) as avgdl from tok), q(term, weight) as (values {values}),
tf as (select id, len(w) as dl, term, weight, len(list_filter(w, lambda x: x = term)) as tf from tok, q), df as (select term, count(*) as df from tf where tf > 0 group by 1),
kw as (select id as source_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as tag_score from tf join df using (term), st where tf > 0 group by 1),
top as (select * from kw where tag_score > 0 order by tag_score desc, source_id limit {k})"""


_CAND = "select doc_id as id, text from documents where lang = 'en'"
_TERMS = retrieval.query_terms(QUERY, ENTITIES)


def _candidates(spark, sf_dir) -> DataFrame:
    return flt.where(src.entries(spark, sf_dir).drop("quality"), {"tag": "en"})


@query(f"with {_bm25_sql(_TERMS, _CAND, 20)} select * from top")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25_topk(_candidates(spark, sf_dir), "text", _TERMS, 20)


_BATCH = {i: retrieval.query_terms(q) for i, q in enumerate(["licensed under the license", "token secret key", "der die und", "idiot clown", "public version 3"])}


@query(
    "with q(query_id, term, weight) as (values " + ", ".join(f"({i}, '{t}', {w})" for i, ts in _BATCH.items() for t, w in sorted(ts.items())) + f"), tok as (select doc_id as id, {_TOK.format('text')} as w from documents), st as (select count(*) as n, avg(len(w)) as avgdl from tok),"
    " post as (select id, len(w) as dl, unnest(w) as term from tok), tf as (select id, dl, term, count(*) as tf from post where term in (select term from q) group by all), df as (select term, count(*) as df from tf group by 1),"
    " s as (select query_id, id as source_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as tag_score from tf join df using (term) join q using (term), st group by all)"
    " select * from (select *, cast(row_number() over (partition by query_id order by tag_score desc, source_id) as integer) as rank from s) where rank <= 10"
)
def bm25_batch(spark, sf_dir):
    rows = [(i, t, w) for i, ts in _BATCH.items() for t, w in sorted(ts.items())]
    q = F.broadcast(spark.createDataFrame(rows, "query_id int, term string, weight int"))
    return retrieval.bm25_batch(src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"), "text", q, 10)


def _vector(spark, sf_dir, vec_id: int = 0) -> list[float]:
    return [float(x) for x in src.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


_DENSE = "dense as (select vec_id as source_id, round(greatest(list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 0)), 0), 6) as semantic_score from embeddings {0})"


@query(f"with {_DENSE.format('')} select * from dense where semantic_score > 0 order by semantic_score desc, source_id limit 10")
def dense_topk(spark, sf_dir):
    e = src.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "source_id")
    return retrieval.dense_topk(e, "embedding", _vector(spark, sf_dir), 10)


_DT = f"{_DENSE.format('')}, dt as (select * from dense where semantic_score > 0 order by semantic_score desc, source_id limit 30)"


@query(
    f"with {_DT}, {_bm25_sql(_TERMS, _CAND, 30)}, a as (select *, row_number() over (order by semantic_score desc, source_id) as r1 from dt), b as (select *, row_number() over (order by tag_score desc, source_id) as r2 from top)"
    " select source_id, round(coalesce(1.0 / (60 + r1), 0) + coalesce(1.0 / (60 + r2), 0), 9) as rrf_score, coalesce(semantic_score, 0) as semantic_score, coalesce(tag_score, 0) as tag_score, r1 is not null and r2 is not null as dual_hit from a full join b using (source_id)"
)
def hybrid_retrieval(spark, sf_dir):
    e = src.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "source_id")
    dense = retrieval.dense_topk(e, "embedding", _vector(spark, sf_dir), 30)
    return retrieval.rrf(dense, retrieval.bm25_topk(_candidates(spark, sf_dir), "text", _TERMS, 30))


@query("with r as (select doc_id as source_id, n_chars * 1.0 as score, 0 as tier from documents where lang = 'es' and n_chars < 300), d as (select doc_id as source_id, n_chars * 1.0 as score, 1 as tier from documents where lang = 'fr'), u as (select * from r union all select * from d) select source_id, cast(score as double) as score, tier, cast(row_number() over (order by tier, score desc, source_id) as integer) as place from (select * from u order by tier, score desc, source_id limit 25)")
def raw_first_merge(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("n_chars").cast("double").alias("score"), "lang")
    return retrieval.raw_first(d.where("lang = 'es' and score < 300").drop("lang"), d.where("lang = 'fr'").drop("lang"), 25, "score")


@query("select count(*) filter (value > 0 and value >= 20) as passed, count(*) filter (value > 0 and value < 20) as below, count(*) filter (value is null or value <= 0) as invalid from events")
def score_rejections(spark, sf_dir):
    return retrieval.score_filter(src.table(spark, sf_dir, "events"), "value", 20.0)


@query("select o_orderkey, cast(epoch(o_orderdate) as bigint) as timestamp, round(o_totalprice * pow(0.5, greatest(915148800 - cast(epoch(o_orderdate) as bigint), 0) / 86400.0 / 90), 6) as decayed from orders order by decayed desc, timestamp desc, o_orderkey limit 50")
def decay_rank(spark, sf_dir):
    o = src.table(spark, sf_dir, "orders").select("o_orderkey", tm.seconds(F.col("o_orderdate")).alias("timestamp"), "o_totalprice")
    return retrieval.decayed(o, "o_totalprice", "timestamp", 915_148_800, 90.0, 50, "o_orderkey").select("o_orderkey", "timestamp", "decayed")


# Lineage.
@query(f"with {EDGES}, c as (select semantic_id as root, semantic_id as id, 0 as depth from semantics union all select semantic_id, child, 1 from semantics join edges on parent = semantic_id union all select semantic_id, b.child, 2 from semantics join edges a on a.parent = semantic_id join edges b on b.parent = a.child) select root, id, depth from c")
def lineage_descendants(spark, sf_dir):
    _, e, s = _tiers(spark, sf_dir)
    return lineage.descendants(s.select(F.col("semantic_id").alias("root")), lineage.edges(e, s)).select("root", "id", "depth")


@query(f"with {EDGES}, st as (select source_id as start from timeline where seq_no = 1), a1 as (select start, parent as id, 1 as depth from st join edges on child = start), a2 as (select start, parent as id, 2 as depth from a1 join edges on child = id) select start, start as id, 0 as depth from st union all select distinct * from a1 union all select distinct * from a2")
def lineage_ancestors(spark, sf_dir):
    t, e, s = _tiers(spark, sf_dir)
    return lineage.ancestors(t.where("seq_no = 1").select(F.col("source_id").alias("start")), lineage.edges(e, s))


@query(f"with {EDGES}, vis as (select source_id as id from timeline where user_id = 'u1' and seq_no <= 2), p as (select distinct parent as id from vis join edges on child = id), g as (select distinct parent as id from p join edges on child = id), x as (select * from vis union select * from p union select * from g) select summary_id as source_id from episodes where summary_id not in (select id from x)")
def visible_exclusion(spark, sf_dir):
    t, e, s = _tiers(spark, sf_dir)
    out = lineage.visible_exclusion(t.where("user_id = 'u1' and seq_no <= 2").select(F.col("source_id").alias("start")), lineage.edges(e, s))
    return lineage.exclude(e.select(F.col("summary_id").alias("source_id")), out)


@query(f"with {EDGES}, raw as (select source_id from timeline where tokens > 400) select summary_id as source_id from episodes where summary_id not in (select parent from edges join raw on child = source_id)")
def derived_dedup(spark, sf_dir):
    t, e, s = _tiers(spark, sf_dir)
    return lineage.drop_covered(e.select(F.col("summary_id").alias("source_id")), t.where("tokens > 400").select("source_id"), lineage.edges(e, s))


@query(f"with {T}, hits as (select source_id, tokens as score from timeline), b as (select t.turn_id, max(score) as score, max_by(source_id, (score, source_id)) as hit from hits join timeline t using (source_id) group by 1) select hit, score, turn_id, string_agg(source_id, ',' order by seq_no) as source_ids from timeline join b using (turn_id) group by 1, 2, 3")
def relation_expansion(spark, sf_dir):
    t = src.timeline(spark, sf_dir)
    out = lineage.expand_hits(t.select("source_id", F.col("tokens").alias("score")), t)
    return out.withColumn("source_ids", F.array_join("source_ids", ","))


# Intervals, coverage, catalogue.
@query(f"with {EP}, c as (select user_id, period_start_ts as start_ts, period_end_ts + 1800 as end_ts from episodes), f as (select *, max(end_ts) over (partition by user_id order by start_ts, end_ts rows between unbounded preceding and 1 preceding) as reach from c), g as (select *, sum(case when start_ts <= reach then 0 else 1 end) over (partition by user_id order by start_ts, end_ts rows unbounded preceding) as i from f) select user_id, min(start_ts) as start_ts, max(end_ts) as end_ts, count(*) as n from g group by user_id, i")
def merge_intervals(spark, sf_dir):
    _, e, _ = _tiers(spark, sf_dir)
    return intervals.merged(e.select("user_id", F.col("period_start_ts").alias("start_ts"), (F.col("period_end_ts") + 1800).alias("end_ts")), ["user_id"], "start_ts", "end_ts")


@query(f"with {EP}, l as (select unnest(source_ids) as source_id, batch = 0 as summarized from episodes where batch <= 1), r as (select t.*, summarized from timeline t left join l using (source_id) where timestamp >= {LO} and timestamp < {HI}) select user_id, conversation_id, case when summarized is null then 'live' when summarized then 'covered' else 'gap' end as state, greatest(min(timestamp), {LO}) as start_ts, least(max(timestamp) + 1, {HI}) as end_ts, count(*) as n from r group by 1, 2, 3")
def coverage_states(spark, sf_dir):
    t, e, _ = _tiers(spark, sf_dir)
    held = e.where("batch <= 1").select(F.explode("source_ids").alias("source_id"), (F.col("batch") == 0).alias("summarized"))
    return intervals.coverage(t, held, LO, HI)


_CARDS = f"{SEM}, cards as (select summary_id as memory_id, 'summary' as node_type, user_id, period_start_ts, period_end_ts, len(source_ids) as n_sources from episodes union all select semantic_id, 'semantic_summary', user_id, period_start_ts, period_end_ts, len(source_summary_ids) from semantics)"


@query(f"with {_CARDS} select memory_id, node_type, user_id, period_start_ts, period_end_ts, cast(n_sources as integer) as n_sources from cards where period_end_ts >= {LO} and period_start_ts < {HI}")
def overlap_browse(spark, sf_dir):
    _, e, s = _tiers(spark, sf_dir)
    return catalog.browse(catalog.cards(e, s), LO, HI).select("memory_id", "node_type", "user_id", "period_start_ts", "period_end_ts", "n_sources")


@query(f"with {_CARDS}, o as (select memory_id, node_type, period_start_ts, period_end_ts, row_number() over (order by period_start_ts, period_end_ts, node_type, memory_id) as r from cards) select memory_id, node_type, period_start_ts, period_end_ts from o where r > 20 and r <= 40")
def keyset_page_2(spark, sf_dir):
    _, e, s = _tiers(spark, sf_dir)
    c = catalog.cards(e, s)
    last = catalog.page(c, 20).select(*catalog.ORDER).orderBy(*[F.desc(x) for x in catalog.ORDER]).first()
    return catalog.page(c, 20, tuple(last)).select("memory_id", "node_type", "period_start_ts", "period_end_ts")


_POOL = f"{EP}, terms as (select source_id, unnest(list_distinct({_TOK.format('content')})) as term from timeline), es as (select summary_id, unnest(source_ids) as source_id from episodes), pool as (select distinct summary_id, term from es join terms using (source_id))"


def _keyword_sql(keep: str) -> str:
    hit = lambda k: f"select summary_id, '{k}' as kw from pool where term like '%{k}%' group by 1"
    return f"with {_POOL}, h as ({hit('ther')} union all {hit('ing')}) select summary_id, count(*) as n_hits from h group by 1 having count(*) {keep}"


def _keyword(spark, sf_dir, match_all: bool) -> DataFrame:
    t, e, _ = _tiers(spark, sf_dir)
    terms = t.select("source_id", F.explode(F.array_distinct(fx.tokens(F.col("content")))).alias("term"))
    pool = catalog.term_pool(e, terms, ["ther", "ing"])
    return catalog.keyword_match(pool, "pool", ["ther", "ing"], match_all).select("summary_id", F.size("witnesses").cast("long").alias("n_hits"))


@query(_keyword_sql(">= 1"))
def keyword_pool_any(spark, sf_dir):
    return _keyword(spark, sf_dir, False)


@query(_keyword_sql(">= 2"))
def keyword_pool_all(spark, sf_dir):
    return _keyword(spark, sf_dir, True)


@query(f"with {EV} select strftime(make_timestamp((timestamp + 28800) * 1000000), '%Y-%m-%d') as date, count(distinct user_id) as n_actors from ev group by 1 having bool_or(user_id = 7)")
def participant_match(spark, sf_dir):
    e = src.event_entries(spark, sf_dir).select("timestamp", "seq_no", F.col("actor_id").cast("string").alias("actor_id"), F.concat(F.lit("User "), "actor_id").alias("display_name"), tm.date_label(F.col("timestamp"), TZ).alias("date"))
    refs = catalog.participant_refs(e, ["date"])
    return refs.where(catalog.participant_match(F.col("refs"), ["user 7"])).select("date", F.size("refs").cast("long").alias("n_actors"))


# Timeline reads.
@query(f"with {T} select user_id, conversation_id, turn_id as turn, min(seq_no) as first_seq, max(seq_no) as last_seq, count(*) as n_entries, cast(sum(tokens) as bigint) as tokens, string_agg(source_id, ',' order by seq_no) as source_ids from timeline group by 1, 2, 3")
def turn_groups(spark, sf_dir):
    out = tl.turns(src.timeline(spark, sf_dir))
    return out.select("user_id", "conversation_id", "turn", "first_seq", "last_seq", "n_entries", "tokens", F.array_join("source_ids", ",").alias("source_ids"))


@query(f"with {T}, r as (select conversation_id, turn_id, row_number() over (partition by conversation_id order by min(seq_no), turn_id) as turn_rank from timeline group by 1, 2), a as (select source_id as anchor, conversation_id, turn_rank as mid from timeline join r using (conversation_id, turn_id) where seq_no = 3) select anchor, source_id, cast(turn_rank as integer) as turn_rank, cast(turn_rank - mid as integer) as distance from timeline join r using (conversation_id, turn_id) join a using (conversation_id) where abs(turn_rank - mid) <= 1")
def anchor_window(spark, sf_dir):
    t = src.timeline(spark, sf_dir)
    return tl.anchor_window(t, t.where("seq_no = 3").select(F.col("source_id").alias("anchor")), 1).select("anchor", "source_id", "turn_rank", "distance")


@query(f"with recursive {T}, u as (select conversation_id, turn_id, min(seq_no) as first_seq, cast(sum(tokens) as bigint) as tokens from timeline group by 1, 2), n as (select *, row_number() over (partition by conversation_id order by first_seq) as i from u), p as (select conversation_id, i, first_seq, tokens, cast(1 as bigint) as page, tokens as used from n where i = 1 union all select n.conversation_id, n.i, n.first_seq, n.tokens, case when p.used + n.tokens > 600 then p.page + 1 else p.page end, case when p.used + n.tokens > 600 then n.tokens else p.used + n.tokens end from p join n on n.conversation_id = p.conversation_id and n.i = p.i + 1) select conversation_id, first_seq, tokens, page, tokens > 600 as oversized from p")
def token_pages(spark, sf_dir):
    turns = tl.turns(src.timeline(spark, sf_dir)).select("conversation_id", "first_seq", "tokens")
    return tl.pages(turns, 600, ["conversation_id"], ["first_seq"])


@query(f"with {T}, d as (select *, strftime(make_timestamp((timestamp + 28800) * 1000000), '%Y-%m-%d') as date from timeline) select source_id, date, lag(date) over (partition by conversation_id order by seq_no) is distinct from date as header from d")
def date_headers(spark, sf_dir):
    return tl.date_headers(src.timeline(spark, sf_dir), tm.date_label(F.col("timestamp"), TZ)).select("source_id", "date", "header")


_TRACE = "tr as (select user_id, event_id, ts, event_type, sum(case when event_type = 'click' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as c from events)"


def _trace(spark, sf_dir) -> DataFrame:
    """Per user: a click is a call, the views and errors up to the next click are its results."""
    e = src.table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = e.withColumn("c", F.sum((F.col("event_type") == "click").cast("int")).over(w)).where("c > 0 and event_type in ('click', 'view', 'error')")
    return numbered.select(F.concat(F.lit("t"), "user_id").alias("turn_id"), F.col("c").cast("string").alias("correlation_id"), F.when(F.col("event_type") == "click", "action").otherwise("observation").alias("turn_role"), F.when(F.col("event_type") == "view", "success").when(F.col("event_type") == "error", "failed").alias("status"))


@query(f"with {_TRACE} select 't' || user_id as turn_id, cast(c as varchar) as correlation_id from tr where c > 0 and event_type in ('click', 'view', 'error') group by 1, 2 having count(*) filter (event_type <> 'click') = 0")
def pending_correlations(spark, sf_dir):
    return tl.pending_calls(_trace(spark, sf_dir))


@query(f"with {_TRACE} select 't' || user_id as turn_id, count(*) as n_branches, count(*) filter (o > 0) as n_complete from (select user_id, c, count(*) filter (event_type <> 'click') as o from tr where c > 0 and event_type in ('click', 'view', 'error') group by 1, 2) group by 1")
def branch_completeness(spark, sf_dir):
    return lineage.branches(_trace(spark, sf_dir)).groupBy("turn_id").agg(F.count("*").alias("n_branches"), F.count_if("complete").alias("n_complete"))


# Settlement.
_SET = """s as (select doc_id, source, text, '[compact_reloadable]' || chr(10) || 'tool: ' || source || chr(10) || 'call_id: c' || doc_id || chr(10) || 'source_id: d' || doc_id || chr(10) || 'stored_chars: ' || length(text) as card from documents),
k as (select *, case when trim(text, ' ' || chr(10) || chr(9) || chr(13)) = '' then 'explicit_empty' when strlen(text) < 256 or strlen(card) >= strlen(text) * 0.5 then 'inline_full' else 'compact_reloadable' end as projection from s), f as (select *, case when projection = 'compact_reloadable' then card else text end as projected from k)"""


def _settled(spark, sf_dir) -> DataFrame:
    d = src.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    made = settlement.card(F.col("source"), F.concat(F.lit("c"), "doc_id"), F.concat(F.lit("d"), "doc_id"), F.col("text"))
    return settlement.classified(d, "text", made)


@query(f"with {_SET} select doc_id, projection, strlen(projected) as n_bytes, sha256(projected) as projected_sha256 from f")
def settle_classify(spark, sf_dir):
    return _settled(spark, sf_dir).select("doc_id", "projection", fx.utf8_bytes(F.col("projected")).cast("long").alias("n_bytes"), F.sha2("projected", 256).alias("projected_sha256"))


@query(f"with {_SET}, m as (select source, projection, greatest(1, (strlen(text) + 3) // 4) + 4 as b, greatest(1, (strlen(projected) + 3) // 4) + 4 as a from f) select source, count(*) as n, count(*) filter (projection = 'compact_reloadable') as n_folded, cast(sum(b) as bigint) as tokens_before, cast(sum(a) as bigint) as tokens_after, cast(sum(b) - sum(a) as bigint) as tokens_saved, round((sum(b) - sum(a)) / cast(sum(b) as double), 4) as saved_ratio from m group by 1")
def settlement_metrics(spark, sf_dir):
    return settlement.metrics(_settled(spark, sf_dir), ["source"], "text")


@query(f"with {_SET} select source, min(doc_id) filter (projection = 'compact_reloadable') as first_changed, sha256(string_agg(sha256(projected), '' order by doc_id)) as prefix_hash, case when count(*) filter (projection = 'compact_reloadable') > 0 then 'settled' else 'unchanged' end as status from f group by 1")
def settlement_plan(spark, sf_dir):
    return settlement.plan(_settled(spark, sf_dir), ["source"], "doc_id")


# Compaction.
_BUN = f"{T}, u as (select user_id, conversation_id, turn_id, min(seq_no) as first_seq, max(seq_no) as last_seq, sum(tokens) as tokens, bool_or(turn_role = 'final') as terminal from timeline group by 1, 2, 3), cf as (select *, max(last_seq) over (partition by conversation_id order by first_seq, last_seq rows between unbounded preceding and 1 preceding) as reach from u), cg as (select *, sum(case when first_seq <= reach then 0 else 1 end) over (partition by conversation_id order by first_seq, last_seq rows unbounded preceding) as component from cf), bun as (select user_id, conversation_id, component, min(first_seq) as first_seq, max(last_seq) as last_seq, cast(sum(tokens) as bigint) as tokens, count(*) as n_turns, bool_and(terminal) as terminal from cg group by 1, 2, 3)"


@query(f"with {_BUN} select user_id, conversation_id, cast(component as bigint) as component, first_seq, last_seq, tokens, n_turns, terminal from bun")
def compaction_components(spark, sf_dir):
    return compaction.bundles(tl.turns(src.timeline(spark, sf_dir))).drop("tenant_id", "domain_id")


@query(f"with {_BUN}, w as (select *, sum(tokens) over (partition by conversation_id order by first_seq rows unbounded preceding) as cum, max(cast(not terminal as int)) over (partition by conversation_id order by first_seq rows unbounded preceding) as opn, sum(case when terminal then tokens else 0 end) over (partition by conversation_id) as tot, sum(n_turns) over (partition by conversation_id order by first_seq desc rows unbounded preceding) - n_turns as later from bun) select conversation_id, first_seq, tokens, tot >= 500 and opn = 0 and cum - tokens < 350 and later >= 1 as chosen from w")
def compaction_prefix(spark, sf_dir):
    b = compaction.bundles(tl.turns(src.timeline(spark, sf_dir)))
    return compaction.prefix(b, 500, 0.7, 1).select("conversation_id", "first_seq", "tokens", "chosen")


@query(f"with {EP} select user_id, conversation_id, summary_id, period_start_ts, period_end_ts, n_entries, cast(tokens as bigint) as tokens, array_to_string(source_ids, ',') as source_ids from episodes")
def episode_rollup(spark, sf_dir):
    _, e, _ = _tiers(spark, sf_dir)
    return e.select("user_id", "conversation_id", "summary_id", "period_start_ts", "period_end_ts", "n_entries", "tokens", F.array_join("source_ids", ",").alias("source_ids"))


@query(f"with {SEM} select semantic_id, user_id, period_start_ts, period_end_ts, cast(tokens as bigint) as tokens, array_to_string(source_summary_ids, ',') as source_summary_ids from semantics")
def semantic_rollup(spark, sf_dir):
    _, _, s = _tiers(spark, sf_dir)
    return s.select("semantic_id", "user_id", "period_start_ts", "period_end_ts", "tokens", F.array_join("source_summary_ids", ",").alias("source_summary_ids"))


@query(f"with {EP}, r as (select *, row_number() over (partition by user_id order by timestamp, summary_id) as rank, count(*) over (partition by user_id) as n from episodes) select user_id, summary_id, cast(rank as integer) as rank from r where n >= 10 and rank <= 5")
def semantic_batch(spark, sf_dir):
    _, e, _ = _tiers(spark, sf_dir)
    return compaction.semantic_batch(e).select("user_id", "summary_id", "rank")


@query(f"with {EP}, r as (select *, row_number() over (partition by user_id order by timestamp, summary_id) as rank from episodes) select user_id, count(*) as n, max(rank) - min(rank) + 1 = count(*) as contiguous from r where period_start_ts >= {LO} and period_start_ts < {HI} group by 1")
def contiguity_check(spark, sf_dir):
    _, e, _ = _tiers(spark, sf_dir)
    return intervals.contiguous(e, ["user_id"], ["timestamp", "summary_id"], (F.col("period_start_ts") >= LO) & (F.col("period_start_ts") < HI))


# Projection, rendering, documents, embeddings, streams.
@query(f"with {T} select conversation_id, sha256(string_agg('[' || strftime(make_timestamp((timestamp + 28800) * 1000000), '%Y-%m-%d') || ' ' || (['周一', '周二', '周三', '周四', '周五', '周六', '周日'])[isodow(make_timestamp((timestamp + 28800) * 1000000))] || ' ' || strftime(make_timestamp((timestamp + 28800) * 1000000), '%H:%M') || '] ' || role || ': ' || coalesce(content, ''), chr(10) order by seq_no)) as text_sha256 from timeline group by 1")
def rendered_conversations(spark, sf_dir):
    return projection.chat_lines(src.timeline(spark, sf_dir), ["conversation_id"], TZ).select("conversation_id", F.sha2("text", 256).alias("text_sha256"))


@query()
def sentence_segments(spark, sf_dir):
    c = src.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(speech.sentence_array(F.col("text"))).alias("pos", "sentence"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def hourly_activity(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
