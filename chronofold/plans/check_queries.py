"""Queries that take every branch of an operator: admission, redaction, relaxation, validity, ledgers, all payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents, embedding
from ..functions import text as fx
from ..functions import times as tm
from ..operators import guards, lineage, projection, retrieval
from ..sources import adapters as src
from . import filters as flt
from .queries import _TOK, T, query
from .read_queries import TR, XE

_VISIBLE = "case when k % 9 = 0 then 'never' when k % 4 = 0 then 'explicit' else 'default' end"


@query(f"with {TR}, v as (select source_id, kind, {_VISIBLE} as visibility, turn_role in ('action', 'observation') or kind like 'tool.%' as trace from tr) select source_id, visibility = 'default' and not trace as by_default, (visibility = 'default' and not trace) or ((kind like 'tool.%' or kind = 'message.user') and (visibility = 'explicit' or (trace and visibility <> 'never'))) as when_asked from v")
def admission(spark, sf_dir):
    t = src.trace_timeline(spark, sf_dir)
    visibility = F.when(F.col("k") % 9 == 0, "never").when(F.col("k") % 4 == 0, "explicit").otherwise("default")
    args = (visibility, F.col("kind"), F.col("turn_role"))
    return t.select("source_id", flt.admitted(*args).alias("by_default"), flt.admitted(*args, ["tool.*", "message.user"]).alias("when_asked"))


_NAMES = "(?:api[_-]?key|authorization|auth[_-]?key|pt[_-]?key|access[_-]?token|refresh[_-]?token|password|passwd|secret|token)"
_MARK = "[secret value omitted]"


def _redacted(column: str) -> str:
    """The rules without look-behind and back references: what stands before a name is taken along."""
    out = column
    for pattern, to in (
        (r"(?i)(\\bBearer\\s+)[A-Za-z0-9._~+/=-]{12,}", rf"\\1{_MARK}"), (r"(?i)\\bsk-[A-Za-z0-9_-]{12,}", _MARK), (r"\\beyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\b", _MARK),
        (rf"(?i)((?:^|[^A-Za-z0-9_])[''\"]?{_NAMES}[''\"]?\\s*[:=]\\s*)\"[^''\"\\r\\n]{{8,}}\"", rf'\\1"{_MARK}"'),
        (rf"(?i)((?:^|[^A-Za-z0-9_])[''\"]?{_NAMES}[''\"]?\\s*[:=]\\s*)''[^''\"\\r\\n]{{8,}}''", rf"\\1''{_MARK}''"),
        (rf"(?i)((?:^|[^A-Za-z0-9_])[''\"]?{_NAMES}[''\"]?\\s*[:=]\\s*)[A-Za-z0-9_~+/=-]{{16,}}($|[\\s,;}}\\]])", rf"\\1{_MARK}\\2"),
    ):
        out = f"regexp_replace({out}, '{pattern.replace(chr(92) * 2, chr(92))}', '{to.replace(chr(92) * 2, chr(92))}', 'g')"
    return f"regexp_replace({out}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', ' ', 'g')"


@query(f"select doc_id, length(text) as before, length(r) as after, sha256(r) as redacted_sha256 from (select doc_id, text, {_redacted('text')} as r from documents) where text <> r")
def redact_secrets(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").select("doc_id", "text", fx.redact(F.col("text")).alias("redacted"))
    return d.where(F.col("text") != F.col("redacted")).select("doc_id", F.length("text").cast("long").alias("before"), F.length("redacted").cast("long").alias("after"), F.sha2("redacted", 256).alias("redacted_sha256"))


@query("select doc_id as source_id, lang as tag, p as pool, p = 'none' as relaxed from documents, (values ('none'), ('some')) as v(p) where lang in ('fr', 'es') and (p = 'none' or source = 'src3')")
def relaxation(spark, sf_dir):
    """One pool in which no row meets the soft condition, which is then dropped, and one in which some do."""
    pool = flt.where(src.entries(spark, sf_dir), {"tag": {"$in": ["fr", "es"]}})
    both = [retrieval.relaxed(pool, F.col("namespace") == name).select("source_id", "tag", F.lit(p).alias("pool"), "relaxed") for name, p in (("no-such-source", "none"), ("src3", "some"))]
    return both[0].unionByName(both[1])


@query(f"with {XE}, l as (select summary_id, unnest(source_ids) as source_id from xe) select summary_id, count(*) as n_sources, count(*) filter (where k % 13 = 0) as n_missing, case when count(*) filter (where k % 13 = 0) = 0 then 'valid' else 'invalid' end as lineage_status from l join tr using (source_id) group by 1")
def lineage_validity(spark, sf_dir):
    """Episodes whose sources are all there, and some of whose sources are gone."""
    t = src.trace_timeline(spark, sf_dir)
    return lineage.validity(src.trace_episodes(t), t.where("k % 13 <> 0"))


@query(f"""with {T}, h as (select conversation_id, cast(conversation_id as bigint) % 4 as g, seq_no as position, sha256(content) as h from timeline), old as (select conversation_id, g, position, case when g = 1 and position = 1 then 'x' else h end as h from h where g = 3 or position <= 2 union all select distinct conversation_id, g, 99, 'gone' from h where g = 2),
b as (select coalesce(o.conversation_id, h.conversation_id) as conversation_id, coalesce(o.position, h.position) as position, o.h as oh, h.h as nh from old o full join h on o.conversation_id = h.conversation_id and o.position = h.position)
select conversation_id, case when bool_or(oh is not null and oh is distinct from nh) then 'stale' when count(*) filter (where oh is null) > 0 then 'append' else 'current' end as status, min(case when oh is null then position end) as from_position from b group by 1""")
def frozen_ledger(spark, sf_dir):
    """Ledgers that are current, that lack a tail, of which a row changed, and that hold a row which is gone."""
    h = src.timeline(spark, sf_dir).select("conversation_id", (F.col("conversation_id").cast("long") % 4).alias("g"), F.col("seq_no").alias("position"), F.sha2("content", 256).alias("h"))
    old = h.where("g = 3 or position <= 2").withColumn("h", F.when((F.col("g") == 1) & (F.col("position") == 1), "x").otherwise(F.col("h")))
    gone = h.where("g = 2").select("conversation_id", "g").distinct().select("conversation_id", "g", F.lit(99).cast("long").alias("position"), F.lit("gone").alias("h"))
    return projection.frozen(old.unionByName(gone).drop("g"), h.drop("g"), ["conversation_id"])


@query("""select event_id, '{"k":' || json_extract_string(props, '$.k') || '}' as canonical, sha256('{"k":' || json_extract_string(props, '$.k') || '}') as hash from events""")
def canonical_props(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    return e.select("event_id", documents.canonical_json(F.col("props")).alias("canonical"), documents.json_hash(F.col("props")).alias("hash"))


@query(f"""with t as (select conv_id, turn, unnest({_TOK.format('text')}) as w from conversations), h as (select conv_id, turn, length(w) as n, sha256(w) as x from t),
p as (select conv_id, turn, cast(('0x' || substr(x, 1, 8)) as bigint) % 128 as place, sum((1 - 2 * (cast(('0x' || substr(x, 9, 2)) as bigint) % 2)) * (1 + n / 10)) as v from h group by 1, 2, 3),
n as (select conv_id, turn, sqrt(sum(v * v)) as norm from p group by 1, 2)
select conv_id, turn, place, round(v / norm, 6) + 0.0 as value from p join n using (conv_id, turn) where abs(v) > 1e-9 and norm > 0""")
def hashed_embeddings(spark, sf_dir):
    """Every place of every vector that is not zero."""
    c = src.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    v = embedding.embed(c, "text").select("conv_id", "turn", F.posexplode("embedding").alias("place", "value"))
    return v.where(F.abs("value") > 1e-9).select("conv_id", "turn", F.col("place").cast("long").alias("place"), (F.round("value", 6) + 0.0).alias("value"))


_ROLE = "case when origin = 'assistant' then 'assistant' else 'user' end"
_TOOL, _ARGS = "'t' || (k % 3)", "'{\"k\":' || k || '}'"
_CALLS = f"'{{\"id\":\"' || correlation_id || '\",\"type\":\"function\",\"function\":{{\"name\":\"' || {_TOOL} || '\",\"arguments\":\"' || replace({_ARGS}, '\"', '\\\"') || '\"}}}}'"
_USES = f"'{{\"type\":\"tool_use\",\"id\":\"' || correlation_id || '\",\"name\":\"' || {_TOOL} || '\",\"input\":' || {_ARGS} || '}}'"
_RESULTS = "'{\"type\":\"tool_result\",\"tool_use_id\":\"' || correlation_id || '\",\"content\":\"v' || k || '\"}'"


def _payload_sql(profile: str) -> str:
    chat = "'{\"role\":\"' || min(role) || '\",\"content\":\"' || min(text) || '\"}'"
    if profile == "anthropic_messages":
        call, result = f"'{{\"role\":\"assistant\",\"content\":[' || string_agg({_USES}, ',' order by seq_no) || ']}}'", f"'{{\"role\":\"user\",\"content\":[' || string_agg({_RESULTS}, ',' order by seq_no) || ']}}'"
        chat = "'{\"role\":\"' || min(role) || '\",\"content\":[{\"type\":\"text\",\"text\":\"' || min(text) || '\"}]}'"
    elif profile == "openai_chat":
        call, result = f"'{{\"role\":\"assistant\",\"tool_calls\":[' || string_agg({_CALLS}, ',' order by seq_no) || ']}}'", "'{\"role\":\"tool\",\"tool_call_id\":\"' || min(correlation_id) || '\",\"content\":\"' || min(text) || '\"}'"
    else:
        call, result = f"'{{\"type\":\"function_call\",\"call_id\":\"' || min(correlation_id) || '\",\"name\":\"' || min({_TOOL}) || '\",\"arguments\":\"' || replace(min({_ARGS}), '\"', '\\\"') || '\"}}'", "'{\"type\":\"function_call_output\",\"call_id\":\"' || min(correlation_id) || '\",\"output\":\"' || min(text) || '\"}'"
        chat = "'{\"type\":\"message\",\"role\":\"' || min(role) || '\",\"content\":\"' || min(text) || '\"}'"
    joins = {"anthropic_messages": "('call', 'result')", "openai_chat": "('call')"}.get(profile, "('')")
    return f"""select '{profile}' as profile, conversation_id, position, md5(case g when 'call' then {call} when 'result' then {result} else {chat} end) as payload_md5, string_agg(source_id, ',' order by seq_no) as source_ids from (
  select *, cast(sum(fresh) over (partition by conversation_id order by seq_no) as bigint) - 1 as position from (select *, case when g = lag(g) over (partition by conversation_id order by seq_no) and g in {joins} then 0 else 1 end as fresh from m)) group by conversation_id, position, g"""


_PROFILES = ("openai_chat", "anthropic_messages", "openai_responses")


@query(f"with {TR}, m as (select *, case turn_role when 'action' then 'call' when 'observation' then 'result' else 'text' end as g, 'v' || k as text, {_ROLE} as role from tr) " + " union all ".join(map(_payload_sql, _PROFILES)))
def projected_messages(spark, sf_dir):
    """The payloads of three providers: calls and results alone or gathered, arguments as text or as objects."""
    t = src.trace_timeline(spark, sf_dir).select("conversation_id", "seq_no", "source_id", F.concat(F.lit("v"), "k").alias("text"), "origin", "turn_role", "correlation_id", F.concat(F.lit("t"), F.col("k") % 3).alias("tool_name"), F.to_json(F.struct("k")).alias("arguments"))
    out = None
    for profile in _PROFILES:
        one = projection.project(t, profile, ["conversation_id"], "seq_no").select(F.lit(profile).alias("profile"), "conversation_id", "position", F.md5("payload").alias("payload_md5"), F.array_join("source_ids", ",").alias("source_ids"))
        out = one if out is None else out.unionByName(one)
    return out


_ENTRY = f"""en as (select *, '' as tenant_id, '' as domain_id, 'raw' as layer, {_VISIBLE} as retrieval_visibility, case when k % 19 = 0 then 'never' else 'auto' end as retrieval_policy, case when k % 23 = 0 then 'trusted' else 'untrusted_data' end as trust, 1 as index_version,
  turn_role in ('action', 'observation') or kind like 'tool.%' as trace from tr)"""


def _entries(spark, sf_dir):
    t = src.trace_timeline(spark, sf_dir)
    k = F.col("k")
    return t.withColumns({"layer": F.lit("raw"), "retrieval_visibility": F.when(k % 9 == 0, "never").when(k % 4 == 0, "explicit").otherwise("default"), "retrieval_policy": F.when(k % 19 == 0, "never").otherwise("auto"), "trust": F.when(k % 23 == 0, "trusted").otherwise("untrusted_data"), "index_version": F.lit(1), "lineage_status": F.lit("raw")})


@query(f"""with {TR}, {_ENTRY}, ok as (select source_id from en where user_id = 'u3' and index_status = 'indexed' and trust = 'untrusted_data' and retrieval_visibility <> 'never' and retrieval_policy <> 'never' and ((retrieval_visibility = 'default' and not trace) or retrieval_visibility = 'explicit' or trace) and (kind like 'tool.%' or kind = 'message.user') and timestamp >= 1704067200 and timestamp < 1704240000 and k <> 50)
select source_id, source_id in (select source_id from ok) as valid from tr""")
def hit_revalidation(spark, sf_dir):
    """Every entry as a hit: which still meet the plan in the table of truth, and which do not."""
    e = _entries(spark, sf_dir)
    plan = guards.HardPlan(user_id="u3", kinds=("tool.*", "message.user"), explicit=True, time=tm.TimeRange(1_704_067_200, 1_704_240_000), timezone="UTC")
    good, bad = guards.revalidated(e.select("source_id"), e, plan, excluded=e.where("k = 50").select(F.col("source_id").alias("id")))
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


@query(f"with {TR}, {_ENTRY} select source_id, retrieval_policy <> 'never' and trust = 'untrusted_data' and retrieval_visibility = 'default' and not trace as plain, retrieval_policy <> 'never' and trust = 'untrusted_data' and (retrieval_visibility = 'explicit' or (retrieval_visibility = 'default' and not trace)) as asked from en")
def relation_visibility(spark, sf_dir):
    return _entries(spark, sf_dir).select("source_id", guards.relation_visible(False).alias("plain"), guards.relation_visible(True).alias("asked"))


@query(f"""with {XE}, x as (select summary_id, unnest(source_ids) as source_id, lineage_status from xe), v as (select source_id, k % 2 = 0 as broken from tr where is_summarized)
select source_id as id from v union select summary_id from x join v using (source_id) where not broken""")
def exclusion_with_broken_lineage(spark, sf_dir):
    t = src.trace_timeline(spark, sf_dir)
    edges = src.trace_episodes(t).select(F.col("summary_id").alias("parent"), F.posexplode("source_ids").alias("pos", "child"))
    seen = t.where("is_summarized")
    return guards.excluded_ids(seen.select(F.col("source_id").alias("start")), edges, seen.where("k % 2 = 0").select(F.col("source_id").alias("id")))


@query(f"with {TR}, g as (select turn_id, min((-k, source_id)) as best from tr where turn_id <> '' group by 1) select best[2] as source_id, -best[1] as score, turn_id from g".replace("best[2]", "struct_extract_at(best, 2)").replace("best[1]", "struct_extract_at(best, 1)"))
def distinct_groups(spark, sf_dir):
    """Hits that stand for the same turn are one match, the best of them."""
    t = src.trace_timeline(spark, sf_dir).where("turn_id <> ''")
    turns = t.groupBy("turn_id").agg(F.collect_list("source_id").alias("source_ids"))
    hits = t.select("source_id", F.col("k").alias("score"), "turn_id").join(turns, "turn_id")
    return guards.distinct_groups(hits).select("source_id", "score", "turn_id")
