"""Queries of the projection ledger, with their SQL. Documents stand for call arguments and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, settlement
from ..sources import adapters as src
from .queries import query

_LINES = "'[compact_reloadable]' || chr(10) || 'tool: ' || source || chr(10) || 'call_id: c' || doc_id || chr(10) || 'source_id: ' || doc_id || chr(10) || 'stored_chars: ' || length(text)"


def _docs(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").where("text is not null")
    call = F.concat(F.lit("c"), "doc_id")
    return d.withColumn("call", call).withColumn("card", settlement.card(F.col("source"), call, F.col("doc_id").cast("string"), F.col("text")))


def _one(key, value):
    return F.to_json(F.map_from_arrays(F.array(key), F.array(value)))


def _payloads(spark, sf_dir):
    d = _docs(spark, sf_dir)
    tool = F.to_json(F.struct(F.lit("tool").alias("role"), F.col("call").alias("tool_call_id"), F.col("text").alias("content")))
    block = F.to_json(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("tool_result").alias("type"), F.col("call").alias("tool_use_id"), F.col("text").alias("content"))).alias("content")))
    plain = F.to_json(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    rows = None
    for profile, payload in ((ledger.OPENAI, tool), (ledger.ANTHROPIC, block), (ledger.CANONICAL, plain)):
        one = d.select("doc_id", "text", "call", "card", F.lit(profile).alias("profile"), payload.alias("payload"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(f"""with s as (select doc_id, text, {_LINES} as card from documents where text is not null),
k as (select *, case when trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' then 'explicit_empty' when strlen(text) < 256 or strlen(card) >= strlen(text) * 0.5 then 'inline_full' else 'compact_reloadable' end as kind from s)
select doc_id, profile, kind, md5(case when kind = 'compact_reloadable' then card else text end) as content_md5 from k, (values ('openai_chat'), ('anthropic_messages'), ('canonical_user_assistant')) as p(profile)""")
def settle_results(spark, sf_dir):
    """Results of calls folded inside the payloads of three providers."""
    rows = _payloads(spark, sf_dir)
    done = rows.withColumn("s", ledger.settled_json("payload", "profile", _one(F.col("call"), F.lit("result")), _one(F.col("call"), F.col("doc_id").cast("string")), _one(F.col("call"), F.col("card"))))
    at = F.when(F.col("profile") == ledger.ANTHROPIC, F.get_json_object("s.payload", "$.content[0].content")).otherwise(F.get_json_object("s.payload", "$.content"))
    return done.select("doc_id", "profile", F.from_json("s.kinds", "map<string,string>")[F.col("call")].alias("kind"), F.md5(at).alias("content_md5"))


@query("""with s as (select doc_id, text, substr(text, 1, 120) || chr(10) || '[truncated source_id=' || doc_id || ']' as cut from documents where text is not null)
select doc_id, strlen(text) >= 256 and strlen(cut) < strlen(text) * 0.5 as folded, md5(case when strlen(text) >= 256 and strlen(cut) < strlen(text) * 0.5 then cut else text end) as q_md5 from s""")
def settle_arguments(spark, sf_dir):
    """Arguments of a chat call folded inside the payload, which stays valid JSON."""
    d = _docs(spark, sf_dir)
    arguments = F.to_json(F.struct(F.col("text").alias("q"), F.array(F.col("source")).alias("l")))
    call = F.struct(F.col("call").alias("id"), F.lit("function").alias("type"), F.struct(F.lit("search").alias("name"), arguments.alias("arguments")).alias("function"))
    d = d.withColumn("payload", F.to_json(F.struct(F.lit("assistant").alias("role"), F.array(call).alias("tool_calls"))))
    done = d.withColumn("s", ledger.settled_json("payload", F.lit(ledger.OPENAI), _one(F.col("call"), F.lit("arguments")), _one(F.col("call"), F.col("doc_id").cast("string")), F.lit("{}")))
    q = F.get_json_object(F.get_json_object("s.payload", "$.tool_calls[0].function.arguments"), "$.q")
    return done.select("doc_id", (F.from_json("s.kinds", "map<string,string>")[F.col("call")] == ledger.FOLDED).alias("folded"), F.md5(q).alias("q_md5"))


@query("""with d as (select doc_id, coalesce(text, '') as text, doc_id % 3 = 0 as bad from documents),
m as (select doc_id, 0 as position, bad as downgraded, case when bad then 'assistant' else 'assistant' end as role, case when bad then '[historical tool call retained as canonical trace]' || chr(10) || 'arguments_status: unavailable_after_safety_projection' || chr(10) || 'tool: search; call_id: c' || doc_id || chr(10) || 'source_ids: a' || doc_id || chr(10) || 'The original result remains available in the following canonical trace.' else null end as content from d
union all select doc_id, 1, bad, case when bad then 'user' else 'tool' end, case when bad then '[historical tool result retained as canonical trace]' || chr(10) || 'call_id: c' || doc_id || chr(10) || 'source_ids: o' || doc_id || chr(10) || 'result:' || chr(10) || text else text end from d)
select doc_id, position, downgraded, role, md5(coalesce(content, '')) as content_md5 from m""")
def provider_safe_messages(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("c"), "doc_id").alias("call"))
    arguments = F.when(F.col("doc_id") % 3 == 0, F.lit("[secret value omitted]")).otherwise(F.lit('{"q":1}'))
    call = F.struct(F.col("call").alias("id"), F.lit("function").alias("type"), F.struct(F.lit("search").alias("name"), arguments.alias("arguments")).alias("function"))
    one = d.select("doc_id", F.lit(0).alias("position"), F.to_json(F.struct(F.lit("assistant").alias("role"), F.array(call).alias("tool_calls"))).alias("payload"), F.array(F.concat(F.lit("a"), "doc_id")).alias("source_ids"))
    two = d.select("doc_id", F.lit(1).alias("position"), F.to_json(F.struct(F.lit("tool").alias("role"), F.col("call").alias("tool_call_id"), F.col("text").alias("content"))).alias("payload"), F.array(F.concat(F.lit("o"), "doc_id")).alias("source_ids"))
    out = ledger.provider_safe(one.unionByName(two), ["doc_id"], ledger.OPENAI)
    return out.select("doc_id", "position", "downgraded", F.get_json_object("payload", "$.role").alias("role"), F.md5(F.coalesce(F.get_json_object("payload", "$.content"), F.lit(""))).alias("content_md5"))


# Ledgers: a conversation's messages are its rows; what a second save brings differs by the conversation's number.
_C = "c as (select conv_id, cast(turn as integer) as position, md5(coalesce(text, '')) as h, max(turn) over (partition by conv_id) as top, conv_id % 3 as g from conversations)"


@query(f"""with {_C}, old as (select * from c where position < top or g = 2), fresh as (select conv_id, position, case when g = 1 and position = 0 then 'x' else h end as h, g, top from c),
j as (select f.conv_id, f.position, f.h, f.g, o.h as oh, (select max(position) from old o2 where o2.conv_id = f.conv_id) as last, sum(case when o.h is null then 1 else 0 end) over (partition by f.conv_id order by f.position) as nth from fresh f left join old o using (conv_id, position))
select conv_id, position, case when oh = h then 'same' when oh is null then case when position = coalesce(last, -1) + nth then 'append' else 'projection_gap' end when conv_id % 2 = 0 and position % 2 = 0 then 'replace' else 'projection_immutable_conflict' end as outcome from j""")
def ledger_save(spark, sf_dir):
    c = src.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("position"), F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    top = c.groupBy("conv_id").agg(F.max("position").alias("top"))
    c = c.join(top, "conv_id").withColumn("g", F.col("conv_id") % 3)
    old = c.where("position < top or g = 2").withColumn("status", F.when(F.col("position") % 2 == 0, "complete").otherwise("request_frozen"))
    fresh = c.withColumn("h", F.when((F.col("g") == 1) & (F.col("position") == 0), "x").otherwise(F.col("h")))
    live = c.where("conv_id % 2 = 0").select("conv_id")
    return ledger.saved(old.select("conv_id", "position", "h", "status"), fresh.select("conv_id", "position", "h"), live, ["conv_id"]).select("conv_id", "position", "outcome")


@query(f"""with {_C}, a as (select conv_id, count(*) as n, string_agg(sha256(coalesce(text, '')), '' order by turn) as hs, max(case when conv_id % 5 = 1 and turn = 0 then 1 else 0 end) as broken, conv_id % 5 as g from conversations group by conv_id)
select conv_id, case when g = 2 then n - 1 else n end as n_messages, case when g = 2 then 'incomplete' when g = 1 then 'corrupt' when g = 3 then 'corrupt' else 'valid' end as status from a""")
def ledger_verify(spark, sf_dir):
    """Settlements of which some lost their last message, some have a changed payload, some another chain hash."""
    c = src.table(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(_by_turn()).alias("n"), F.coalesce("text", F.lit("")).alias("payload"))
    c = c.withColumn("position", F.col("n") - 1).withColumn("h", F.sha2("payload", 256)).withColumn("g", F.col("conv_id") % 5)
    chain = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "h"))), lambda x: x["h"]), ""), 256)
    heads = c.groupBy("conv_id", "g").agg(F.count("*").alias("expected"), chain.alias("chain_hash")).withColumn("chain_hash", F.when(F.col("g") == 3, "x").otherwise(F.col("chain_hash")))
    last = c.groupBy("conv_id").agg(F.max("position").alias("last"))
    messages = c.join(last, "conv_id").where("not (g = 2 and position = last)").withColumn("payload", F.when((F.col("g") == 1) & (F.col("position") == 0), F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return ledger.verified(heads, messages, ["conv_id"])


def _by_turn():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("turn")


@query("""with f as (select 'p' || (doc_id // 4) as turn, doc_id % 4 as position, 's' || doc_id as source_id, md5(coalesce(text, '')) as h, (doc_id // 4) % 2 = 0 as done from documents)
select source_id, string_agg(case when done then 'settled-' || turn else h end, ',') as hashes from f group by source_id""")
def effective_hashes(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 4)).alias("turn"), (F.col("doc_id") % 4).alias("position"), F.concat(F.lit("s"), "doc_id").alias("source_id"), F.md5(F.coalesce("text", F.lit(""))).alias("h"), (F.floor(F.col("doc_id") / 4) % 2 == 0).alias("done"))
    full = d.select("turn", "position", "h", F.array("source_id").alias("source_ids"))
    settled = d.where("done").groupBy("turn").agg(F.lit(0).cast("long").alias("position"), F.concat(F.lit("settled-"), F.first("turn")).alias("h"), F.collect_list("source_id").alias("source_ids"))
    return ledger.effective_hashes(full, settled.select("turn", "position", "h", "source_ids"), ["turn"]).select("source_id", F.array_join("hashes", ",").alias("hashes"))


@query("""select turn_id, attempt, profile, outcome from (select conv_id as turn_id, turn as attempt, role as profile, case when turn = 1 then 'conflict' else 'append' end as outcome, row_number() over (partition by conv_id, turn, role order by conv_id) as r from conversations where turn > 0) where r = 1""")
def request_audits(spark, sf_dir):
    """Audits of all messages after the first were unknown but those of turn 1, which had another tail; turn 0 is repeated."""
    c = src.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("turn_id"), F.col("turn").alias("attempt"), F.col("role").alias("profile"), F.md5(F.coalesce("text", F.lit(""))).alias("prefix_hash"), F.lit("t").alias("tail_hash"))
    keys = ("turn_id", "attempt", "profile")
    none = c.limit(0).select(*keys, F.lit("").alias("audit_hash"))
    first = ledger.audits(c.where("attempt = 0").unionByName(c.where("attempt = 1").withColumn("tail_hash", F.lit("other"))), none)
    return ledger.audits(c, first.select(*keys, "audit_hash")).select(*keys, "outcome")
