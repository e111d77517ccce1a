"""Operator 2: chat formatting by quotation linking.

A line's quote level is the number of ``>`` marks before it, and a passage is a run of lines of one level. A passage is
normalised (marks off, lower case, its lines joined, words) and hashed, and joined to the latest earlier message of the
conversation whose own text has the same words in a row; a passage of fewer than ``LEAST_WORDS`` words must be a whole
line there, so that an "ok" links to no sentence that holds the word. Of the outermost passages with a source, the
message with the most quoted words is the one answered, the later one on a tie; a message without a resolved passage
starts a thread. Conversations are then ordered by thread, and their text is what is left without quotes and without
the line that announces them.

The own words of a message are hashed in windows as long as the passages of its conversation, and the join is an
ordered scan per hash, so words that stand in very many messages add rows, never pairs. Only conversations with a
passage take part.

Null texts are empty; messages with a null conv_id are one conversation; repeated rows are kept, each with the same
links; messages with a null turn come first, answer nothing and are never answered. Very long messages are hashed
whole. Columns besides conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, read_table, written

MARKS = r"^(?:[ \t]*>)+"
#: A shorter passage must be a whole line of its source.
LEAST_WORDS = 4
#: How a quote is announced, in the languages of the corpus.
ANNOUNCED = r"(?i)^\s*(?:on|le|am|el)\b.{1,200}\b(?:wrote|a écrit|schrieb|escribió)\s*:\s*$"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def bare(line: Column) -> Column:
    return F.regexp_replace(line, MARKS + r"[ \t]?", "")


def words_of(text: Column) -> Column:
    """Normalised words."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, mid (hash of the row), own lines, passages (level, n, h), clean text, n_quotes, quote_depth."""
    m = messages.select("conv_id", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    m = m.withColumn("mid", F.xxhash64("conv_id", "turn", "role", "text")).withColumn("lines", F.split("text", r"\r?\n"))
    m = m.withColumn("levels", F.transform("lines", level))
    at = lambda i: F.get("levels", i)
    own = F.filter("lines", lambda line, i: (at(i) == 0) & ~(line.rlike(ANNOUNCED) & (F.coalesce(at(i + 1), F.lit(0)) > 0)))
    places = F.sequence(F.lit(0), F.size("levels") - 1)
    starts = F.filter(places, lambda i: (at(i) > 0) & ((i == 0) | (at(i - 1) != at(i))))
    # A passage ends before the next line of another level, or with the message.
    end = lambda i: F.coalesce(F.get(F.filter(places, lambda j: (j > i) & (at(j) != at(i))), F.lit(0)), F.size("levels"))
    text = lambda i: F.array_join(F.transform(F.slice("lines", i + 1, end(i) - i), bare), " ")
    passages = F.transform(starts, lambda i: F.struct(at(i).alias("level"), words_of(text(i)).alias("w")))
    clean = F.regexp_replace(F.regexp_replace(F.array_join("own", "\n"), r"^\s+|\s+$", ""), r"\n{3,}", "\n\n")
    hashed = F.transform(F.filter("passages", lambda p: F.size(p["w"]) > 0), lambda p: F.struct(p["level"].alias("level"), F.size(p["w"]).alias("n"), F.xxhash64(p["w"]).alias("h")))
    staged = m.withColumn("own", own).withColumn("passages", F.when(F.array_max("levels") > 0, passages))
    return staged.select("conv_id", "turn", "role", "mid", "own", F.coalesce(hashed, F.array().cast("array<struct<level:int,n:int,h:bigint>>")).alias("passages"), clean.alias("clean"), F.size(starts).cast("long").alias("n_quotes"), F.array_max("levels").alias("quote_depth"))


def answers(messages: DataFrame) -> DataFrame:
    """conv_id, mid, turn, reply_to (a turn) for messages with a resolved passage."""
    live = messages.where("turn is not null")
    lengths = written(live.select("conv_id", F.explode("passages.n").alias("n")).groupBy("conv_id").agg(F.collect_set("n").alias("lengths")), "passage-lengths", compact=True)
    quoting = live.alias("m").join(lengths.alias("q"), F.expr("m.conv_id <=> q.conv_id")).select("m.conv_id", "turn", "mid", "own", "passages", "lengths")
    asked = quoting.select("conv_id", "turn", "mid", F.explode("passages").alias("p")).select("conv_id", "turn", "mid", "p.level", "p.n", "p.h")
    words = quoting.select("conv_id", "turn", "own", words_of(F.array_join("own", " ")).alias("w"), F.explode("lengths").alias("n")).where(F.size("w") >= F.col("n"))
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda i: F.xxhash64(F.slice("w", i + 1, F.col("n"))))
    lines = F.transform(F.filter(F.transform("own", words_of), lambda w: F.size(w) == F.col("n")), lambda w: F.xxhash64(w))
    found = words.select("conv_id", "turn", "n", F.explode(F.array_distinct(F.when(F.col("n") < LEAST_WORDS, lines).otherwise(windows))).alias("h"))
    both = asked.unionByName(found.withColumns({"level": F.lit(0), "mid": F.lit(None).cast("long")}))
    # At one turn passages come before own words, so no message answers itself.
    earlier = Window.partitionBy("conv_id", "n", "h").orderBy("turn", F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    source = F.last(F.when(F.col("level") == 0, F.col("turn")), ignorenulls=True).over(earlier)
    linked = both.withColumn("source", source).where("level > 0 and source is not null and source < turn")
    votes = linked.groupBy("conv_id", "mid", "turn", "level", "source").agg(F.sum("n").alias("n"))
    best = F.min_by("source", F.struct("level", -F.col("n"), -F.col("source")))
    return votes.groupBy("conv_id", "mid", "turn").agg(best.alias("reply_to"))


def threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, thread (the turn that starts it) by pointer doubling over the answered turns."""
    current = written(replies.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("thread")), "threads", compact=True)
    for _ in range(64):
        up = current.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        joined = current.alias("c").join(up.alias("u"), F.expr("c.conv_id <=> u.conv_id and c.thread = u.thread"), "left")
        after = written(joined.select("c.conv_id", "turn", F.coalesce("above", F.col("c.thread")).alias("thread"), F.col("above").isNotNull().alias("moved")), "threads", compact=True)
        moved = after.where("moved").limit(1).count()
        dropped(current)
        current = after.drop("moved")
        if not moved:
            break
    return current


def conversations(messages: DataFrame) -> DataFrame:
    """Every message without quotes, with what it answers and its place in the reply order."""
    rows = parsed(messages)
    replies = written(answers(rows), "replies", compact=True)
    joined = rows.drop("own", "passages").alias("r").join(replies.alias("a"), F.expr("r.conv_id <=> a.conv_id and r.mid = a.mid"), "left").select("r.*", "reply_to")
    if replies.limit(1).count():
        joined = joined.alias("r").join(threads(replies).alias("t"), F.expr("r.conv_id <=> t.conv_id and r.turn = t.turn"), "left").select("r.*", "thread")
    else:
        joined = joined.withColumn("thread", F.lit(None).cast(rows.schema["turn"].dataType))
    thread = F.coalesce("thread", "turn")
    order = Window.partitionBy("conv_id").orderBy(thread.asc_nulls_first(), F.col("turn").asc_nulls_first(), "mid")
    return joined.select("conv_id", "turn", "role", F.col("clean").alias("text"), "n_quotes", "quote_depth", "reply_to", thread.alias("thread"), F.row_number().over(order).cast("long").alias("reply_order"))


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(read_table(spark, sf_dir, "conversations"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which every message quotes the one before it: what each answers, its thread and its own text."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    marked = F.array_join(F.transform(F.split(before, "\n"), lambda line: F.concat(F.lit("> "), line)), "\n")
    quoting = c.withColumn("text", F.when(before.isNotNull(), F.concat(F.lit("On Monday they wrote:\n"), marked, F.lit("\n"), F.col("text"))).otherwise(F.col("text")))
    return conversations(quoting).select("conv_id", "turn", "reply_to", "thread", F.md5("text").alias("text_md5"))


QUOTED_SQL = """
with c as (select conv_id, turn, coalesce(text, '') as text, lag(turn) over (partition by conv_id order by turn) as before, min(turn) over (partition by conv_id) as first from conversations)
select conv_id, turn, before as reply_to, first as thread, md5(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) as text_md5 from c
"""
