"""Cleaning a corpus end to end: language, toxicity, near duplicates, benchmark leaks, tokens.

Each stage reads what the one before it wrote. ``documents`` may have further columns; all but the last
stage return exactly the columns they got. Rows are only ever removed by a stage's own decision:
``language_id`` drops texts without a letter and texts that no language explains (more than
``MOST_PHRASES`` cross-parsing phrases per letter over at least ``LEAST_PHRASES`` phrases), ``toxicity`` drops
scores of 0.5 or more, ``near_duplicates`` keeps the smallest id of each group of texts whose sets of five-word shingles have a cosine
similarity of 0.8 or more (what SimHash estimates), ``decontamination`` drops
documents that hold ten consecutive words of a benchmark item, and ``bpe`` adds token ids.
Rows with a null id are judged on their text alone and are never called duplicates; of rows that repeat an
id and its text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import bpe, decontam, langid, simhash, toxicity
from chronofold.llm.common import crc_fold, read_table, written

MOST_PHRASES = 0.75
LEAST_PHRASES = 40
BROADCAST_IDS = 1_000_000


#: Arrow batches of the stages that run Python: two tasks' batches, in the JVM and in Python, stay small.
BATCH_BYTES = "8m"


def _frugal(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _small(df: DataFrame) -> DataFrame:
    """A written table of ids, broadcast only behind its row count."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name.lower() in map(str.lower, docs.columns):
        name = f"{name}_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _frugal(spark)
    model = langid.train(docs.where(crc_fold(F.col("doc_id")) != 0))
    letters = F.length(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[^\p{L}]", ""))
    if not model.names:
        return docs.where(letters > 0)
    lang, score, rate = (_unused(docs, f"found_{name}") for name in ("lang", "score", "rate"))
    found = langid.identify(docs, model, carry=tuple(docs.columns), names=(lang, score, rate))
    odd = (F.col(rate) > MOST_PHRASES) & (F.col(rate) * letters > LEAST_PHRASES)
    return found.where((F.col(lang) != "und") & ~odd).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _frugal(spark)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    name = _unused(docs, "toxic_score")
    return toxicity.score(docs, model, carry=tuple(docs.columns), name=name).where(F.col(name) < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _frugal(spark)
    groups = written(simhash.near_duplicates(docs, measure="cosine"), "groups", compact=True)
    copies = groups.where("doc_id <> component_id or text_hash <> component_text").select("doc_id", "text_hash").distinct()
    copies = _small(written(copies, "copies", compact=True))
    kept = docs.alias("d").join(copies.alias("c"), F.expr("d.doc_id = c.doc_id and xxhash64(coalesce(cast(d.text as string), '')) = c.text_hash"), "left_anti").select(*docs.columns)
    if not groups.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        return kept
    named = F.col("doc_id").isNotNull()
    return kept.where(named).dropDuplicates(["doc_id", "text"]).unionByName(kept.where(~named))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = written(decontam.contaminated(docs, read_table(spark, sf_dir, "benchmark")), "leaks", compact=True)
    known = docs.alias("d").join(_small(leaks).alias("l"), F.expr("d.doc_id <=> l.doc_id and xxhash64(cast(d.text as string)) = l.text_hash"), "left_anti")
    return known.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _frugal(spark)
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"))
    return bpe.encode_decode(docs, bpe.default_vocabulary(), keep_ids=True, carry=carry)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", encode),
]

#: Suffix automata, Viterbi decoding and SimHash have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
