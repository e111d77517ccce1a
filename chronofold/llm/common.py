"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Separators of the plain-word rule: every ASCII character that is neither a digit nor a lower-case letter.
WORD_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where none is named (tests) is one set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jvm_dir.get() if jvm_dir.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        folder = "/tmp/chronofold-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Files of a table that is written for a later step, for each core: small partitions share one.
FILES_PER_CORE = 4


def written(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing.

    With ``compact`` the partitions of a wide shuffle go to a few files a core, for tables that are small beside it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.coalesce(max(8, FILES_PER_CORE * spark.sparkContext.defaultParallelism)) if compact else df
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z only, as the contracts ask; other letters keep their case."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def plain_words(text: Column) -> Column:
    """Words of the plain-word rule as an array; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_SEPARATORS), "")


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def added(df: DataFrame, text_col: str, carry: tuple[str, ...], names: tuple[str, ...], kinds: tuple, make, rows: int = 500) -> DataFrame:
    """``carry`` columns of ``df`` and new ones called ``names``, made out of the text. One narrow stage, no shuffle.

    ``make()`` is called once a task and returns a function from a list of at most ``rows`` texts to a list of tuples
    or to one Arrow array for each new column; ``kinds`` are pairs of an SQL and an Arrow type. Columns go by place,
    so no name of ``df`` can clash with one used inside.
    """
    columns = [F.col(f"`{c}`") for c in carry]
    # A text that is carried along is sent once.
    sent = text_col in carry and df.schema[text_col].dataType.simpleString() == "string"
    source = df.select(*columns, *[] if sent else [F.col(f"`{text_col}`").cast("string")])
    n, at_text = len(carry), carry.index(text_col) if sent else len(carry)
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(source.schema.fields[:n])] + [f"c{n + i} {kind}" for i, (kind, _) in enumerate(kinds)])

    def run(batches):
        of = make()
        # Small slices, so that what is made of a whole batch is never held together here or in the JVM.
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            made = of(batch.column(at_text).to_pylist())
            if not made or not isinstance(made[0], pa.Array):
                made = [pa.array([m[i] for m in made], kind) for i, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *made], [f"c{i}" for i in range(n + len(kinds))])

    return source.toDF(*[f"c{i}" for i in range(len(source.columns))]).mapInArrow(run, schema).toDF(*carry, *names)


class WordCache(dict):
    """A word -> value cache of at most ``2 * limit`` entries: when full, the older half goes.

    Values are pure functions of the word, so the cache changes speed, never results.
    """

    def __init__(self, compute, limit: int = 40_000, longest: int = 256):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value
