"""A versioned append log over Parquet with optimistic commits.

Every commit writes immutable files and then one manifest, which comes into being under its name in one step that
fails if the generation exists. Readers see the files of the manifests up to a generation, so a read is a snapshot, a
failed writer leaves only files that no manifest names, and of two writers one wins and the other reads again. A
manifest names what its commit added; every ``CHECKPOINT`` generations one names all files.

Tables that have the columns of a scope are laid out in ``BUCKETS`` folders by its hash, so a read of one scope lists
and scans one folder of each commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCOPE = ("tenant_id", "user_id", "domain_id")
BUCKET, BUCKETS = "scope_bucket", 64
CHECKPOINT = 16


class CommitConflict(RuntimeError):
    """Another writer committed the generation first."""


def bucket(tenant_id: Column, user_id: Column, domain_id: Column) -> Column:
    """The folder of a scope; of three literals a literal, so the scan is pruned."""
    return F.pmod(F.xxhash64(tenant_id, user_id, domain_id), F.lit(BUCKETS)).cast("int")


def shared_root(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; outside local mode the cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        folder = "/tmp/chronofold-shared"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


class LogStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, table: str, name: str = ""):
        return self._path(f"{self.root}/{table}/_manifests/{name}" if name else f"{self.root}/{table}/_manifests")

    def _generations(self, table: str) -> list[int]:
        folder = self._manifest(table)
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith("."))

    def generation(self, table: str) -> int:
        return (self._generations(table) or [0])[-1]

    def _entry(self, table: str, generation: int) -> dict:
        path = self._manifest(table, f"{generation:012d}.json")
        if not self._fs.exists(path):
            raise FileNotFoundError(f"{table} has no generation {generation}")
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _files(self, table: str, generation: int) -> list[str]:
        out: list[str] = []
        while generation:
            entry = self._entry(table, generation)
            out = [*entry["add"], *out]
            if entry["whole"]:
                break
            generation -= 1
        return out

    def _create(self, path, text: str) -> bool:
        """``path`` with its whole text, or False if it exists: one step, whoever else tries."""
        temporary = self._path(path.getParent(), f".{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if self._fs.getScheme() == "file":
                # A rename replaces its target here; a second name for a file does not.
                link, of = (jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (path, temporary))
                jvm.java.nio.file.Files.createLink(link, of)
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, path, options)
        except Exception as error:
            if not self._fs.exists(path):
                raise
            del error
            return False
        finally:
            self._fs.delete(temporary, False)
        return True

    def commit(self, table: str, rows: DataFrame, expected: int | None = None, replace: bool = False, by: tuple[str, ...] = ()) -> int:
        """Append (or replace by) ``rows``; with ``expected`` the commit holds only on that generation.

        ``by`` are columns whose values become folders; tables with a scope have its bucket without asking.
        """
        base = self.generation(table) if expected is None else expected
        folder = f"{self.root}/{table}/commit=c{uuid.uuid4().hex}"
        if by:
            rows.write.partitionBy(*by).parquet(folder)
        elif set(SCOPE) <= set(rows.columns):
            rows.withColumn(BUCKET, bucket(*map(F.col, SCOPE))).write.partitionBy(BUCKET).parquet(folder)
        else:
            rows.write.parquet(folder)
        whole = replace or not base or (base + 1) % CHECKPOINT == 0
        old = [] if replace or not base or not whole else self._files(table, base)
        self._fs.mkdirs(self._manifest(table))
        if not self._create(self._manifest(table, f"{base + 1:012d}.json"), json.dumps({"add": [*old, folder], "whole": whole})):
            self._fs.delete(self._path(folder), True)
            raise CommitConflict(f"{table} is beyond generation {base}")
        return base + 1

    def read(self, table: str, generation: int | None = None, scope: tuple[str, str, str] | None = None) -> DataFrame:
        """A generation's rows, the latest by default; of one scope, only its folders are read."""
        at = self.generation(table) if generation is None else generation
        if not at:
            raise FileNotFoundError(table)
        out = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.root}/{table}").parquet(*self._files(table, at)).drop("commit")
        if scope is not None and BUCKET in out.columns:
            out = out.where(F.col(BUCKET) == bucket(*map(F.lit, scope)))
            for name, value in zip(SCOPE, scope, strict=True):
                out = out.where(F.col(name) == value)
        return out.drop(BUCKET)

    def append_new(self, table: str, rows: DataFrame, key: str = "source_id", scope: tuple[str, ...] = ("tenant_id", "user_id", "domain_id", "conversation_id")) -> int:
        """Idempotent append: rows whose key is known are skipped; a key of another scope is an error."""
        rows = rows.dropDuplicates([key])
        base = self.generation(table)
        if not base:
            return self.commit(table, rows, 0)
        known = self.read(table, base).select(key, F.struct(*scope).alias("__owner"))
        foreign = rows.join(known, key).where(~F.struct(*scope).eqNullSafe(F.col("__owner"))).limit(1).count()
        if foreign:
            raise PermissionError("owned_by_another_namespace")
        return self.commit(table, rows.join(known, key, "left_anti"), base)

    def upsert(self, table: str, rows: DataFrame, key: str) -> int:
        """New versions of rows: row_version counts up; older versions stay in the log."""
        base = self.generation(table)
        if not base:
            return self.commit(table, rows.withColumn("row_version", F.lit(1).cast("long")), 0)
        last = self.read(table, base).groupBy(key).agg(F.max("row_version").alias("__v"))
        return self.commit(table, rows.join(last, key, "left").withColumn("row_version", F.coalesce("__v", F.lit(0)).cast("long") + 1).drop("__v"), base)

    def current(self, table: str, key: str) -> DataFrame:
        """The latest version of every row."""
        ranked = self.read(table).withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("row_version"))))
        return ranked.where("__r = 1").drop("__r")

    def forget(self, table: str, predicate) -> int:
        """Rewrite the table without the rows of a scope, all of their versions included.

        Once the new generation stands, the generations before it and their files are deleted: a read of one of
        them fails, and nothing of the scope is left in the folder.
        """
        base = self.generation(table)
        new = self.commit(table, self.read(table, base).where(~F.coalesce(predicate, F.lit(False))), base, replace=True)
        for old in self._generations(table):
            if old < new:
                self._fs.delete(self._manifest(table, f"{old:012d}.json"), False)
        self.sweep(table)
        return new

    def sweep(self, table: str) -> list[str]:
        """Delete data that no manifest names: what failed writers and forgotten generations left. No writer may be at work."""
        named = {self._path(f).getName() for g in self._generations(table) for f in self._entry(table, g)["add"]}
        gone = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.root}/{table}")) if s.getPath().getName().startswith("commit=") and s.getPath().getName() not in named]
        for path in gone:
            self._fs.delete(path, True)
        return [p.getName() for p in gone]

    def pending(self, table: str, index: str, key: str = "source_id") -> DataFrame:
        """Rows that the index table lacks: the outbox, derived instead of marked."""
        rows = self.read(table)
        return rows.join(self.read(index).select(key), key, "left_anti") if self.generation(index) else rows
