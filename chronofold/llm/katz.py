"""Operator 7: scoring with a Katz back-off bigram model counted over the whole corpus.

P(w | h) is the Good-Turing discounted relative frequency of (h, w) if training text has it, else
alpha(h) P(w), where P(w) is the discounted unigram with the rest for unknown words, and alpha(h) is the
left-over mass of h divided by the unigram mass of the words never seen after h, so every context sums to
one exactly. A context whose counts leave nothing gets one more count in its denominator. A document is
its words and one end token; its first context is a start mark that is never predicted.

Documents are cut into blocks of at most ``BLOCK_BYTES`` of text. A block sends its distinct words and
bigrams with their training counts once to the buckets of the count tables (cut by key hash, so a frequent
word or pair is one entry a block, wherever it stands), gets the totals back, sends discounted sums per
context to the buckets of the context table, gets denominators and back-off weights back, and then scores
its tokens. All tables are Parquet in the shared folder; only counts of counts reach the driver. That is the whole
table scored against itself with bigrams; :func:`tables` stores a model of any order, which scores any text.

Null and empty texts are one end token. A null id counts as training by the checksum of the empty string.
Repeated rows count and are scored each. Very long texts are scored whole, in a block of their own if need be; columns
besides the id, the text and the fold are not read. Without training rows the model gives every token probability 1.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, ascii_lower, crc_fold, read_table, shared_dir, written

BLOCK_BYTES = 8_000_000
BUCKET_BYTES = 48_000_000
#: Good-Turing discounts counts up to this one.
TOP = 5
#: No word holds a line break.
END, START = (np.uint64(xxhash.xxh64_intdigest(b)) for b in (b"\n", b"\n\n"))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight together, which the shuffle compresses well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def gaps(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def ungaps(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, np.uint64), dtype=np.uint64)


def discounts(of: list[int]) -> np.ndarray:
    """Katz' factor for counts 0..TOP; ``of[r]`` is the number of n-grams with count r, up to TOP + 1.

    Where the counts of counts give no factor inside (0, 1), a count r is discounted by half a count.
    """
    d = np.ones(TOP + 1)
    cut = (TOP + 1) * of[TOP + 1] / of[1] if of[1] else 1.0
    for r in range(1, TOP + 1):
        x = ((r + 1) * of[r + 1] / (r * of[r]) - cut) / (1 - cut) if of[r] and cut < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


class Unigram:
    def __init__(self, total: int, of: list[int], mass: float):
        """``mass``: discounted count of all words."""
        self.d, self.total = discounts(of), total
        self.over = total if mass < total * (1 - 1e-12) else total + 1
        self.unknown = 1 - mass / self.over if total else 1.0


def discounted(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where(c > TOP, 1.0, d[np.minimum(c, TOP)]) * c


class Block:
    """Tokens of some documents as places in the block's sorted word hashes."""

    def __init__(self, vocab: np.ndarray, ids: np.ndarray, lens: np.ndarray, train: np.ndarray):
        self.vocab, self.ids, self.lens = vocab, ids, lens
        self.begin = np.cumsum(lens) - lens
        self.train = np.repeat(train, lens)
        at = int(np.searchsorted(vocab, START))
        # Contexts: the words with the start mark among them.
        self.contexts, up = np.insert(vocab, at, START), np.where(np.arange(len(vocab)) >= at, 1, 0)
        own = ids + up[ids]
        self.prev = np.empty_like(own)
        self.prev[1:] = own[:-1]
        self.prev[self.begin] = at
        self.pairs, self.first, self.pair = np.unique(mix(self.contexts[self.prev], vocab[ids]), return_index=True, return_inverse=True)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block, doc_ids, held, lens, vocab, ids, tokens from docs (doc_id, text, held)."""
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        cache = WordCache(xxhash.xxh64_intdigest, 300_000)
        held_rows: list[tuple] = []
        size = 0

        def flush():
            nonlocal held_rows, size, made
            hashes = np.concatenate([h for _, _, h in held_rows])
            vocab, ids = np.unique(hashes, return_inverse=True)
            lens = np.array([len(h) for _, _, h in held_rows], np.int32)
            row = [pa.array([task << 32 | made], pa.int64()), pa.array([[d for d, _, _ in held_rows]], pa.list_(arrow)), pa.array([[t for _, t, _ in held_rows]], pa.list_(pa.bool_())), pa.array([lens.tolist()], pa.list_(pa.int32())), pa.array([gaps(vocab)], pa.binary()), pa.array([planes(ids.astype(np.uint32))], pa.binary()), pa.array([len(ids)], pa.int64())]
            held_rows, size, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays(row, ["block", "doc_ids", "held", "lens", "vocab", "ids", "tokens"])

        for batch in batches:
            for doc_id, text, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode().lower()
                words = raw.split()
                h = np.empty(len(words) + 1, np.uint64)
                h[:-1] = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
                h[-1] = END
                held_rows.append((doc_id, held, h))
                size += len(raw)
                if size >= block_bytes:
                    yield flush()
        if held_rows:
            yield flush()

    return docs.select("doc_id", "text", "held").mapInArrow(run, f"block long, doc_ids array<{kind.simpleString()}>, held array<boolean>, lens array<int>, vocab binary, ids binary, tokens long")


def _load(row: dict) -> Block:
    lens, held = np.array(row["lens"], np.int64), np.array(row["held"], bool)
    return Block(ungaps(row["vocab"]), unplanes(row["ids"], np.uint32).astype(np.int64), lens, ~held)


def _counts(table: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, words, word_n, pairs, pair_n: a block's distinct keys with their training counts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = _load(row)
                word_n = np.bincount(b.ids[b.train], minlength=len(b.vocab)).astype(np.uint32)
                pair_n = np.bincount(b.pair[b.train], minlength=len(b.pairs)).astype(np.uint32)
                w, p = _cuts(b.vocab, buckets), _cuts(b.pairs, buckets)
                cols = [pa.array(range(buckets), pa.int32()), pa.array([row["block"]] * buckets, pa.int64())]
                for keys, n, cut in ((b.vocab, word_n, w), (b.pairs, pair_n, p)):
                    cols.append(pa.array([gaps(keys[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()))
                    cols.append(pa.array([planes(n[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "block", "words", "word_n", "pairs", "pair_n"])

    return table.select("block", "held", "lens", "vocab", "ids").mapInArrow(run, "bucket int, block long, words binary, word_n binary, pairs binary, pair_n binary")


def _sum_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Total of every entry's key, totals of distinct keys, and which entry owns its key (the first counted)."""
    every, n = np.concatenate(keys), np.concatenate(counts)
    distinct, back = np.unique(every, return_inverse=True)
    total = np.bincount(back, weights=n, minlength=len(distinct)).astype(np.int64)
    counted = np.flatnonzero(n)
    own = np.zeros(len(every), bool)
    own[counted[np.unique(back[counted], return_index=True)[1]]] = True
    return total[back], total, own


def _of(total: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)[: TOP + 2].tolist()


_TOTALS = "block long, bucket int, word_n binary, pair_n binary, own binary, word_of array<long>, pair_of array<long>, tokens long, words long"


def _totals(counts: DataFrame) -> DataFrame:
    """Per block and bucket the totals in the block's key order; a row of block -1 holds a bucket's statistics."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words, pairs = [ungaps(r["words"]) for r in rows], [ungaps(r["pairs"]) for r in rows]
        wt, word_total, _ = _sum_up(words, [unplanes(r["word_n"], np.uint32) for r in rows])
        pt, pair_total, own = _sum_up(pairs, [unplanes(r["pair_n"], np.uint32) for r in rows])
        w, p = np.cumsum([0, *map(len, words)]), np.cumsum([0, *map(len, pairs)])
        out = [{"block": r["block"], "bucket": r["bucket"], "word_n": planes(wt[w[i] : w[i + 1]]), "pair_n": planes(pt[p[i] : p[i + 1]]), "own": np.packbits(own[p[i] : p[i + 1]]).tobytes()} for i, r in enumerate(rows)]
        out.append({"block": -1, "bucket": rows[0]["bucket"], "word_of": _of(word_total), "pair_of": _of(pair_total), "tokens": int(word_total.sum()), "words": int((word_total > 0).sum())})
        kinds = {"block": pa.int64(), "bucket": pa.int32(), "word_n": pa.binary(), "pair_n": pa.binary(), "own": pa.binary(), "word_of": pa.list_(pa.int64()), "pair_of": pa.list_(pa.int64()), "tokens": pa.int64(), "words": pa.int64()}
        return pa.table({k: pa.array([r.get(k) for r in out], t) for k, t in kinds.items()})

    return counts.groupBy("bucket").applyInArrow(run, _TOTALS)


class Model:
    """The few numbers that all blocks need."""

    def __init__(self, tokens: int, words: int, word_of: list[int], pair_of: list[int]):
        self.tokens, self.words = tokens, words
        d = discounts(word_of)
        low = sum(r * word_of[r] for r in range(1, TOP + 1))
        mass = tokens - low + sum(d[r] * r * word_of[r] for r in range(1, TOP + 1))
        self.unigram, self.pair_d = Unigram(tokens, word_of, mass), discounts(pair_of)

    def p_word(self, c: np.ndarray) -> np.ndarray:
        u = self.unigram
        return np.where(c > 0, discounted(u.d, c) / max(u.over, 1), u.unknown)


def _back(rows: list[dict], b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's totals over all buckets: of its words, of its pairs, and which pairs it owns."""
    rows = sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["bucket"])
    word_n, pair_n = (np.concatenate([unplanes(r[k], np.int64) for r in rows]) for k in ("a", "b"))
    own, at = np.zeros(len(b.pairs), bool), 0
    for r in rows:
        n = len(r["b"]) // 8
        own[at : at + n] = np.unpackbits(np.frombuffer(r["c"], np.uint8), count=n)
        at += n
    return word_n, pair_n, own


def _rows(table: DataFrame, totals: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Everything that belongs to a block: kind 0 its tokens, 1 its totals, 2 its contexts' weights."""
    none = F.lit(None)
    bucketed = lambda df, kind, *cols: df.select("block", F.lit(kind).alias("kind"), "bucket", *(F.col(c).alias(n) for c, n in zip(cols, "abc", strict=False)), *(none.cast("binary").alias(n) for n in "abc"[len(cols) :]), *(F.lit(None).cast(table.schema[n].dataType).alias(n) for n in ("doc_ids", "held", "lens", "vocab", "ids")))
    out = table.select("block", F.lit(0).alias("kind"), F.lit(-1).alias("bucket"), *(none.cast("binary").alias(n) for n in "abc"), "doc_ids", "held", "lens", "vocab", "ids")
    out = out.unionByName(bucketed(totals, 1, "word_n", "pair_n", "own"))
    return out if weights is None else out.unionByName(bucketed(weights, 2, "over", "alpha"))


def _context_sums(table: DataFrame, totals: DataFrame, model: Model, buckets: int) -> DataFrame:
    """bucket, block, contexts, and per context the owned pairs' counts, discounted counts and unigram mass."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        row = next(r for r in rows if r["kind"] == 0)
        b = _load(row)
        word_n, pair_n, own = _back(rows, b)
        at = b.first[own]
        context, c, n = b.prev[at], pair_n[own], len(b.contexts)
        sums = [np.bincount(context, weights=x, minlength=n) for x in (c, discounted(model.pair_d, c), model.p_word(word_n[b.ids[at]]))]
        cut = _cuts(b.contexts, buckets)
        cols = {"bucket": pa.array(range(buckets), pa.int32()), "block": pa.array([row["block"]] * buckets, pa.int64())}
        cols["contexts"] = pa.array([gaps(b.contexts[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
        for name, x in zip(("n", "kept", "seen"), sums, strict=True):
            cols[name] = pa.array([planes(x[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
        return pa.table(cols)

    return _rows(table, totals, None).groupBy("block").applyInArrow(run, "bucket int, block long, contexts binary, n binary, kept binary, seen binary")


def backoff(n: np.ndarray, kept: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and back-off weight of contexts; one never seen backs off with weight 1."""
    over = np.where(kept < n * (1 - 1e-12), n, n + 1)
    alpha = np.where(n > 0, (1 - kept / np.maximum(over, 1)) / np.maximum(1 - seen, 1e-300), 1.0)
    return over, alpha


def _weights(sums: DataFrame) -> DataFrame:
    """block, bucket, over, alpha in the block's context order."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        contexts = [ungaps(r["contexts"]) for r in rows]
        _, back = np.unique(np.concatenate(contexts), return_inverse=True)
        n, kept, seen = (np.bincount(back, weights=np.concatenate([unplanes(r[k], np.float64) for r in rows])) for k in ("n", "kept", "seen"))
        over, alpha = (x[back] for x in backoff(n, kept, seen))
        cut = np.cumsum([0, *map(len, contexts)])
        slices = lambda x: pa.array([planes(x[cut[i] : cut[i + 1]]) for i in range(len(rows))], pa.binary())
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "over": slices(over), "alpha": slices(alpha)})

    return sums.groupBy("bucket").applyInArrow(run, "block long, bucket int, over binary, alpha binary")


def _scores(table: DataFrame, totals: DataFrame, weights: DataFrame, model: Model) -> DataFrame:
    kind = table.schema["doc_ids"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        row = next(r for r in rows if r["kind"] == 0)
        b = _load(row)
        word_n, pair_n, _ = _back(rows, b)
        ordered = sorted((r for r in rows if r["kind"] == 2), key=lambda r: r["bucket"])
        over, alpha = (np.concatenate([unplanes(r[k], np.float64) for r in ordered]) for k in ("a", "b"))
        back = np.log10(model.p_word(word_n))[b.ids] + np.log10(alpha)[b.prev]
        c = pair_n[b.pair]
        seen = np.log10(np.maximum(discounted(model.pair_d, c), 1e-300) / np.maximum(over[b.prev], 1))
        per_doc = lambda x: np.add.reduceat(x, b.begin)
        base = np.log10((word_n + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
        made = {"doc_id": pa.array(row["doc_ids"], arrow), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(b.lens, pa.int64())}
        made |= {"n_known": pa.array(per_doc((word_n > 0)[b.ids].astype(np.int64)), pa.int64()), "train_tokens": pa.array([model.tokens] * len(b.lens), pa.int64())}
        return pa.table(made | {"base_score": pa.array(per_doc(base[b.ids])), "score": pa.array(per_doc(np.where(c > 0, seen, back)))})

    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _rows(table, totals, weights).groupBy("block").applyInArrow(run, schema)


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Score every row of docs (doc_id, text, held); rows with held false are the training text."""
    spark = docs.sparkSession
    table = written(blocks(docs, block_bytes), "katz-blocks")
    tokens = table.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(tokens * 8 / bucket_bytes))
    counted = written(_totals(_counts(table, buckets)), "katz-totals")
    stats = counted.where("block = -1")
    of = {k: [0] * (TOP + 2) for k in ("word_of", "pair_of")}
    for k in of:
        for r in stats.select(F.posexplode(k).alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect():
            of[k][r["r"]] = r["n"]
    whole = stats.agg(F.sum("tokens"), F.sum("words")).first()
    model, totals = Model(whole[0] or 0, whole[1] or 0, of["word_of"], of["pair_of"]), counted.where("block >= 0")
    weights = written(_weights(_context_sums(table, totals, model, buckets)), "katz-weights")
    return _scores(table, totals, weights, model)


class Tables:
    """A Katz model of any order as stored tables, which score any text.

    ``grams`` (order, gram, p) has the discounted probability of every n-gram of the training text, ``contexts``
    (order, context, alpha) the back-off weight of every history; both lie in folders by order and by a hash of their
    key. An n-gram's key is the hash of its words. Scoring goes down the orders: an n-gram that the model has gives its
    probability, else the weight of its history (1 if it was never seen) times that of the next shorter one.
    """

    def __init__(self, spark: SparkSession, path: str, order: int, unknown: float):
        self.spark, self.path, self.order, self.unknown = spark, path, order, unknown

    def table(self, name: str, order: int) -> DataFrame:
        schema = {"grams": "gram long, p double", "contexts": "context long, alpha double"}[name]
        return self.spark.read.schema(f"{schema}, order int, bucket int").parquet(f"{self.path}/{name}").where(F.col("order") == order).drop("order", "bucket")

    def score(self, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``id_col``, n_tokens and score (log10 probability) of each row; rows that repeat an id are one text each."""
        rows = texts.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col), F.col(text_col).alias("text"))
        rows = written(rows, "katz-texts")
        left = _tokens(rows.select("__row", "text"), self.order).withColumns({"lp": F.lit(None).cast("double"), "weight": F.lit(0.0)})
        for k in range(self.order, 0, -1):
            grams = self.table("grams", k).select(F.col("gram").alias(f"g{k}"), F.log10("p").alias("found"))
            left = left.join(grams, f"g{k}", "left").withColumn("lp", F.coalesce("lp", F.col("weight") + F.col("found"))).drop("found")
            if k > 1:
                contexts = self.table("contexts", k).select(F.col("context").alias(f"c{k}"), F.log10("alpha").alias("back"))
                left = left.join(contexts, f"c{k}", "left").withColumn("weight", F.col("weight") + F.coalesce("back", F.lit(0.0))).drop("back")
        value = F.coalesce("lp", F.col("weight") + math.log10(self.unknown) if self.unknown else F.lit(float("-inf")))
        sums = left.groupBy("__row").agg(F.count("*").alias("n_tokens"), F.sum(value).alias("score"))
        return rows.join(sums, "__row").select(id_col, "n_tokens", "score")


def _tokens(texts: DataFrame, order: int) -> DataFrame:
    """One row a token: __row, g1..gn (its n-grams' keys), c2..cn (their histories' keys)."""
    low = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    padded = F.concat(F.array(*[F.lit("\n\n")] * (order - 1)), words, F.array(F.lit("\n"))) if order > 1 else F.concat(words, F.array(F.lit("\n")))
    rows = texts.select("__row", padded.alias("w")).select("__row", "w", F.explode(F.sequence(F.lit(order), F.size("w"))).alias("end"))
    part = lambda size, end: F.xxhash64(F.slice("w", end - size + 1, F.lit(size)))
    return rows.select("__row", *[part(k, F.col("end")).alias(f"g{k}") for k in range(1, order + 1)], *[part(k - 1, F.col("end") - 1).alias(f"c{k}") for k in range(2, order + 1)])


def _factors(counts: DataFrame) -> F.Column:
    """The discounted count of column c; counts of counts are at most ``TOP`` + 1 rows on the driver."""
    of = [0] * (TOP + 2)
    for r in counts.where(F.col("c") <= TOP + 1).groupBy("c").count().collect():
        of[r["c"]] = r["count"]
    d = discounts(of).tolist()
    return F.col("c") * F.when(F.col("c") <= TOP, F.get(F.array(*map(F.lit, d)), F.col("c").cast("int"))).otherwise(1.0)


def tables(docs: DataFrame, order: int = 3, path: str | None = None, buckets: int = 64) -> Tables:
    """Count and store a model of ``order`` over the texts of ``docs`` (text); each order costs two shuffles of its n-grams."""
    path = path or f"{shared_dir(docs.sparkSession)}/katz-model-{uuid.uuid4().hex}"
    save = lambda df, name, key, k: df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).withColumn("order", F.lit(k)).write.mode("append").partitionBy("order", "bucket").parquet(f"{path}/{name}")
    tokens = written(_tokens(docs.select(F.lit(0).alias("__row"), "text"), order).drop("__row"), "katz-tokens")
    unknown, below = 1.0, None
    for k in range(1, order + 1):
        keys = [f"g{k}", *([f"g{k - 1}", f"c{k}"] if k > 1 else [])]
        counts = written(tokens.groupBy(*keys).agg(F.count("*").alias("c")), "katz-counts")
        counts = counts.withColumn("kept", _factors(counts))
        if k == 1:
            total = counts.agg(F.sum("c").alias("n"), F.sum("kept").alias("kept")).first()
            n, kept = total["n"] or 0, total["kept"] or 0.0
            over = n if kept < n * (1 - 1e-12) else n + 1
            unknown = 1 - kept / over if n else 1.0
            probable = counts.select(F.col("g1").alias("gram"), (F.col("kept") / over).alias("p"))
        else:
            joined = counts.join(below.select(F.col("gram").alias(f"g{k - 1}"), F.col("p").alias("lower")), f"g{k - 1}")
            sums = joined.groupBy(f"c{k}").agg(F.sum("c").alias("n"), F.sum("kept").alias("all"), F.sum("lower").alias("seen"))
            sums = written(sums.withColumn("over", F.when(F.col("all") < F.col("n") * (1 - 1e-12), F.col("n")).otherwise(F.col("n") + 1)), "katz-contexts")
            save(sums.select(F.col(f"c{k}").alias("context"), ((1 - F.col("all") / F.col("over")) / F.greatest(1 - F.col("seen"), F.lit(1e-300))).alias("alpha")), "contexts", "context", k)
            probable = counts.join(sums.select(f"c{k}", "over"), f"c{k}").select(F.col(f"g{k}").alias("gram"), (F.col("kept") / F.col("over")).alias("p"))
        below = written(probable, "katz-grams")
        save(below, "grams", "gram", k)
    return Tables(docs.sparkSession, path, order, unknown)


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", F.col("text").cast("string").alias("text"), (crc_fold(F.col("doc_id")) == 1).alias("held")))


def katz_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_katz that SQL can express, with a fold that SQL can express."""
    docs = read_table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", F.col("text").cast("string").alias("text"), (F.col("doc_id") % 5 == 1).alias("held")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


BASE_SQL = """
with d as (select doc_id, doc_id % 5 = 1 as held_out, list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), chr(10)) as w from documents),
t as (select doc_id, held_out, unnest(w) as w from d), c as (select w, count(*) as c from t where not held_out group by 1), s as (select coalesce(sum(c), 0) as n, count(*) as v from c)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, cast(any_value(n) as bigint) as train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 4) as base_score
from t left join c using (w), s group by 1, 2
"""


def brute_force(docs: list[tuple[str | None, bool]]) -> list[tuple[int, int, int, float, float]]:
    """(n_tokens, n_known, train_tokens, base, score) of each (text, held) by plain dictionaries, for tests."""
    seqs = [[*(t or "").encode().lower().split(), "end"] for t, _ in docs]
    words, pairs = Counter(), Counter()
    for s, (_, held) in zip(seqs, docs, strict=True):
        if not held:
            words.update(s)
            pairs.update(zip(["start", *s], s, strict=False))
    total = sum(words.values())
    of = lambda c: [sum(n == r for n in c.values()) for r in range(TOP + 2)]
    dw, dp = discounts(of(words)), discounts(of(pairs))
    cut = lambda d, n: (d[n] if n <= TOP else 1.0) * n
    mass = sum(cut(dw, n) for n in words.values())
    over_words = total if mass < total * (1 - 1e-12) else total + 1
    p = lambda w: cut(dw, words[w]) / over_words if words[w] else (1 - mass / over_words if total else 1.0)
    after: dict = {}
    for (h, w), n in pairs.items():
        after.setdefault(h, {})[w] = n

    def prob(h, w):
        if h not in after:
            return p(w)
        n, kept = sum(after[h].values()), sum(cut(dp, x) for x in after[h].values())
        over = n if kept < n * (1 - 1e-12) else n + 1
        if w in after[h]:
            return cut(dp, after[h][w]) / over
        return (1 - kept / over) / (1 - sum(map(p, after[h]))) * p(w)

    base = lambda w: math.log10((words[w] + 0.5) / (total + 0.5 * (len(words) + 1)))
    return [(len(s), sum(words[w] > 0 for w in s), total, sum(map(base, s)), sum(math.log10(prob(h, w)) for h, w in zip(["start", *s], s, strict=False))) for s in seqs]
