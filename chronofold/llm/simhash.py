"""Operator 3: SimHash near-duplicate detection by tiled exact comparison.

Distinct fingerprints are compared exactly, tile against tile, with numpy exclusive-or and bit counts. Two
fingerprints within the radius agree on at least one of ``radius + 1`` bit segments, so tiles are cut from
the fingerprints that share a segment's value, ordered by population count; tile pairs whose population
counts differ beyond the radius are skipped. Segment values held by more than ``tile_rows`` fingerprints
are spread over many tiles, and their tile pairs over many tasks. A comparison emits a spanning forest of
the links it finds, never all pairs, and the components of all forests are the groups.

Null and empty texts have fingerprint zero and are linked like any other; equal texts, repeated rows and
ties share a fingerprint and so a component. A null id never names a component if its group has another. Very long
texts are hashed whole, in slices; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import read_table, written
from .components import components

RADIUS = 3
SHINGLE = 3
TILE_ROWS = 4096
BLOCK = 512
CHUNK = 1 << 16
#: Near duplicates: hashes of a sketch, the chance to miss a similar pair.
SKETCH, MISS = 128, 1e-9


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, repeats included; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(words) - shingle + 1)


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: a bit is 1 if over half of the shingle hashes have it; 0 without words."""
    return _majority(shingles(text, shingle))


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp. One narrow stage over whole texts."""
    source = df.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray, out: list[tuple[int, int]]) -> np.ndarray:
    """Add to ``out`` pairs that connect what ``a``-``b`` connects beyond ``label``, nearest first; the new labels."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # Each greater label hooks onto one smaller label, so no cycle can close.
        high, first = np.unique(np.maximum(x, y), return_index=True)
        out += zip(a[first].tolist(), b[first].tolist(), strict=True)
        to = np.arange(len(label))
        to[high] = np.minimum(x, y)[first]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _within(left: np.ndarray, right: np.ndarray | None, radius: int, more: np.ndarray | None, both: int):
    """Arrays (a, b, bits) of the pairs within ``radius``, block by block; positions count through left, then right.

    Blocks are cut in order of population count, and block pairs whose counts differ beyond the radius are
    not compared.
    """
    own = right is None
    fps = left if own else np.concatenate([left, right])
    side = np.zeros(len(fps), bool)
    side[len(left) :] = True
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    fps, side = fps[order], side[order]
    more = None if more is None else more[order]
    pops = np.bitwise_count(fps).astype(np.int64)
    for i in range(0, len(fps), BLOCK):
        for j in range(i, len(fps), BLOCK):
            if pops[j] - pops[min(i + BLOCK, len(fps)) - 1] > radius:
                break
            apart = np.bitwise_count(fps[i : i + BLOCK, None] ^ fps[None, j : j + BLOCK])
            a, b = np.nonzero(apart <= radius)
            if i == j or not own:
                real = (a + i < b + j) & (own | (side[a + i] != side[b + j]))
                a, b = a[real], b[real]
            if len(a):
                bits = apart[a, b]
                if more is not None:
                    bits = bits + np.bitwise_count(more[a + i] ^ more[b + j])
                    a, b, bits = (x[bits <= both] for x in (a, b, bits))
                yield order[a + i], order[b + j], bits


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, more: np.ndarray | None = None, both: int = 128) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within ``radius``; right None compares the tile with itself.

    Positions in the result count through left, then right. With ``more``, second words of the fingerprints
    in the same positions, a pair must also differ in at most ``both`` bits of the two.
    """
    label, out = np.arange(len(left) + (0 if right is None else len(right))), []
    for a, b, bits in _within(left, right, radius, more, both):
        nearest = np.argsort(bits, kind="stable")
        label = _forest(label, a[nearest], b[nearest], out)
    return out


def _runs(batches, radius: int, node_type: pa.DataType):
    """Links among the rows (key, fp, node), sorted by key; a run of one key is bounded by the caller."""
    schema = pa.schema([("a", node_type), ("b", node_type)])
    held: list[pa.Table] = []

    def links(table: pa.Table):
        key, fps = table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        at = [(int(s) + x, int(s) + y) for s, e in zip(cuts[:-1], cuts[1:], strict=True) if e - s > 1 for x, y in tile_links(fps[s:e], None, radius)]
        nodes = table.column("node").combine_chunks()
        ends = [nodes.take(pa.array([p[k] for p in at], pa.int64())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
        key = table.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        held = [table.slice(last)]
        if last:
            yield links(table.slice(0, last))
    if held:
        yield links(pa.concat_tables(held))


def links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``nodes`` (fp distinct, node) -> (a, b): enough links to connect all that is within ``radius``."""
    segments = radius + 1
    edges = [64 * i // segments for i in range(segments + 1)]
    keys = F.array(*[F.lit(i << 58) + F.shiftrightunsigned(F.shiftleft("fp", 64 - e), 64 - e + s) for i, (s, e) in enumerate(zip(edges, edges[1:], strict=False))])
    rows = nodes.select("fp", "node", F.explode(keys).alias("key"), F.bit_count("fp").alias("pop"))
    kind = nodes.schema["node"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    node_type, schema = to_arrow_type(kind), f"a {kind.simpleString()}, b {kind.simpleString()}"
    hot = rows.groupBy("key").count().where(F.col("count") > tile_rows).select("key")
    n_hot = hot.count() if nodes.count() > tile_rows else 0
    if not n_hot:
        return rows.repartition("key").sortWithinPartitions("key").select("key", "fp", "node").mapInArrow(lambda b: _runs(b, radius, node_type), schema)
    hot = written(hot, "hot-segments", compact=True)
    cold = rows.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key").select("key", "fp", "node").mapInArrow(lambda b: _runs(b, radius, node_type), schema)
    # Hot values: bands of radius + 1 population counts, each cut by hash into tiles of about tile_rows.
    banded = rows.join(hot, "key", "left_semi").withColumn("band", F.floor(F.col("pop") / (radius + 1)).cast("int"))
    cuts = banded.groupBy("key", "band").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("cuts"))
    # The tile takes part in the grouping, so a band's rows are spread before they meet.
    cut = banded.join(cuts, ["key", "band"]).withColumn("tile", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("cuts")).cast("int"))
    tiles = cut.groupBy("key", "band", "tile").agg(F.collect_list(F.struct("fp", "node")).alias("rows"), F.first("cuts").alias("cuts"))
    tiles = written(tiles, "tiles")
    partners = tiles.select("key", "band", "tile", "cuts").join(cuts.select("key", F.col("band").alias("band2"), F.col("cuts").alias("cuts2")), "key").where("band2 = band or band2 = band + 1")
    pairs = partners.select("key", "band", "tile", "band2", F.explode(F.sequence(F.lit(0), F.col("cuts2") - 1)).alias("tile2")).where("band2 > band or tile2 >= tile")
    right = tiles.select("key", F.col("band").alias("band2"), F.col("tile").alias("tile2"), F.col("rows").alias("rows2"))
    both = pairs.join(tiles.drop("cuts"), ["key", "band", "tile"]).join(right, ["key", "band2", "tile2"])
    work = both.select(((F.col("band") == F.col("band2")) & (F.col("tile") == F.col("tile2"))).alias("own"), "rows.fp", F.col("rows.node").alias("node"), F.col("rows2.fp").alias("fp2"), F.col("rows2.node").alias("node2"))

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own, left, right = batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(3)[i].values
                nodes = batch.column(2)[i].values if own else pa.concat_arrays([batch.column(2)[i].values, batch.column(4)[i].values])
                found = tile_links(left.to_numpy().view(np.uint64), None if own else right.to_numpy().view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array([p[k] for p in found], pa.int64())) for k in (0, 1)], schema=pa.schema([("a", node_type), ("b", node_type)]))

    return cold.unionByName(work.mapInArrow(compare, schema))


def second(h: np.ndarray) -> np.ndarray:
    """Independent hashes out of hashes."""
    x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


class Measure:
    """When two shingle sets of sizes a, b with ``both`` in common count as similar."""

    def __init__(self, name: str, least: float):
        if name not in ("jaccard", "cosine") or not 0 < least <= 1:
            raise ValueError((name, least))
        self.name, self.least = name, least
        #: The least Jaccard similarity, and ratio of sizes, that a similar pair can have.
        self.ratio = least if name == "jaccard" else least * least

    def needed(self, a, b):
        """The least overlap; works on numbers and arrays."""
        x = (a + b) * (self.least / (1 + self.least)) if self.name == "jaccard" else np.sqrt(a * b * 1.0) * self.least
        return x - 1e-9 * (a + b)

    def in_sketch(self, size: int) -> int:
        """The least number of hashes that the sketch of a set of ``size`` has in common with a similar set's.

        A small set's sketch and its partners' are whole. Else the shared hashes among the k smallest of the
        union are in both sketches, and fewer of them than this come with a probability below ``MISS``.
        """
        if size <= self.ratio * SKETCH:
            return max(1, math.ceil(self.ratio * size - 1e-9))
        k, chance = min(size, SKETCH), 0.0
        for q in range(k + 1):
            chance += math.comb(k, q) * self.ratio**q * (1 - self.ratio) ** (k - q)
            if chance > MISS:
                return max(1, q)
        return k

    def load(self, payload) -> np.ndarray:
        return np.frombuffer(payload, np.uint64)

    def same(self, x: np.ndarray, y: np.ndarray) -> bool:
        return _overlap(x, y) >= self.needed(len(x), len(y))

    def forest(self, sets: list[np.ndarray], label: np.ndarray, own: int) -> list[tuple[int, int]]:
        """Pairs that connect all similar sets beyond what ``label`` connects; the first ``own`` sets meet the rest, or
        with ``own`` = all of them each other.

        Parity words are compared by exclusive-or and bit counts, block by block in the order of their population
        counts; block pairs whose counts differ by more than any similar pair of theirs may are skipped. What is
        left and not yet connected is compared as a set.
        """
        n = len(sets)
        sizes = np.array([len(x) for x in sets], np.int64)
        # Twice as many bits as members keep the words of unlike sets apart.
        bits = max(64, 1 << int(2 * sizes.max(initial=1) - 1).bit_length())
        words = np.array([parity(x, bits) for x in sets]).reshape(n, bits // 64)
        pops = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        side = np.arange(n) >= own
        order = np.argsort(pops, kind="stable")
        label, out = label.copy(), []
        for i in range(0, n, BLOCK):
            x = order[i : i + BLOCK]
            for j in range(i, n, BLOCK):
                y = order[j : j + BLOCK]
                most = sizes[x].max() + sizes[y].max()
                if pops[y[0]] - pops[x[-1]] > most - 2 * self.needed(sizes[x].min(), sizes[y].min()):
                    continue
                apart = np.zeros((len(x), len(y)), np.int32)
                for w in range(bits // 64):
                    apart += np.bitwise_count(words[x, w][:, None] ^ words[y, w][None])
                room = sizes[x][:, None] + sizes[y][None] - 2 * self.needed(sizes[x][:, None], sizes[y][None])
                ok = (apart <= room) & (label[x][:, None] != label[y][None])
                ok &= (np.arange(len(x))[:, None] < np.arange(len(y))[None]) if i == j else True
                if own < n:
                    ok &= side[x][:, None] != side[y][None]
                a, b = np.nonzero(ok)
                near = np.argsort(apart[a, b], kind="stable")
                for p, q in zip(x[a[near]].tolist(), y[b[near]].tolist(), strict=True):
                    if label[p] != label[q] and self.same(sets[p], sets[q]):
                        out.append((p, q))
                        label[label == max(label[p], label[q])] = min(label[p], label[q])
        return out


def _sets(df: DataFrame, shingle: int, keep: bool) -> DataFrame:
    """doc_id, text_hash and the text's shingle set.

    The set is digest, size, fp (SimHash of the distinct shingles) and low (its ``SKETCH`` smallest hashes), or
    with ``keep`` all hashes, sorted.
    """
    source = df.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), F.col("text").cast("string").alias("text"))
    kinds = {"hashes": pa.binary()} if keep else {"digest": pa.binary(), "size": pa.int64(), "fp": pa.int64(), "low": pa.list_(pa.int64())}

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(2):
                h = np.unique(shingles(t.as_py(), shingle))
                if keep:
                    rows.append((h.tobytes(),))
                else:
                    spread = np.partition(second(h), SKETCH)[:SKETCH] if len(h) > SKETCH else second(h)
                    rows.append((xxhash.xxh128_digest(h.tobytes()), len(h), _majority(h), spread.view(np.int64)))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "text_hash", *kinds])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, text_hash long, " + ("hashes binary" if keep else "digest binary, size long, fp long, low array<long>"))


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits, each the parity of the members that hash to it: two sets differ in at least as many members
    as their words differ in bits, whatever the sets."""
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, measure: str = "jaccard", few: int = blocks.FEW, tile_hashes: int = blocks.TILE_WEIGHT) -> DataFrame:
    """doc_id, text_hash, component_id, component_text: groups of texts whose sets of word shingles are similar.

    ``measure`` is "jaccard", or "cosine" (shared shingles by the geometric mean of the sizes, which is what SimHash
    estimates). Texts of one shingle set are one node. A set's sketch is its ``SKETCH`` smallest hashes; two similar
    sets have a known least number of them in common (``Measure.in_sketch``), so a pair shares one of the rarest
    hashes that each posts: all but that number less one, rarest first, and those of no other node need no post.
    Links are sought in four ways, each checked on the whole sets before it counts: SimHash fingerprints within
    ``RADIUS`` bits; of the nodes that post a hash each with the one among them whose hashes are shared most; all
    pairs of different groups that post a hash of at most ``few`` nodes; and, for hashes of more nodes, all their
    nodes of different groups, tile against tile by exclusive-or and bit counts (``Measure.forest``). A similar
    pair is missed with a probability below ``MISS`` and for no other reason. No step lists the pairs of a large group.

    Null and empty texts have one empty set and are copies of each other. Rows whose id is null have no
    component. Rows of one id with different texts are told apart by ``text_hash`` (xxhash64); a group is named by
    its least (doc_id, text_hash). Other columns are ignored.
    """
    test = Measure(measure, similarity)
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    rows = written(_sets(docs, shingle, False), "shingle-sketches")
    nodes = rows.groupBy(F.col("digest").alias("node")).agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_hash", "size", "fp", "low")).alias("first"))
    nodes = written(nodes.select("node", "copies", "first.*"), "nodes", compact=True)
    # 1. SimHash fingerprints.
    prints = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.join(prints, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = same.unionByName(links(prints.select("fp", F.col("first").alias("node"))))
    # 2. Sketch hashes that several nodes share; a node and the hashes it posts are one row.
    posts = nodes.select("node", "size", F.explode("low").alias("h"))
    total = nodes.agg(F.sum(F.size("low"))).first()[0] or 0
    shared, hot = blocks.shared_keys(posts, total)
    held = blocks.by_key(posts, shared, "h", hot).groupBy("node").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "h"))).alias("hs"))
    least = F.get(F.array(*[F.lit(test.in_sketch(n)) for n in range(SKETCH + 1)]), F.least("size", F.lit(SKETCH)).cast("int"))
    # The first places of the rarest go to hashes of no other node.
    room = F.size("hs") - least + 1
    held = written(held.where(room > 0).select("node", "size", F.slice("hs", F.lit(1), room).alias("hs")), "sharing-nodes", compact=True)
    pairs = written(pairs.unionByName(blocks.star(held, test, hot)).distinct(), "candidates", compact=True)
    ends = held.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    wanted = blocks.small(written(nodes.join(ends, "node").select("doc_id", "text_hash", "node"), "wanted", compact=True))
    texts = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).join(wanted.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_semi")
    if rows.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id", "text_hash"])
    sets = written(_sets(texts, shingle, True).join(wanted, ["doc_id", "text_hash"]).select("node", F.col("hashes").alias("payload")), "shingle-sets")
    good = written(blocks.verified(pairs, sets, test, total), "similar", compact=True)
    linked = blocks.connected(held, components(good), sets, test, hot, total, few, tile_hashes)
    n_rows = nodes.agg(F.sum("copies")).first()[0] or 0
    named = blocks.named(nodes.select("node", "doc_id", "text_hash"), linked, F.min(F.struct("doc_id", "text_hash")), n_rows)
    named = written(named.select(F.col("node").alias("digest"), F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("component_text")), "named", compact=True)
    often = nodes.where(F.col("copies") > blocks.hot_limit(n_rows)).select(F.col("node").alias("digest"))
    return blocks.by_key(rows.select("doc_id", "text_hash", "digest"), named, "digest", often).select("doc_id", "text_hash", "component_id", "component_text")


def groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs`` (doc_id, text)."""
    fps = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes", compact=True)
    linked = components(links(nodes.where(F.col("node").isNotNull()), radius, tile_rows))
    named = nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
