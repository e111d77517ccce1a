"""Operator 9: copies of images by local descriptors.

Corners are the strongest places of their neighbourhood on several scales of a grey image, so their number grows
with the picture; each patch is turned by the direction of its intensity centroid, and 128 comparisons of smoothed
pixels make its descriptor. Two images are candidates if any two of their descriptors agree on the 48 bits of one
of four tables. Candidates have all their descriptors compared: those that differ in at most ``MOST_BITS`` bits vote
for a similarity transform (turn, scale, shift), and the images are linked when corners at ``LEAST_VOTES`` places and
at ``LEAST_SHARE`` of the places of the picture with fewer agree on one. Links make classes. A test measures the recall of the tables against comparing all pairs.

Equal images are one node, so exact copies add no pairs. Table entries are the keys of ``blocks.connected``: no
entry's pairs are listed but those of few images, and the images of crowded entries that are not one class yet are
compared tile against tile, each pair that meets in a table, so the size of an entry loses no link.

Null, broken and flat images and those too small for a patch have no corners and are linked to equal bytes only.
Images are raw grey (width, height, pixels) or binary PGM/PPM of any size. Repeated rows are classed each; rows
whose id is null are classed but name no class that has another id. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import read_table, written

SCALES = (1.0, 0.75, 0.5)
PATCH = 7
#: A corner is the strongest place within so many pixels of its scale.
APART = 4
#: Places that must agree, and their share of the places with corners of the picture that has fewer.
LEAST_VOTES, LEAST_SHARE = 4, 0.3
#: Images described at once.
BATCH = 128
SHIFT_BIN = 6.0
#: Corners of one square of so many pixels, which several scales may find, count once.
PLACE = 6.0
#: Descriptors of one corner differ in at most so many of their 128 bits.
MOST_BITS = 20
#: The tables: where in a descriptor the bytes of a key start, and how many there are.
TABLES, KEY_BYTES = (0, 3, 7, 10), 6

#: A corner: place, direction, scale it was found on, descriptor.
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "u1", (16,))])

#: 128 pairs of different points inside the patch, drawn once from a fixed seed.
_DRAWN = np.clip(np.rint(np.random.default_rng(20).normal(0, PATCH / 2.2, (192, 4))), -PATCH + 1, PATCH - 1).astype(np.float32)
TESTS = _DRAWN[(_DRAWN[:, :2] != _DRAWN[:, 2:]).any(axis=1)][:128]
_AXIS = np.arange(-PATCH, PATCH + 1)
_DISC = (_AXIS[:, None] ** 2 + _AXIS[None] ** 2 <= PATCH * PATCH).astype(np.float32)


def encode_pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return b"P5 %d %d 255\n" % (w, h) + np.clip(np.rint(image), 0, 255).astype(np.uint8).tobytes()


def decode(raw: bytes | None) -> np.ndarray | None:
    """Grey float image of a binary PGM or PPM; None if it is not one."""
    m = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", raw or b"")
    if not m:
        return None
    w, h, planes = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    body = np.frombuffer(raw, np.uint8, offset=m.end())
    if not w or not h or len(body) < w * h * planes:
        return None
    return body[: w * h * planes].reshape(h, w, planes).mean(axis=2, dtype=np.float32)


def resize(images: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, over the last two axes."""
    ih, iw = images.shape[-2:]
    y = np.clip((np.arange(h) + 0.5) * ih / h - 0.5, 0, ih - 1)
    x = np.clip((np.arange(w) + 0.5) * iw / w - 0.5, 0, iw - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, ih - 1), np.minimum(x0 + 1, iw - 1)
    fy, fx = (y - y0)[:, None].astype(np.float32), (x - x0)[None].astype(np.float32)
    at = lambda r, c: images[..., r, :][..., c]
    return (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy


def _blur(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(1, 1), (1, 1)], mode="edge")
    rows = p[..., :-2, :] + 2 * p[..., 1:-1, :] + p[..., 2:, :]
    return (rows[..., :-2] + 2 * rows[..., 1:-1] + rows[..., 2:]) / 16


def _greatest(a: np.ndarray, r: int) -> np.ndarray:
    """The maximum within ``r`` places on the last two axes."""
    for axis in (-1, -2):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r, r)
        a = np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, mode="edge"), 2 * r + 1, axis).max(axis=-1)
    return a


def describe(images: np.ndarray) -> list[np.ndarray]:
    """The corners (``POINT``) of each of ``images`` (number, height, width), in the image's own pixels."""
    found: list[list[np.ndarray]] = [[] for _ in images]
    for scale in SCALES:
        h, w = round(images.shape[1] * scale), round(images.shape[2] * scale)
        if min(h, w) < 2 * PATCH + 3:
            continue
        a = _blur(images if scale == 1.0 else resize(images, h, w))
        gy, gx = np.gradient(a, axis=(1, 2))
        xx, yy, xy = _blur(_blur(gx * gx)), _blur(_blur(gy * gy)), _blur(_blur(gx * gy))
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        peak = (r == _greatest(r, APART)) & (r > 1.0)
        peak[:, :PATCH] = peak[:, h - PATCH :] = peak[:, :, :PATCH] = peak[:, :, w - PATCH :] = False
        n, ys, xs = np.nonzero(peak)
        if not len(n):
            continue
        patches = a[n[:, None, None], ys[:, None, None] + _AXIS[None, :, None], xs[:, None, None] + _AXIS[None, None]] * _DISC
        angle = np.arctan2((patches * _AXIS[None, :, None]).sum((1, 2)), (patches * _AXIS[None, None]).sum((1, 2)))
        c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
        at = lambda i: a[n[:, None], np.clip(np.rint(ys[:, None] + s * TESTS[None, :, i] + c * TESTS[None, :, i + 1]).astype(int), 0, h - 1), np.clip(np.rint(xs[:, None] + c * TESTS[None, :, i] - s * TESTS[None, :, i + 1]).astype(int), 0, w - 1)]  # noqa: E731, B023
        points = np.zeros(len(n), POINT)
        points["x"], points["y"], points["scale"], points["angle"] = xs / scale, ys / scale, scale, angle
        points["bits"] = np.packbits(at(0) < at(2), axis=1)
        for i, part in zip(*_parts(n, points), strict=True):
            found[i].append(part)
    return [np.concatenate(f) if f else np.empty(0, POINT) for f in found]


def _parts(n: np.ndarray, points: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Rows of equal n (sorted) taken together."""
    cuts = np.flatnonzero(n[1:] != n[:-1]) + 1
    return n[np.concatenate([[0], cuts])].tolist(), np.split(points, cuts)


def words(points: np.ndarray) -> np.ndarray:
    """The distinct table entries of corners: ``KEY_BYTES`` of the descriptor and which table they are of."""
    bits = points["bits"].astype(np.int64)
    keys = [sum((bits[:, at + i] << 8 * i for i in range(KEY_BYTES)), np.int64(table) << 8 * KEY_BYTES) for table, at in enumerate(TABLES)]
    return np.unique(np.concatenate(keys))


def corners(images: DataFrame) -> DataFrame:
    """id, digest, n_corners, points (a packed array of ``POINT``), words for every row of images (id, image)."""
    kind = images.schema["id"].dataType

    def described(raws: list[bytes]) -> dict[bytes, np.ndarray]:
        """By digest, with images of one shape described together."""
        shaped: dict[tuple, dict[bytes, np.ndarray]] = {}
        out = {}
        for raw in raws:
            digest = hashlib.sha256(raw).digest()
            image = None if digest in out else decode(raw)
            if digest not in out:
                out[digest] = np.empty(0, POINT)
            if image is not None:
                shaped.setdefault(image.shape, {})[digest] = image
        for same in shaped.values():
            out.update(zip(same, describe(np.stack(list(same.values()))), strict=True))
        return out

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                raws = [raw or b"" for raw in part.column(1).to_pylist()]
                made = described(raws)
                digests = [hashlib.sha256(raw).digest() for raw in raws]
                points = [made[d] for d in digests]
                cols = [pa.array(digests, pa.binary()), pa.array([len(p) for p in points], pa.int64()), pa.array([p.tobytes() for p in points], pa.binary()), pa.array([words(p) for p in points], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["id", "digest", "n_corners", "points", "words"])

    return images.select("id", "image").mapInArrow(run, f"id {kind.simpleString()}, digest binary, n_corners long, points binary, words array<long>")


def _places(points: np.ndarray) -> int:
    return len(np.unique(points["x"] // PLACE * 65536 + points["y"] // PLACE))


class Copies:
    """Whether two images, as their corners, show the same: the test of ``blocks``."""

    ratio = 0.0

    def __init__(self, least_votes: int = LEAST_VOTES, most_bits: int = MOST_BITS):
        self.least_votes, self.most_bits = least_votes, most_bits

    def load(self, payload) -> np.ndarray:
        return np.frombuffer(payload, POINT)

    def same(self, x: np.ndarray, y: np.ndarray) -> bool:
        """Matched corners at enough places of x agree on one turn, scale and shift."""
        least = max(self.least_votes, LEAST_SHARE * min(_places(x), _places(y)))
        bits = [np.ascontiguousarray(e["bits"]).view(np.uint64).reshape(-1, 2) for e in (x, y)]
        apart = sum(np.bitwise_count(bits[0][:, None, k] ^ bits[1][None, :, k]) for k in (0, 1))
        a, b = np.nonzero(apart <= self.most_bits)
        if len(a) < least:
            return False
        p, q = x[a], y[b]
        turn, grow = q["angle"] - p["angle"], p["scale"] / q["scale"]
        c, s = grow * np.cos(turn), grow * np.sin(turn)
        dx, dy = (q["x"] - c * p["x"] + s * p["y"]) / SHIFT_BIN, (q["y"] - s * p["x"] - c * p["y"]) / SHIFT_BIN
        turn, grow = np.mod(turn, np.float32(2 * np.pi)) / 0.5, np.rint(np.log2(grow) * 2)
        # Two sets of bins, half a bin apart, so that no agreement falls on a border of both.
        for k in (0, 0.5):
            bins = np.unique(np.column_stack([np.floor(turn + k), grow, np.floor(dx + k), np.floor(dy + k), p["x"] // PLACE, p["y"] // PLACE]).astype(np.int64), axis=0)
            if np.unique(bins[:, :4], axis=0, return_counts=True)[1].max() >= least:
                return True
        return False

    def forest(self, items: list[np.ndarray], label: np.ndarray, own: int) -> list[tuple[int, int]]:
        """All pairs that meet in a table and are not yet connected are compared."""
        label, out = label.copy(), []
        entries = [words(x) for x in items]
        of = np.repeat(np.arange(len(items)), [len(e) for e in entries])
        keys = np.concatenate([*entries, np.empty(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        _, groups = _parts(keys[order], of[order]) if len(keys) else ([], [])
        seen: set[tuple[int, int]] = set()
        for group in groups:
            left, right = (group, group) if own == len(items) else (group[group < own], group[group >= own])
            for p in left.tolist():
                for q in right[(right > p) & (label[right] != label[p])].tolist():
                    if (p, q) in seen or label[p] == label[q]:
                        continue
                    seen.add((p, q))
                    if self.same(items[p], items[q]):
                        out.append((p, q))
                        label[label == max(label[p], label[q])] = min(label[p], label[q])
        return out


def copies(images: DataFrame, least_votes: int = LEAST_VOTES, few: int = blocks.FEW, tile_weight: int = blocks.TILE_WEIGHT) -> DataFrame:
    """id, class_id (the least id reachable), n_corners for every row of images (id, image)."""
    test = Copies(least_votes)
    rows = written(corners(images), "media-corners")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "n_corners", "points", "words")).alias("first")
    nodes = written(rows.groupBy(F.col("digest").alias("node")).agg(F.count("*").alias("copies"), first).select("node", "copies", "first.*"), "media-nodes", compact=True)
    posts = nodes.select("node", F.explode("words").alias("h"))
    sizes = nodes.agg(F.sum(F.size("words")), F.sum("copies")).first()
    total, n_rows = sizes[0] or 0, sizes[1] or 0
    shared, hot = blocks.shared_keys(posts, total)
    held = written(blocks.by_key(posts, shared, "h", hot).groupBy("node").agg(F.collect_list(F.struct("n", "h")).alias("hs")).join(nodes.select("node", F.col("n_corners").alias("size")), "node"), "media-shared", compact=True)
    payloads = nodes.select("node", F.col("points").alias("payload"))
    linked = blocks.starred(held, payloads, test, hot, total, "media")
    linked = blocks.connected(held, linked, payloads, test, hot, total, few, tile_weight)
    named = blocks.named(nodes.select("node", "id"), linked, F.min("id"), n_rows)
    named = written(named.select(F.col("node").alias("digest"), F.col("first").alias("class_id")), "media-classes", compact=True)
    often = nodes.where(F.col("copies") > blocks.hot_limit(n_rows)).select(F.col("node").alias("digest"))
    return blocks.by_key(rows.select("id", "digest", "n_corners"), named, "digest", often).select("id", "class_id", "n_corners")


#: Fixed patterns out of which vectors are drawn: seed, side of a picture, blurs that make them smooth.
DRAWN_SEED, DRAWN_SIDE, DRAWN_BLURS = 11, 64, 2


def patterns(n: int) -> np.ndarray:
    """``n`` fixed smooth random patterns; pattern i does not depend on n."""
    out = np.random.default_rng(DRAWN_SEED).normal(0, 1, (n, DRAWN_SIDE, DRAWN_SIDE)).astype(np.float32)
    for _ in range(DRAWN_BLURS):
        out = _blur(out)
    return out / out.std(axis=(1, 2), keepdims=True)


def render(vectors: list) -> list[bytes | None]:
    """Vectors as grey pictures: each value is the weight of a fixed pattern, so near vectors look alike and each
    place of a picture depends on all values. Null or empty: none."""
    known = [v is not None and len(v) > 0 for v in vectors]
    longest = max((len(v) for v, k in zip(vectors, known, strict=True) if k), default=0)
    flat = np.zeros((len(vectors), longest), np.float32)
    for row, v, k in zip(flat, vectors, known, strict=True):
        if k:
            row[: len(v)] = np.nan_to_num(np.asarray(v, np.float32), posinf=0.0, neginf=0.0)
    size = np.linalg.norm(flat, axis=1, keepdims=True)
    weights = flat / np.where(size > 0, size, 1)
    drawn = 127.5 + 48.0 * (weights @ patterns(longest).reshape(longest, -1)).reshape(-1, DRAWN_SIDE, DRAWN_SIDE) if longest else []
    return [encode_pgm(image) if k else None for image, k in zip(drawn, known, strict=True)] if longest else [None] * len(vectors)


def rendered(vectors: DataFrame) -> DataFrame:
    """id, image from vectors (id, vector): the corpus has no pictures, so its vectors are drawn."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8 * BATCH):
                part = batch.slice(at, 8 * BATCH)
                drawn = render([v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for v in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(drawn, pa.binary())], ["id", "image"])

    return vectors.select("id", "vector").mapInArrow(run, f"id {kind}, image binary")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return copies(rendered(vectors)).select(F.col("id").alias("vec_id"), "class_id", "n_corners")
