"""Operator 8: byte-level BPE encoding and decoding with a contiguous rank array per short word.

Each pre-token keeps its part ids and, beside them, the merge rank of every adjacent pair in one flat list.
The smallest rank is found by a scan, its right boundary is deleted, and the two neighbouring ranks are
refreshed. Pre-tokens above ``SHORT`` bytes use a heap over a linked list, which merges in the same order.

Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded each on its own,
and columns of the input other than the id and the text are never read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import WordCache, added, read_table

#: White space as the pre-tokenizer's regular expression engine has it.
_WS = r"\t-\r \x85\xa0  -     　"
#: The byte-level split of the public tokenizers (fixed value), with white space spelled out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
SHORT = 160
SLICE = 200
NONE = 1 << 30
DEFAULT_FILE = "byte_bpe_50k.json"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


class _Runs(Exception):
    """A space stands next to other white space."""


class RankArrayBpe:
    def __init__(self, spec: str, cache_limit: int = 60_000):
        data = json.loads(spec)
        vocab, alphabet = data["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.pieces = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.pieces.update({i: t.encode() for t, i in self.special.items()})
        by_byte = {p[0]: i for i, p in self.pieces.items() if len(p) == 1}
        self.byte_ids = [by_byte[b] for b in range(256)]
        self.pair_rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pair_rank.setdefault(vocab[left] << 20 | vocab[right], rank)
            self.merged.append(vocab[left + right])
        self.split = regex.compile(PATTERN).findall
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache = WordCache(self._packed, cache_limit)
        self.chunks = WordCache(self._spaced, cache_limit)

    def _packed(self, word: str) -> bytes:
        return array("I", self.merge(word.encode())).tobytes()

    def merge(self, word: bytes) -> list[int]:
        if len(word) > SHORT:
            return self._merge_long(word)
        rank_of, merged = self.pair_rank.get, self.merged
        parts = [self.byte_ids[b] for b in word]
        ranks = [rank_of(parts[i] << 20 | parts[i + 1], NONE) for i in range(len(parts) - 1)]
        while ranks and (best := min(ranks)) != NONE:
            at = ranks.index(best)
            parts[at] = merged[best]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << 20 | parts[at], NONE)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] << 20 | parts[at + 1], NONE)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        rank_of, n = self.pair_rank.get, len(word)
        part, right, left = [self.byte_ids[b] for b in word], [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank_of(part[i] << 20 | part[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j], right[i] = self.merged[rank], -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := rank_of(part[x] << 20 | part[y], NONE)) != NONE:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return [p for p in part if p >= 0]

    def _spaced(self, chunk: str) -> bytes:
        """Ids of a space and ``chunk``, which neither starts nor ends with white space."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Runs
        return b"".join(map(self.cache.__getitem__, self.split(" " + chunk)))

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        Single spaces always start a pre-token, so what lies between them can be looked up whole; a text
        in which a space meets other white space is split as a whole instead.
        """
        first, *rest = text.split(" ")
        if rest and first and not first[-1].isspace():
            try:
                return b"".join([*map(self.cache.__getitem__, self.split(first)), *map(self.chunks.__getitem__, rest)])
            except _Runs:
                pass
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if self.at_special is None or not any(t in text for t in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += [self._plain(text[at : m.start()]), array("I", [self.special[m.group()]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, array("I", packed))).decode("utf-8", "replace")


_LOADED: dict[str, RankArrayBpe] = {}


def load(spec: str) -> RankArrayBpe:
    """One tokenizer per Python worker and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = RankArrayBpe(spec)
    return _LOADED[key]


def encode_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode ``text_col``; ``vocabulary`` is a tokenizer file on the driver (a few MB, broadcast).

    ``carry`` columns stay; ``keep_ids`` adds the ids as an array. No shuffle.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    names = ("n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids)
    kinds = (("long", pa.int64()), ("string", pa.string()), ("string", pa.string()), *[("array<int>", pa.list_(pa.int32()))] * keep_ids)

    def make():
        bpe, sha = load(spec.value), hashlib.sha256

        def columns(texts: list[str | None]) -> list[pa.Array]:
            packed = [bpe.encode(t or "") for t in texts]
            decoded = [bpe.decode(p) for p in packed]
            cols = [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([sha(p).hexdigest() for p in packed]), pa.array([sha(t.encode()).hexdigest() for t in decoded])]
            if keep_ids:
                ends = pa.array([0, *accumulate(len(p) // 4 for p in packed)], pa.int32())
                cols.append(pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(packed))])))
            return cols

        return columns

    # Small slices, so that ids and texts of a whole batch are never held together.
    out = added(df, text_col, (id_col, *carry), names, kinds, make, SLICE)
    return out if id_col == "doc_id" else out.withColumnRenamed(id_col, "doc_id")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), default_vocabulary())
