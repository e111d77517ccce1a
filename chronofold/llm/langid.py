"""Operator 1: language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled running text. A text (letters in lower case, all else
one space) is parsed from left to right into the longest matches that the automaton offers, across words; a
character that the language never had is a phrase of its own. A phrase costs the logarithm of the labelled text's
length, so phrases times that are the text's cross-entropy in bits; the language with the fewest wins, ties go to
the one with more labelled rows, then to the smaller name. Texts are parsed in pieces of ``PIECE`` characters, many
at once, which adds at most one phrase a piece for every language alike.

Training reads a bounded sample: about ``docs_per_language`` rows of each language, taken by a hash of the id, cut
into pieces of ``PIECE`` characters; ``pieces_per_language`` of these, wherever they stand, make the automaton, and
snippets of as many others fit the one number that turns bits into a probability. Every language takes part.

Null and letterless texts are ``und`` with score 0, and so is every text if there are no labelled rows. Very long
texts are parsed whole. Repeated rows are scored each on its own. Any further columns may be carried along, under
any name; the result's names are arguments.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import added, crc_fold, read_table

DOCS_PER_LANGUAGE = 400
PIECES_PER_LANGUAGE = 64
PIECE = 1000
#: Characters of a snippet on which the score is fitted, and the scales to choose from.
SNIPPET = 40
SCALES = (1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05)
#: Characters parsed at once.
AT_ONCE = 1_000_000
OTHER = re.compile(r"[\W\d_]+")


def running(text: str | None) -> str:
    """Letters in lower case, everything else one space; empty if there is no letter."""
    bare = OTHER.sub(" ", (text or "").lower())
    return "" if not bare or bare.isspace() else bare


class SuffixAutomaton:
    """Of some texts: a walk from state 0 spells exactly the strings that stand in one of them."""

    def __init__(self, texts):
        self.next: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        for text in texts:
            last = 0
            for c in text:
                last = self._extend(last, c, link, length)

    def _extend(self, last: int, c: str, link: list[int], length: list[int]) -> int:
        nxt = self.next
        if (q := nxt[last].get(c)) is not None:
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, c, link, length)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c, link, length)
        return cur

    def _clone(self, p: int, q: int, c: str, link: list[int], length: list[int]) -> int:
        nxt, new = self.next, len(self.next)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new


class CrossParser:
    """The automata of all languages in arrays, stepped for many pieces of text at once.

    From a state goes on character c to ``to[at]``, if ``owner[at]`` is the state, for ``at = base[state] + c``.
    A state with one transition takes one place, one with several a place for every character.
    """

    def __init__(self, languages: list[tuple[str, list[str]]]):
        """``languages``: name and texts, as :func:`running` makes them, in the order in which ties go."""
        self.names = [name for name, _ in languages]
        self.cost = np.log2([max(2, sum(map(len, texts))) for _, texts in languages])
        self.scale, self.most = 1.0, 1.0
        letters = sorted({c for _, texts in languages for t in texts for c in t})
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        wide, free = len(letters) + 1, len(letters) + 1
        base, to, owner, first = [], [], [], []
        for _, texts in languages:
            states, zero = SuffixAutomaton(texts).next, len(base)
            first.append(zero)
            for s, moves in enumerate(states, zero):
                coded = [(int(self.code[ord(c)]), zero + q) for c, q in moves.items()]
                base.append(free - coded[0][0] if len(coded) == 1 else free)
                row = [-1] * (1 if len(coded) == 1 else wide if coded else 0)
                for c, q in coded:
                    row[c if len(row) > 1 else 0] = q
                to += row
                owner += [s] * len(row)
                free += len(row)
        ends = [-1] * wide
        self.base, self.root = np.array(base, np.int32), np.array(first, np.int32)
        self.to, self.owner = (np.array(ends + x + ends, np.int32) for x in (to, owner))

    def _step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after ``c``, -1 where no text goes on so."""
        at = self.base.take(state) + c
        return np.where(self.owner.take(at) == state, self.to.take(at), -1)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text in each language."""
        ids = self.code.take(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)).astype(np.int32)
        sizes = np.array([len(t) for t in texts], np.int64)
        pieces = -(-sizes // PIECE)
        of = np.repeat(np.arange(len(texts)), pieces)
        place = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(sizes) - sizes, pieces) + place * PIECE
        long = np.minimum(sizes[of] - place * PIECE, PIECE)
        order = np.argsort(-long, kind="stable")
        start, long, of = start[order], long[order], of[order]
        n = len(self.names)
        root = np.tile(self.root, len(of))
        state, count = root.copy(), np.zeros(len(root), np.int32)
        for t in range(int(long.max(initial=0))):
            k = int(np.searchsorted(-long, -t, "left")) * n
            c = np.repeat(ids.take(start[: k // n] + t), n)
            after = self._step(state[:k], c)
            lost = np.flatnonzero(after < 0)
            if len(lost):
                begun = root.take(lost)
                again = self._step(begun, c.take(lost))
                count[lost] += (state.take(lost) != begun).astype(np.int32) + (again < 0)
                after[lost] = np.where(again < 0, begun, again)
            state[:k] = after
        count += state != root
        out = np.zeros((len(texts), n), np.int64)
        np.add.at(out, of, count.reshape(-1, n))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score, phrases per letter of each text."""
        bare = [running(t) for t in texts]
        out: list[tuple[str, float, float]] = []
        for at, end in _batches([len(t) for t in bare]):
            part = bare[at:end]
            if not self.names:
                out += [("und", 0.0, 0.0)] * len(part)
                continue
            found = self.phrases(part)
            bits = found * self.cost
            best = bits.argmin(axis=1)
            apart = bits - bits[np.arange(len(part)), best][:, None]
            score = np.minimum(self.most, 1 / np.exp2(-self.scale * np.minimum(apart, 1000)).sum(axis=1))
            for text, b, s, row in zip(part, best.tolist(), score.tolist(), found, strict=True):
                out.append((self.names[b], s, float(row[b]) / (len(text) - text.count(" "))) if text else ("und", 0.0, 0.0))
        return out

    def fit(self, snippets: list[tuple[str, str]]) -> None:
        """Fit the scale of the score to (language, text) that the automata have not seen; n of them allow n + 1 in n + 2."""
        snippets = [(name, bare) for name, t in snippets if name in self.names and (bare := running(t))]
        self.most = (len(snippets) + 1) / (len(snippets) + 2)
        if not snippets:
            return
        bits = self.phrases([t for _, t in snippets]) * self.cost
        bits -= bits.min(axis=1, keepdims=True)
        true = np.array([self.names.index(name) for name, _ in snippets])

        def loss(scale: float) -> float:
            mass = np.exp2(-scale * np.minimum(bits, 1000))
            p = mass[np.arange(len(true)), true] / mass.sum(axis=1)
            return -np.log(np.clip(p, 1 - self.most, self.most)).sum()

        self.scale = min(SCALES, key=loss)


def _batches(sizes: list[int]):
    """Runs (from, to) of about ``AT_ONCE``, or of one that is longer."""
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > AT_ONCE:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def train(documents: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, pieces_per_language: int = PIECES_PER_LANGUAGE) -> CrossParser:
    """The parser of the languages of ``documents`` (doc_id, text, lang), training rows only.

    The driver gets twice ``pieces_per_language`` pieces of ``PIECE`` characters for each language.
    """
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return CrossParser([])
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, docs_per_language / r["count"]))]), F.col("lang"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    places = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE))
    pieces = rows.where((chance < share) & (F.length("text") > 0)).select("lang", "doc_id", F.posexplode(F.transform(places, lambda i: F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE)))).alias("place", "piece"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "place"), "piece")
    found = pieces.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * pieces_per_language).collect()
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in found:
        parts.setdefault(r["lang"], []).append((r["rank"], r["piece"]))
    learned = {name: [t for rank, piece in sorted(some) if rank <= pieces_per_language and (t := running(piece))] for name, some in parts.items()}
    parser = CrossParser([(r["lang"], learned[r["lang"]]) for r in counts if learned.get(r["lang"])])
    held = [(name, piece[at : at + SNIPPET]) for name, some in parts.items() for rank, piece in sorted(some) if rank > pieces_per_language for at in range(0, len(piece), SNIPPET)]
    parser.fit(held)
    return parser


def identify(df: DataFrame, model: CrossParser, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "phrase_rate")) -> DataFrame:
    """``carry`` columns of each row plus language, score and phrases per letter as ``names``. No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = (("string", pa.string()), ("double", pa.float64()), ("double", pa.float64()))
    return added(df, text_col, carry, names, kinds, lambda: shared.value.predict)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(crc_fold(F.col("doc_id")) != 0))
    return identify(docs, model).select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
