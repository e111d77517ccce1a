"""Operator 6: toxicity after noisy-channel deobfuscation.

A token that looks disguised (symbols or digits among letters, letters repeated three times or more, or
letters spelled out with separators) becomes a lattice: every character offers the letters it may stand
for, a run may stand for one or two letters, a symbol may stand for nothing. Viterbi decoding under a
character trigram model, learned from the training texts, restores the likeliest word, however long the token.
A run of spelled-out letters is split where its gaps are wider than elsewhere, and of all ways to cut each part
into words of the training texts and other letters the likeliest is taken.

The score looks at the words of the restored text and at their beginnings: each such unit has a smoothed log odds
of toxic against clean training texts less its standard error. A logistic model on a text's strongest and second
strongest word, on all of its words together and on their share of the text gives the probability.

Training reads every labelled row outside the held-out fold (of rows that repeat an id the greatest text); words and
units count from ``LEAST_ROWS`` of them on. Counts and the sums of each Newton step are made where the rows lie, so the
driver holds the words and units alone. What is made of the words is made once and sent to the workers, which keep it
for all their tasks. Every text is scored whole, very long ones too. Null and empty texts have no units and get the model's floor. Without labelled rows of both kinds every score
is 0. If an id is labelled twice, toxic wins. Repeated rows are scored each on its own. Any further columns may be
carried along, under any name.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, added, crc_fold, read_table, written

#: Labelled ids that may be broadcast.
BROADCAST_ROWS = 1_000_000
LEAST_ROWS = 3
PREFIXES = (4, 5, 6)

#: What a character may stand for besides itself.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SILENT = set(".-_*~^'`,:;/\\#\"=<>") | {" "}
LETTERS = re.compile(r"[^\W\d_]+")
#: Four or more single characters with one to four separators between each.
SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+])(?:[ .\-_*]{1,4}(?:[^\W_]|[@$!|+])){3,}(?![^\W_])")
#: The second and third character of any such run; a text without it is left alone.
SPELLED_PART = re.compile(r"[ .\-_*][\w@$!|+][ .\-_*]{1,4}[\w@$!|+][ .\-_*]")
GAP = re.compile(r"[ .\-_*]+")
RUN = re.compile(r"(.)\1*", re.S)
REPEAT = re.compile(r"([^\W\d_])\1\1")
TRAIL = re.compile(r"([!?.,;:#%&*$])\1+$")
EDGES = ".,;:?\"'()[]{}<>&%#*"
LOG_SUB, LOG_DROP, LOG_RUN, LOG_KEEP = math.log(0.15), math.log(0.2), math.log(0.3), math.log(0.9)
LOG_ODD = math.log(1e-4)
#: A letter of a spelled-out run that belongs to no word of the training texts.
LOG_LETTER = -4.0
SINGLE = re.compile(r"[^\W_]|[@$!|+]")


class CharModel:
    """Trigram model of words' characters, add-k smoothed through the bigram and unigram."""

    def __init__(self, words: dict[str, int]):
        self.tri, self.bi, self.uni = Counter(), Counter(), Counter()
        for word, n in words.items():
            n = 1 + math.log(n)
            padded = f"^^{word}$"
            for i in range(2, len(padded)):
                self.tri[padded[i - 2 : i + 1]] += n
        for three, n in self.tri.items():
            self.bi[three[:2]] += n
            self.uni[three[2]] += n
        self.total, self.memo = sum(self.uni.values()) + 1, WordCache(self._log, 20_000)

    def _log(self, three: str) -> float:
        low = (self.uni[three[2]] + 0.1) / (self.total + 30)
        return math.log((self.tri[three] + 2 * low) / (self.bi[three[:2]] + 2))

    def log(self, two: str, c: str) -> float:
        return self.memo[two + c]


class Deobfuscator:
    def __init__(self, words: dict[str, int]):
        self.lm = CharModel(words)
        total = sum(words.values())
        self.sorted = sorted(words)
        self.logs = array("d", [math.log(words[w] / total) for w in self.sorted])

    def decode(self, token: str) -> str:
        """The likeliest word behind a disguised token: Viterbi over (last two letters) states."""
        best: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
        for m in RUN.finditer(token):
            c, n = m[1], len(m[0])
            options: list[tuple[str, float]] = []
            if c.isalpha():
                options.append((c, LOG_KEEP if n == 1 else LOG_RUN if n > 2 else LOG_KEEP + LOG_SUB))
                if n >= 2:
                    options.append((c + c, LOG_KEEP if n == 2 else LOG_RUN))
            else:
                for to in LEET.get(c, ""):
                    options.append((to, LOG_SUB))
                    if n >= 2:
                        options.append((to + to, LOG_SUB))
                if c in SILENT or not c.isalnum():
                    options.append(("", LOG_DROP))
                if not options:
                    options.append(("", LOG_ODD * n))
            new: dict[str, tuple[float, tuple | None]] = {}
            for state, (cost, path) in best.items():
                for letters, channel in options:
                    s, total = state, cost + channel
                    for x in letters:
                        total += self.lm.log(s, x)
                        s = s[1] + x
                    if s not in new or new[s][0] < total:
                        new[s] = (total, (path, letters) if letters else path)
            best = new
        _, path = max(((cost + self.lm.log(s, "$"), path) for s, (cost, path) in best.items()), key=lambda found: found[0])
        letters = []
        while path is not None:
            path, last = path
            letters.append(last)
        return "".join(reversed(letters))

    def words(self, token: str) -> list[str]:
        """Letter runs of a white-space token, and the restored word if the token looks disguised."""
        core = token.strip(EDGES)
        if core.isalpha() and not REPEAT.search(core):  # most tokens
            return [core]
        token = TRAIL.sub("", token)
        found = LETTERS.findall(token)
        core = token.strip(EDGES)
        if (core and not core.isalpha() and any(map(str.isalpha, core)) or REPEAT.search(core)) and "://" not in core and (back := self.decode(core)):
            return [*found, back]
        return found

    def _known(self, start: str) -> tuple[bool, float | None]:
        """Whether a word of the training texts starts so, and the log probability of the word ``start``."""
        i = bisect_left(self.sorted, start)
        if i == len(self.sorted) or not self.sorted[i].startswith(start):
            return False, None
        return True, self.logs[i] if self.sorted[i] == start else None

    def cut(self, run: str) -> list[str]:
        """The likeliest words behind a spelled-out run in which the breaks between words are lost."""
        # Of a letter held down three stay, which still may be one, two or the end of a word and the next.
        chars = re.sub(r"(.)\1{3,}", r"\1\1\1", "".join(SINGLE.findall(run)))
        # best[i]: cost of the first i characters, where the last word starts, the word, whether it is known.
        best: list[tuple[float, int, str, bool]] = [(0.0, 0, "", True)] + [(-math.inf, 0, "", False)] * len(chars)
        for i, first in enumerate(chars):
            cost = best[i][0]
            if cost + LOG_LETTER > best[i + 1][0]:
                best[i + 1] = (cost + LOG_LETTER, i, first if first.isalpha() else LEET.get(first, "")[:1], False)
            at, j = {"": 0.0}, i
            while at and j < len(chars):
                c, j, new = chars[j], j + 1, {}
                options = [(c, LOG_KEEP)] if c.isalpha() else [(to, LOG_SUB) for to in LEET.get(c, "")]
                for word, channel in at.items():
                    steps = [(word + to, channel + log) for to, log in options]
                    if word and word[-1] == c:  # a letter held down
                        steps.append((word, channel + LOG_SUB))
                    for longer, log in steps:
                        if new.get(longer, -math.inf) < log:
                            new[longer] = log
                at = {}
                for word, channel in new.items():
                    starts, log = self._known(word)
                    if starts:
                        at[word] = channel
                    if log is not None and cost + channel + log > best[j][0]:
                        best[j] = (cost + channel + log, i, word, True)
        found, rest, i = [], "", len(chars)
        while i:
            _, i, word, known = best[i]
            if known:
                found, rest = [*found, rest, word], ""
            else:
                rest = word + rest
        return [w for w in [*found, rest] if w]

    def spelled(self, low: str) -> set[str]:
        """Words behind all spelled-out runs of a lower-case text, in its own gaps and without them."""
        out = set()
        if not SPELLED_PART.search(low):
            return out
        for m in SPELLED.finditer(low):
            run = m.group()
            least = min(map(len, GAP.findall(run)))
            for part in re.split(r"[ .\-_*]{%d,}" % (least + 1), run):
                out.update(self.cut(part))
                out.add(self.decode(part))
        out.discard("")
        return out

    def restored(self, text: str) -> set[str]:
        """Distinct words of the restored text."""
        low, out = text.lower(), set()
        for token in set(low.split()):
            out.update(self.words(token))
        out.update(self.spelled(low))
        out.discard("")
        return out


def units(word: str) -> list[str]:
    return [word, *["^" + word[:k] for k in PREFIXES if len(word) >= k]]


class Scorer:
    """Scores texts by a model. It is made once and sent whole, so that a worker keeps it and its cache for all its tasks."""

    def __init__(self, model: dict):
        self.noise = model.get("noise") or Deobfuscator(model["words"])
        self.weights, self.coef = model["units"], model["coef"]
        self.starts = {u[1:]: w for u, w in self.weights.items() if u.startswith("^")}
        # All units of a word share its first letters, so many words are known to have none at one look.
        self.heads = {head: self.starts.get(head, 0.0) for head in (u.removeprefix("^")[: PREFIXES[0]] for u in self.weights)}
        self.cache = WordCache(self._token, 80_000)

    def _weight(self, word: str) -> float:
        """The greatest weight of the word's units, 0 if none has one."""
        best = self.heads.get(word[: PREFIXES[0]])
        if best is None:
            return 0.0
        # A word shorter than a beginning gives its own letters again, which count as a shorter beginning.
        for found in (self.weights.get(word), *[self.starts.get(word[:k]) for k in PREFIXES[1:]]):
            if found is not None and found > best:
                best = found
        return best

    def _token(self, token: str) -> float:
        words = self.noise.words(token)
        return self._weight(words[0]) if len(words) == 1 else max(map(self._weight, words), default=0.0)

    def features(self, text: str | None) -> list[float]:
        """The strongest and the second strongest word, all words together, and their share of the text."""
        low = (text or "").lower()
        tokens = set(low.split())
        found = [self.cache[t] for t in tokens] + [self._weight(w) for w in self.noise.spelled(low)]
        top = sorted(found, reverse=True)[:2] + [0.0, 0.0]
        total = sum(found)
        return [top[0], top[1], math.log1p(total), total / math.sqrt(len(found) + 1)]

    def score(self, text: str | None) -> float:
        if self.coef is None:
            return 0.0
        z = self.coef[0] + sum(c * x for c, x in zip(self.coef[1:], self.features(text), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))

    def scores(self, texts: list[str | None]) -> list[tuple[float]]:
        return [(self.score(t),) for t in texts]


def _logistic(rows: DataFrame, n: int, ridge: float = 1e-2) -> list[float]:
    """Ridge logistic regression on all ``rows`` (x of n numbers, toxic) by Newton steps, each one pass of sums."""
    w = np.zeros(n + 1)
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(50):

        def sums(batches, w=w):
            slope, curve = np.zeros(len(w)), np.zeros((len(w), len(w)))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(-1, n)
                y = (batch.column(1).to_numpy() > 0).astype(float)
                a = np.column_stack([np.ones(len(x)), x])
                p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
                slope += a.T @ (y - p)
                curve += a.T @ (a * (p * (1 - p))[:, None])
            yield pa.RecordBatch.from_arrays([pa.array([slope.tolist()]), pa.array([curve.ravel().tolist()])], ["slope", "curve"])

        parts = rows.mapInArrow(sums, "slope array<double>, curve array<double>").collect()  # a row a task
        slope = np.sum([r["slope"] for r in parts], axis=0)
        curve = np.sum([r["curve"] for r in parts], axis=0).reshape(len(w), len(w))
        step = np.linalg.solve(curve + penalty, slope - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _pairs(df: DataFrame) -> dict:
    """Two columns as a dictionary. They come as Arrow columns: a Row for each would take several times the driver's memory."""
    table = df.toArrow()
    return dict(zip(*(column.to_pylist() for column in table.columns), strict=True))


def train(documents: DataFrame, labels: DataFrame) -> dict:
    """Fit on all labelled rows outside the held-out fold. ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    none = {"words": {}, "units": {}, "coef": None}
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    if not n:
        return none
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marked) if n <= BROADCAST_ROWS else marked, "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    texts = written(texts.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half")), "toxicity-texts")
    spark = documents.sparkSession
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where("length(word) between 2 and 30")
    lm = _pairs(words.groupBy("word").count().where(F.col("count") >= LEAST_ROWS))
    if not lm:
        return none
    noise = Deobfuscator(lm)
    shared = spark.sparkContext.broadcast(noise)

    def unit_rows(batches):
        noise = shared.value
        cache = WordCache(lambda token: [u for w in noise.words(token) for u in units(w)], 20_000)
        for batch in batches:
            tally = {(half, bad): Counter() for half in (0, 1) for bad in (False, True)}
            for text, toxic, half in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                low = (text or "").lower()
                found = set(chain.from_iterable(map(cache.__getitem__, set(low.split()))))
                found.update(u for w in noise.spelled(low) for u in units(w))
                tally[half, toxic > 0].update(found)
            for half in (0, 1):
                good, bad = tally[half, False], tally[half, True]
                names = list(good.keys() | bad.keys())
                columns = [pa.array(names, pa.string()), pa.array([bad[u] for u in names], pa.int64()), pa.array([good[u] for u in names], pa.int64()), pa.array([half] * len(names), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["unit", "bad", "good", "half"])

    # One pass counts the units of both halves.
    tallies = texts.select("text", "toxic", "half").mapInArrow(unit_rows, "unit string, bad long, good long, half long")
    counts = written(tallies.groupBy("unit", "half").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "toxicity-units")
    sizes = {(r["half"], r["bad"]): r["count"] for r in texts.groupBy("half", (F.col("toxic") > 0).alias("bad")).count().collect()}
    if len({bad for _, bad in sizes}) < 2:
        return none

    def fitted(kept: tuple[int, ...]) -> dict[str, float]:
        bad, good = (sum(sizes.get((h, kind), 0) for h in kept) for kind in (True, False))
        if not bad or not good:
            return {}
        odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
        spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
        both = counts.where(F.col("half").isin(*kept)).groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        return _pairs(both.where(F.col("bad") >= LEAST_ROWS).select("unit", (odds - spread).alias("w")).where("w > 0"))

    # Each half's features come from units of the other, so no text is judged by units it brought.
    scorers = spark.sparkContext.broadcast([Scorer({"noise": noise, "units": fitted((1 - h,)), "coef": None}) for h in (0, 1)])

    def feature_rows(batches):
        for batch in batches:
            made = [scorers.value[h].features(t) for t, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    rows = written(texts.select("text", "toxic", "half").mapInArrow(feature_rows, "x array<double>, toxic int"), "toxicity-features", compact=True)
    return {"words": lm, "units": fitted((0, 1)), "coef": _logistic(rows, 4), "noise": noise}


def score(df: DataFrame, model: dict, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``carry`` columns of each row plus its score as ``name``. One narrow stage, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(Scorer(model))
    return added(df, text_col, carry, (name,), (("double", pa.float64()),), lambda: shared.value.scores)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
