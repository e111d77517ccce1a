import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import EDGES, edge_docs, save

from chronofold.llm import decontam, katz, simhash
from chronofold.llm.components import components


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(200)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    want = {n: root(n) for a, b in edges for n in (a, b) if a != b}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_bit_by_bit():
    for text in ("one two three four five five five", "two words", "", "A b C d", None):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert simhash.fingerprint(text) & (2**64 - 1) == want


def near_fingerprints(n=900):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    out = []
    for i in range(n):
        x = int(base[i % 60]) if i % 3 else int(rng.integers(0, 2**63))
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


def brute_components(fps, radius):
    a = np.array(fps, np.uint64)
    up = list(range(len(a)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= radius):
            x, y = root(i), root(i + 1 + int(j))
            up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(a))]


@pytest.mark.parametrize("tile_rows", [4096, 16])
def test_links_find_all_groups(spark, tile_rows):
    fps = near_fingerprints()
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    nodes = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, node long")
    found = simhash.links(nodes, 3, tile_rows)
    assert all(bin(fps[r.a] ^ fps[r.b]).count("1") <= 3 for r in found.collect())
    got = {r.node: r.component for r in components(found).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == brute_components(fps, 3)


def test_tile_links_are_a_forest():
    tile = np.array([i for i in range(2000)], np.uint64)
    found = simhash.tile_links(tile, None, 3)
    assert len(found) == 1999
    left, right = np.arange(0, 600, dtype=np.uint64), np.arange(600, 1200, dtype=np.uint64)
    assert all(a < 600 <= b or b < 600 <= a for a, b in simhash.tile_links(left, right, 3))


def test_simhash_edges(spark, tmp_path):
    save(edge_docs(spark), tmp_path, "documents")
    rows = simhash.op3_simhash(spark, str(tmp_path)).collect()
    assert len(rows) == len(EDGES)
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16 and by[3].component_id == 1
    assert by[5].component_id == 4 and by[9].component_id == 9
    save(edge_docs(spark).limit(0), tmp_path, "documents")
    assert simhash.op3_simhash(spark, str(tmp_path)).count() == 0


def test_simhash_of_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, None), (None, "")], "doc_id long, text string").selectExpr("*", "1 as fp", "2 as key", "3 as node", "text as digest")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.groups(docs).collect()}
    assert got[1][1] == got[2][1] == 1 and got[3] == got[None] == (0, 3) and got[1][0] == simhash.fingerprint(long)
    pairs = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert pairs == {1: 1, 2: 1, 3: 3}


def test_near_duplicates_by_exact_similarity(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows, n = [], 0
    for size in (60, 200, 700):
        for _ in range(15):
            text = [rng.choice(words) for _ in range(size)]
            for changes in (0, 0, 1, size // 60, size // 6):
                copy = list(text)
                for _ in range(changes):
                    copy[rng.randrange(size)] = rng.choice(words)
                rows.append((n, " ".join(copy)))
                n += 1
    rows += [(n + 1, None), (n + 2, ""), (None, "no id"), (0, rows[0][1])]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows if i is not None and t}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    both = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    caught = sum(got[a] == got[b] for a, b in both)
    assert caught >= 0.95 * len(both)
    up = {i: i for i in got}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in both:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert all(got[a] != got[b] or root(a) == root(b) for a in sets for b in sets if a < b)
    assert got[n + 2] == n + 1


@pytest.mark.parametrize("block_bytes", [300, 8_000_000])
def test_katz_equals_dictionaries(spark, sf_dir, block_bytes):
    rows = [(r.doc_id, r.text, r.doc_id % 4 == 0) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(25).collect()]
    rows = [(i, " ".join((t or "").split()[:120]), h) for i, t, h in rows] + [(1001, None, True), (1002, "", False), (1003, "the the the the", False), (1003, "the the the the", False), (None, "the unseenword", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    want = sorted((str(r[0]), *w) for r, w in zip(rows, katz.brute_force([(t, h) for _, t, h in rows]), strict=True))
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.score(df, block_bytes=block_bytes).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-9)


def backed_off(train, order):
    """P(word, history) of a Katz model of ``order`` by plain dictionaries, and its words."""
    counts = [Counter() for _ in range(order + 1)]
    for text in train:
        seq = ["<s>"] * (order - 1) + text.lower().split() + ["</s>"]
        for i in range(order - 1, len(seq)):
            for k in range(1, order + 1):
                counts[k][tuple(seq[i - k + 1 : i + 1])] += 1
    d = [None] + [katz.discounts([sum(n == r for n in counts[k].values()) for r in range(katz.TOP + 2)]) for k in range(1, order + 1)]
    cut = lambda k, n: (d[k][n] if n <= katz.TOP else 1.0) * n
    total = sum(counts[1].values())
    kept = sum(cut(1, n) for n in counts[1].values())
    over1 = total if kept < total * (1 - 1e-12) else total + 1
    after = {}
    for k in range(2, order + 1):
        for gram, n in counts[k].items():
            after.setdefault(gram[:-1], {})[gram[-1]] = n

    def p(word, history):
        if not history:
            return cut(1, counts[1][word,]) / over1 if counts[1][word,] else (1 - kept / over1 if total else 1.0)
        k, seen = len(history) + 1, after.get(history)
        if seen is None:
            return p(word, history[1:])
        n, used = sum(seen.values()), sum(cut(k, x) for x in seen.values())
        over = n if used < n * (1 - 1e-12) else n + 1
        if word in seen:
            return cut(k, seen[word]) / over
        return (1 - used / over) / (1 - sum(p(w, history[1:]) for w in seen)) * p(word, history[1:])

    return p, [g[0] for g in counts[1]]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stored_katz_tables_equal_dictionaries(spark, order):
    rng = random.Random(order)
    line = lambda: " ".join(rng.choice(["a", "b", "C", "dd", "e", "x%d" % rng.randrange(40)]) for _ in range(rng.randrange(0, 25)))
    train, other = [line() for _ in range(60)], [line() for _ in range(20)] + ["", None, "never seen words", "a  B\tc", "a  B\tc"]
    p, words = backed_off(train, order)
    model = katz.tables(spark.createDataFrame([(t,) for t in train], "text string"), order)
    rows = list(enumerate(train + other))
    got = {r.doc_id: r for r in model.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for key, text in rows:
        seq = ["<s>"] * (order - 1) + (text or "").lower().split() + ["</s>"]
        want = sum(math.log10(p(seq[i], tuple(seq[i - order + 1 : i]))) for i in range(order - 1, len(seq)))
        assert got[key].n_tokens == len(seq) - order + 1 and got[key].score == pytest.approx(want, abs=1e-7)
    for history in ([("a",), ("dd",)] if order == 2 else [("a", "b"), ("<s>", "<s>"), ("e", "nosuch")] if order == 3 else [()]):
        assert sum(p(w, history) for w in words) + p("unseen word", history) == pytest.approx(1.0)
    empty = katz.tables(spark.createDataFrame([], "text string"), order)
    assert empty.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first().score == 0.0


def test_katz_normalises():
    assert all(0 < x <= 1 for x in katz.discounts([0, 10, 5, 3, 2, 1, 1])[1:])
    for words, after in (([9, 4, 3, 2, 1, 1, 1], {0: 3, 2: 1, 4: 1}), ([9, 9, 9], {0: 7, 1: 6}), ([1], {0: 1})):
        word_n = np.array([*words, 0])  # the last is any unknown word
        of = lambda c: np.bincount(np.minimum(c, katz.TOP + 2), minlength=katz.TOP + 3)[: katz.TOP + 2].tolist()
        pairs = np.array(list(after.values()))
        model = katz.Model(int(word_n.sum()), len(words), of(np.array(words)), of(pairs))
        p = model.p_word(word_n)
        assert p.sum() == pytest.approx(1)
        kept, seen = katz.discounted(model.pair_d, pairs), p[list(after)]
        over, alpha = katz.backoff(*(np.array([float(x.sum())]) for x in (pairs, kept, seen)))
        rest = [i for i in range(len(word_n)) if i not in after]
        assert kept.sum() / over[0] + alpha[0] * p[rest].sum() == pytest.approx(1)


def test_katz_edges(spark, tmp_path):
    for docs in (edge_docs(spark), edge_docs(spark).limit(0), edge_docs(spark).where("doc_id = -1")):
        save(docs, tmp_path, "documents")
        assert katz.op7_katz(spark, str(tmp_path)).count() == docs.count()
    only_held = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held boolean")
    r = katz.score(only_held).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_leaks(docs, items, window=10):
    grams = {}
    for key, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[i : i + window]), set()).add(key)
    sizes = sorted({len(g) for g in grams})
    out = []
    for key, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (items_of := grams.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= items_of
        names = ",".join(sorted("" if x is None else str(x) for x in found))
        out.append((str(key), len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination_equals_plain_search(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()] + [(900, None), (901, ""), (902, "short Phrase"), (903, "short phrase"), (904, "a a a a a a a a a a a a")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(r[0], r[1]) for r in EDGES] + [(700, "x SHORT phrase, y short PHRASE"), (701, "a " * 30), (702, items[0][1] + " tail " + items[1][1]), (702, items[0][1] + " tail " + items[1][1]), (703, " ".join(plain_words(items[2][1])[3:14]))]
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == brute_leaks(docs, items)


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    items, docs = [(1, "one two three four five six seven eight nine ten eleven")], [(1, "zero one two three four five six seven eight nine ten"), (2, "one two")]
    got = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == brute_leaks(docs, items)


def test_decontamination_edges(spark):
    docs, items = edge_docs(spark), spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
    assert decontam.decontaminate(docs, items.limit(0)).where("contaminated").count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 as w", "2 as text_hash", "3 as term", "4 as n_words")
    assert decontam.decontaminate(clash, items.selectExpr("*", "'x' as phrase", "1 as doc_id")).count() == len(EDGES)


def test_lists_meet_before_words_are_compared(spark):
    """Only documents in which both rarest terms stand in place are compared, and comparing still decides."""
    texts = ["alpha b c d e f g h i omega", "alpha b c d x f g h i omega", "alpha omega", "omega b c d e f g h i alpha", "b c d e f g h i " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = decontam.Index(docs, spark.createDataFrame([(1, texts[0])], "item_id long, text string"))
    assert {(r.doc_id, r.start) for r in index.meetings().collect()} == {(0, 0), (1, 0)}
    assert [(r.doc_id, r.start, r.n) for r in index.exact().collect()] == [(0, 0, 10)]


def test_proximity_equals_plain_search(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(40)]
    items = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(5)] + ["q z", "k"]
    count = {c: sum(t.split().count(c) for t in texts) for c in "abcdefghijklmnopqrstuvwxyz"}
    want = set()
    for item in items:
        w = item.split()
        for i in range(max(len(w) - 10, 0) + 1):
            phrase = w[i : i + 10]
            order = sorted(range(len(phrase)), key=lambda k: (count[phrase[k]], k))
            first, second = order[0], order[min(1, len(order) - 1)]
            for n, text in enumerate(texts):
                t = text.split()
                starts = [[p - off for p, x in enumerate(t) if x == phrase[off]] for off in (first, second)]
                want |= {(n, tuple(phrase), x, y - x) for x in starts[0] for y in starts[1] if abs(y - x) <= 2}
    index = decontam.Index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    name = {r.ph: tuple(r.phrase) for r in index.ranked.collect()}
    assert {(r.doc_id, name[r.ph], r.start, r["shift"]) for r in index.near(2).collect()} == want and want


def chains():
    """Texts whose groups hang together by chains, by a hub, or not at all although they share most lines."""
    rng = random.Random(11)
    word = lambda: "w%d" % rng.randrange(10**6)
    texts = []
    for _ in range(5):
        base = [word() for _ in range(160)]
        for _ in range(12):
            base = [w if rng.random() > 0.017 else word() for w in base]
            texts.append(" ".join(base))
    hub = [word() for _ in range(120)]
    texts += [" ".join(w if rng.random() > 0.03 else word() for w in hub) for _ in range(60)] + [" ".join(hub)]
    lines = [[word() for _ in range(12)] for _ in range(16)]
    texts += [" ".join(w for line in rng.sample(lines, 9) for w in line) for _ in range(60)]
    texts += [" ".join(hub[:3]), " ".join(hub[:3]), "one", "", ""]
    return texts


@pytest.mark.parametrize(("measure", "few", "tile_hashes"), [("jaccard", 16, 1_000_000), ("cosine", 2, 3_000), ("jaccard", 0, 3_000)])
def test_near_duplicates_equal_brute_force(spark, measure, few, tile_hashes):
    texts = chains()
    rows = list(enumerate(texts, 1))
    made = [set(simhash.shingles(t, 5).tolist()) for t in texts]
    want = list(range(1, len(rows) + 1))

    def similar(x, y):
        both = len(x & y)
        return x == y or both >= 0.8 * (len(x | y) if measure == "jaccard" else (len(x) * len(y)) ** 0.5) > 0

    for i in range(len(rows)):
        for j in range(i):
            if want[i] != want[j] and similar(made[i], made[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), measure=measure, few=few, tile_hashes=tile_hashes).collect()}
    assert [got[n + 1] for n in range(len(rows))] == want


def test_parity_words_never_reject_a_similar_pair():
    rng = np.random.default_rng(2)
    for measure in (simhash.Measure("jaccard", 0.8), simhash.Measure("cosine", 0.8)):
        for size in (1, 7, 90, 3000):
            base = rng.integers(0, 2**63, size, dtype=np.uint64)
            sets = [np.unique(np.concatenate([base[: size - size // k], rng.integers(0, 2**63, e, dtype=np.uint64)])) for k in (2, 3, 5, 9, 20) for e in (0, size // 8, size // 4)]
            pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= measure.needed(len(sets[a]), len(sets[b]))]
            found = measure.forest(sets, np.arange(len(sets)), len(sets))
            groups = lambda edges: {frozenset(g) for g in _groups(len(sets), edges)}
            assert groups(found) == groups(pairs)


def test_least_shared_hashes_of_a_sketch():
    rng = np.random.default_rng(4)
    for measure in (simhash.Measure("jaccard", 0.8), simhash.Measure("cosine", 0.8)):
        assert [measure.in_sketch(n) for n in (1, 5, 10)] == [1, 4, 8 if measure.ratio == 0.8 else 7]
        for size in (60, 90, 128, 400):
            for _ in range(100):
                x = rng.integers(0, 2**63, size, dtype=np.uint64)
                y = np.unique(x[: int(np.ceil(measure.ratio * size))])
                low = lambda a: np.sort(a)[: simhash.SKETCH]
                assert len(np.intersect1d(low(x), low(y))) >= measure.in_sketch(size)


def _groups(n, edges):
    of = list(range(n))
    for a, b in edges:
        of = [of[a] if x == of[b] else x for x in of]
    return [[i for i in range(n) if of[i] == g] for g in set(of)]
