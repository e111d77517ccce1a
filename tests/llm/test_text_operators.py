import hashlib
import zlib
from array import array

import pytest
from helpers import EDGES, edge_docs, save
from pyspark.sql import functions as F

from chronofold.llm import bpe, langid, licenses, toxicity
from chronofold.llm.common import WordCache


def test_word_cache_is_bounded_and_pure():
    cache = WordCache(len, limit=3)
    assert [cache["a" * i] for i in range(20)] == list(range(20))
    assert len(cache) + len(cache.old) <= 6
    assert cache["a" * 300] == 300 and "a" * 300 not in cache


def test_bpe_equals_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(bpe.default_vocabulary())
    ours = bpe.RankArrayBpe(open(bpe.default_vocabulary()).read(), cache_limit=50)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += [r[1] for r in EDGES if r[1]] + ["a  b \n c\n\n d", " lead", "trail ", "tab\t tab", "it's we'll", "x<|endoftext|><|endoftext|> y", "漢字かな ½٣", "a\x1cb\x85c", "ab" * 300]
    for t in texts:
        packed = ours.encode(t)
        assert array("I", packed).tolist() == want.encode(t, add_special_tokens=False).ids, t[:60]
        assert ours.decode(packed) == t


def test_bpe_query_digests(spark):
    rows = bpe.encode_decode(edge_docs(spark), bpe.default_vocabulary(), keep_ids=True, carry=("score",)).collect()
    assert len(rows) == len(EDGES)
    decode = bpe.RankArrayBpe(open(bpe.default_vocabulary()).read()).decode
    for r in rows:
        assert len(r.ids) == r.n_tokens and hashlib.sha256(array("I", r.ids).tobytes()).hexdigest() == r.ids_sha256
        assert hashlib.sha256(decode(array("I", r.ids).tobytes()).encode()).hexdigest() == r.decoded_sha256
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}


def test_bpe_edges(spark):
    docs, path = edge_docs(spark), bpe.default_vocabulary()
    assert bpe.encode_decode(docs.limit(0), path, keep_ids=True).count() == 0
    clash = docs.selectExpr("doc_id", "text", "doc_id as c0", "text as __text")
    out = bpe.encode_decode(clash, path, carry=("c0", "__text"))
    assert out.columns == ["doc_id", "c0", "__text", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = out.collect()
    assert len(rows) == len(EDGES) and all(r.decoded_sha256 == hashlib.sha256((r["__text"] or "").encode()).hexdigest() for r in rows)
    repeats = [r.ids_sha256 for r in rows if r.doc_id == 5]
    assert len(repeats) == 2 and len(set(repeats)) == 1


def plain_phrases(text, pool):
    """Longest matches that cover the text, by plain search."""
    i = n = 0
    while i < len(text):
        j = i
        while j < len(text) and any(text[i : j + 1] in p for p in pool):
            j += 1
        n, i = n + 1, max(j, i + 1)
    return n


def test_cross_parsing_equals_plain_search(monkeypatch):
    """Phrases, winner and score of texts in three languages; matches run across words and pieces start anew."""
    pools = {"a": ["the cat sat on the mat and the dog ", "a bandana for banana "], "b": [" der hund und die katze ", "die banane "], "c": ["xyzzy plugh "]}
    parser = langid.CrossParser(list(pools.items()))
    texts = ["the cat sat on the dog", "Die Katze, und der Hund!", "banana", "ananas 12 ÿÿ", "z", "x" * 50, "the mat and die katze " * 9]
    for piece in (7, 1000):
        monkeypatch.setattr(langid, "PIECE", piece)
        bare = [langid.running(t) for t in texts]
        want = [[sum(plain_phrases(t[i : i + piece], pool) for i in range(0, len(t), piece)) for pool in pools.values()] for t in bare]
        assert parser.phrases(bare).tolist() == want
        for (name, score, rate), row, t in zip(parser.predict(texts), want, bare, strict=True):
            bits = [n * c for n, c in zip(row, parser.cost, strict=True)]
            assert name == "abc"[bits.index(min(bits))] and rate == row[bits.index(min(bits))] / len(t.replace(" ", ""))
            assert abs(score - 1 / sum(2 ** -(b - min(bits)) for b in bits)) < 1e-9
    assert "the cat sat" in pools["a"][0] and parser.phrases(["the cat sat"])[0][0] == 1
    assert parser.predict([None, "", "12 !"]) == [("und", 0.0, 0.0)] * 3


def test_langid_learns_every_language_and_doubts_short_texts(spark):
    rng = __import__("random").Random(1)
    rows = [(i, "".join(chr(0x4E00 + 40 * (i % 300) + rng.randrange(40)) for _ in range(30)), f"l{i % 300}") for i in range(900)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.names) == 300 and 0 < model.most < 1
    assert [p[0] for p in model.predict([t for _, t, _ in rows[:50]])] == [lang for _, _, lang in rows[:50]]


def test_langid_accuracy_and_contract(spark, sf_dir):
    rows = langid.op1_langid(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)


def test_langid_edges(spark):
    docs = edge_docs(spark)
    got = langid.identify(docs, langid.train(docs), carry=tuple(docs.columns), names=("p", "s", "r")).collect()
    assert len(got) == len(EDGES) and {r.p for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.train(docs.limit(0)).names == []
    assert {r.lang_pred for r in langid.identify(docs, langid.CrossParser([])).collect()} == {"und"}
    clash = docs.select("doc_id", "text", F.col("lang").alias("__text"), F.col("lang").alias("c0"))
    assert langid.identify(clash, langid.train(docs), carry=tuple(clash.columns)).columns == ["doc_id", "text", "__text", "c0", "lang_pred", "score", "phrase_rate"]
    assert langid.identify(docs.limit(0), langid.train(docs)).count() == 0


@pytest.mark.parametrize("token", ["1d10t", "i.d.i.o.t", "idiooot", "id!ot", "1d1ot"])
def test_deobfuscation(token):
    noise = toxicity.Deobfuscator({"idiot": 50, "station": 20, "editor": 20, "the": 90})
    assert noise.decode(token) == "idiot"
    assert "idiot" in noise.restored(f"you {token} there")


def test_plain_words_stay():
    noise = toxicity.Deobfuscator({"idiot": 50})
    assert noise.restored("The station, and 12 editors") == {"the", "station", "and", "editors"}
    assert noise.restored("s p e l l e d") >= {"s", "p", "e", "l", "d"}


def test_toxicity_learns(spark):
    rows = [(i, ("a calm line of words " * 5) + ("idiot" if i % 4 == 0 else "friend"), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    probe = spark.createDataFrame([(1, "what an 1d10t"), (2, "what a friend"), (3, None), (4, "i d i o t you are"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(probe, model).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_toxicity_learns_from_every_labelled_row(spark):
    docs = spark.range(16_000).selectExpr("id as doc_id", "if(id % 9 = 0, 'shared idiot', 'shared garden') as text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 9 = 0) as toxic")
    model = toxicity.train(docs, labels)
    n = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").count()
    assert n > 12_000
    assert model["words"]["shared"] == n
    assert toxicity.Scorer(model).score("idiot") > 0.5 > toxicity.Scorer(model).score("garden")


def test_toxicity_makes_its_tables_once_and_sends_them(spark, monkeypatch):
    made, real = [], toxicity.CharModel.__init__
    monkeypatch.setattr(toxicity.CharModel, "__init__", lambda self, words: made.append(len(words)) or real(self, words))
    df = spark.range(400).selectExpr("id as doc_id", "if(id % 4 = 0, 'shared idiot', 'shared garden') as text", "int(id % 4 = 0) as toxic").repartition(6)
    scores = toxicity.score(df, toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic")))
    assert {r.score >= 0.5 for r in scores.where("doc_id % 4 = 0").collect()} == {True}
    assert made == [3]


def test_toxicity_brings_no_word_as_a_row_to_the_driver(spark, monkeypatch):
    df = spark.range(400).selectExpr("id as doc_id", "concat(if(id % 4 = 0, 'idiot', 'garden'), ' w', translate(cast(id % 50 as string), '0123456789', 'abcdefghij')) as text", "int(id % 4 = 0) as toxic")
    fetched, real = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: fetched.append(real(self)) or fetched[-1])
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert len(model["words"]) > 20 and model["units"]["idiot"] > 0
    assert not any("word" in row or "unit" in row for rows in fetched for row in rows)


def test_toxicity_short_cuts_change_nothing():
    rng = __import__("random").Random(3)
    noise = toxicity.Deobfuscator({"idiot": 50, "clown": 20, "you": 90})
    units = {"^idio": 1.5, "^clown": 2.5, "clowns": 4.0, "you": 0.5, "^stupid": 3.0, "été": 1.0}
    scorer = toxicity.Scorer({"words": {"idiot": 50, "clown": 20, "you": 90}, "units": units, "coef": None})
    for _ in range(4000):
        token = "".join(rng.choice(["idio", "clown", "stup", "you", "été", "id", "s", "t", "o", "ooo", "_", "1", "$", "!!", ",", ".", "(", "'", "-", "://"]) for _ in range(rng.randint(1, 4)))
        kept = toxicity.TRAIL.sub("", token)
        words, core = toxicity.LETTERS.findall(kept), kept.strip(".,;:?\"'()[]{}<>&%#*")
        if (core and not core.isalpha() and any(map(str.isalpha, core)) or toxicity.REPEAT.search(core)) and "://" not in core and (back := noise.decode(core)):
            words = [*words, back]
        assert noise.words(token) == words, token
        assert scorer.cache[token] == max((units.get(u, 0.0) for w in words for u in toxicity.units(w)), default=0.0), token
        run = "".join(rng.choice("abé1@_ .-* ") for _ in range(12))
        assert toxicity.SPELLED_PART.search(run) or not toxicity.SPELLED.search(run), run


def test_toxicity_edges(spark, tmp_path):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0)):
        save(docs, tmp_path, "documents")
        save(lab, tmp_path, "labels")
        rows = toxicity.op6_toxicity(spark, str(tmp_path)).collect()
        assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    save(docs.limit(0), tmp_path, "documents")
    assert toxicity.op6_toxicity(spark, str(tmp_path)).count() == 0


def licensed_texts():
    """Whole notices, with names and years between, with words changed, and only their key phrases or rare words."""
    rng = __import__("random").Random(6)
    out = []
    for label, wording, phrases, _ in licenses.TEMPLATES:
        w = wording.split()
        out += [f"intro {wording} outro", " ".join(phrases), " ".join(sorted(w)), wording + " " + wording]
        gap = list(w)
        gap[len(w) // 2 : len(w) // 2] = ["acme", "corp", "2024"]
        out.append("x y " + " ".join(gap))
        out.append(" ".join(x if rng.random() > 0.15 else "changed" for x in w))
        out.append(" ".join(w[: len(w) // 2]))
    return out


def test_licenses_equal_brute_force(spark, sf_dir):
    texts = licensed_texts() + ["mit " * 1500, "cc by nc cc by nc", "GNU general public license version 3, all rights reserved", "under under the mit license the MIT license"]
    texts += ["Copyright 2020 Acme. All rights reserved. " + licenses.TEMPLATES[10][1], "license " * 700 + "software " * 300]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).unionByName(edge_docs(spark).selectExpr("doc_id + 10000 as doc_id", "text").where("length(text) < 9000 or text is null"))
    docs = docs.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")).dropDuplicates(["doc_id", "text"])
    vocabulary = sorted({w for t in licenses.templates() for w in t.words} | {w for _, p in licenses.BASE for w in p.split()})
    idf = licenses.inverse(*licenses.document_frequencies(docs, vocabulary), vocabulary)
    seen = set()
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for doc_id, text in rows:
        r, (words, base, found, score) = got[doc_id], licenses.brute_force(text, idf)
        starts = [i for _, i in base]
        assert (r.n_words, r.n_base) == (len(words), len(base))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({name for name, _ in base})) and r.labels == ",".join(sorted({name for name, _ in base} | {name for name, _ in found}))
        assert {(m.label, m.start) for m in r.matches} == found and r.score == pytest.approx(score)
        seen |= {name for name, _ in found}
    assert seen == {t[0] for t in licenses.TEMPLATES}
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_needs_index_and_phrase(spark):
    """A long notice's key phrases alone make no label, nor do its rare words without the phrases."""
    label, wording, phrases, _ = licenses.TEMPLATES[0]
    rows = [(1, wording), (2, " ".join(phrases)), (3, wording.replace("free of charge", "for a fee")), (4, "Copyright Acme. All rights reserved. " + licenses.TEMPLATES[10][1]), (5, "All rights reserved.")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as w", "2 as places", "text as label")).collect()}
    assert got == {1: "mit", 2: "", 3: "", 4: "bsd", 5: "proprietary"}


def test_licenses_edges(spark):
    rows = licenses.scan(edge_docs(spark)).collect()
    assert len(rows) == len(EDGES) and {r.score for r in rows if r.doc_id in (1, 2, 3)} == {0.0}
    assert {(r.n_base, r.base_labels) for r in rows if r.doc_id == 9} == {(2, "cc-by-nc,mit")}


def test_spelled_runs_are_cut_into_words():
    noise = toxicity.Deobfuscator({"idiot": 50, "clown": 20, "you": 90, "are": 90, "such": 30, "station": 20})
    for text in ("you are a c l o w n", "y o u a r e a c l o w n", "c.l.0.w.n y.o.u", "s t a t i o n " * 40 + "c l o w n"):
        assert "clown" in noise.restored(text), text
    for text in ("such a i d i o t", "y o u i d i o t", "y o u 1 d 1 0 t", "i i d d i o t y o u"):
        assert "idiot" in noise.restored(text), text
    assert sorted(noise.cut("y o u a r e a i d i o t")) == ["a", "are", "idiot", "you"]
    assert "idiot" not in noise.restored("s t a t i o n")
    for text in ("y o u  a r e  a n  i d i o t", "y  o  u    a  r  e    a  n    i  d  i  o  t", "c-l-o-w-n--y-o-u"):
        assert noise.spelled(text) & {"idiot", "clown"} and "you" in noise.spelled(text), text
    model = {"words": {"idiot": 50, "clown": 20, "you": 90}, "units": {"clown": 5.0}, "coef": [-4.0, 2.0, 0.0, 0.0, 0.0]}
    assert toxicity.Scorer(model).score("l e t t e r s " * 30 + "a c l o w n") > 0.5 > toxicity.Scorer(model).score("a t o w n")


def readings(token):
    """All (letters, channel cost) that a disguised token may stand for."""
    out = [("", 0.0)]
    for m in toxicity.RUN.finditer(token):
        c, n = m[1], len(m[0])
        if c.isalpha():
            options = [(c, toxicity.LOG_KEEP if n == 1 else toxicity.LOG_RUN if n > 2 else toxicity.LOG_KEEP + toxicity.LOG_SUB)] + ([(c + c, toxicity.LOG_KEEP if n == 2 else toxicity.LOG_RUN)] if n > 1 else [])
        else:
            options = [(to * k, toxicity.LOG_SUB) for to in toxicity.LEET.get(c, "") for k in (1, 2)[: 1 + (n > 1)]] + ([("", toxicity.LOG_DROP)] if not c.isalnum() else [])
            options = options or [("", toxicity.LOG_ODD * n)]
        out = [(word + to, cost + log) for word, cost in out for to, log in options]
    return out


@pytest.mark.parametrize("token", ["1d10t", "!d!!0oot", "c|0w--n", "a$$ho|e", "2x", "s*t*u*p*i*d", "lll1110oo", "--", "m0r0n5!"])
def test_viterbi_equals_trying_all_readings(token):
    noise = toxicity.Deobfuscator({"idiot": 50, "clown": 20, "stupid": 9, "moron": 5, "hole": 3, "well": 7})

    def cost(word, channel):
        padded = f"^^{word}$"
        return channel + sum(noise.lm.log(padded[i - 2 : i], padded[i]) for i in range(2, len(padded)))

    best = max(cost(*r) for r in readings(token))
    assert max(cost(w, c) for w, c in readings(token) if w == noise.decode(token)) == pytest.approx(best)


def test_long_tokens_and_long_runs_are_decoded():
    noise = toxicity.Deobfuscator({"idiot": 50, "you": 20, "abcd": 9})
    assert noise.decode("1d10t" + "z-y" * 20_000).startswith("idiot")
    assert "idiot" in noise.spelled("a b c d " * 300 + "i d i o t")


def test_cut_equals_trying_all_cuts():
    words = {"idiot": 50, "clown": 20, "you": 90, "are": 30, "a": 10, "own": 4}
    noise, total = toxicity.Deobfuscator(words), 204

    def best(run):
        if not run:
            return 0.0
        out = toxicity.LOG_LETTER + best(run[1:])
        for w, n in words.items():
            if run.startswith(w):
                out = max(out, len(w) * toxicity.LOG_KEEP + __import__("math").log(n / total) + best(run[len(w) :]))
        return out

    for run in ("youareaclown", "idiotyou", "xyzyou", "clownown", "ridiot"):
        found, cost = noise.cut(" ".join(run)), 0.0
        assert "".join(sorted("".join(found))) == "".join(sorted(run))
        cost = sum(len(w) * toxicity.LOG_KEEP + __import__("math").log(words[w] / total) if w in words else len(w) * toxicity.LOG_LETTER for w in found)
        assert cost == pytest.approx(best(run)), run


def test_toxicity_carries_any_columns_and_repeats(spark):
    rows = [(i % 200, "calm words " * 5 + ("idiot" if i % 4 == 0 else "friend"), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    clash = df.selectExpr("doc_id", "text", "toxic as `__text`", "toxic as half")
    out = toxicity.score(clash, model, carry=tuple(clash.columns), name="s")
    assert out.columns == [*clash.columns, "s"] and out.where("(s >= 0.5) = (`__text` = 1)").count() == 400
