"""Operator 5 (native): licence scanning with a positional index of rare licence words.

Each template is the wording of a licence notice with mandatory key phrases inside, all at known places. The document
frequencies of all template words are counted over the whole table; the ``RARE`` rarest words of a template (highest
IDF), wherever in it they stand, are its postings: word, template, relative position. A file looks up the places of
words that are among the ``RARE - VOTES + 1`` rarest of a template; each place moved back by the relative position is
a start of the template. There the postings meet: at least ``VOTES`` of the rare words must stand within ``SLACK``
places of where the template has them. If they do, every key phrase must be found whole, at most ``GAP`` words from its
place, so that names and years may stand between, and no phrase that rules the template out may be. So neither the
rare words alone nor a key phrase alone makes a label. Shorter templates need the same shares of their words.

The base phrases are templates of their own, found exactly: their rarest word is looked up and the phrase compared.

The score is 1 for a base phrase and else the largest IDF-weighted share of a found template's rare words that stand
in place. The work on a file stays inside its row: one narrow scan for the frequencies, one for the result, no
shuffle of text and only DataFrame functions. The index is a literal whose size depends on the templates alone.

Null and empty texts have no words, no labels and score 0. Very long texts are scanned whole, in time that grows with
the places of rare words. Repeated rows are scanned each on its own; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain_words, read_table

#: Fixed values: (label, phrase), the base of every scan.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Fixed values: (label, wording, mandatory key phrases, phrases that rule it out), public wordings of licence notices.
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        ("free of charge to any person", "to deal in the software"),
        (),
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ("apache license version 2", "except in compliance with the license"),
        (),
    ),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",), ()),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",), ()),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        ("gnu general public license", "version 3 of the license"),
        (),
    ),
    (
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        ("gnu general public license", "version 2 of the license"),
        (),
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        ("gnu lesser general public license",),
        (),
    ),
    ("lgpl", "this work is licensed under the gnu lesser general public license", ("gnu lesser general public license",), ()),
    (
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu affero general public license",),
        (),
    ),
    ("agpl", "this work is licensed under the gnu affero general public license", ("gnu affero general public license",), ()),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice",
        ("redistribution and use in source and binary forms", "provided that the following conditions are met"),
        (),
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ("mozilla public license",),
        (),
    ),
    ("cc-by-sa", "this work is licensed under cc by sa 4 0", ("cc by sa",), ()),
    ("cc-by-nd", "this work is licensed under cc by nd 4 0", ("cc by nd",), ()),
    (
        "cc-by-sa",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        ("creative commons attribution sharealike",),
        (),
    ),
    ("cc0", "cc0 1 0 universal cc0 1 0 public domain dedication", ("public domain dedication",), ()),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software", "with or without fee"),
        (),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        ("free and unencumbered software", "into the public domain"),
        (),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        ("permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely"),
        (),
    ),
    ("proprietary", "all rights reserved", ("all rights reserved",), ("redistribution and use", "permission is hereby granted")),
)
#: Rare words of a template, how many must stand in place, and how far off in words; and how far off a phrase may be.
RARE, VOTES, SLACK, GAP = 8, 5, 4, 15


class Template:
    def __init__(self, label: str, wording: str, phrases: tuple[str, ...], barred: tuple[str, ...]):
        self.label, self.words = label, wording.split()
        self.barred = [p.split() for p in barred]
        self.phrases = []
        for p in (p.split() for p in phrases):
            self.phrases.append((p, next(i for i in range(len(self.words) - len(p) + 1) if self.words[i : i + len(p)] == p)))

    def rarest(self, idf: dict[str, float]) -> tuple[list[tuple[str, int]], int]:
        """The rare words with their places, rarest first, each word once; and how many of them must stand in place."""
        first = {w: i for i, w in reversed(list(enumerate(self.words)))}
        rare = sorted(first.items(), key=lambda wi: (-idf[wi[0]], wi[1]))[:RARE]
        return rare, math.ceil(len(rare) * VOTES / RARE)


def templates(extra=TEMPLATES) -> list[Template]:
    return [Template(*t) for t in extra]


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Rows, and rows that hold each of ``words``; the result has a row for each of them at most."""
    held = F.array_intersect(plain_words(F.col("text")), F.array(*map(F.lit, words)))
    found = docs.select(F.explode(F.concat(held, F.array(F.lit(" ")))).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in found}
    return counts.pop(" ", 0), counts


def inverse(rows: int, df: dict[str, int], words) -> dict[str, float]:
    return {w: math.log((rows + 1) / (df.get(w, 0) + 1)) + 1 for w in words}


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _lists(of: dict[str, list[tuple[int, int]]]) -> Column:
    """word -> array of (t, off)."""
    entry = lambda posts: F.array(*[F.struct(F.lit(n).alias("t"), F.lit(i).alias("off")) for n, i in posts])
    return F.create_map(*[x for w, posts in sorted(of.items()) for x in (F.lit(w), entry(posts))])


def scan(docs: DataFrame, extra=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label, start)."""
    known, base = templates(extra), [(label, phrase.split()) for label, phrase in BASE]
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    vocabulary = sorted({w for t in known for w in t.words} | {w for _, p in base for w in p})
    idf = inverse(*document_frequencies(docs, vocabulary), vocabulary)
    starts: dict[str, list[tuple[int, int]]] = {}
    begins: dict[str, list[tuple[int, int]]] = {}
    for number, (_, phrase) in enumerate(base):
        i = min(range(len(phrase)), key=lambda i: (-idf[phrase[i]], i))  # noqa: B023
        begins.setdefault(phrase[i], []).append((number, i))
    rows = []
    for number, t in enumerate(known):
        rare, votes = t.rarest(idf)
        for word, i in rare[: len(rare) - votes + 1]:
            starts.setdefault(word, []).append((number, i))
        rows.append(F.struct(
            F.lit(t.label).alias("label"), F.lit(votes).alias("votes"),
            F.array(*[F.struct(F.lit(w).alias("word"), F.lit(i).alias("off"), F.lit(idf[w]).alias("idf")) for w, i in rare]).alias("rare"),
            F.array(*[F.struct(_strings(p).alias("words"), F.lit(i).alias("off")) for p, i in t.phrases]).alias("phrases"),
            F.array(*map(_strings, t.barred)).cast("array<array<string>>").alias("barred"),
        ))
    table = F.array(*rows)
    phrases = F.array(*[F.struct(F.lit(label).alias("label"), _strings(p).alias("words")) for label, p in base])

    words = docs.select("doc_id", plain_words(F.col("text")).alias("w"))
    w = F.col("w")
    # Both mentions of w keep Spark from splitting the text anew for every place.
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda i: (i < F.size(w)) & F.get(w, i).isin(sorted({*starts, *begins})))
    placed = words.select("doc_id", "w", places.alias("places"))
    none = F.array().cast("array<struct<t:int,start:int>>")

    def moved(of: Column) -> Column:
        """Where the indexed words at ``places`` put the starts of their templates."""
        lists = lambda i: F.coalesce(F.try_element_at(of, F.get(w, i)), F.array().cast("array<struct<t:int,off:int>>"))
        found = F.flatten(F.transform("places", lambda i: F.transform(lists(i), lambda p: F.struct(p["t"].alias("t"), (i - p["off"]).alias("start")))))
        return F.when(F.size("places") > 0, F.array_distinct(found)).otherwise(none)

    started = placed.select("doc_id", "w", moved(_lists(begins)).alias("b"), moved(_lists(starts)).alias("m"))
    of = lambda s: F.get(table, s["t"])
    near = lambda at, far: F.sequence(F.greatest(at - far, F.lit(0)), F.greatest(at + far, F.lit(0)))
    at_place = lambda s, r: F.exists(near(s["start"] + r["off"], SLACK), lambda j: F.get(w, j) == r["word"])
    whole = lambda phrase, at: F.exists(near(at, GAP), lambda j: F.slice(w, j + 1, F.size(phrase)) == phrase)

    def fits(s: Column) -> Column:
        """The postings of a template meet at the start; its key phrases are there, and no phrase that rules it out."""
        t = of(s)
        meet = F.size(F.filter(t["rare"], lambda r: at_place(s, r))) >= t["votes"]
        phrased = F.forall(t["phrases"], lambda p: whole(p["words"], s["start"] + p["off"]))
        return meet & phrased & ~F.exists(t["barred"], lambda p: whole(p, s["start"]))

    exact = F.filter("b", lambda s: (s["start"] >= 0) & (F.slice(w, F.greatest(s["start"], F.lit(0)) + 1, F.size(F.get(phrases, s["t"])["words"])) == F.get(phrases, s["t"])["words"]))
    out = started.select("doc_id", "w", exact.alias("b"), F.filter("m", fits).alias("m"))

    def share(s: Column) -> Column:
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, r: x + r["idf"])
        rare = of(s)["rare"]
        return total(F.filter(rare, lambda r: at_place(s, r))) / total(rare)

    base_names, names = F.transform("b", lambda s: F.get(phrases, s["t"])["label"]), F.transform("m", lambda s: of(s)["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    begin = F.transform("b", lambda s: s["start"].cast("long"))
    best = F.greatest(F.when(F.size("b") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("m", share)), F.lit(0.0)))
    return out.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.size("b").cast("long").alias("n_base"), F.array_min(begin).alias("first_word"), F.array_max(begin).alias("last_word"),
        joined(base_names).alias("base_labels"), joined(F.concat(base_names, names)).alias("labels"), F.least(F.lit(1.0), best).alias("score"),
        F.transform("m", lambda s: F.struct(of(s)["label"].alias("label"), s["start"].alias("start"))).alias("matches"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).drop("matches")


def brute_force(text: str | None, idf: dict[str, float], extra=TEMPLATES) -> tuple[list[str], list[tuple[str, int]], set[tuple[str, int]], float]:
    """Words, base places, found templates and score of one text by trying every start, for tests."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    at = lambda p: [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    whole = lambda p, i: any(w[j : j + len(p)] == p for j in range(max(i - GAP, 0), max(i + GAP, 0) + 1))
    placed = lambda word, i: word in w[max(i - SLACK, 0) : max(i + SLACK, 0) + 1]
    base, found, score = [(label, i) for label, phrase in BASE for i in at(phrase.split())], set(), 0.0
    for t in templates(extra):
        rare, votes = t.rarest(idf)
        for start in range(-len(t.words), len(w)):
            exact = any(0 <= start + i < len(w) and w[start + i] == word for word, i in rare[: len(rare) - votes + 1])
            inside = [word for word, i in rare if placed(word, start + i)]
            if exact and len(inside) >= votes and all(whole(p, start + i) for p, i in t.phrases) and not any(whole(p, start) for p in t.barred):
                found.add((t.label, start))
                score = max(score, sum(idf[x] for x in inside) / sum(idf[x] for x, _ in rare))
    return w, base, found, 1.0 if base else score


_DUCK_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_DUCK_BASE = " union all ".join(f"select '{label}' as label, {phrase.split()} as p" for label, phrase in BASE)
#: The columns that the contract fixes; the method's own labels and scores have a brute-force test.
BASE_SQL = f"""
with d as (select doc_id, {_DUCK_WORDS} as w from documents), base as ({_DUCK_BASE}),
hits as (select doc_id, label, i as start from d, base, unnest(range(greatest(len(w) - len(p) + 1, 0))) as t(i) where list_slice(w, i + 1, i + len(p)) = p)
select d.doc_id, cast(len(any_value(w)) as bigint) as n_words, count(start) as n_base, min(start) as first_word, max(start) as last_word,
  coalesce(array_to_string(list_sort(list(distinct label) filter (where label is not null)), ','), '') as base_labels
from d left join hits using (doc_id) group by d.doc_id
"""


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_licenses that SQL can express."""
    return scan(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
