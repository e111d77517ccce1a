"""Operator 10 (native): benchmark decontamination with a distributed positional inverted index.

Every run of ``window`` consecutive words of a test item is a phrase (an item with fewer words, but not
none, is one phrase). The terms of each phrase are ranked by their count over all training documents, and
the index stores the postings (term, document, position) of the two rarest terms of every phrase. The two
lists of a phrase, each moved back by its term's offset, are intersected on document and start; what is left is
compared word by word with the stored tokens of its document, of which only documents with a candidate are read.
Proximity matches are starts of the two lists that differ by at most a slop. Phrases with a term that no document
has are dropped unread.

Only DataFrame functions run on the main path. Null texts have no words; rows without hits get zeros; very long
texts are indexed whole; repeated rows get equal results; rows of one id with different texts are told apart by the
texts' hash; a test item that is null or has no words has no phrases. Items that share a phrase are all reported.
Further columns, whatever their names, are not read. Tables are broadcast only up to ``BROADCAST_BYTES``, else
joined, and then a term's postings move without the text around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain_words, read_table, written

WINDOW = 10
SLOP = 3
BROADCAST_BYTES = 24_000_000


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast only behind its size: the bytes of its rows as JSON, whatever they nest."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def _key(x: str, y: str) -> Column:
    """One row's document is the other's, null ids alike."""
    return F.expr(f"{x}.doc_id <=> {y}.doc_id and {x}.text_hash = {y}.text_hash")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id and phrase (array of words), one row for each distinct window of each item."""
    words = items.select("item_id", plain_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    return words.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, window))).alias("phrase")).distinct()


def ranked_phrases(words: DataFrame, phrase: DataFrame) -> DataFrame:
    """phrase, ph (its hash), n, and its two rarest terms with their offsets (equal for one-word phrases)."""
    vocabulary = written(phrase.select(F.explode("phrase").alias("term")).distinct(), "decontam-vocabulary", compact=True)
    counts = written(words.select(F.explode("w").alias("term")).join(_small(vocabulary), "term").groupBy("term").count(), "decontam-counts", compact=True)
    places = phrase.select("phrase", F.posexplode("phrase").alias("off", "term")).join(_small(counts), "term", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "off", "term")))
    ranked = places.groupBy("phrase").agg(order.alias("order")).where(F.col("order")[0]["count"] > 0)
    second = F.coalesce(F.get("order", F.lit(1)), F.col("order")[0])
    return ranked.select("phrase", F.size("phrase").alias("n"), F.col("order")[0].alias("rarest"), second.alias("next")).select(
        "phrase", F.xxhash64("phrase").alias("ph"), "n", F.col("rarest.term").alias("term1"), F.col("rarest.off").alias("off1"), F.col("next.term").alias("term2"), F.col("next.off").alias("off2")
    )


class Index:
    """The documents' tokens, and the postings of the terms that ``items`` need, in the shared folder."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW):
        docs, items = docs.select("doc_id", F.col("text").cast("string").alias("text")), items.select("item_id", F.col("text").cast("string").alias("text"))
        self.words = written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), plain_words(F.col("text")).alias("w")), "decontam-words")
        self.items = written(phrases(items, window), "decontam-phrases", compact=True)
        self.ranked = written(ranked_phrases(self.words, self.items.select("phrase").distinct()), "decontam-ranked", compact=True)
        terms = written(self.ranked.select(F.explode(F.array("term1", "term2")).alias("term")).distinct(), "decontam-terms", compact=True)
        tokens = self.words.select("doc_id", "text_hash", F.posexplode("w").alias("pos", "term"))
        self.postings = written(tokens.join(_small(terms), "term"), "decontam-postings")

    def _moved(self, which: int) -> DataFrame:
        """The list of each phrase's term ``which``, moved back by its offset: doc_id, text_hash, ph, start."""
        plan = written(self.ranked.select("ph", F.col(f"term{which}").alias("term"), F.col(f"off{which}").alias("off")), "decontam-plan", compact=True)
        return self.postings.join(_small(plan), "term").select("doc_id", "text_hash", "ph", (F.col("pos") - F.col("off")).alias("start"))

    def meetings(self) -> DataFrame:
        """doc_id, text_hash, ph, start where the lists of a phrase's two rarest terms intersect."""
        a, b = self._moved(1).where("start >= 0").distinct().alias("a"), self._moved(2).distinct().alias("b")
        return a.join(b, _key("a", "b") & F.expr("a.ph = b.ph and a.start = b.start"), "left_semi")

    def exact(self) -> DataFrame:
        """doc_id, text_hash, phrase, n, start of every occurrence."""
        known = written(self.ranked.select("ph", "phrase", "n"), "decontam-known", compact=True)
        met = self.meetings().join(_small(known.select("ph", "n")), "ph")
        # A document's starts are bounded by its length and the phrases.
        met = written(met.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n", "ph")).alias("met")), "decontam-met", compact=True)
        tokens = self.words.alias("w").join(_small(met).alias("m"), _key("w", "m")).select("m.doc_id", "m.text_hash", "w", F.explode("met").alias("s"))
        found = tokens.select("doc_id", "text_hash", "s.ph", "s.n", "s.start", F.slice("w", F.col("s.start") + 1, F.col("s.n")).alias("phrase"))
        return found.join(_small(known.select("ph", "phrase")), ["ph", "phrase"], "left_semi").select("doc_id", "text_hash", "phrase", "n", "start").distinct()

    def near(self, slop: int = SLOP) -> DataFrame:
        """Proximity matches: doc_id, text_hash, ph, start, shift where the two rarest terms of a phrase stand within
        ``slop`` places of the distance that they have in it; a start may lie before the document."""
        # Starts that differ by at most slop share a bucket or stand in neighbouring ones.
        width = max(1, slop)
        a = self._moved(1).distinct().select("*", F.explode(F.array(*[F.floor(F.col("start") / width) + d for d in (-1, 0, 1)])).alias("bucket")).alias("a")
        b = self._moved(2).distinct().withColumn("bucket", F.floor(F.col("start") / width)).alias("b")
        close = _key("a", "b") & F.expr(f"a.ph = b.ph and a.bucket = b.bucket and abs(a.start - b.start) <= {int(slop)}")
        return a.join(b, close).select("a.doc_id", "a.text_hash", "a.ph", "a.start", (F.col("b.start") - F.col("a.start")).alias("shift"))

    def lengths(self) -> DataFrame:
        return self.words.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"))


def covered(spans: Column) -> Column:
    """Words inside the union of the sorted (start, n) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["n"]
        return F.struct((acc["hit"] + F.greatest(end - F.greatest(acc["end"], s["start"]), F.lit(0))).cast("long").alias("hit"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["hit"])


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) of the documents that hold a phrase of an item."""
    return Index(docs, items, window).exact().select("doc_id", "text_hash").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    index = Index(docs, items, window)
    hits = written(index.exact(), "decontam-hits", compact=True)
    # A document's starts and items are bounded by its length and the phrases, and both are sets.
    spans = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    named = hits.select("doc_id", "text_hash", "phrase").distinct().join(_small(index.items), "phrase")
    names = named.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("names"))
    found = spans.select("doc_id", "text_hash", covered(F.col("spans")).alias("n_hit")).alias("s").join(names.alias("t"), _key("s", "t")).select("s.doc_id", "s.text_hash", "n_hit", "names")
    out = index.lengths().alias("d").join(_small(written(found, "decontam-found", compact=True)).alias("f"), _key("d", "f"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "d.doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.sha2(F.array_join("names", ","), 256), F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document with proximity matches: how many, of how many phrases, and how many of them are not in place."""
    near = Index(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).near()
    counts = near.groupBy("doc_id").agg(F.count("*").alias("n_near"), F.count_distinct("ph").alias("n_phrases"), F.count_if(F.col("shift") != 0).alias("n_shifted"))
    return counts


_DUCK_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""
with d as (select doc_id, {_DUCK_WORDS} as w from documents),
b as (select item_id, {_DUCK_WORDS} as w from benchmark),
win as (
  select distinct item_id, list_slice(w, i + 1, i + {WINDOW}) as p from b, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) as t(i) where len(w) > 0
),
sizes as (select distinct len(p) as n from win),
grams as (select doc_id, i as start, n, list_slice(w, i + 1, i + n) as p from d, sizes, unnest(range(len(w) - n + 1)) as t(i) where len(w) >= n),
hits as (select doc_id, start, n, item_id from grams join win using (p)),
cov as (select doc_id, count(distinct start + k) as n_hit from hits, unnest(range(n)) as t(k) group by doc_id),
its as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as names from hits group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov using (doc_id) left join its using (doc_id)
"""

PROXIMITY_SQL = f"""
with d as (select doc_id, {_DUCK_WORDS} as w from documents),
b as (select item_id, {_DUCK_WORDS} as w from benchmark),
win as (
  select distinct list_slice(w, i + 1, i + {WINDOW}) as p from b, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) as t(i) where len(w) > 0
),
tok as (select doc_id, w[i + 1] as term, i as pos from d, unnest(range(len(w))) as t(i)),
cnt as (select term, count(*) as c from tok group by term),
terms as (
  select p, i as off, p[i + 1] as term, row_number() over (partition by p order by coalesce(c, 0), i) as r, coalesce(c, 0) as c
  from win, unnest(range(len(p))) as t(i) left join cnt on cnt.term = p[i + 1]
),
ranked as (
  select a.p, a.term as t1, a.off as o1, coalesce(b.term, a.term) as t2, coalesce(b.off, a.off) as o2
  from terms a left join terms b on a.p = b.p and b.r = 2 where a.r = 1 and a.c > 0
),
m1 as (select distinct doc_id, p, pos - o1 as start from tok join ranked on term = t1),
m2 as (select distinct doc_id, p, pos - o2 as start from tok join ranked on term = t2)
select m1.doc_id, count(*) as n_near, count(distinct m1.p) as n_phrases, count(*) filter (where m1.start <> m2.start) as n_shifted
from m1 join m2 on m1.doc_id = m2.doc_id and m1.p = m2.p and abs(m1.start - m2.start) <= {SLOP}
group by m1.doc_id
"""
