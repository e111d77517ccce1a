"""Hybrid retrieval: exact vector top-k, BM25, rank fusion, relaxation, merging, budgets, decay.

Statistics of BM25 are those of the filtered candidates, so filters always stand below the scoring. A query
costs one narrow scan for the statistics and one for the scores; term frequencies are counted inside the
row and nothing but one row of statistics is ever shuffled. Ties are broken by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.5, 0.75
RRF_K = 60


def cosine(vector: Column, query: list[float] | Column) -> Column:
    """0 for a zero vector or another length."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    v = vector.cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    norm = F.sqrt(total(F.transform(v, lambda x: x * x))) * F.sqrt(total(F.transform(q, lambda x: x * x)))
    return F.when((F.size(v) == F.size(q)) & (norm > 0), total(F.zip_with(v, q, lambda x, y: x * y)) / norm).otherwise(0.0)


def dense_topk(df: DataFrame, vector: str, query: list[float], k: int, id_col: str = "source_id", least: float = 0.0) -> DataFrame:
    """id and semantic_score of the k nearest; scores at or below ``least``, and below zero, are rejected."""
    scored = df.select(F.col(id_col), F.round(F.greatest(cosine(F.col(vector), query), F.lit(0.0)), 6).alias("semantic_score"))
    return scored.where((F.col("semantic_score") > 0) & (F.col("semantic_score") >= least)).orderBy(F.desc("semantic_score"), id_col).limit(k)


def query_terms(text: str, entities: list[str] = (), topics: list[str] = ()) -> dict[str, int]:
    """Term weights of a query: its words, entity words three times, topic words once."""
    import re

    def words(value: str) -> list[str]:
        low = str(value or "").lower()
        out = re.findall("[a-z0-9]+", low)
        for run in re.findall("[一-鿿]+", low):
            out += [*run, *(run[i : i + 2] for i in range(len(run) - 1))]
        return out

    weights: dict[str, int] = {}
    for value, weight in [(text, 1), *((e, 3) for e in entities), *((t, 1) for t in topics)]:
        for w in words(value):
            weights[w] = weights.get(w, 0) + weight
    return weights


def bm25_topk(df: DataFrame, text: str, terms: dict[str, int], k: int, id_col: str = "source_id", least: float = 0.0) -> DataFrame:
    """id and tag_score of the k best; an empty query finds nothing.

    Each text is split once and thinned to the words of the query, among which the terms are counted.
    """
    names = sorted(terms)
    if not names:
        return df.select(F.col(id_col), F.lit(0.0).alias("tag_score")).where(F.lit(False))
    words = df.select(F.col(id_col), tokens(F.col(text)).alias("w"))
    # Two mentions of w, and of q below, keep Spark from splitting the text once for every term.
    asked = words.select(id_col, F.size("w").alias("dl"), F.filter("w", lambda x: x.isin(names)).alias("q"))
    counts = [F.size("q") - F.size(F.array_remove("q", t)) for t in names]
    rows = asked.select(id_col, "dl", *[c.alias(f"tf{i}") for i, c in enumerate(counts)])
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(names))])
    # One row of statistics.
    scored = rows.crossJoin(F.broadcast(stats)).select(id_col, bm25_score(terms, lambda i, t: F.col(f"tf{i}"), lambda i, t: F.col(f"df{i}")).alias("tag_score"))
    return scored.where((F.col("tag_score") > 0) & (F.col("tag_score") >= least)).orderBy(F.desc("tag_score"), id_col).limit(k)


def bm25_score(terms: dict[str, int], tf, df) -> Column:
    """The score from columns n, avgdl, dl, and per term (place in the order of names, name) its tf and df."""
    score = F.lit(0.0)
    for i, t in enumerate(sorted(terms)):
        f, d = tf(i, t), F.greatest(df(i, t), F.lit(1))
        idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
        score = score + F.when(f > 0, terms[t] * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-6))))).otherwise(0.0)
    return F.round(score, 6)


def bm25_batch(df: DataFrame, text: str, queries: DataFrame, k: int, id_col: str = "source_id") -> DataFrame:
    """Many queries at once: query_id, id, tag_score, rank. ``queries``: (query_id, term, weight).

    Postings of the queries' terms only are shuffled, reduced to (term, row) before they meet the queries;
    partial top-k per partition keeps a frequent term from gathering its rows.
    """
    rows = df.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("w")).select("id", "w", F.size("w").alias("dl"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    wanted = queries.select("term").distinct()
    postings = rows.select("id", "dl", F.explode("w").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    dfs = postings.groupBy("term").agg(F.count("*").alias("df"))
    p = postings.join(dfs, "term").crossJoin(F.broadcast(stats))
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = p.select("term", "id", part.alias("part")).join(queries, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("part")), 6).alias("tag_score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("tag_score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "tag_score", "rank")


def rrf(dense: DataFrame, keyword: DataFrame, id_col: str = "source_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two top-k lists: rrf_score, both scores, dual_hit."""
    order = lambda df, score, name: df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), id_col)))
    # Windows without partitions, over lists that a limit already bounds.
    both = order(dense, "semantic_score", "r1").join(order(keyword, "tag_score", "r2"), id_col, "full")
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    out = both.select(id_col, F.round(part("r1") + part("r2"), 9).alias("rrf_score"), zero("semantic_score"), zero("tag_score"), (F.col("r1").isNotNull() & F.col("r2").isNotNull()).alias("dual_hit"))
    return out.orderBy(F.desc("rrf_score"), F.desc("semantic_score"), F.desc("tag_score"), id_col)


def relaxed(df: DataFrame, strict: Column) -> DataFrame:
    """Rows that meet the soft condition, or all rows if none does, in one plan; adds ``relaxed``."""
    any_strict = df.agg(F.coalesce(F.bool_or(strict), F.lit(False)).alias("__any"))
    joined = df.crossJoin(F.broadcast(any_strict))
    return joined.where(~F.col("__any") | strict).withColumn("relaxed", ~F.col("__any")).drop("__any")


def raw_first(raw: DataFrame, derived: DataFrame, k: int, score: str, id_col: str = "source_id") -> DataFrame:
    """The raw tier fills the k places first, summaries take what is left; adds tier and place."""
    both = raw.withColumn("tier", F.lit(0)).unionByName(derived.withColumn("tier", F.lit(1)))
    cut = both.orderBy("tier", F.desc(score), id_col).limit(k)
    return cut.withColumn("place", F.row_number().over(Window.orderBy("tier", F.desc(score), id_col)))


def score_filter(df: DataFrame, score: str, least: float) -> DataFrame:
    """How many scores pass, are below the threshold, or are not positive and finite."""
    ok = F.col(score).isNotNull() & ~F.isnan(score) & (F.col(score) > 0) & (F.col(score) < float("inf"))
    return df.agg(F.count_if(ok & (F.col(score) >= least)).alias("passed"), F.count_if(ok & (F.col(score) < least)).alias("below"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid"))


def decayed(df: DataFrame, base: str, timestamp: str, now: int, half_life_days: float, k: int, id_col: str) -> DataFrame:
    """Importance halves with every half-life; most recent first on ties."""
    age = F.greatest(F.lit(now) - F.col(timestamp), F.lit(0)) / 86400.0
    out = df.withColumn("decayed", F.round(F.col(base) * F.pow(F.lit(0.5), age / half_life_days), 6))
    return out.orderBy(F.desc("decayed"), F.desc(timestamp), id_col).limit(k)


def fits_budget(matches: list[tuple[str, str]], budget: int, count) -> list[tuple[str, str, bool]]:
    """(id, text, truncated) of a few ranked matches: first fit, and the first alone may be cut to fit.

    ``count`` gives the tokens of a text. A later, shorter match may fit where an earlier one did not.
    """
    out, left = [], budget
    for key, text in matches:
        need = count(text)
        if need <= left:
            out.append((key, text, False))
            left -= need
        elif not out and need > budget:
            low, high = 0, len(text)
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if count(text[:middle]) <= budget else (low, middle - 1)
            if low:
                out.append((key, text[:low], True))
                left = 0
    return out
