"""Ranked full-text search (BM25) over any table of texts.

``scores`` reads the texts themselves: one pass for the corpus figures (number of documents, average length) and one
for the texts that hold a term. ``text_index`` keeps postings (document, term, tf, length) in a stored table instead, of which
a query reads its terms' rows only; both rank by ``rank``. Document frequencies come from the same rows.
k1 and b are conventional values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.fulltext import stem, stemmed, tokens

K1, B = 1.2, 0.75


def postings(texts: DataFrame, keys: list[str], text: str, stemming: bool = False) -> DataFrame:
    """(keys.., term, tf, length, first) of every non-empty text; ``first`` marks one posting of each document.

    Terms are counted within their text, where they are, so nothing is shuffled.
    """
    words = stemmed(F.col(text)) if stemming else tokens(text)
    rows = texts.where(F.col(text).isNotNull()).select(*keys, words.alias("words")).where(F.size("words") > 0)
    # Sorted words stand in runs; a run begins where a word differs from the one before, and ends where the next begins.
    ordered = rows.select(*keys, F.array_sort("words").alias("w"), F.size("words").alias("length"))
    begins = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    runs = ordered.withColumn("at", begins)
    counted = F.transform("at", lambda a, i: F.struct(F.get("w", a).alias("term"), (F.coalesce(F.get("at", i + 1), F.col("length")) - a).cast("bigint").alias("tf"), (i == 0).alias("first")))
    return runs.select(*keys, "length", F.explode(counted).alias("p")).select(*keys, "p.term", "p.tf", "length", "p.first")


def query_terms(query: str, stemming: bool = False) -> list[str]:
    import re

    words = [w for w in re.split(r"[\W_]+", query.lower()) if w]
    return sorted({stem(w) for w in words} if stemming else set(words))


def scores(texts: DataFrame, keys: list[str], text: str, query: str, stemming: bool = False, operator: str = "or") -> DataFrame:
    """(keys.., score) of every text that holds a term (``or``) or all terms (``and``) of the query."""
    terms = query_terms(query, stemming)
    words = stemmed(F.col(text)) if stemming else tokens(text)
    rows = texts.where(F.col(text).isNotNull()).select(*keys, words.alias("words")).withColumn("length", F.size("words")).where("length > 0")
    docs, mean_length = rows.agg(F.count("*"), F.avg("length")).first()
    # tf of the query's terms without exploding the texts.
    tf = F.array(*[F.struct(F.lit(t).alias("term"), (F.size("words") - F.size(F.array_remove("words", t))).alias("tf")) for t in terms])
    # A text that does not even contain a term's letters is not split again (stems may change letters, so they get no such test).
    likely = texts if stemming or not terms else texts.where(reduce(lambda a, b: a | b, [F.lower(F.col(text)).contains(t) for t in terms]))
    able = likely.where(F.col(text).isNotNull()).select(*keys, words.alias("words")).withColumn("length", F.size("words")).where("length > 0")
    hits = able.select(*keys, "length", F.explode(tf).alias("p")).select(*keys, "length", "p.term", "p.tf").where("tf > 0")
    return rank(hits, keys, docs, mean_length or 1.0, len(terms), operator)


def rank(hits: DataFrame, keys: list[str], docs: int, mean_length: float, n_terms: int, operator: str = "or") -> DataFrame:
    """(keys.., score) from the postings (keys.., term, tf, length) of a query's terms and the corpus figures."""
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    # One row a query term.
    idf = frequency.select("term", F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighed = hits.join(F.broadcast(idf), "term").withColumn("w", F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean_length))))
    out = weighed.groupBy(*keys).agg(F.sum("w").alias("score"), F.count("*").alias("matched"))
    return (out.where(F.col("matched") == n_terms) if operator == "and" else out).drop("matched")


def boolean(texts: DataFrame, keys: list[str], text: str, must: list[str] = (), should: list[str] = (), must_not: list[str] = ()) -> DataFrame:
    """(keys.., score): all ``must`` queries, none of ``must_not``; the scores of must and should add up."""
    return combine(lambda q: scores(texts, keys, text, q), keys, must, should, must_not)


def combine(score: Callable[[str], DataFrame], keys: list[str], must: list[str] = (), should: list[str] = (), must_not: list[str] = ()) -> DataFrame:
    """``boolean`` over any way to score one query, as (keys.., score)."""
    found: DataFrame | None = None
    for q in must:
        one = score(q)
        found = one if found is None else found.join(one.withColumnRenamed("score", "s"), keys).select(*keys, (F.col("score") + F.col("s")).alias("score"))
    for q in should:
        one = score(q).withColumnRenamed("score", "s")
        how = "left" if must else "full"
        found = one.withColumnRenamed("s", "score") if found is None else found.join(one, keys, how).select(*keys, (F.coalesce("score", F.lit(0.0)) + F.coalesce("s", F.lit(0.0))).alias("score"))
    if found is None:
        raise ValueError("a query needs at least one must or should clause")
    for q in must_not:
        found = found.join(score(q).select(*keys), keys, "left_anti")
    return found


def top(scored: DataFrame, keys: list[str], k: int, score: Column | str = "score") -> DataFrame:
    """The k best, ties by key."""
    return scored.orderBy(F.desc(score), *keys).limit(k)
