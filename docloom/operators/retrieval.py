"""Lexical and vector retrieval: inverted index, BM25 with statistics per source, rank fusion, exact vector search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

K1, B = 1.2, 0.75
#: Limits of a query: code points, bytes, code points of a term, terms, hits of a page, sources, matches.
MAX_POINTS, MAX_BYTES, MAX_TERM, MAX_TERMS, MAX_PAGE, MAX_SOURCES, MAX_MATCHES = 512, 2048, 64, 8, 100, 32, 1000


class QueryError(ValueError):
    """A query that is refused: its parameters are wrong, its scope too wide, or it matches too much."""


def query_terms(text: str) -> list[str]:
    """The terms of a query, cut at blanks, checked against the limits."""
    if len(text) > MAX_POINTS or len(text.encode()) > MAX_BYTES:
        raise QueryError("query_too_long")
    terms = text.lower().split()
    if not terms or len(terms) > MAX_TERMS or any(len(t) > MAX_TERM for t in terms):
        raise QueryError("terms")
    return terms


def check_page(limit: int, sources: list[str] | None, kinds: list[str] | None = None) -> None:
    """Limits of a page and of its scope."""
    if not 1 <= limit <= MAX_PAGE or len(kinds or ()) > 9:
        raise QueryError("parameters")
    if len(sources or ()) > MAX_SOURCES:
        raise QueryError("scope_required")


def postings(records: DataFrame, source: str, record: str, text: str) -> DataFrame:
    """(source, record, term, pos) of all tokens."""
    return records.select(F.col(source).alias("source"), F.col(record).alias("record"), F.posexplode(T.tokens(F.col(text))).alias("pos", "term"))


def statistics(records: DataFrame, source: str, record: str, text: str) -> DataFrame:
    """(source, record, length), and the number of records and mean length of the source."""
    lengths = records.select(F.col(source).alias("source"), F.col(record).alias("record"), F.size(T.tokens(F.col(text))).alias("length"))
    means = lengths.groupBy("source").agg(F.count("*").alias("records"), F.avg("length").alias("mean"))
    return lengths.join(means, "source")


def phrases_of(query: str) -> list[list[str]]:
    """The different terms of a query, each as its tokens in a row."""
    phrases = [re.findall(r"[^\W_]+", t) for t in query_terms(query)]
    phrases = [list(x) for x in dict.fromkeys(map(tuple, phrases)) if x]
    if not phrases:
        raise QueryError("terms")
    return phrases


def _scored(counted: DataFrame, means: DataFrame, n_phrases: int) -> DataFrame:
    """Hits (source, record, score) of counts tf0, tf1, ... and of the sources' records, mean length and df0, df1, ..."""
    hits = counted.where(" AND ".join(f"tf{i} > 0" for i in range(n_phrases))).join(means, "source")
    score = F.lit(0.0)
    for i in range(n_phrases):
        tf, n = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("records") - n + 0.5) / (n + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.select("source", "record", F.round(score, 6).alias("score"))


def bm25(records: DataFrame, query: str, source: str, record: str, text: str) -> DataFrame:
    """Records that hold every term of the query, with their score; df, size and mean length are those of the record's source.

    A term that is more than one token must occur as these tokens in a row. This scans all texts; a stored index (index.py) doesn't.
    """
    phrases = phrases_of(query)
    base = records.select(F.col(source).alias("source"), F.col(record).alias("record"), T.tokens(F.col(text)).alias("tokens"))

    def count(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return F.size(F.filter("tokens", lambda t: t == phrase[0]))
        places = F.sequence(F.lit(1), F.greatest(F.size("tokens") - len(phrase) + 1, F.lit(1)))
        return F.size(F.filter(places, lambda i: F.slice("tokens", i, len(phrase)) == F.array(*map(F.lit, phrase))))

    counted = base.select("source", "record", F.size("tokens").alias("length"), *(count(p).alias(f"tf{i}") for i, p in enumerate(phrases)))
    df = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))]
    means = counted.groupBy("source").agg(F.count("*").alias("records"), F.avg("length").alias("mean"), *df)
    return _scored(counted, means, len(phrases))


def fused(hits: DataFrame, k: int = 60) -> DataFrame:
    """The rank of each hit within its source and the reciprocal of it, by which sources are merged."""
    by = Window.partitionBy("source").orderBy(F.desc("score"), "record")
    return hits.withColumn("rank", F.row_number().over(by)).withColumn("rrf", 1 / (k + F.col("rank")))


def page(hits: DataFrame, limit: int) -> DataFrame:
    """The first hits of all sources, by reciprocal rank and id."""
    return fused(hits).orderBy(F.desc("rrf"), "source", "record").limit(limit)


def hybrid(left: DataFrame, right: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Two rankings (key, rank) in one, by the sum of reciprocal ranks; a record may be in only one of them."""
    a, b = left.select(key, F.col("rank").alias("_a")), right.select(key, F.col("rank").alias("_b"))
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    return a.join(b, key, "full").withColumn("rrf", part("_a") + part("_b")).drop("_a", "_b")


def vector_hits(vectors: DataFrame, queries: DataFrame, k: int, least: float = -1.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best vectors per query (query_id, query) by inner product, ties to the smaller id.

    The queries are a stated set and are sent to all rows; each task ranks its own rows first, so k rows per query and task move.
    """
    scored = vectors.crossJoin(queries).withColumn("score", F.round(T.dot(F.col(vector), F.col("query")), 6)).where(F.col("score") >= least)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def best_child(hits: DataFrame, record: str, *ties: str) -> DataFrame:
    """The best scored child of each record, then the records by score."""
    by = Window.partitionBy(record).orderBy(F.desc("score"), *ties)
    return hits.withColumn("_p", F.row_number().over(by)).where("_p = 1").drop("_p")


def excerpt(text: Column, term: str, size: int = 512) -> tuple[Column, Column]:
    """(start, part) of the excerpt of at most `size` code points around the first occurrence of the term."""
    start = F.greatest(F.instr(F.lower(text), term) - 1 - size // 4, F.lit(0))
    return start, F.substring(text, start + 1, F.lit(size))


def keyword_score(text: Column, query: str) -> Column:
    """How many words of the query, repeats counted, occur in the text."""
    words = F.array(*(F.lit(w) for w in query.lower().split()))
    return F.size(F.filter(words, lambda w: F.contains(F.lower(text), w)))


def expanded(hits: DataFrame, chunks: DataFrame, key: str, doc: str, order: str) -> DataFrame:
    """Hits with the chunks before and after them, each once."""
    by = Window.partitionBy(doc).orderBy(order)
    near = chunks.select(key, F.lag(key).over(by).alias("before"), F.lead(key).over(by).alias("after"))
    found = hits.select(key).join(near, key)
    return found.select(F.explode(F.array_compact(F.array("before", key, "after"))).alias(key)).distinct()
