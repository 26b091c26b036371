"""A stored search index that can't answer from old data: one part per source, named by what the source holds.

A digest of a source is made of order-free digests of its ranges of records, so that it costs one pass and names the range that
changed. Postings lie in a folder named by source and digest. A search compares the live digests with the folders that are there; a source
that changed has another name, is missing until update() has written it, and leaves all others untouched. Writing a part twice gives the
same part.

Records of a source are dealt to blocks by a hash, about `BLOCK` each, alike for all terms. A row of the postings is a term in a block, with the largest
impact of any of its records. A top-k search adds these up to a bound per block, scores the best blocks, and then only those whose bound reaches the kth score.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.base import SENT_ROWS, looked_up, materialized
from docloom.operators.retrieval import K1, MAX_MATCHES, B, QueryError, check_page, phrases_of
from docloom.sources.sinks import table_there

#: Ranges of a source's digest, records of a block, blocks of a file, and blocks of each source that a top-k search scores first.
RANGES, BLOCK, FILE_BLOCKS, FIRST_BLOCKS = 64, 128, 16, 2
#: Names that a filter lists; beyond it they are joined.
LISTED = 1000
#: A score is rounded to six digits; a bound below a score by less than this may belong to an equal one.
SLACK = 2e-6
POSTINGS = "content string, term string, block int, most double, n int, entries array<struct<record:bigint,length:int,at:array<int>>>"


def leaves(records: DataFrame, source: str, record: str, text: str) -> DataFrame:
    """(source, range, n, digest): the digest of each range of a source's records, whatever their order; repeats count."""
    parts = [F.col(c) for c in (record, text)] + [F.col(c).isNull() for c in (record, text)]
    sums = [F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)")).alias(f"_{seed}") for seed in (1, 2)]
    rows = records.withColumn("_source", F.col(source)).withColumn("range", F.pmod(F.xxhash64(record), F.lit(RANGES)).cast("int"))
    found = rows.groupBy("_source", "range").agg(F.count("*").alias("n"), *sums)
    return found.select(F.col("_source").alias("source"), "range", "n", F.sha2(F.concat_ws(":", "range", "n", "_1", "_2"), 256).alias("digest"))


def contents(ranges: DataFrame) -> DataFrame:
    """(source, content, records): the name of what each source holds, from the digests of its ranges, at most `RANGES` each."""
    found = ranges.groupBy("source").agg(F.array_sort(F.collect_list("digest")).alias("listed"), F.sum("n").alias("records"))
    name = F.sha2(F.concat_ws("|", F.to_json(F.struct("source")), F.array_join("listed", ",")), 256)
    return found.select("source", name.alias("content"), "records")


def parts(spark: SparkSession, path: str) -> DataFrame:
    """(content, source, records, mean, blocks) of the parts that were written to their end."""
    found = table_there(spark, f"{path}/parts")
    return spark.createDataFrame([], "content string, source string, records long, mean double, blocks int") if found is None else found.dropDuplicates(["content"])


def update(records: DataFrame, path: str, source: str, record: str, text: str, live: DataFrame | None = None) -> int:
    """Writes the parts that the index lacks, and says how many; parts of unchanged sources are left as they are.

    record: a whole number. live: contents() of the records, where they are known. A part is listed after its postings are there, so a build that was cut
    off lists none. Old parts stay for readers that still use them; no search of newer records reads them.
    """
    spark = records.sparkSession
    live = contents(leaves(records, source, record, text)) if live is None else live
    missing = materialized(live.select("source", "content", "records").join(parts(spark, path).select("content"), "content", "left_anti"))
    n = missing.count()
    if not n:
        return 0
    named = missing.select(F.to_json(F.struct("source")).alias("_key"), "content")
    rows = records.select(F.to_json(F.struct(F.col(source).alias("source"))).alias("_key"), F.col(source).alias("source"), F.col(record).cast("long").alias("record"), F.col(text).alias("text"))
    rows = looked_up(rows, named, "_key").drop("_key")
    sizes = rows.groupBy("content", "source").agg(F.count("*").alias("records"), F.avg(F.coalesce(F.size(T.tokens(F.col("text"))), F.lit(0))).alias("mean"))
    sizes = materialized(sizes.withColumn("blocks", F.ceil(F.col("records") / BLOCK).cast("int")))
    rows = looked_up(rows, sizes.select("content", "mean", "blocks"), "content")
    block = F.pmod(F.xxhash64("record"), F.col("blocks")).cast("int")
    # The texts move once and whole; all tokens of a file's blocks are then in one task.
    dealt = rows.select("content", "mean", block.alias("block"), "record", "text").withColumn("file", (F.col("block") / FILE_BLOCKS).cast("int")).repartition("content", "file")
    tokens = dealt.withColumn("tokens", T.tokens(F.col("text"))).drop("text")
    postings = tokens.groupBy("content", "file").applyInArrow(_postings, POSTINGS)
    ordered = postings.sortWithinPartitions("content", "term", "block")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("content").parquet(f"{path}/postings")
    sizes.select("content", "source", "records", "mean", "blocks").coalesce(1).write.mode("append").parquet(f"{path}/parts")
    return n


def _postings(file: pa.Table) -> pa.Table:
    """A row per term and block of one file's records, in this order: its largest impact, how many records hold it, and where. Rows that repeat a record at
    its length are one entry."""
    tokens, record, block = file.column("tokens").combine_chunks(), file.column("record"), file.column("block").to_numpy()
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
    held, of_row = np.unique(np.stack([block, record.is_valid().to_numpy(), pc.fill_null(record, 0).to_numpy(), lengths], axis=1, dtype=np.int64), axis=0, return_inverse=True)
    words = tokens.flatten().dictionary_encode()
    by_name = pc.sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(by_name), np.int32)
    place[by_name] = np.arange(len(by_name), dtype=np.int32)
    term, owner = place[words.indices.to_numpy()], np.repeat(of_row.reshape(-1).astype(np.int32), lengths)
    pos = np.arange(len(term), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    order = np.lexsort((pos, owner, term))
    term, owner, pos = term[order], owner[order], pos[order]
    new = np.r_[True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])][: len(term)]
    starts = np.append(np.flatnonzero(new), len(term)).astype(np.int32)
    term, (block, known, number, length) = term[starts[:-1]], held[owner[starts[:-1]]].T
    new = np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])][: len(term)]
    heads = np.append(np.flatnonzero(new), len(term)).astype(np.int32)
    first = heads[:-1]
    impact = _impact(np.diff(starts), length, file.column("mean")[0].as_py())
    most = np.maximum.reduceat(impact, first) if len(first) else impact
    one = pa.StructArray.from_arrays([pa.array(number, mask=known == 0), pa.array(length, pa.int32()), pa.ListArray.from_arrays(starts, pa.array(pos))], ["record", "length", "at"])
    content = pa.repeat(file.column("content")[0], len(first))
    columns = [content, words.dictionary.take(pa.array(by_name[term[first]])), pa.array(block[first], pa.int32()), pa.array(most), pa.array(np.diff(heads)), pa.ListArray.from_arrays(heads, one)]
    return pa.table(columns, ["content", "term", "block", "most", "n", "entries"])


def _impact(tf: Column | np.ndarray, length: Column | np.ndarray, mean: Column | float) -> Column | np.ndarray:
    """What a term adds to a record's score, but for its rarity; it grows with tf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class Search:
    """One query over the current parts of an index."""

    def __init__(self, spark: SparkSession, path: str, live: DataFrame, query: str, sources: list[str] | None = None):
        """live: contents() of the records now. A source whose part isn't there makes the search refuse with `stale_index`.
        sources: the scope, what the actor may see and asked for; more than 32 are refused."""
        check_page(1, sources)
        self.phrases = phrases_of(query)
        self.tokens = list(dict.fromkeys(t for p in self.phrases for t in p))
        if sources is not None:
            live = live.where(F.col("source").isin(sources))
        there = parts(spark, path).drop("records", "source")
        self.parts = materialized(live.select("source", "content", "records").join(there, "content", "left"))
        if not self.parts.where("blocks IS NULL").isEmpty():
            raise QueryError("stale_index")
        self.few = self.parts.limit(SENT_ROWS + 1).count() <= SENT_ROWS
        self.single = all(len(p) == 1 for p in self.phrases)
        stored = table_there(spark, f"{path}/postings")
        if stored is None:
            stored = spark.createDataFrame([], POSTINGS)
        self.postings = self._chosen(stored.where(F.col("term").isin(self.tokens)), self.parts.select("content"), "content")

    def _by_part(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """Rows with what is known of their part, a row each: sent to all executors where the parts were counted to be few."""
        return rows.join(F.broadcast(known) if self.few else known, "content")

    @staticmethod
    def _chosen(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
        """Rows of these keys: named in the filter, which reaches the scan, where they are few; else joined."""
        few = [r[0] for r in keys.limit(LISTED + 1).collect()]
        return rows.where(F.col(column).isin(few)) if len(few) <= LISTED else rows.join(keys, column, "left_semi")

    def scored(self, chosen: DataFrame | None = None) -> DataFrame:
        """(content, source, record, score) of all hits, or of those in the chosen blocks (content, block); no tokens but the query's are read."""
        rows = self.postings
        if chosen is not None:
            rows = self._chosen(rows, chosen.select("block").distinct(), "block").join(chosen, ["content", "block"], "left_semi")
        rows = rows.select("content", "term", F.inline("entries"))
        counts = [F.max(F.when(F.col("term") == t, F.size("at"))).alias(f"n{i}") for i, t in enumerate(self.tokens)]
        in_phrases = {t for p in self.phrases if len(p) > 1 for t in p}
        places = [F.first(F.when(F.col("term") == t, F.col("at")), ignorenulls=True).alias(f"p{i}") for i, t in enumerate(self.tokens) if t in in_phrases]
        counted = rows.groupBy("content", "record", "length").agg(*counts, *places)
        tf = [self._tf(p) for p in self.phrases]
        counted = counted.select("content", "record", "length", *(F.coalesce(x, F.lit(0)).alias(f"tf{i}") for i, x in enumerate(tf)))
        hits = counted.where(" AND ".join(f"tf{i} > 0" for i in range(len(tf))))
        known = self._by_part(hits, self.rarity(counted))
        score = functools.reduce(lambda a, b: a + b, (F.col(f"idf{i}") * _impact(F.col(f"tf{i}"), F.col("length"), F.col("mean")) for i in range(len(tf))))
        return known.select("content", "source", "record", F.round(score, 6).alias("score"))

    def _tf(self, phrase: list[str]) -> Column:
        at = [self.tokens.index(t) for t in phrase]
        if len(at) == 1:
            return F.col(f"n{at[0]}")
        together = lambda i: functools.reduce(lambda a, b: a & b, (F.array_contains(f"p{c}", i + k) for k, c in enumerate(at)))
        held = functools.reduce(lambda a, b: a & b, (F.col(f"p{c}").isNotNull() for c in at))
        return F.when(held, F.size(F.filter(f"p{at[0]}", together)))

    def rarity(self, counted: DataFrame) -> DataFrame:
        """(content, source, mean, idf0, ...) of each source: of terms from the headers of their blocks, of phrases from the counts of all records that hold them."""
        if self.single:
            df = self.postings.groupBy("content").agg(*(F.sum(F.when(F.col("term") == p[0], F.col("n"))).alias(f"df{i}") for i, p in enumerate(self.phrases)))
        else:
            df = counted.groupBy("content").agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(self.phrases))))
        df = self.parts.select("content", "source", "records", "mean").join(df, "content")
        n = lambda i: F.coalesce(F.col(f"df{i}"), F.lit(0))
        idf = [F.log(1 + (F.col("records") - n(i) + 0.5) / (n(i) + 0.5)).alias(f"idf{i}") for i in range(len(self.phrases))]
        return df.select("content", "source", "mean", *idf)

    def bounds(self) -> DataFrame:
        """(content, block, bound, possible): of each block that holds all tokens, a bound of its scores, and of how many hits it has. How rare a phrase is
        takes all records to know, so with one the bound is infinite."""
        most = [F.max(F.when(F.col("term") == t, F.col("most"))).alias(f"most{i}") for i, t in enumerate(self.tokens)]
        n = [F.max(F.when(F.col("term") == t, F.col("n"))).alias(f"n{i}") for i, t in enumerate(self.tokens)]
        blocks = self.postings.groupBy("content", "block").agg(*most, *n)
        blocks = blocks.where(" AND ".join(f"n{i} IS NOT NULL" for i in range(len(self.tokens))))
        possible = F.least(*(F.col(f"n{i}") for i in range(len(n)))) if len(n) > 1 else F.col("n0")
        if not self.single:
            return blocks.select("content", "block", F.lit(float("inf")).alias("bound"), possible.alias("possible"))
        at = [self.tokens.index(p[0]) for p in self.phrases]
        bound = functools.reduce(lambda a, b: a + b, (F.col(f"idf{i}") * F.col(f"most{t}") for i, t in enumerate(at)))
        return self._by_part(blocks, self.rarity(blocks)).select("content", "block", bound.alias("bound"), possible.alias("possible"))

    def top(self, k: int) -> DataFrame:
        """(source, record, score, rank) of the k best hits of each source, exactly; blocks whose bound stays below the kth score aren't
        read. A query with a phrase of several tokens reads all blocks that hold these."""
        by_score = Window.partitionBy("content").orderBy(F.desc("score"), "record")
        if not self.single:
            hits = self.scored()
            return hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("source", "record", "score", "rank")
        blocks = materialized(self.bounds())
        by_bound = Window.partitionBy("content").orderBy(F.desc("bound"), "block")
        first = materialized(blocks.withColumn("_r", F.row_number().over(by_bound)).where(F.col("_r") <= FIRST_BLOCKS).select("content", "block"))
        seen = materialized(self.scored(first))
        rest = self.open(blocks, first, seen, k)
        hits = seen.unionByName(self.scored(rest))
        return hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("source", "record", "score", "rank")

    def open(self, blocks: DataFrame, first: DataFrame, seen: DataFrame, k: int) -> DataFrame:
        """Blocks beside the first whose bound reaches the kth score that was seen in their source."""
        by_score = Window.partitionBy("content").orderBy(F.desc("score"), "record")
        kth = seen.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") == k).select("content", F.col("score").alias("kth"))
        left = blocks.join(first, ["content", "block"], "left_anti")
        known = left.join(kth, "content", "left").where(F.col("kth").isNull() | (F.col("bound") + SLACK >= F.col("kth")))
        return materialized(known.select("content", "block"))

    def guarded(self, most: int = MAX_MATCHES) -> DataFrame:
        """The hits, unless there are more than `most`: then the search is refused with `query_too_broad`.

        The blocks' headers bound the number; only where the bound is above `most` are hits counted, and no more than most + 1 of them.
        """
        possible = self.bounds().agg(F.sum("possible")).first()[0] or 0
        hits = self.scored()
        if possible > most and hits.limit(most + 1).count() > most:
            raise QueryError("query_too_broad")
        return hits.drop("content")
