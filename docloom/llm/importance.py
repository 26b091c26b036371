"""Importance resampling towards a target: hashed n-gram counts of the corpus and of the target weigh documents, Gumbel noise draws.

Texts are taken in blocks. The different words of a block are mapped to integers, its n-grams are tuples of them held in one
integer each, and each different tuple is written out as bytes and hashed once; its bucket then goes back to all its places.
Both scans keep a block in memory and send counts of buckets only, so what is shuffled doesn't grow with the texts' length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.base import numbered
from docloom.llm.common import cut_lineage, slices, text_bytes

#: Bytes of one text that are split at a time; the rest of a longer text follows in the next pieces.
PIECE_BYTES = 1 << 20
#: Bytes that stand between words (0x00-0x2F, 0x3A-0x60, 0x7B-0x7F once A-Z are lower-cased) become blanks; the others stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size; no word is cut."""
    rest = b""
    for start in range(0, len(data), size):
        part = rest + data[start : start + size].translate(WORD_BYTES)
        words = part.split()
        rest = words.pop() if words and start + size < len(data) and part[-1] != 32 else b""
        yield words


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[bytes], np.ndarray]]:
    """(rows, row of each word, words, whether a word opens its text): many short texts at a time, or one piece of a long one.

    A piece after the first begins with the last word of the one before, which counts as a word of that one only.
    """
    for part in slices(batches, text, PIECE_BYTES):
        data = text_bytes(part.column(text))
        if len(data) > 1 or len(data[0]) <= PIECE_BYTES:
            split = [x.translate(WORD_BYTES).split() for x in data]
            sizes = np.array([len(x) for x in split])
            opens = np.zeros(sizes.sum(), dtype=bool)
            opens[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
            yield part, np.repeat(np.arange(len(data)), sizes), [w for x in split for w in x], opens
            continue
        last: list[bytes] = []
        for words in pieces(data[0]):
            rows, opens = np.zeros(len(last) + len(words), dtype=np.int64), np.zeros(len(last) + len(words), dtype=bool)
            opens[:1] = not last
            if last:
                rows[0] = -1
            yield part, rows, last + words, opens
            last = (last + words)[-1:]


def features(words: list[bytes], rows: np.ndarray, opens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each run of one or two words of a block, repeats included; a word of row -1 only begins a pair."""
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    coded = pa.array(words, pa.binary()).dictionary_encode()
    ids, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    single = np.array([zlib.crc32(w) % buckets for w in known], dtype=np.int64)[ids]
    own = rows >= 0
    second = np.flatnonzero(~opens[1:]) + 1
    tuples = pa.array(ids[second - 1] * len(known) + ids[second]).dictionary_encode()
    first, last = np.divmod(tuples.dictionary.to_numpy(), len(known))
    of_tuple = np.array([zlib.crc32(known[a] + b" " + known[b]) % buckets for a, b in zip(first.tolist(), last.tolist(), strict=True)], dtype=np.int64)
    return np.concatenate([rows[own], rows[second]]), np.concatenate([single[own], of_tuple[tuples.indices.to_numpy()]])


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = 10_000) -> np.ndarray:
    """How many features of all whole texts fall into each bucket. Null texts have none.

    A task adds up its own blocks and sends a row per bucket at most; `buckets` sums reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for _, rows, words, opens in blocks(batches):
            total += np.bincount(features(words, rows, opens, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Floored, scaled log ratio of a bucket's smoothed shares in the target and in the corpus."""
    whole, wanted, n = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = [(t + 1) * (whole + n) / ((s + 1) * (wanted + n)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.floor(scale * np.log(np.array(ratio))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row; gain: one whole number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None
        for rows_of, rows, words, opens in blocks(batches):
            if rows_of is not part:
                if part is not None:
                    yield out(part, *held)
                part, held = rows_of, [np.zeros(rows_of.num_rows, dtype=np.int64) for _ in range(3)]
            row, bucket = features(words, rows, opens, len(gain))
            held[0] += np.bincount(rows[rows >= 0], minlength=part.num_rows)
            held[1] += np.bincount(row, minlength=part.num_rows)
            np.add.at(held[2], row, gain[bucket])
        if part is not None:
            yield out(part, *held)

    def out(part: pa.RecordBatch, n_words: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (n_words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): `percent` of the documents of enough words are drawn, those of the highest scores.

    Every row counts, repeated ones too; null texts and texts without words have no feature and weight 0. The noise of a row comes from
    its id alone; a null id counts as an empty one and comes last among ties. Rows of equal id and score are ranked by their number
    of features. Empty tables give an empty result; an empty target gives all its buckets the same share.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    scored = cut_lineage(weighed(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise))
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = percent * fit.count() // 100
    ranked = numbered(fit, F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", name="place")
    ranked = ranked.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
