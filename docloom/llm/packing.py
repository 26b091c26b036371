"""Packing by lexical retrieval: each seed document fills its window with unused neighbours from a sharded BM25 index.

A task reads its documents in order and forms shards of a bounded number of tokens, so nothing is shuffled and no group
grows with the input. Full windows of a long document stand alone; its tail goes to the shard. Within a shard the first
unused tail is the seed; the tails that its BM25 query ranks highest follow, and the last one taken is cut where the window
ends, its rest staying in the shard. What is left when a shard runs out is cut into sequences of power-of-two lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.bpe import PATTERN, ranges, vocabulary
from docloom.llm.common import slices

#: Longest text, in characters, for the faster library: its pattern engine gives up on runs of about a million blanks.
LIBRARY_CHARACTERS = 200_000

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary of a tokenizer file for the faster library; both give the same ids, as ids follow the merge order."""
    bpe = vocabulary(path)
    if (np.diff(bpe.merged) != 1).any():
        raise ValueError("ids do not follow the merge order")
    ends = bpe.token_start + bpe.token_length
    data = bpe.token_bytes.tobytes()
    special = set(bpe.special.values())
    ranks = {data[a:b]: i for i, (a, b) in enumerate(zip(bpe.token_start.tolist(), ends.tolist(), strict=True)) if i not in special}
    return tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=bpe.special)


def token_ids(text: str, path: str) -> np.ndarray:
    """Token ids of one whole text; long texts go through the merge rounds of bpe, which take runs of any length."""
    if len(text) > LIBRARY_CHARACTERS:
        return vocabulary(path).encode([text])[0].astype(np.uint32)
    return encoder(path).encode_to_numpy(text, allowed_special="all")


class Shard:
    """BM25 over the tails of one shard; terms are token ids, the query of a seed is its whole tail."""

    def __init__(self, tails: list[np.ndarray], k1: float, b: float):
        n = len(tails)
        lengths = np.array([len(x) for x in tails])
        _, terms = np.unique(np.concatenate(tails), return_inverse=True)
        pairs, tf = np.unique(np.repeat(np.arange(n), lengths) * (terms.max() + 1) + terms, return_counts=True)
        docs, terms = np.divmod(pairs, terms.max() + 1)
        self.df = np.bincount(terms)
        idf = np.log1p((n - self.df + 0.5) / (self.df + 0.5))
        weight = idf[terms] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[docs] / lengths.mean()))
        self.terms, self.first = terms, np.searchsorted(docs, np.arange(n + 1))
        by_term = np.argsort(terms, kind="stable")
        self.posting, self.weight = docs[by_term], weight[by_term]
        self.start = np.cumsum(self.df) - self.df

    def scores(self, seed: int) -> np.ndarray:
        terms = self.terms[self.first[seed] : self.first[seed + 1]]
        at = ranges(self.start[terms], self.df[terms])
        return np.bincount(self.posting[at], self.weight[at], len(self.first) - 1)


def fill(tails: list[np.ndarray], window: int, k1: float = 1.2, b: float = 0.75) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (tail, start, length) that hold each token of the tails once."""
    index = Shard(tails, k1, b)
    start, left = np.zeros(len(tails), dtype=np.int64), np.array([len(x) for x in tails], dtype=np.int64)
    seed = 0
    while seed < len(tails):
        if not left[seed]:
            seed += 1
            continue
        scores = index.scores(seed)
        scores[left == 0] = -1
        scores[seed] = np.inf
        order = np.argsort(-scores, kind="stable")
        order = order[: np.count_nonzero(left)]
        total = np.cumsum(left[order])
        taken = order[: np.searchsorted(total, window) + 1]
        lengths = left[taken].copy()
        lengths[-1] -= max(0, int(total[len(taken) - 1]) - window)
        pieces = list(zip(taken.tolist(), start[taken].tolist(), lengths.tolist(), strict=True))
        yield from [pieces] if total[-1] >= window else _split(pieces)
        start[taken] += lengths
        left[taken] -= lengths


def _split(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The last pieces of a shard, cut into sequences of power-of-two lengths, longest first."""
    rest = sum(x[2] for x in pieces)
    while rest:
        size = 1 << (rest.bit_length() - 1)
        rest -= size
        out = []
        while size:
            tail, start, length = pieces.pop(0)
            out.append((tail, start, min(length, size)))
            if length > size:
                pieces.insert(0, (tail, start + size, length - size))
            size -= out[-1][2]
        yield out


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, shard_tokens: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is the token ids of its whole text and then `end_id`; a null or empty text is `end_id` alone. Each id lies in
    one piece, each sequence is at most `window` long. Every row is packed, so repeated rows give repeated pieces; rows with
    a null id keep it. Sequence ids are made of the partition's number and a counter: a repeated task gives the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sequence = TaskContext.get().partitionId() << 36, 0
        rows: list[tuple] = []
        tails: list[np.ndarray] = []
        owners: list[tuple] = []

        def piece(owner: tuple, ids: np.ndarray, at: int, offset: int) -> tuple:
            doc, total = owner
            return doc, at, len(ids), zlib.crc32(ids.tobytes()), total, base + sequence, offset

        def out() -> pa.RecordBatch:
            names = [x.split()[0] for x in PIECES.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)
            rows.clear()
            return batch

        def flush() -> None:
            nonlocal sequence
            for pieces in fill(tails, window):
                offset = 0
                for i, start, length in pieces:
                    at = (owners[i][1] - len(tails[i])) + start
                    rows.append(piece(owners[i], tails[i][start : start + length], at, offset))
                    offset += length
                sequence += 1
            tails.clear()
            owners.clear()

        held = 0
        for part in slices(batches):
            for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.append(token_ids(text or "", path), np.uint32(end_id)).astype("<u4")
                whole = len(ids) // window * window
                for at in range(0, whole, window):
                    rows.append(piece((doc, len(ids)), ids[at : at + window], at, 0))
                    sequence += 1
                if whole < len(ids):
                    tails.append(ids[whole:])
                    owners.append((doc, len(ids)))
                    held += len(tails[-1])
                if held >= shard_tokens:
                    flush()
                    held = 0
            if rows:
                yield out()
        if tails:
            flush()
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
