"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The texts are cut into pieces by the vocabulary's pattern; different pieces not seen before are encoded together. Their
symbols lie in one flat array. A round finds the rank of each neighbouring pair by binary search over the sorted pair keys,
takes each piece's lowest, and merges that pair wherever it occurs in the piece.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import slices

#: Fixed value: the pattern that cuts texts into pieces, part of the vocabulary's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int64(1) << 40
#: Pieces that a task remembers before it starts anew.
REMEMBERED = 250_000


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of start, start + 1, ... for each range."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class ByteBpe:
    """One vocabulary, with the pieces encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        byte_of, vocab = _byte_characters(), data["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * self.size
        for text, i in vocab.items():
            spelled[i] = bytes(byte_of[c] for c in text) if text not in self.special else text.encode()
        for text, i in self.special.items():
            spelled[i] = text.encode()
        self.token_length = np.array([len(x) for x in spelled])
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in byte_of.items():
            self.byte_id[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int64)
        self.start, self.length = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self._add(list(self.special), np.array(list(self.special.values()), dtype=np.int64), np.ones(len(self.special), dtype=np.int64))

    def _add(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.start = np.append(self.start, len(self.ids) + np.cumsum(lengths) - lengths)
        self.length = np.append(self.length, lengths)
        self.ids = np.append(self.ids, ids)
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each piece)."""
        lengths = np.array([len(x) for x in pieces], dtype=np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        rank = np.full(len(symbols), NO_RANK)  # of the pair that starts here
        fresh = np.flatnonzero(owner[:-1] == owner[1:])
        rank[fresh] = self._rank(symbols[fresh], symbols[fresh + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[heads, len(symbols)])
            lowest = np.minimum.reduceat(rank, heads)
            going = np.repeat(lowest < NO_RANK, sizes)
            if not going.all():
                done.append((owner[~going], symbols[~going]))
                symbols, owner, rank = symbols[going], owner[going], rank[going]
                lowest = np.repeat(lowest, sizes)[going]
                if not len(symbols):
                    break
            else:
                lowest = np.repeat(lowest, sizes)
            at = np.flatnonzero(rank == lowest)
            run = np.r_[True, np.diff(at) != 1]  # in "aaa" the pair occurs twice but can be merged once
            first = np.flatnonzero(run)
            at = at[(np.arange(len(at)) - first[np.cumsum(run) - 1]) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            fresh = np.unique(np.r_[at, np.maximum(at - 1, 0)])
            rank[fresh] = NO_RANK
            fresh = fresh[fresh < len(symbols) - 1]
            fresh = fresh[owner[fresh] == owner[fresh + 1]]
            rank[fresh] = self._rank(symbols[fresh], symbols[fresh + 1])
        owners = np.concatenate([o for o, _ in done]) if done else owner
        ids = np.concatenate([s for _, s in done]) if done else symbols
        order = np.argsort(owners, kind="stable")
        return ids[order], np.bincount(owners, minlength=len(pieces))

    def pieces(self, text: str) -> list[str]:
        if self.split is None or not self.split.search(text):
            return self.pattern.findall(text)
        return [p for x in self.split.split(text) for p in ([x] if x in self.special else self.pattern.findall(x))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self.known) > REMEMBERED:
            self.forget()
        cut = [self.pieces(t) for t in texts]
        new = list({p for pieces in cut for p in pieces if p not in self.known})
        if new:
            self._add(new, *self.merge([p.encode() for p in new]))
        which = np.fromiter((self.known[p] for pieces in cut for p in pieces), np.int64)
        lengths = self.length[which]
        ids = self.ids[ranges(self.start[which], lengths)]
        ends = np.cumsum(lengths)
        bounds = np.r_[0, ends][np.cumsum([0, *map(len, cut)])]
        return ids, np.diff(bounds)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids spell; what is not UTF-8 turns into U+FFFD, as in a decoded string."""
        out = self.token_bytes[ranges(self.token_start[ids], self.token_length[ids])].tobytes()
        return out.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBpe:
    """One per task process and file."""
    return ByteBpe(path)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the token ids of each whole text and the text that they spell.

    path: a tokenizer file with byte-level BPE, readable on every executor. Null texts count as empty and give no ids;
    special tokens in a text are taken as such; each row stands alone, so equal rows give equal rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, lengths in encoded(batches, path):
            bpe, ends = vocabulary(path), np.cumsum(lengths)
            decoded = [bpe.decode(ids[e - n : e]).decode() for e, n in zip(ends, lengths, strict=True)]
            listed = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("id"), listed, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string")


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids of all their texts in a row, ids of each text) for small slices of the batches."""
    bpe = vocabulary(path)
    for part in slices(batches):
        yield part, *bpe.encode([x or "" for x in part.column("text").to_pylist()])


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of round_trip(), hashed where they are made instead of moved as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, lengths in encoded(batches, path):
            bpe, ends, small = vocabulary(path), np.cumsum(lengths), ids.astype("<u4")
            spans = [(e - n, e) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            hashed = [hashlib.sha256(small[a:b].tobytes()).hexdigest() for a, b in spans]
            decoded = [hashlib.sha256(bpe.decode(ids[a:b])).hexdigest() for a, b in spans]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lengths), pa.array(hashed), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
