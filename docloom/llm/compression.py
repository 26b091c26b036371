"""Vector codes: product quantization whose codebooks are fitted by heap Lloyd rounds over whole numbers.

Vectors are cut into equal parts, each with a codebook of its own. A block of vectors holds, per part and entry, a heap of the
parts assigned to the entry, keyed by the slack between the distances to the second nearest entry and to the entry itself,
moved by how far the entries had drifted when the part was last looked at. After a round of updates the drift of each entry grows; only
parts whose slack it has used up are popped and compared with all entries again. A heap is kept as a sorted run, so pops are a
prefix. Every comparison is of exact integers; the bounds are floating-point numbers that are rounded to the safe side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut_lineage, lookup

#: Vectors of a block, and parts that are compared with a whole codebook at a time.
BLOCK, AT_ONCE = 8192, 4096
#: What a slack has to exceed its drift by, as a share of the numbers that it comes from.
SAFE = 1e-6
STATE = "vec_id array<long>, label array<string>, vectors binary, kind string, keys binary, rows binary, sizes binary, moved array<decimal(38,0)>"


@dataclass
class Codebooks:
    """entries: (parts, entries, width), exact; drift: how far each entry's bound has moved since the first round, (parts, entries)."""

    entries: np.ndarray
    drift: np.ndarray

    def updated(self, counts: np.ndarray, sums: np.ndarray) -> Codebooks:
        """Each entry moves to the floored mean of its parts; entries without any stay."""
        means = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], self.entries)
        step = np.sqrt(((means - self.entries) ** 2).sum(axis=2).astype(float)) * (1 + SAFE)
        order = np.sort(step, axis=1)
        most = np.where(step == order[:, -1:], order[:, -2:-1] if order.shape[1] > 1 else 0.0, order[:, -1:])
        return Codebooks(means, self.drift + step + most)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.entries.ravel().tolist()).encode()).hexdigest()


def _exact(vectors: np.ndarray, entries: np.ndarray) -> type:
    """int64 where squared distances fit it, else Python's whole numbers."""
    far = int(max(np.abs(vectors).max(initial=0), np.abs(entries).max(initial=0)))
    return np.int64 if vectors.shape[-1] * (2 * far) ** 2 < 2**62 else object


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, slack) of each part: the nearest entry, ties to the lower index, and a lower bound of how much farther the next one is."""
    kind = _exact(parts, entries)
    at, slack = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts))
    for low in range(0, len(parts), AT_ONCE):
        piece = parts[low : low + AT_ONCE].astype(kind)
        away = ((piece[:, None, :] - entries.astype(kind)[None]) ** 2).sum(axis=2)
        best = away.argmin(axis=1)
        at[low : low + AT_ONCE] = best
        near = np.sqrt(away[np.arange(len(piece)), best].astype(float))
        if len(entries) > 1:
            others = away.astype(float)
            others[np.arange(len(piece)), best] = np.inf
            second = np.sqrt(others.min(axis=1))
            slack[low : low + AT_ONCE] = second * (1 - SAFE) - near * (1 + SAFE)
        else:
            slack[low : low + AT_ONCE] = np.inf
    return at, slack


class Heaps:
    """Per part and entry, the rows of a block by rising key: keys and rows are (parts, n), sizes (parts, entries)."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray):
        self.keys, self.rows, self.sizes = keys, rows, sizes

    @classmethod
    def of(cls, at: np.ndarray, keys: np.ndarray, n_entries: int) -> Heaps:
        """at, keys: (parts, n)."""
        rows = np.stack([np.lexsort((k, a)) for a, k in zip(at, keys, strict=True)])
        sizes = np.stack([np.bincount(a, minlength=n_entries) for a in at])
        return cls(np.take_along_axis(keys, rows, axis=1), rows, sizes)

    def assigned(self) -> np.ndarray:
        """The entry of each row, (parts, n)."""
        out = np.empty_like(self.rows)
        for p, sizes in enumerate(self.sizes):
            out[p, self.rows[p]] = np.repeat(np.arange(len(sizes)), sizes)
        return out

    def pop(self, drift: np.ndarray) -> list[np.ndarray]:
        """Places, per part, of what each heap pops: the keys that the drift of its entry has reached."""
        out = []
        for keys, sizes, moved in zip(self.keys, self.sizes, drift, strict=True):
            ends = np.cumsum(sizes)
            out.append(np.concatenate([np.arange(e - n, e - n + np.searchsorted(keys[e - n : e], d, "right")) for e, n, d in zip(ends, sizes, moved, strict=True)]))
        return out


def _parts(vectors: np.ndarray, books: Codebooks) -> np.ndarray:
    """(parts, n, width) of (n, length)."""
    return vectors.reshape(len(vectors), len(books.entries), -1).transpose(1, 0, 2)


def assign(vectors: np.ndarray, books: Codebooks) -> Heaps:
    found = [nearest(part, entries) for part, entries in zip(_parts(vectors, books), books.entries, strict=True)]
    at = np.stack([f[0] for f in found])
    keys = np.stack([f[1] for f in found]) + np.take_along_axis(books.drift, at, axis=1)
    return Heaps.of(at, keys, books.entries.shape[1])


def reassign(vectors: np.ndarray, heaps: Heaps, books: Codebooks) -> tuple[Heaps, int]:
    """The heaps after pops and exact rescans of what they popped, and how many parts that were."""
    at, n = heaps.assigned(), 0
    keys = np.empty_like(heaps.keys)
    np.put_along_axis(keys, heaps.rows, heaps.keys, axis=1)
    for p, (part, places) in enumerate(zip(_parts(vectors, books), heaps.pop(books.drift), strict=True)):
        rows = heaps.rows[p, places]
        if len(rows):
            entry, slack = nearest(part[rows], books.entries[p])
            at[p, rows], keys[p, rows] = entry, slack + books.drift[p, entry]
            n += len(rows)
    return Heaps.of(at, keys, books.entries.shape[1]), n


def _moved(vectors: np.ndarray, before: np.ndarray | None, after: np.ndarray, books: Codebooks) -> list[int]:
    """What a block's moves add to counts and sums, flat: per part and entry its count and the sums of its components."""
    parts, shape = _parts(vectors, books), books.entries.shape
    out = np.zeros((shape[0], shape[1], shape[2] + 1), dtype=_exact(vectors, books.entries))
    for p in range(shape[0]):
        rows = np.arange(len(vectors)) if before is None else np.flatnonzero(before[p] != after[p])
        for sign, entry in ((1, after[p, rows]),) if before is None else ((1, after[p, rows]), (-1, before[p, rows])):
            np.add.at(out[p, :, 0], entry, sign)
            np.add.at(out[p, :, 1:], entry, sign * parts[p, rows].astype(out.dtype))
    return [int(x) for x in out.ravel().tolist()]


def _small(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as hold them."""
    far = int(np.abs(values).max(initial=0))
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if far <= np.iinfo(t).max))


def _row(ids, labels, vectors: np.ndarray, heaps: Heaps, moved: list[int]) -> pa.RecordBatch:
    """A block's state; keys are rounded down to four bytes."""
    keys = heaps.keys.astype(np.float32)
    keys = np.where(keys > heaps.keys, np.nextafter(keys, np.float32(-np.inf)), keys).astype(np.float32)
    small = _small(vectors)
    values = [[ids], [labels], [small.tobytes()], [small.dtype.str], [keys.tobytes()], [heaps.rows.astype(np.uint16).tobytes()], [heaps.sizes.astype(np.int32).tobytes()], [moved]]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.decimal128(38, 0))]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in STATE.split(", ")])


def _read(row: dict, books: Codebooks) -> tuple[np.ndarray, Heaps]:
    n, (parts, entries, _) = len(row["vec_id"]), books.entries.shape
    vectors = np.frombuffer(row["vectors"], dtype=np.dtype(row["kind"])).reshape(n, -1).astype(np.int64)
    heaps = Heaps(
        np.frombuffer(row["keys"], dtype=np.float32).reshape(parts, n).astype(float),
        np.frombuffer(row["rows"], dtype=np.uint16).reshape(parts, n).astype(np.int64),
        np.frombuffer(row["sizes"], dtype=np.int32).reshape(parts, entries).astype(np.int64),
    )
    return vectors, heaps


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def _first(books: Codebooks):
    """Blocks of rows with all their parts assigned."""

    def block(ids: list, labels: list, vectors: np.ndarray) -> pa.RecordBatch:
        heaps = assign(vectors, books)
        return _row(ids, labels, vectors, heaps, _moved(vectors, None, heaps.assigned(), books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held = [], [], []
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                if held and len(ids) + part.num_rows > BLOCK:
                    yield block(ids, labels, np.concatenate(held))
                    ids, labels, held = [], [], []
                ids += part.column("vec_id").to_pylist()
                labels += part.column("label").to_pylist()
                held.append(_matrix(part))
        if held:
            yield block(ids, labels, np.concatenate(held))

    return run


def _again(books: Codebooks):
    """The blocks after their heaps were popped for the drift so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                vectors, heaps = _read(row, books)
                after, _ = reassign(vectors, heaps, books)
                yield _row(row["vec_id"], row["label"], vectors, after, _moved(vectors, heaps.assigned(), after.assigned(), books))

    return run


def _coded(books: Codebooks):
    """(vec_id, label, code, error) of each row, by the last codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                vectors, heaps = _read(row, books)
                at = reassign(vectors, heaps, books)[0].assigned()
                kind, error = _exact(vectors, books.entries), 0
                for p, part in enumerate(_parts(vectors, books)):
                    error = error + ((part.astype(kind) - books.entries[p].astype(kind)[at[p]]) ** 2).sum(axis=1)
                codes = [bytes(x).hex() for x in at.T.astype(np.uint8)]
                errors = pa.array([x if x < 2**63 else None for x in error.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_id"], pa.int64()), pa.array(row["label"], pa.string()), pa.array(codes), errors], ["vec_id", "label", "code", "error"])

    return run


def _totals(state: DataFrame, books: Codebooks, before: np.ndarray | None) -> np.ndarray:
    """Counts and sums per part and entry, those of earlier rounds included; their number is fixed by the parameters."""
    shape = (*books.entries.shape[:2], books.entries.shape[2] + 1)
    out = np.zeros(int(np.prod(shape)), dtype=object)
    for r in state.select(F.posexplode("moved").alias("at", "n")).where("n <> 0").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = int(r["n"])
    return out.reshape(shape) + (0 if before is None else before)


def compress(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row with a usable vector.

    Components become floor(scale * x). Left out are vectors that are null or hold null or non-finite components, or ones whose scaled value
    doesn't fit 64 bits, and those whose length isn't that of the row with the smallest id among the vectors that `parts` divides. Repeated
    rows all count; of rows of one id the smaller vector comes first; null ids are kept and come last. With fewer than `entries` rows
    codebooks are that small. At most 256 entries. A sum of errors that doesn't fit 64 bits is null. An empty table gives an empty result.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits")
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < 2.0**63))
    usable = rows.where(F.coalesce(finite, F.lit(False)) & (F.size(vector_col) > 0) & (F.size(vector_col) % parts == 0))
    vector = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    label = F.to_json(F.struct(F.col(label_col).alias("of")))
    kept = usable.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), vector.alias("vector"))
    order = (F.asc_nulls_last("vec_id"), "vector")
    head = kept.select("vec_id", "vector", F.size("vector").alias("n")).orderBy(*order).limit(1).collect()
    if head:
        kept = kept.where(F.size("vector") == head[0]["n"])
    start = np.array([r["vector"] for r in kept.select("vec_id", "vector").orderBy(*order).limit(entries).collect()] or [[0] * parts], dtype=object)
    books = Codebooks(start.reshape(len(start), parts, -1).transpose(1, 0, 2), np.zeros((parts, len(start))))
    state, totals = cut_lineage(kept.mapInArrow(_first(books), STATE)), None
    for i in range(rounds):
        if i:
            state = cut_lineage(state.drop("moved").mapInArrow(_again(books), STATE))
        totals = _totals(state, books, totals)
        books = books.updated(totals[:, :, 0], totals[:, :, 1:])
    coded = cut_lineage(state.drop("moved").mapInArrow(_coded(books), "vec_id long, label string, code string, error long"))
    whole = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    whole = cut_lineage(whole.select("label", F.when(F.abs("sum") <= F.lit(2**63 - 1), F.col("sum")).cast("long").alias("label_error")))
    return lookup(coded, whole, "label").select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
