"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.base import shared_folder

#: Bytes of text that a task turns into Python objects at a time.
SLICE_BYTES = 2 << 20


_held: dict[object, object] = {}


def held_alone(key: object, build: Callable[[], object]) -> object:
    """What `build` makes, kept in the task process until something else is asked for: a worker goes from stage to stage, and the
    models of earlier ones make room."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Named columns of one parquet table; only these reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


#: Rows of narrow tables that a file of cut lineage may hold.
ROWS_A_FILE = 500_000


def cut_lineage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialize in the shared folder, so that a lost executor costs no step before this one.

    rows: a bound on the rows of a narrow table, where known; it is then written to as few files as its size needs.
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(rows // ROWS_A_FILE + 1)).checkpoint()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words_of(data: bytes, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lists of words of one text in blocks, so that a very long text stays in bounds.

    Words are runs of anything but space and 0x09-0x0D, which is what bytes.split() takes as separators.
    """
    if len(data) <= block:
        yield data.split()
        return
    start, rest = 0, b""
    while start < len(data):
        piece = rest + data[start : start + block]
        start += block
        words = piece.split()
        rest = words.pop() if words and start < len(data) and not piece[-1:].isspace() else b""
        yield words


def crc_bucket(column: str, modulus: int):
    """crc32 of an id as text, modulo; null ids fall into no bucket."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def hot_keys(df: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Keys that hold more than 1/share of all rows, so at most `share` rows: safe to broadcast."""
    n = df.groupBy(key).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_total"))
    return n.join(F.broadcast(total), F.col("_n") * share > F.col("_total")).select(key).repartition(1)


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of `left` with rows that `right` has once per key, whatever share of `left` one key holds.

    Keys above a thousandth of `left` (at most a thousand of them) are looked up by broadcast, the others by a shuffle.
    Both sides should be materialized, since each is read twice.
    """
    hot = cut_lineage(hot_keys(left, key))
    often = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key)
    return left.join(often, key).unionByName(rest)
