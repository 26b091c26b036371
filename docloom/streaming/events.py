"""Structured Streaming over event tables: late data behind a watermark, windows, sessions, stateful job states. Extensions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(events: DataFrame, at: str, keys: list[str], value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and key; a window is closed once the watermark has passed it."""
    found = events.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key, ended by a gap: the streaming form of interval merging."""
    found = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_requests(events: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first request of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def job_states(events: DataFrame, key: str, moves: dict[str, tuple[str, ...]], first: str, terminal: tuple[str, ...]) -> DataFrame:
    """The state of each job after every batch of events (key, seq, state); refused moves are counted, terminal states stay."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, refused = state.get if state.exists else (first, 0)
        for target in pd.concat(list(batches)).sort_values("seq")["state"]:
            if now not in terminal and target in moves.get(now, ()):
                now = target
            else:
                refused += 1
        state.update((now, refused))
        yield pd.DataFrame([(keys[0], now, refused)], columns=[key, "state", "refused"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string, refused long", "state string, refused long", "update", GroupStateTimeout.NoTimeout)
