"""Ordered folds: state that depends on what was emitted. A group is streamed through its task; only the fold's state is held."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.functions.base import looked_up, materialized

OUT_ROWS = 4096


def fold(df: DataFrame, keys: list[str], order: list[str], step: Callable[[Iterable[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that `step` yields from each group's rows, which it gets one after another in order; the keys are added by step's own rows.

    Groups are dealt by their keys and sorted by Spark, so a group of any size goes through its task batch by batch. A fold needs
    what came before, so a group isn't split.
    """
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *(F.asc_nulls_last(c) for c in order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(b.slice(i, OUT_ROWS).to_pylist() for b in batches for i in range(0, b.num_rows, OUT_ROWS))
        out = chain.from_iterable(step(group) for _, group in groupby(rows, itemgetter(*keys)))
        while part := list(islice(out, OUT_ROWS)):
            yield pa.RecordBatch.from_pylist(part, schema=arrow)

    return ordered.mapInArrow(run, fields)


def timed_chunks(df: DataFrame, key: str, target: float = 45.0, overlap: int = 2) -> DataFrame:
    """Segments (key, seg_id, start, end) gathered until they last `target` seconds; the last `overlap` open the next chunk.

    A final rest is a chunk of its own if it has a segment that no chunk has yet. An overlap of 0 keeps none.
    """

    def step(rows: Iterable[dict]) -> Iterator[dict]:
        held, done, n = [], -1, 0
        for i, r in enumerate(rows):
            held.append((i, r))
            if r["end"] - held[0][1]["start"] >= target:
                yield {key: r[key], "chunk": n, "first_seg": held[0][1]["seg_id"], "last_seg": r["seg_id"], "n_segments": len(held)}
                n, done = n + 1, i
                held = held[-overlap:] if overlap else []
        if held and held[-1][0] > done:
            yield {key: held[0][1][key], "chunk": n, "first_seg": held[0][1]["seg_id"], "last_seg": held[-1][1]["seg_id"], "n_segments": len(held)}

    kind = df.schema[key].dataType.simpleString()
    return fold(df, [key], ["seg_id"], step, f"{key} {kind}, chunk long, first_seg long, last_seg long, n_segments long")


def bounded_batches(df: DataFrame, key: str, order: list[str], most: int = 16, span: float = 180.0) -> DataFrame:
    """Rows (key, at) in order, a new batch after `most` rows or beyond `span` from the batch's first row."""

    def step(rows: Iterable[dict]) -> Iterator[dict]:
        n, first, batch = 0, None, -1
        for r in rows:
            if first is None or n >= most or r["at"] - first > span:
                n, first, batch = 0, r["at"], batch + 1
            n += 1
            yield {key: r[key], "id": r["id"], "batch": batch}

    kind = df.schema[key].dataType.simpleString()
    return fold(df, [key], order, step, f"{key} {kind}, id long, batch long")


def merged_blocks(df: DataFrame, key: str, most: int = 260) -> DataFrame:
    """Neighbouring blocks (key, order, page, tokens, text) of a page joined while they have at most `most` tokens together."""

    def step(rows: Iterable[dict]) -> Iterator[dict]:
        held: dict | None = None
        for r in rows:
            if held and held["page"] == r["page"] and held["tokens"] + r["tokens"] <= most:
                held = {**held, "tokens": held["tokens"] + r["tokens"], "text": f"{held['text']}\n{r['text']}", "last": r["order"]}
            else:
                if held:
                    yield held
                held = {key: r[key], "first": r["order"], "last": r["order"], "page": r["page"], "tokens": r["tokens"], "text": r["text"]}
        if held:
            yield held

    kind = df.schema[key].dataType.simpleString()
    return fold(df, [key], ["order"], step, f"{key} {kind}, first long, last long, page long, tokens long, text string")


def capped_windows(df: DataFrame, key: str, gap: float = 2.0, cap: float = 75.0) -> DataFrame:
    """Intervals merged where the gap is small and the whole stays within the cap; one that exceeds it opens a new window."""

    def step(rows: Iterable[dict]) -> Iterator[dict]:
        start = end = None
        n = 0
        for r in rows:
            if start is not None and r["start"] - end <= gap and max(end, r["end"]) - start <= cap:
                end, n = max(end, r["end"]), n + 1
                continue
            if start is not None:
                yield {key: k, "start": start, "end": end, "n": n}
            k, start, end, n = r[key], r["start"], r["end"], 1
        if start is not None:
            yield {key: k, "start": start, "end": end, "n": n}

    kind = df.schema[key].dataType.simpleString()
    return fold(df, [key], ["start", "end"], step, f"{key} {kind}, start double, end double, n long")


def distinct_frames(df: DataFrame, key: str, bits: int = 5, seconds: float = 15.0) -> DataFrame:
    """Frames (key, frame, at, hash) that differ from the last kept one by `bits`, or come `seconds` after it."""

    def step(rows: Iterable[dict]) -> Iterator[dict]:
        last = None
        for r in rows:
            if last is None or ((int(r["hash"]) ^ int(last["hash"])) & (2**64 - 1)).bit_count() >= bits or r["at"] - last["at"] >= seconds:
                last = r
                yield {key: r[key], "frame": r["frame"]}

    kind = df.schema[key].dataType.simpleString()
    return fold(df, [key], ["at", "frame"], step, f"{key} {kind}, frame long")


#: Rows of a topic that one round of leaders() settles in order, and topics whose new leaders a round sends to all rows.
ROUND_ROWS, ROUND_TOPICS = 1024, 64


def _led(least: float):
    """Of a topic's rows in order: whom each joins, the first leader with that cosine, or itself; the rows must be few."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        units, names, kept = _units(group), group.column("id").to_pylist(), []
        led = []
        for i, v in enumerate(units):
            hits = np.flatnonzero(units[kept] @ v >= least) if kept else []
            kept += [] if len(hits) else [i]
            led.append(names[kept[hits[0]]] if len(hits) else names[i])
        return group.append_column("leader", pa.array(led, pa.int64()))

    return run


def _units(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Vectors of length 1, or 0 where they have none."""
    column = rows.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), np.finfo(float).tiny)


def _joined(known: dict, least: float):
    """The rows with the first of their topic's new leaders that has this cosine, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, OUT_ROWS) for i in range(0, batch.num_rows, OUT_ROWS)):
                units, topics = _units(part), np.array(part.column("topic").to_pylist(), dtype=object)
                led, taken = np.zeros(part.num_rows, dtype=np.int64), np.zeros(part.num_rows, dtype=bool)
                for topic, (names, matrix) in known.items():
                    at = np.flatnonzero(topics == topic)
                    if len(at) and len(names):
                        close = units[at] @ matrix.T >= least
                        taken[at] = close.any(axis=1)
                        led[at] = names[close.argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(led, pa.int64(), mask=~taken)], [*part.schema.names, "leader"])

    return run


def leaders(df: DataFrame, key: str, least: float = 0.9) -> DataFrame:
    """Greedy clusters of vectors (key, id, vector) in order of id: a vector joins the first leader with that cosine, else leads.

    Rounds: the first open rows of each topic are settled in order, in a task a topic. Their leaders, a bounded number, go to all tasks, and every
    open row that one of them takes is settled too, wherever it lies; leaders come in order of id, so the first round that takes a row has its first leader.
    The rows left go to the next round. A topic of any size is spread over all tasks; there are as many rounds as its leaders need. Ids are unique in a topic;
    a vector of length 0 leads itself alone.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    rows = "topic string, id long, vector array<double>, leader long"
    topic = F.to_json(F.struct(F.col(key).alias("of")))
    open_rows = materialized(df.select(topic.alias("topic"), F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")))
    names = df.select(topic.alias("topic"), F.col(key)).distinct()
    settled: list[DataFrame] = []
    while not open_rows.isEmpty():
        sizes = materialized(open_rows.groupBy("topic").agg(F.count("*").alias("n")))
        large = [r[0] for r in sizes.where(F.col("n") > ROUND_ROWS).orderBy(F.desc("n"), "topic").limit(ROUND_TOPICS).collect()]
        waiting = sizes.where((F.col("n") > ROUND_ROWS) & ~F.col("topic").isin(large)).select("topic")
        now = open_rows.join(waiting, "topic", "left_anti")
        first = now.withColumn("_r", F.row_number().over(Window.partitionBy("topic").orderBy("id"))).where(F.col("_r") <= ROUND_ROWS).drop("_r")
        led = materialized(first.groupBy("topic").applyInArrow(_led(least), rows))
        settled.append(led.select("topic", "id", "leader"))
        known = {}
        for t in large:
            new = led.where((F.col("topic") == t) & (F.col("id") == F.col("leader"))).select("id", "vector").orderBy("id").toArrow()
            known[t] = new.column("id").to_numpy(), _units(new)
        rest = open_rows.where(F.col("topic").isin(large)).join(led.select("topic", "id"), ["topic", "id"], "left_anti")
        asked = materialized(rest.mapInArrow(_joined(known, least), rows)) if large else spark.createDataFrame([], rows)
        settled.append(asked.where("leader IS NOT NULL").select("topic", "id", "leader"))
        later = open_rows.join(waiting, "topic", "left_semi").select("topic", "id", "vector")
        open_rows = materialized(asked.where("leader IS NULL").select("topic", "id", "vector").unionByName(later))
    found = functools.reduce(DataFrame.unionByName, settled) if settled else spark.createDataFrame([], "topic string, id long, leader long")
    return looked_up(found, names, "topic").select(F.col(key).cast(kind).alias(key), "id", "leader")


def rows_by_mean(words: DataFrame, tolerance: float) -> DataFrame:
    """Words (page, word, x, y) in rows: a word joins the row whose running mean y is within the tolerance."""

    def step(rows: Iterable[dict]) -> Iterator[dict]:
        total, n, row = 0.0, 0, -1
        for r in rows:
            if not n or abs(r["y"] - total / n) > tolerance:
                total, n, row = 0.0, 0, row + 1
            total, n = total + r["y"], n + 1
            yield {"page": r["page"], "word": r["word"], "row": row}

    return fold(words, ["page"], ["y", "x"], step, "page long, word long, row long")


def job_states(events: DataFrame, key: str, moves: dict[str, tuple[str, ...]], first: str, terminal: tuple[str, ...]) -> DataFrame:
    """The state of each job after its events (key, seq, state): moves that are not allowed are refused, a terminal state stays."""

    def step(rows: Iterable[dict]) -> Iterator[dict]:
        state, refused, taken = first, 0, 0
        for r in rows:
            if state not in terminal and r["state"] in moves.get(state, ()):
                state, taken = r["state"], taken + 1
            else:
                refused += 1
        yield {key: r[key], "state": state, "taken": taken, "refused": refused}

    kind = events.schema[key].dataType.simpleString()
    return fold(events, [key], ["seq"], step, f"{key} {kind}, state string, taken long, refused long")


def sentence_chunks(df: DataFrame, key: str, budget: int = 200, overlap: int = 1) -> DataFrame:
    """Sentences (key, order, tokens, text) gathered up to a token budget, the last `overlap` opening the next chunk."""

    def step(rows: Iterable[dict]) -> Iterator[dict]:
        held, fresh, n = [], 0, 0
        for r in rows:
            if fresh and sum(h["tokens"] for h in held) + r["tokens"] > budget:
                yield {key: r[key], "chunk": n, "first": held[0]["order"], "last": held[-1]["order"], "text": " ".join(h["text"] for h in held)}
                n, fresh = n + 1, 0
                held = held[-overlap:] if overlap else []
            held.append(r)
            fresh += 1
        if fresh:
            yield {key: held[0][key], "chunk": n, "first": held[0]["order"], "last": held[-1]["order"], "text": " ".join(h["text"] for h in held)}

    kind = df.schema[key].dataType.simpleString()
    return fold(df, [key], ["order"], step, f"{key} {kind}, chunk long, first long, last long, text string")
