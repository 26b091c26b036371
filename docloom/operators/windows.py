"""Windows over texts and ordered rows, gaps and islands, and coverage audits. Offsets are code points, from 0, half open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def char_windows(df: DataFrame, text: str, size: int = 2000, overlap: int = 0) -> DataFrame:
    """Windows of `size` code points of each whole text: window, start, end, part and blank.

    With an overlap, a window that would only repeat the tail of the one before isn't made.
    """
    step = size - overlap
    length = F.length(text)
    starts = F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(step)))
    if overlap:
        starts = F.filter(starts, lambda s: (s == 0) | (s + overlap < length))
    rows = df.select("*", F.posexplode(starts).alias("window", "start")).withColumn("end", F.least(F.col("start") + size, length))
    part = F.substring(F.col(text), F.col("start") + 1, F.lit(size))
    return rows.withColumn("part", part).withColumn("blank", F.length(F.regexp_replace("part", r"(?U)\s+", "")) == 0)


def islands(df: DataFrame, keys: list[str], gap: float = 0.0, *order: str) -> DataFrame:
    """Intervals (start, end) of a key merged where the next starts at most `gap` after the largest end so far."""
    by = Window.partitionBy(*keys).orderBy("start", "end", *order)
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col("start") <= reach + gap, 0).otherwise(1))
    marked = marked.withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def neighbours(df: DataFrame, keys: list[str], order: str, text: str, lines: int = 3) -> DataFrame:
    """The last lines of the row before and the first of the row after, as before and after."""
    by = Window.partitionBy(*keys).orderBy(order)
    split = lambda c: F.split(c, "\n")
    last = F.array_join(F.slice(split(F.lag(text).over(by)), -lines, lines), "\n")
    whole = F.array_join(split(F.lag(text).over(by)), "\n")
    before = F.when(F.size(split(F.lag(text).over(by))) < lines, whole).otherwise(last)
    after = F.array_join(F.slice(split(F.lead(text).over(by)), 1, lines), "\n")
    return df.withColumn("before", before).withColumn("after", after)


def inherited(df: DataFrame, keys: list[str], order: str, value: Column) -> Column:
    """The last known value up to a row, else the next known one."""
    by = Window.partitionBy(*keys).orderBy(order)
    back = F.last(value, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(back, ahead)


def batches(size: int, overlap: int, n: Column) -> Column:
    """Starts of batches of `size` rows that share `overlap` rows with the next one."""
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(size - overlap).cast("long")))
    return F.filter(starts, lambda s: (s == 0) | (s + overlap < n))


def fixed_batches(df: DataFrame, keys: list[str], size: int, *order: str) -> DataFrame:
    """Rows in order, `size` to a batch."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("batch", F.floor((place - 1) / size).cast("long"))


def grid(start: Column, end: Column, step_ms: int, edge_ms: int = 0) -> Column:
    """Sample times in whole milliseconds inside an interval, away from its edges."""
    low, high = start + edge_ms, end - edge_ms
    return F.when(low <= high, F.sequence(low, high, F.lit(step_ms).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def padded(start: Column, end: Column, by: float = 2.0) -> tuple[Column, Column]:
    """An interval widened on both sides, not below 0."""
    return F.greatest(F.lit(0.0), start - by), end + by


def evenly_spaced(df: DataFrame, keys: list[str], count: int, *order: str) -> DataFrame:
    """`count` rows of each key, at i * (n - 1) // (count - 1); all of them where there are fewer."""
    by = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(by.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(by))
    last = max(count - 1, 1)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.floor(i * (F.col("_n") - 1) / last))
    return rows.where((F.col("_n") <= count) | F.array_contains(wanted, F.col("_i").cast("bigint"))).drop("_i", "_n")


def chain_audit(df: DataFrame, seq: str, digest: str, previous: str, keys: list[str]) -> DataFrame:
    """Rows of a ledger with broken_link (previous isn't the digest before) and gap (the number isn't one more)."""
    by = Window.partitionBy(*keys).orderBy(seq)
    linked = F.col(previous).eqNullSafe(F.lag(digest).over(by))
    dense = F.coalesce(F.col(seq) == F.lag(seq).over(by) + 1, F.lit(True))
    return df.withColumn("broken_link", ~linked).withColumn("gap", ~dense)


def coverage_audit(windows: DataFrame, key: str, length: str) -> DataFrame:
    """Per text whether windows (start, end) follow one another without gap and cover it once."""
    by = Window.partitionBy(key).orderBy("start", "end")
    rows = windows.withColumn("_joined", F.coalesce(F.col("start") == F.lag("end").over(by), F.col("start") == 0))
    covers = F.bool_and("_joined") & (F.min("start") == 0) & (F.max("end") == F.first(length))
    return rows.groupBy(key).agg(F.count("*").alias("windows"), covers.alias("complete"))


def order_audit(df: DataFrame, keys: list[str], order: str, page: str) -> DataFrame:
    """Per key, rows whose page is before that of the row above, and whether the order runs densely from 0."""
    by = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_back", F.coalesce(F.lag(page).over(by) > F.col(page), F.lit(False)))
    rows = rows.withColumn("_dense", F.row_number().over(by) - 1 == F.col(order))
    return rows.groupBy(*keys).agg(F.count_if("_back").alias("steps_back"), F.bool_and("_dense").alias("dense"))


def levels(df: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Heading level from the falling whole font size."""
    return df.withColumn("level", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(F.floor(size)))))


def text_lines(words: DataFrame, tolerance: float) -> DataFrame:
    """Words (page, x, y, x_end) in reading order, with a line that changes where y moves by the tolerance or more."""
    by = Window.partitionBy("page").orderBy("y", "x")
    step = F.coalesce(F.abs(F.col("y") - F.lag("y").over(by)) >= tolerance, F.lit(True)).cast("int")
    return words.withColumn("_step", step).withColumn("line", F.sum("_step").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def split_lines(lines: DataFrame, tolerance: float) -> DataFrame:
    """Parts of a line, cut where the gap to the word before is wider than the tolerance."""
    by = Window.partitionBy("page", "line").orderBy("x")
    gap = F.coalesce(F.col("x") - F.lag("x_end").over(by) > tolerance, F.lit(False)).cast("int")
    return lines.withColumn("_gap", gap).withColumn("piece", F.sum("_gap").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def two_columns(words: DataFrame) -> DataFrame:
    """Column 0 or 1 of each word of a page, split at the middle of the widest gap between rounded x starts, the first if tied."""
    starts = words.select("page", F.round("x").alias("s")).distinct()
    after = F.lead("s").over(Window.partitionBy("page").orderBy("s"))
    gaps = starts.withColumn("gap", after - F.col("s")).where("gap is not null")
    widest = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("gap"), "s"))
    cut = gaps.withColumn("_p", widest).where("_p = 1").select("page", (F.col("s") + F.col("gap") / 2).alias("cut"))
    return words.join(cut, "page", "left").withColumn("column", F.when(F.col("x") > F.col("cut"), 1).otherwise(0)).drop("cut")


def repeated(df: DataFrame, signature: list[str], page: str) -> DataFrame:
    """Signatures that occur on more than one page."""
    return df.groupBy(*signature).agg(F.count_distinct(page).alias("pages")).where("pages > 1")


def cue_spans(cues: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Code-point span of each cue in its texts joined by one blank."""
    by = Window.partitionBy(*keys).orderBy(order)
    end = F.sum(F.length(text) + 1).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return cues.withColumn("span_end", end - 1).withColumn("span_start", F.col("span_end") - F.length(text))


def window_times(windows: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Times of each window (start, end offsets): the smallest start and largest end of the cues that it touches."""
    pairs = windows.join(spans, key).where((F.col("start") < F.col("span_end")) & (F.col("span_start") < F.col("end")))
    return pairs.groupBy(key, "start", "end").agg(F.min("cue_start").alias("from_time"), F.max("cue_end").alias("to_time"))
