"""Grouping, exact-identity merging, counts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.base import numbered


def cell_counts(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Rows per key."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def state_histogram(df: DataFrame, key: str, state: str, states: list[str]) -> DataFrame:
    """One column per state."""
    return df.groupBy(key).agg(*(F.count_if(F.col(state) == s).alias(f"n_{s}") for s in states))


def ladder(counts: list[tuple[str, str]], otherwise: str) -> Column:
    """The first state of a priority list that has a count."""
    out = F.lit(otherwise)
    for column, state in reversed(counts):
        out = F.when(F.col(column) > 0, state).otherwise(out)
    return out


def exact_groups(df: DataFrame, keys: list[str], ordinal: str, weight: Column, prefix: str = "KS") -> DataFrame:
    """Groups of rows with equal keys: size, first ordinal, the ordinal of the heaviest row (ties: the first), and ids in order of first sight."""
    best = F.max_by(ordinal, F.struct(weight, -F.col(ordinal)))
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"), best.alias("representative"))
    return numbered(groups, "first").withColumn("group_id", F.format_string(f"{prefix}%04d", "number")).drop("number")


def merged_values(df: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """The sorted distinct values of each key, in slices of at most `most`."""
    sets = df.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("_all"))
    parts = sets.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / most).cast("int"))))
    return parts.withColumn("values", F.slice("_all", F.col("part") * most + 1, most)).drop("_all")


def fact_dedup(facts: DataFrame, keys: list[str], source: str, ordinal: str, fact: str) -> DataFrame:
    """One row per normalized fact: the first wording and all sources, sorted."""
    return facts.groupBy(*keys).agg(
        F.min_by(fact, ordinal).alias(fact), F.min(ordinal).alias("first"), F.array_sort(F.collect_set(source)).alias("sources")
    )


def duplicate_excess(keys: list[str]) -> Column:
    """Rows beyond the first of each key."""
    return F.count("*") - F.count_distinct(F.struct(*keys))


def cumulative_histogram(df: DataFrame, keys: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Per key and bound, how many values are at most that; the last bound is +Inf. Nulls aren't counted."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*keys).agg(*counts, F.count(value).alias(f"b{len(bounds)}"))
    pairs = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col(f"b{len(bounds)}").alias("n")))
    return wide.select(*keys, F.inline(F.array(*pairs)))


def histogram_audit(buckets: DataFrame, keys: list[str], place: str, total: str) -> DataFrame:
    """Whether the counts of a series never fall and the last equals the total."""
    rows = buckets.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, "n"))), lambda x: x["n"]).alias("_n"), F.first(total).alias("_t"))
    return rows.select(*keys, F.col("_n").eqNullSafe(F.array_sort("_n")).alias("monotonic"), (F.element_at("_n", -1) == F.col("_t")).alias("closed"))


#: Consecutive numbers under one node of a digest's tree, and levels of nodes: any whole number of 64 bits finds its place.
NODE_ROWS, NODE_LEVELS = 1024, 7


def digest(df: DataFrame, keys: list[str], order: str, row: Column, rows: int = NODE_ROWS, levels: int = NODE_LEVELS) -> DataFrame:
    """(digest, n) of each record set: the root of a tree of sha256 digests over ranges of a whole number that orders the rows.

    A leaf frames the digests of the rows whose number lies in one range of `rows`, each with its number; a node frames those of the `rows` ranges below it. So
    no task holds more than a range, and a changed row changes the path to its leaf only. Repeated numbers are framed by digest; a
    null number comes first.
    """
    framed = df.select(*keys, F.col(order).cast("long").alias("_at"), F.sha2(row, 256).alias("_d"), F.lit(1).cast("long").alias("_n"))
    for _ in range(levels):
        parts = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_d"))), lambda x: F.concat_ws(":", x["_at"].cast("string"), x["_d"]))
        up = F.floor(F.col("_at") / rows) if rows & (rows - 1) else F.shiftright("_at", rows.bit_length() - 1)
        framed = framed.withColumn("_up", up).groupBy(*keys, "_up").agg(F.sha2(F.array_join(parts, ";"), 256).alias("_d"), F.sum("_n").alias("_n"))
        framed = framed.withColumnRenamed("_up", "_at")
    # what is left is one node, or two where numbers have both signs
    last = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_d"))), lambda x: F.concat_ws(":", x["_at"].cast("string"), x["_d"])), ";")
    return framed.groupBy(*keys).agg(F.sha2(last, 256).alias("digest"), F.sum("_n").alias("n"))


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def totals(df: DataFrame, size: str) -> DataFrame:
    """Number and total size, 0 where there are none."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size"))


def conflicts(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys for which a column has several different values, with the columns' names."""
    found = df.groupBy(key).agg(*(F.count_distinct(c).alias(c) for c in columns))
    names = F.filter(F.array(*(F.when(F.col(c) > 1, F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return found.select(key, names.alias("conflicting")).where(F.size("conflicting") > 0)


def merged_resources(df: DataFrame, key: str, blocks: str) -> DataFrame:
    """One row per key with the union of its block ids, sorted; rows without a key stay as they are."""
    flat = F.array_sort(F.array_distinct(F.flatten(F.collect_list(blocks))))
    known = df.where(F.col(key).isNotNull()).groupBy(key).agg(flat.alias(blocks))
    return known.unionByName(df.where(F.col(key).isNull()).select(key, blocks))


def statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, least, median, mean and largest value."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.median(value).alias("median"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def flattened(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """One row per element of the arrays inside an array of structs."""
    return df.withColumn("_o", F.explode(outer)).withColumn("_i", F.explode(F.col(f"_o.{inner}"))).select("*", "_o.*", "_i.*").drop("_o", "_i", outer, inner)


def running_budget(df: DataFrame, keys: list[str], order: str, cost: str, cap: float) -> DataFrame:
    """Cost spent up to each row, and whether it goes beyond the cap."""
    from pyspark.sql import Window

    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(by)).withColumn("over", F.col("spent") > cap)


def grid_rates(df: DataFrame, keys: list[str], metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per group and metric the numerator, denominator and rate, null where the denominator is 0."""
    sums = [f(e).alias(f"{m}_{part}") for m, pair in metrics.items() for part, e, f in (("num", pair[0], F.count_if), ("den", pair[1], F.count_if))]
    wide = df.groupBy(*keys).agg(*sums)
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"{m}_num").alias("numerator"), F.col(f"{m}_den").alias("denominator"), F.when(F.col(f"{m}_den") > 0, F.col(f"{m}_num") / F.col(f"{m}_den")).alias("rate")) for m in metrics]
    return wide.select(*keys, F.inline(F.array(*rows)))
