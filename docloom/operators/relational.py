"""Joins, set operations, ordering and paging."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions.base import materialized


def join_all(frames: list[DataFrame], on: list[str], how: str = "inner", suffix: str = "_right", drop: tuple[str, ...] = ()) -> DataFrame:
    """Join of any number of frames on the same columns; a clashing column of a later frame takes the suffix."""

    def step(left: DataFrame, right: DataFrame) -> DataFrame:
        clash = [c for c in right.columns if c in left.columns and c not in on]
        return left.join(right.withColumnsRenamed({c: c + suffix for c in clash}), on, how)

    return reduce(step, frames).drop(*drop)


def natural_join(frames: list[DataFrame]) -> DataFrame:
    """Inner joins in a chain, each on the columns shared with what came before; a single frame is returned as it is."""
    return reduce(lambda a, b: a.join(b, [c for c in a.columns if c in b.columns], "inner"), frames)


def visible(rows: DataFrame, grants: DataFrame, actor: str, key: str, owner: str | None = None) -> DataFrame:
    """Rows that the actor owns or has a read grant for. grants: (key, subject, permission)."""
    granted = grants.where((F.col("subject") == actor) & (F.col("permission") == "read")).select(key).distinct()
    if owner is None:
        return rows.join(granted, key, "left_semi")
    mine = rows.where(F.col(owner) == actor)
    others = rows.where(F.coalesce(F.col(owner) != actor, F.lit(True))).join(granted, key, "left_semi")
    return mine.unionByName(others)


def without(rows: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the blocked ones."""
    return rows.join(blocked.select(key).distinct(), key, "left_anti")


def dyadic_pairs(left: DataFrame, right: DataFrame, keys: list[str], axes: list[tuple[str, str]], width: float) -> DataFrame:
    """Pairs with equal keys whose closed ranges meet on every axis; columns of the right side get the prefix r_.

    Cells come in levels, each twice as wide as the one before. A row lives on the level whose cells are as wide as its longest range, where it
    lies in two cells an axis at most, and visits the levels above on which rows of the other side live. A pair meets on the level of the longer
    one, in the first cell that both share. So a range of a year among ranges of seconds costs as many rows as there are levels, and a hot key is
    spread over its cells. Rows with a null bound, or whose range ends before it begins, meet none.
    """

    def level(prefix: str) -> Column:
        lengths = ((F.col(prefix + high) - F.col(prefix + low)).cast("double") for low, high in axes)
        return F.ceil(F.log2(F.greatest(F.lit(float(width)), *lengths) / width)).cast("int")

    def cell(column: str) -> Column:
        return F.floor(F.col(column) / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level"))))

    def homes(rows: DataFrame, prefix: str) -> DataFrame:
        sound = reduce(lambda x, y: x & y, (F.col(prefix + low) <= F.col(prefix + high) for low, high in axes))
        return rows.where(sound).withColumn("_home", level(prefix))

    def placed(rows: DataFrame, levels: Column, prefix: str) -> DataFrame:
        rows = rows.withColumn("_level", F.explode(levels))
        for i, (low, high) in enumerate(axes):
            rows = rows.withColumn(f"_cell{i}", F.explode(F.sequence(cell(prefix + low), cell(prefix + high))))
        return rows

    a = homes(left, "")
    b = homes(right.withColumnsRenamed({c: f"r_{c}" for c in right.columns if c not in keys}), "r_")
    lived = [sorted(r[0] for r in side.select("_home").distinct().collect()) for side in (a, b)]  # no more than doubles have exponents
    above = lambda levels: F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x > F.col("_home"))
    at_home = F.array("_home")
    on = [*keys, "_level", *(f"_cell{i}" for i in range(len(axes)))]
    one = placed(a, at_home, "").drop("_home").join(placed(b, F.concat(at_home, above(lived[0])), "r_").drop("_home"), on)
    other = placed(a, above(lived[1]), "").drop("_home").join(placed(b, at_home, "r_").drop("_home"), on)
    pairs = one.unionByName(other)
    for i, (low, high) in enumerate(axes):
        meet = (F.col(low) <= F.col(f"r_{high}")) & (F.col(f"r_{low}") <= F.col(high))
        pairs = pairs.where(meet & (F.col(f"_cell{i}") == F.greatest(cell(low), cell(f"r_{low}"))))
    return pairs.drop("_level", *(f"_cell{i}" for i in range(len(axes))))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs with equal keys whose closed intervals (start, end) overlap; columns of the right side get the prefix r_.

    width: that of the narrowest cells, about a common interval's length; any width gives the same pairs.
    """
    return dyadic_pairs(left, right, keys, [("start", "end")], width)


#: Bytes of needles that one automaton holds, and that a shard of needles has at most, but for a single longer one.
AUTOMATON_BYTES = 8 << 20


def contained(needles: DataFrame, hay: DataFrame, needle: str, text: str, needle_id: str, hay_id: str) -> DataFrame:
    """(needle_id, hay_id) of the pairs where the needle's text occurs in the other text exactly, once each.

    Needles are dealt to shards of bounded size; a shard goes to all tasks, which build an automaton of it and read each whole text once for all of its
    needles. Texts aren't shuffled and move no farther than their task. Null texts hold nothing, null needles occur nowhere, the empty needle in every text.
    """
    wanted = needles.select(F.col(needle_id).alias("_n"), F.col(needle).alias("_s")).where("_s IS NOT NULL")
    size = F.octet_length("_s") + 16
    total = wanted.agg(F.sum(size)).first()[0] or 0
    shards = -(-total * 2 // AUTOMATON_BYTES) or 1
    dealt = materialized(wanted.withColumn("_shard", F.pmod(F.xxhash64("_n", "_s"), F.lit(shards))))
    kinds = {f.name: f.dataType for f in (*needles.schema, *hay.schema)}
    schema = StructType().add(needle_id, kinds[needle_id]).add(hay_id, kinds[hay_id])
    texts = hay.select(F.col(hay_id).alias("_h"), F.col(text).alias("_t")).where("_t IS NOT NULL")
    found = [texts.mapInArrow(_occurring(dealt.where(F.col("_shard") == i).select("_n", "_s").toArrow()), schema) for i in range(shards)]
    return reduce(DataFrame.unionByName, found)


def _occurring(shard: pa.Table):
    """Rows (needle's id, text's id) of a shard of needles."""
    ids, strings = shard.column("_n"), shard.column("_s").to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders: dict[str, list[int]] = {}
        for i, s in enumerate(strings):
            holders.setdefault(s, []).append(i)
        everywhere = holders.pop("", [])
        automaton = ahocorasick.Automaton()
        for s, at in holders.items():
            automaton.add_word(s, at)
        automaton.make_automaton()
        for batch in batches:
            rows, needles = [], []
            for row, text in enumerate(batch.column("_t")):
                hits = {id(at): at for _, at in automaton.iter(text.as_py())} if holders else {}
                held = everywhere + [i for at in hits.values() for i in at]
                needles += held
                rows += [row] * len(held)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(needles, pa.int64())).combine_chunks(), batch.column("_h").take(pa.array(rows, pa.int64()))], ["a", "b"])

    return run


def complete_grid(counts: DataFrame, cell: str, period: str, value: str, least: int = 1) -> DataFrame:
    """Every active cell with every observed period, 0 where nothing was counted. Active: at least `least` in all."""
    active = counts.groupBy(cell).agg(F.sum(value).alias("_n")).where(F.col("_n") >= least).select(cell)
    periods = counts.select(period).distinct().agg(F.sort_array(F.collect_set(period)).alias("_periods"))
    grid = active.crossJoin(F.broadcast(periods)).select(cell, F.explode("_periods").alias(period))
    return grid.join(counts, [cell, period], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def long_form(df: DataFrame, ids: list[str], values: list[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """One row per value column."""
    return df.unpivot(ids, values, variable, value)


def sets_differ(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def all_in(part: str, whole: str) -> Column:
    """Whether an array's values are all in another."""
    return F.size(F.array_except(part, whole)) == 0


def best_or_none(df: DataFrame, group: str, rank: str, value: str) -> DataFrame:
    """Per group the value at the smallest rank, null and flagged where several different values share it."""
    least = Window.partitionBy(group)
    top = df.where(F.col(rank).isNotNull()).withColumn("_least", F.min(rank).over(least)).where(F.col(rank) == F.col("_least"))
    n = F.count_distinct(value)
    return top.groupBy(group).agg(F.when(n == 1, F.min(value)).alias(value), (n > 1).alias("ambiguous"), F.first("_least").alias(rank))


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The page after a cursor in key order, with one row more to show that there is a next one."""
    if after is not None:
        df = df.where(F.struct(*keys) > F.struct(*(F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True))))
    return df.orderBy(*keys).limit(limit + 1)


def companion(resources: DataFrame, lectures: DataFrame) -> DataFrame:
    """The lecture of a resource: its parent, else the only lecture that owns one of its sections.

    resources: (resource_id, parent_id, sections), lectures: (lecture_id, sections). status is parent, section, ambiguous or none.
    """
    parent = resources.join(lectures.select(F.col("lecture_id").alias("parent_id")).distinct(), "parent_id").select("resource_id", F.col("parent_id").alias("lecture_id"), F.lit("parent").alias("status"))
    rest = resources.join(parent.select("resource_id"), "resource_id", "left_anti")
    # a section's lectures are one where the smallest and the largest are; so each section goes to its resources as one row
    owners = lectures.select("lecture_id", F.explode("sections").alias("section")).groupBy("section").agg(F.min("lecture_id").alias("_low"), F.max("lecture_id").alias("_high"))
    shared = rest.select("resource_id", F.explode_outer("sections").alias("section")).join(owners, "section", "left")
    by_section = shared.groupBy("resource_id").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    one = F.col("_low") == F.col("_high")
    by_section = by_section.select("resource_id", F.when(one, F.col("_low")).alias("lecture_id"), F.when(one, "section").when(~one, "ambiguous").otherwise("none").alias("status"))
    return parent.unionByName(by_section)
