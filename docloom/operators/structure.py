"""Joins along the tree of a page: ancestors by nested intervals, the nearest owner, lists with their numbering.

A node has its place in document order (`pre`) and that of its last descendant (`end`), so it lies within another exactly where its
interval does. Ancestors come from an interval join; a list's numbering from windows over its items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.relational import dyadic_pairs

#: Width of the narrowest cells in which nodes meet their ancestors.
CELL = 16


def ancestors(nodes: DataFrame, owners: DataFrame, doc: str) -> DataFrame:
    """(doc, pre, owner, tag): each node with all owners around it, a row for each. Both have doc, pre and end, owners a tag."""
    points = nodes.select(doc, "pre", F.col("pre").alias("low"), F.col("pre").alias("high"))
    around = owners.select(doc, F.col("pre").alias("low"), F.col("end").alias("high"), "tag")
    inside = dyadic_pairs(points, around, [doc], [("low", "high")], CELL).where(F.col("r_low") < F.col("pre"))
    return inside.select(doc, "pre", F.col("r_low").alias("owner"), F.col("r_tag").alias("tag"))


def nearest(nodes: DataFrame, owners: DataFrame, doc: str) -> DataFrame:
    """(doc, pre, owner, tag): the innermost owner around each node; nodes that none surrounds are left out."""
    return ancestors(nodes, owners, doc).groupBy(doc, "pre").agg(F.max("owner").alias("owner"), F.max_by("tag", "owner").alias("tag"))


def list_contexts(nodes: DataFrame, doc: str) -> DataFrame:
    """(doc, pre, list, depth, parent, ordered, item_index, ordinal) of each list item.

    list is the innermost list around the item, depth the number of lists around it, parent the innermost item around that list. In an ordered
    list the first item has the list's start, or 1, or in a reversed list the number of its items; each next one counts on by one, in a
    reversed list down; an item's own value sets the count. A start or value that is no whole number leaves items without an ordinal until the next that is.
    """
    items, lists = nodes.where("tag = 'li'"), nodes.where("tag IN ('ol', 'ul')")
    around = ancestors(items, lists, doc).groupBy(doc, "pre").agg(F.max("owner").alias("list"), F.count("*").alias("depth"))
    above = nearest(lists, items, doc).select(doc, F.col("pre").alias("list"), F.col("owner").alias("parent"))
    heads = lists.select(doc, F.col("pre").alias("list"), (F.col("tag") == "ol").alias("ordered"), F.col("start").alias("_start"), F.col("reversed").alias("_reversed"))
    rows = items.select(doc, "pre", F.col("value").alias("_value")).join(around, [doc, "pre"]).join(heads, [doc, "list"]).join(above, [doc, "list"], "left")
    whole = Window.partitionBy(doc, "list")
    so_far = whole.orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    index = F.row_number().over(whole.orderBy("pre"))
    number = lambda c: F.expr(f"try_cast(trim({c}) AS BIGINT)")
    default = F.when(F.col("_start").isNotNull(), number("_start")).when(F.col("_reversed"), F.count("*").over(whole)).otherwise(1)
    rows = rows.withColumn("item_index", index).withColumn("_default", default)
    sets = F.when(F.col("_value").isNotNull(), F.struct("item_index", number("_value").alias("n")))
    sets = F.coalesce(sets, F.when(F.col("item_index") == 1, F.struct("item_index", F.col("_default").alias("n"))))
    rows = rows.withColumn("_set", F.last(sets, ignorenulls=True).over(so_far))
    step = F.when(F.col("_reversed"), -1).otherwise(1)
    ordinal = F.when(F.col("ordered"), F.col("_set.n") + step * (F.col("item_index") - F.col("_set.item_index")))
    return rows.select(doc, "pre", "list", "depth", "parent", "ordered", "item_index", ordinal.cast("long").alias("ordinal"))
