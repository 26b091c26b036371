"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut_lineage, lookup


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for nodes that have an edge.

    edges: columns a and b, long, materialized; direction, order and repetition do not matter. Each round takes the smallest label
    among the neighbours and then the label of the label, so long chains shrink by doubling. Rounds go on until no label changes.
    """
    n = 2 * edges.count()
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), n)
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), n)
    while True:
        heard = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        hooked = cut_lineage(labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label")), n)
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = cut_lineage(lookup(hooked, up, "label").select("node", "old", F.col("top").alias("label")), n)
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels
