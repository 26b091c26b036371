"""Small helpers that operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Named columns of one parquet table; only these reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where the session names none, a folder of our own does in
    local mode, as in tests; elsewhere that is an error, since other machines couldn't read it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows up to which a side of a join is sent to all executors.
SENT_ROWS = 100_000


def looked_up(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join with a narrow table that has each key once: sent to all executors where it is counted to be small, else shuffled."""
    small = right.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    return left.join(F.broadcast(right) if small else right, key)


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """Rows with their place (from 1) in a total order, without sorting everything in one task.

    Rows are dealt by range, numbered inside each partition, and moved by the sizes of the partitions before: one row per partition.
    """
    placed = materialized(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(sizes), "_part").withColumn(name, (place + F.col("_before")).cast("long")).drop("_part", "_before")


def micros(column: str | Column) -> Column:
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def r6(column: Column) -> Column:
    return F.round(column, 6)
