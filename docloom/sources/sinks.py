"""Sinks: files, content-addressed stores, generations with a pointer, caches, metrics text and assembled documents."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_parquet(df: DataFrame, path: str, rows_per_file: int | None = None, mode: str = "errorifexists") -> None:
    """Parquet, with an upper bound of rows per file where asked for."""
    writer = df.write.mode(mode)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line."""
    df.write.mode(mode).json(path)


def table_there(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The table at a path, or nothing where there is none yet; only Spark looks, so that any store works."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    found = table_there(spark, path, like.schema)
    return spark.createDataFrame([], like.schema) if found is None else found


def install(blobs: DataFrame, path: str) -> int:
    """Contents (column content) that the store lacks, under their sha256; how many were added. Repeating it adds none."""
    named = blobs.withColumn("sha256", F.sha2("content", 256)).withColumn("shard", F.substring("sha256", 1, 2)).dropDuplicates(["sha256"])
    fresh = named.join(_read_or_empty(blobs.sparkSession, path, named.select("content", "sha256", "shard")), "sha256", "left_anti").cache()
    n = fresh.count()
    if n:
        fresh.select("content", "sha256", "shard").write.mode("append").partitionBy("shard").parquet(path)
    fresh.unpersist()
    return n


def register(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Rows whose natural key isn't there yet are appended; how many."""
    fresh = rows.dropDuplicates(keys).join(_read_or_empty(rows.sparkSession, path, rows), keys, "left_anti").select(*rows.columns).cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def key_conflicts(rows: DataFrame, existing: DataFrame, keys: list[str], intent: str) -> DataFrame:
    """Requests whose key is known with another intent."""
    known = existing.select(*keys, F.col(intent).alias("_known"))
    return rows.join(known, keys).where(~F.col(intent).eqNullSafe(F.col("_known"))).drop("_known")


def table_digest(df: DataFrame) -> str:
    """Order-free digest of a table: the number of rows and the sums of two hashes of each row."""
    n, a, b = df.select(F.xxhash64(*df.columns).alias("a"), F.xxhash64(F.lit(1), *df.columns).alias("b")).agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return f"{n}:{a}:{b}"


def build_generation(df: DataFrame, root: str) -> str:
    """Write a generation, read it back, compare, and only then point to it; an earlier one stays active if anything fails."""
    spark, name = df.sparkSession, f"gen-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    back = spark.read.schema(df.schema).parquet(f"{root}/{name}")
    digest = table_digest(back)
    if digest != table_digest(df.select(*back.columns)):
        raise RuntimeError(f"generation {name} differs from its source")
    pointer = spark.createDataFrame([(name, digest)], "generation string, digest string")
    pointer.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{root}/pointers")
    return name


def active_generation(spark: SparkSession, root: str) -> DataFrame:
    """The table of the generation that was pointed to last."""
    last = spark.read.schema("generation string, digest string, at timestamp").json(f"{root}/pointers").orderBy(F.desc("at")).first()
    return spark.read.parquet(f"{root}/{last['generation']}")


def build_states(receipts: DataFrame, active: str) -> DataFrame:
    """Receipts (generation, finished) with the state active, retired or interrupted."""
    state = F.when(F.col("generation") == active, "active").when(F.col("finished"), "retired").otherwise("interrupted")
    return receipts.withColumn("state", state)


def vector_upserts(wanted: DataFrame, stored: DataFrame, key: str, vector: str, tolerance: float = 1e-6) -> DataFrame:
    """(key, action): insert, replace where a part differs by more than the tolerance, or keep."""
    other = stored.select(key, F.col(vector).alias("_stored"))
    same = (F.size(vector) == F.size("_stored")) & F.forall(F.zip_with(vector, "_stored", lambda x, y: F.abs(x - y) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))
    return wanted.join(other, key, "left").select(key, F.when(F.col("_stored").isNull(), "insert").when(same, "keep").otherwise("replace").alias("action"))


def exposition(samples: DataFrame) -> Column:
    """A line of metrics text from name, labels (map) and value."""
    escaped = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    labels = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return F.concat(F.col("name"), labels, F.lit(" "), F.col("value").cast("string"))


def assembled(blocks: DataFrame, key: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """The text of each document from its blocks in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return blocks.groupBy(key).agg(F.array_join(parts, separator).alias(text))


def markdown(kind: Column, level: Column, text: Column) -> Column:
    """One block as Markdown."""
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), text)).when(kind == "list_item", F.concat(F.lit("- "), text))
        .when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```"))).when(kind == "quote", F.concat(F.lit("> "), text)).otherwise(text)
    )


def cache_key(params: dict) -> str:
    """Key of a cached result: the hash of the sorted parameters."""
    import hashlib

    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def cached(spark: SparkSession, root: str, params: dict, build) -> DataFrame:
    """The table of these parameters, built once."""
    path = f"{root}/{cache_key(params)}"
    found = table_there(spark, path)
    if found is None:
        build().write.parquet(path)
        found = spark.read.parquet(path)
    return found


def snapshot(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """A copy of each table, and a manifest (name, digest) by which a restored copy can be checked."""
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}")
        rows.append((name, table_digest(spark.read.parquet(f"{root}/{name}"))))
    manifest = spark.createDataFrame(rows, "name string, digest string")
    manifest.coalesce(1).write.json(f"{root}/manifest")
    return manifest


def restored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of a snapshot, refused where it differs from the manifest."""
    df = spark.read.parquet(f"{root}/{name}")
    want = spark.read.schema("name string, digest string").json(f"{root}/manifest").where(F.col("name") == name).first()
    if want is None or want["digest"] != table_digest(df):
        raise RuntimeError(f"{name} isn't what the manifest has")
    return df


def run_log(spark: SparkSession, root: str, run: str, params: dict, metrics: dict) -> None:
    """Parameters and metrics of a run, appended."""
    rows = [(run, kind, k, str(v)) for kind, values in (("param", params), ("metric", metrics)) for k, v in values.items()]
    spark.createDataFrame(rows, "run string, kind string, name string, value string").write.mode("append").parquet(f"{root}/runs")


def newest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc(at))
    return df.withColumn("_p", F.row_number().over(by)).where("_p = 1").drop("_p")
