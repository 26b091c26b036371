"""Scans of delimited, JSON and Parquet files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

CORRUPT = "_corrupt"


def csv_files(spark: SparkSession, paths: list[str], **options) -> dict[str, DataFrame]:
    """One frame per file, named by the file."""
    return {p.rstrip("/").rsplit("/", 1)[-1].removesuffix(".csv"): spark.read.csv(p, header=True, inferSchema=True, **options) for p in paths}


def delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that the header line holds: tab, then semicolon, then comma."""
    first = spark.read.option("encoding", "ISO-8859-1").text(path).first()
    for d in "\t;,":
        if first and d in first[0]:
            return d
    raise ValueError(f"no delimiter in the header of {path}")


def french_csv(spark: SparkSession, path: str, schema: str, decimals: list[str], rows: int | None = None) -> DataFrame:
    """Latin-1, decimal commas, bad lines left out, an optional number of rows."""
    df = spark.read.csv(path, header=True, sep=delimiter(spark, path), encoding="ISO-8859-1", mode="DROPMALFORMED", schema=schema)
    for c in decimals:
        df = df.withColumn(c, F.expr(f"try_cast(replace(replace(`{c}`, ' ', ''), ',', '.') as double)"))
    return df if rows is None else df.limit(rows)


def split_single_column(df: DataFrame) -> DataFrame:
    """A frame whose only column holds several, cut at the header's delimiter: extra cells go, missing ones are null."""
    if len(df.columns) != 1:
        return df
    name = df.columns[0]
    sep = next((d for d in "\t," if d in name), None)
    if sep is None:
        return df
    cells = F.split(F.col(f"`{name}`"), sep)
    return df.select(*(F.trim(F.get(cells, F.lit(i))).alias(c.strip()) for i, c in enumerate(name.split(sep))))


def pruned(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the columns that are wanted and there."""
    df = spark.read.parquet(path)
    return df.select(*(c for c in columns if c in df.columns))


def folder(spark: SparkSession, path: str, suffix: str, prefix: str = "", **options) -> DataFrame:
    """The files of a folder with a name's start and suffix, with the name of the file with - as _."""
    kind = "parquet" if suffix.endswith("parquet") else "csv"
    df = spark.read.format(kind).options(header=True, pathGlobFilter=f"{prefix}*{suffix}", **options).load(path)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), f"{suffix}$".replace(".", r"\."), "")
    return df.select("*", F.translate(name, "-", "_").alias("file_name"))


def _strict(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("a key occurs twice")
    return dict(pairs)


def _no_constant(name: str) -> float:
    raise ValueError(f"{name} is no JSON number")


def _finite(text: str) -> float:
    number = float(text)
    if number in (float("inf"), float("-inf")):
        raise ValueError("number too large")
    return number


def parse_strict(text: str | None) -> tuple[str | None, str | None]:
    """(canonical JSON, error): S07. Duplicate keys, NaN, infinities and overflowing numbers are errors."""
    if text is None:
        return None, "null"
    try:
        value = json.loads(text, object_pairs_hook=_strict, parse_constant=_no_constant, parse_float=_finite)
    except (ValueError, RecursionError) as error:
        return None, str(error)
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")), None


@F.pandas_udf(StructType().add("value", StringType()).add("error", StringType()))
def strict_json(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_strict(t) for t in texts], columns=["value", "error"])


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value, error) of every line that isn't blank, strictly parsed. Files are read whole, to number lines."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = texts.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).where(F.trim("text") != "")
    return lines.select("file", (F.col("line") + 1).alias("line"), strict_json("text").alias("r")).select("file", "line", "r.*")


def blobs(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files of a folder whose size and sha256 are those that `expected` (name, size, sha256) has."""
    files = spark.read.format("binaryFile").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return files.join(expected, "name").where((F.col("length") == F.col("size")) & (F.sha2("content", 256) == F.col("sha256"))).select("name", "content")


def folded_name(c: Column) -> Column:
    """A file name in lower case, without commas, umlauts as their letters."""
    return F.replace(F.translate(F.lower(c), "äöü,", "aou"), F.lit("ß"), F.lit("ss"))


def find_files(files: DataFrame, name: str, wanted: str, exact: bool = True) -> DataFrame:
    """Files whose folded stem is the wanted name, or starts with it."""
    stem = folded_name(F.regexp_replace(F.col(name), r"\.[A-Za-z0-9]+$", ""))
    key = folded_name(F.lit(wanted))
    return files.where(stem == key if exact else stem.startswith(key))


def folder_sizes(files: DataFrame, root: str, top: int = 10) -> DataFrame:
    """Total size of the files (path, length) below each folder of a root, the largest first."""
    below = F.regexp_extract("path", rf"{root.rstrip('/')}/([^/]+)/", 1)
    return files.select(below.alias("folder"), "length").where("folder <> ''").groupBy("folder").agg(F.sum("length").alias("size")).orderBy(F.desc("size"), "folder").limit(top)

