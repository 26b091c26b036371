"""Corpus pipeline: language ID, quality rules, near-duplicates, secrets, packing, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs. All but the last return the columns of `documents`. Every row of the input counts, repeated rows and null ids included.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import language, packing, quality, secrets, simhash
from docloom.llm.common import shared_folder, table
from docloom.llm.queries import BYTE_BPE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that some known language explains; texts without a letter and those of unknown languages go."""
    samples = language.labelled_sample(docs, "text", "lang", "doc_id")
    found = language.identify(docs.select(*COLUMNS), samples)
    return found.where("lang_known").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rules and lies near a language's distributions."""
    return quality.judge(docs.select(*COLUMNS), quality.learned(docs)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts whose SimHash fingerprints differ in at most 3 bits, or that share 0.8 of their five-word shingles.

    It is the one with the smallest id, and of different texts with that id in the group the one with the smallest hash. Rows
    count by id and text, so groups of different texts may keep rows of the same id; equal rows are repeats, of which one stays.
    A group without any id keeps one row.
    """
    found = simhash.near_copies(docs, width=5, similarity=0.8)
    stay = found.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("nameless"), "doc", "key")).alias("first"))
    rows = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_nameless"), F.xxhash64("text").alias("_key"))
    names = [F.coalesce("first.doc", F.lit(0)).alias("_id"), F.col("first.nameless").alias("_nameless"), F.col("first.key").alias("_key")]
    on = ["_id", "_nameless", "_key"]
    return rows.join(stay.select(*names), on, "left_semi").dropDuplicates(on).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the text by a mark; all documents stay."""
    found = secrets.scan(docs.select(*COLUMNS), secrets.train(secrets.labelled_samples(spark)))
    length = F.when(F.col("n_chars").isNotNull(), F.length("redacted").cast("long"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", length.alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs, BYTE_BPE).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("packing", packed)]
#: SQL can't train or apply these models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a Parquet table in the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
