"""One query per operator over its whole table, with production parameters. ORACLES has SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, compression, importance, katz, language, packing, quality, secrets, simhash, sql, substrings, topk, urls, warc
from docloom.llm.common import crc_bucket, table

#: Where executors find the vocabulary; a parameter of the operators.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    samples = language.labelled_sample(docs.where(~held_out), "text", "lang", "doc_id")
    found = language.identify(docs.select("doc_id", "text"), samples)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return katz.score(docs, crc_bucket("doc_id", 7) == 2).withColumnRenamed("id", "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    judged = quality.judge(docs.select("doc_id", "text"), quality.learned(docs))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "class_distance", "word_distance")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages", "page_id", "url"), urls.train(urls.labelled_urls(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict", "probability")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), BYTE_BPE).withColumnRenamed("id", "doc_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = warc.derive(warc.responses(table(spark, sf_dir, "pages", "page_id", "url", "html")))
    return derived.withColumnRenamed("source_id", "page_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_samples(spark))
    return secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"), model).drop("text", "redacted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), BYTE_BPE).withColumnRenamed("id", "doc_id")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding").where(topk.usable("embedding"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return topk.top_k(vectors.select("vec_id", whole.alias("vector")), F.col("vec_id") % 50 == 0)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_language, op3_katz, op4_quality, op5_urls, op6_packing, op7_warc, op8_secrets, op9_bpe, op10_topk, op11_importance, op12_substrings,
        op13_codes,
    )
}
ORACLES: dict[str, str] = {"op7_warc": sql.OP7, "op13_codes": sql.OP13}
