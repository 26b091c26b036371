"""Operators put together: words of pages to documents, canonical knowledge, workflows that run to their end, chunk stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import control, evaluation, knowledge, layout, windows
from docloom.sources.sinks import assembled, table_digest


def document_text(words: DataFrame, tolerance: float = 5.0, gap: float = 12.0) -> DataFrame:
    """Text of each document from words (doc_id, page, x, y, x_end, y_end, text): lines by place, paragraphs by gaps and ends, in page order.

    Bytes of PDF files aren't read; their words come from elsewhere.
    """
    keyed = words.withColumn("_page", F.col("page")).withColumn("page", F.struct("doc_id", "_page"))
    lines = windows.text_lines(keyed, tolerance)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"])
    rows = lines.groupBy("page", "line").agg(F.array_join(parts, " ").alias("text"), F.min("y").alias("y0"), F.max("y_end").alias("y1"))
    found = layout.paragraphs(rows, gap).groupBy("page", "paragraph").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("_l"))
    body = F.regexp_replace(F.array_join("_l", "\n"), r"(\p{L})-\n(\p{Ll})", "$1$2")
    blocks = found.select("page.doc_id", F.struct(F.col("page._page"), F.col("paragraph")).alias("place"), F.regexp_replace(body, "\n", " ").alias("text"))
    return assembled(blocks, "doc_id", "place", "text")


def canonical_items(items: DataFrame, evidence: DataFrame, checks: DataFrame) -> DataFrame:
    """Items with the status of their last check, their deduplicated evidence counted, their confidence, and what is wrong with them."""
    kept = knowledge.evidence_dedup(evidence, "ordinal")
    verified = knowledge.verified_items(items, checks)
    counts = kept.groupBy("item_id").agg(F.count("*").alias("_n"))
    rated = verified.drop("confidence").join(knowledge.confidence(kept), "item_id", "left").join(counts, "item_id", "left")
    rated = rated.withColumn("evidence_count", F.coalesce("_n", F.lit(0))).drop("_n")
    return rated.join(knowledge.item_findings(rated), "item_id")


def projection_audit(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """Findings of parsed pages: texts that their windows don't cover once, links without target, lists that skip a level."""
    cover = windows.coverage_audit(parts, "page_id", "length").where("NOT complete").select("page_id", F.lit("coverage").alias("code"), F.lit("error").alias("severity"))
    rules = {
        "link_target": ("warning", (F.col("kind") == "link") & F.coalesce(F.trim("href") == "", F.lit(True))), "list_level": ("error", (F.col("kind") == "list_item") & (F.col("level") < 1)),
        "empty_heading": ("warning", (F.col("kind") == "heading") & (F.trim("text") == "")),
    }
    return cover.unionByName(evaluation.findings(blocks, "page_id", rules))


def run_to_end(stages: DataFrame, done: DataFrame, execute: Callable[[str], None]) -> DataFrame:
    """Executes what is ready or stale until nothing is left; the receipts (stage_id, config_hash) after it.

    Stages are few and known to the driver; what they do runs on Spark.
    """
    spark = stages.sparkSession
    hashes = {r["stage_id"]: r["config_hash"] for r in stages.select("stage_id", "config_hash").collect()}
    order = [r["stage_id"] for r in control.levels(stages).orderBy("level", "stage_id").collect()]
    receipts = {r["stage_id"]: r["config_hash"] for r in done.collect()}
    state = {r["stage_id"]: r["state"] for r in control.preview(stages, done).collect()}
    for stage in order:
        if state[stage] != "skipped":
            execute(stage)
            receipts[stage] = hashes[stage]
    return spark.createDataFrame(sorted(receipts.items()), "stage_id string, config_hash string")


def until_stable(df: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 100) -> DataFrame:
    """Applies a step until the table's digest doesn't change; more than `most` rounds are an error."""
    from docloom.functions.base import materialized

    before = table_digest(df)
    for _ in range(most):
        df = materialized(step(df))
        after = table_digest(df)
        if after == before:
            return df
        before = after
    raise RuntimeError(f"not stable after {most} rounds")


def chunk_store(chunks: DataFrame, key: str, text: str, metadata: list[str]) -> DataFrame:
    """Chunks as a store takes them: id, text, and metadata as a map of plain strings, arrays joined by commas, nulls left out."""
    flat = {c: F.array_join(c, ",") if t.startswith("array") else F.col(c).cast("string") for c, t in chunks.dtypes if c in metadata}
    pairs = F.map_from_arrays(F.array(*map(F.lit, flat)), F.array(*flat.values()))
    return chunks.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("metadata"))


def over_capacity(vectors: DataFrame, collection: str, each: int = 4096, total: int = 8192) -> DataFrame:
    """Collections that hold more than they may, and the store as a whole (null)."""
    n = vectors.rollup(collection).agg(F.count("*").alias("n"), F.grouping(collection).alias("_all"))
    return n.where(((F.col("_all") == 0) & (F.col("n") > each)) | ((F.col("_all") == 1) & (F.col("n") > total))).select(collection, "n")


def embedded(texts: DataFrame, key: str, text: str, size: int = 16, encoder: Callable[[Column, int], Column] = T.hash_embedding) -> DataFrame:
    """Vectors of texts; a model's batch function may take the encoder's place."""
    return texts.select(key, encoder(F.col(text), size).alias("vector"))


def parsed_times(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy", "yyyy-MM-dd")) -> Column:
    """a time in one of the formats; null in, null out, anything else is an error."""
    found = F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))
    return F.when(c.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no time: "), c)).cast("timestamp"))


def all_of(frames: list[DataFrame]) -> DataFrame:
    """Rows of several tables with the same columns by name; what one lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_report(metrics: DataFrame, root: str, title: str) -> DataFrame:
    """A report bundle in a new folder: all rows as JSON, and as a Markdown table in order of their columns; the manifest (part, rows, digest) is written last.

    Spark writes every row, however many there are; the parts' digests are those of what is read back.
    """
    spark, columns = metrics.sparkSession, metrics.columns
    metrics.write.json(f"{root}/metrics")
    cells = [F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in columns]
    head = [f"# {title}", "", f"| {' | '.join(columns)} |", "|" + "-|" * len(columns)]
    lines = spark.createDataFrame(list(enumerate(head, -len(head))), "place long, value string")
    rows = metrics.select(F.lit(0).cast("long").alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    lines.unionByName(rows).orderBy("place", "value").select("value").write.text(f"{root}/report")
    parts = [("metrics", spark.read.schema(metrics.schema).json(f"{root}/metrics")), ("report", spark.read.text(f"{root}/report"))]
    manifest = spark.createDataFrame([(name, int(mark.split(":")[0]), mark) for name, mark in ((n, table_digest(df)) for n, df in parts)], "part string, rows long, digest string")
    manifest.coalesce(1).write.parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")
