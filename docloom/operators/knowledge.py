"""Statements, formulas, entities and their evidence: merging, deduplication, confidence and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.base import numbered
from docloom.operators.relational import interval_join

EVIDENCE_KEY = ["item_id", "source_id", "chunk_id", "segment_id", "start", "end", "kind", "relation"]


def formula_groups(formulas: DataFrame) -> DataFrame:
    """Formulas (formula_id, plain, latex, kind, status, ordinal) with the same plain key, LaTeX and kind, their statuses merged."""
    keyed = formulas.withColumn("plain_key", T.exact_math(F.col("plain")))
    groups = keyed.groupBy("plain_key", "latex", "kind").agg(
        F.min_by("formula_id", "ordinal").alias("representative"), F.array_sort(F.collect_set("formula_id")).alias("variants"),
        T.status_lattice(F.collect_set("status")).alias("status"), F.min("ordinal").alias("first"),
    )
    return numbered(groups, "first").withColumn("group_id", F.format_string("KE%04d", "number")).drop("number")


def canonical_statements(statements: DataFrame) -> DataFrame:
    """Statements (key, source_id, confidence, start, text, kind) of one key: sources, and the text and kind of the most certain; ids by start."""
    best = F.max_by(F.struct("text", "kind"), F.struct("confidence", -F.col("start")))
    merged = statements.groupBy("key").agg(best.alias("b"), F.array_sort(F.collect_set("source_id")).alias("sources"), F.max("confidence").alias("confidence"), F.min("start").alias("start"))
    return numbered(merged, "start", "key").select(F.format_string("CS%04d", "number").alias("id"), "key", "b.text", "b.kind", "sources", "confidence", "start")


def entities(names: DataFrame) -> DataFrame:
    """Entities (name, kind, confidence, aliases) by case-folded name: all aliases, the kind of the most certain."""
    return names.withColumn("key", T.casefold(F.trim("name"))).groupBy("key").agg(
        F.min("name").alias("name"), F.max_by("kind", F.struct("confidence", "kind")).alias("kind"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
    )


def evidence_dedup(evidence: DataFrame, order: str) -> DataFrame:
    """The first of evidence rows that agree in all of their key."""
    by = Window.partitionBy(*EVIDENCE_KEY).orderBy(order)
    return evidence.withColumn("_p", F.row_number().over(by)).where("_p = 1").drop("_p")


def confidence(evidence: DataFrame) -> DataFrame:
    """A10: the confidence of each item: that of its best supporting evidence, null without any."""
    return evidence.groupBy("item_id").agg(F.max(F.when(F.col("relation") == "support", F.col("confidence"))).alias("confidence"))


def overlapping(evidence: DataFrame, windows: DataFrame, cell: float = 60.0) -> DataFrame:
    """Evidence and windows of one source that share a segment or overlap in time (met in cells of time), each pair once."""
    e = evidence.select("source_id", "evidence_id", F.explode("segments").alias("s"))
    by_segment = e.join(windows.select("source_id", "window_id", F.explode("segments").alias("s")), ["source_id", "s"]).select("source_id", "evidence_id", "window_id")
    times = evidence.select("source_id", "evidence_id", "start", "end"), windows.select("source_id", "window_id", "start", "end")
    by_time = interval_join(*times, ["source_id"], cell).select("source_id", "evidence_id", F.col("r_window_id").alias("window_id"))
    return by_segment.union(by_time).distinct()


def verified_items(items: DataFrame, checks: DataFrame) -> DataFrame:
    """Items with the verification of one of their expressions, the last one; items without any stay as they are."""
    by = Window.partitionBy("expression_id").orderBy(F.desc("ordinal"))
    last = checks.withColumn("_p", F.row_number().over(by)).where("_p = 1").select("expression_id", F.col("status").alias("checked"), "ordinal")
    hits = items.select("item_id", F.explode("expressions").alias("expression_id")).join(last, "expression_id")
    found = hits.groupBy("item_id").agg(F.max_by("checked", "ordinal").alias("checked"))
    return items.join(found, "item_id", "left").withColumn("status", F.coalesce("checked", "status")).drop("checked")


def frame_matches(formulas: DataFrame, frames: DataFrame, least: int) -> DataFrame:
    """Formulas whose variants occur in at least `least` frames, with the number of frames.

    A variant's frames go to a formula as one set, and not as a row for each pair of a formula and a frame.
    """
    held = frames.select("frame_id", F.explode("variants").alias("v")).groupBy("v").agg(F.collect_set("frame_id").alias("held"))
    found = formulas.select("formula_id", F.explode("variants").alias("v")).join(held, "v")
    frames_of = F.array_distinct(F.flatten(F.collect_list("held")))
    return found.groupBy("formula_id").agg(F.size(frames_of).cast("long").alias("frames")).where(F.col("frames") >= least)


def evidence_gate(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """Candidates (candidate_id, chunk_id, segment_ids) whose segments are all in their chunk: distinct ids, and times taken from the segments."""
    ids = candidates.select("candidate_id", "chunk_id", F.explode_outer(F.array_distinct("segment_ids")).alias("segment_id"))
    known = ids.join(segments.select("chunk_id", "segment_id", "start", "end", F.lit(True).alias("_k")), ["chunk_id", "segment_id"], "left")
    return known.groupBy("candidate_id").agg(
        F.array_sort(F.collect_set("segment_id")).alias("segment_ids"), F.min("start").alias("start"), F.max("end").alias("end"), F.coalesce(F.bool_and(F.coalesce("_k", F.lit(False))), F.lit(False)).alias("valid"),
    )


def verbatim_gate(claims: DataFrame, references: DataFrame) -> DataFrame:
    """Claims with whether their text stands in the reference that they cite."""
    joined = claims.join(references.select("ref_id", F.col("text").alias("_ref")), "ref_id", "left")
    return joined.withColumn("verbatim", F.coalesce(F.contains("_ref", F.col("text")), F.lit(False))).drop("_ref")


def plan_coverage(plan: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts (fact_id) as assigned, unassigned or repeated, and ids of the plan (fact_ids) that no fact has."""
    used = plan.select(F.explode("fact_ids").alias("fact_id")).groupBy("fact_id").agg(F.count("*").alias("times"))
    both = facts.select("fact_id", F.lit(True).alias("_known")).join(used, "fact_id", "full")
    state = F.when(F.col("_known").isNull(), "unknown").when(F.col("times").isNull(), "unassigned").when(F.col("times") > 1, "repeated").otherwise("assigned")
    return both.select("fact_id", state.alias("state"))


def item_findings(items: DataFrame) -> DataFrame:
    """What is wrong with an item (item_id, text, confidence, evidence_count, status), as an array of codes."""
    rules = {
        "no_text": F.trim(F.coalesce("text", F.lit(""))) == "", "no_evidence": F.coalesce("evidence_count", F.lit(0)) == 0,
        "confidence_range": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "status": ~F.coalesce(F.col("status").isin("verified", "rejected", "pending", "unverified", "conflict"), F.lit(False)),
    }
    return items.select("item_id", F.array_compact(F.array(*(F.when(test, F.lit(code)) for code, test in rules.items()))).alias("codes"))
