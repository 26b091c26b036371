"""Graded evaluation of rankings, macro averages, candidates for contradiction, and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import formulas
from docloom.functions.base import materialized


def ranking_metrics(hits: DataFrame, gold: DataFrame, k: int, query: str = "query_id", target: str = "target") -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG at k of each query that has judgements.

    hits: (query, rank, target), gold: (query, target, grade). A target counts at its first hit. Metrics whose denominator is
    0 are null, never 0. Sums run over at most k hits of a query.
    """
    by = Window.partitionBy(query, target).orderBy("rank")
    first = hits.where(F.col("rank") <= k).withColumn("_p", F.row_number().over(by)).where("_p = 1").drop("_p")
    graded = first.join(gold, [query, target], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    found = graded.groupBy(query).agg(
        F.count_if(F.col("grade") > 0).alias("relevant"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
        F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"),
    )
    best = Window.partitionBy(query).orderBy(F.desc("grade"), target)
    ideal = gold.where("grade > 0").withColumn("_r", F.row_number().over(best))
    wanted = ideal.groupBy(query).agg(F.count("*").alias("wanted"), F.sum(F.when(F.col("_r") <= k, gain(F.col("grade"), F.col("_r")))).alias("idcg"))
    all_queries = gold.select(query).distinct()
    rows = all_queries.join(found, query, "left").join(wanted, query, "left")
    n, w = F.coalesce("relevant", F.lit(0)), F.coalesce("wanted", F.lit(0))
    return rows.select(
        query, (n / k).alias("precision"), F.when(w > 0, n / w).alias("recall"), F.when(w > 0, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr"),
        F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"),
    )


def macro(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Mean of each metric over the queries that have it, and how many were left out."""
    sums = metrics.agg(*(f(n).alias(f"{n}_{s}") for n in names for s, f in (("mean", F.avg), ("n", F.count))), F.count("*").alias("_all"))
    rows = [F.struct(F.lit(n).alias("metric"), F.col(f"{n}_mean").alias("mean"), F.col(f"{n}_n").alias("used"), (F.col("_all") - F.col(f"{n}_n")).alias("excluded")) for n in names]
    return sums.select(F.inline(F.array(*rows)))


def contradictions(statements: DataFrame, key: str, text: str, negations: str = r"\b(not|nicht)\b") -> DataFrame:
    """Statements that are equal once a negation is taken out, but not before: (normalized text, plain ids, negated ids).

    One row per text: the two sides as counts and first ids, so that frequent texts aren't paired one by one.
    """
    folded = F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))
    bare = F.trim(F.regexp_replace(F.regexp_replace(folded, negations, ""), r"\s+", " "))
    rows = statements.select(key, folded.alias("folded"), bare.alias("bare")).withColumn("negated", F.col("folded") != F.col("bare")).where("bare <> ''")
    sides = rows.groupBy("bare").agg(
        F.count_if("negated").alias("n_negated"), F.count_if(~F.col("negated")).alias("n_plain"),
        F.min(F.when(F.col("negated"), F.col(key))).alias("first_negated"), F.min(F.when(~F.col("negated"), F.col(key))).alias("first_plain"),
    )
    return sides.where("n_negated > 0 AND n_plain > 0")


def findings(df: DataFrame, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per row and rule that it breaks: (key, code, severity). rules: code -> (severity, broken)."""
    broken = [F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, (severity, test) in rules.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*broken))).alias("f")).select(key, "f.*")


def audit_status(found: DataFrame, all_keys: DataFrame, key: str) -> DataFrame:
    """Failed, passed_with_warnings or passed for each key."""
    worst = found.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    joined = all_keys.select(key).distinct().join(worst, key, "left").na.fill(0, ["errors", "warnings"])
    return joined.withColumn("status", F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "passed_with_warnings").otherwise("passed"))


def compared(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both sides by key, and whether each column is the same; a side that is missing differs everywhere."""
    b = right.withColumnsRenamed({c: f"_{c}" for c in columns})
    both = left.withColumn("_l", F.lit(True)).join(b.withColumn("_r", F.lit(True)), key, "full")
    here = F.coalesce(F.col("_l") & F.col("_r"), F.lit(False))
    return both.select(key, *((here & F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"same_{c}") for c in columns))


def coverage(planned: DataFrame, done: DataFrame, key: str, size: str) -> DataFrame:
    """Planned keys done once, several times or never, unknown ones that were done, and whether the sizes agree."""
    n = done.groupBy(key).agg(F.count("*").alias("times"), F.sum(size).alias("_done"))
    both = planned.select(key, F.col(size).alias("_planned"), F.lit(True).alias("_known")).join(n, key, "full")
    known = F.coalesce("_known", F.lit(False))
    return both.agg(
        F.count_if(known & (F.col("times") == 1)).alias("once"), F.count_if(known & (F.col("times") > 1)).alias("repeated"), F.count_if(known & F.col("times").isNull()).alias("missing"),
        F.count_if(~known).alias("unknown"), (F.coalesce(F.sum("_planned"), F.lit(0)) == F.coalesce(F.sum("_done"), F.lit(0))).alias("sizes_agree"),
    )


def integrity(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Foreign-key audit: how often each missing parent is referred to."""
    lost = child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
    return lost.groupBy(child_key).agg(F.count("*").alias("references"))


def formula_parts(references: DataFrame, key: str, column: str, sizes: list[int] | None = None) -> DataFrame:
    """(key, part): the names of all proper subtrees of each formula, or of those with one of the sizes."""
    return references.select(key, F.explode(formulas.part_names(F.col(column), sizes)).alias("part"))


def containing(references: DataFrame, predictions: DataFrame, key: str, other: str, column: str, least: int = 2) -> DataFrame:
    """(key, other): each prediction with the references that hold it as a proper part, by an equality join of names; formulas of fewer than `least`
    nodes, such as a single symbol, are left out. Only parts of a size that is asked for are joined; a formula's tokens bound how many sizes there are."""
    rooted = predictions.select(other, formulas.rooted_formula(F.col(column)).alias("_f"))
    asked = materialized(rooted.select(other, F.col("_f.root").alias("part"), F.col("_f.size").alias("_size")).where(F.col("_size") >= least))
    sizes = [r[0] for r in asked.select("_size").distinct().collect()]
    return formula_parts(references, key, column, sizes).join(asked.select(other, "part"), "part").select(key, other)


def formula_verdicts(cases: DataFrame) -> DataFrame:
    """Cases (status, reference, prediction, parts) with verdict, differences and sound added.

    The verdict is the first that holds: ambiguous; for an absent reference absent or unexpected; missing; exact; normalized; structural, where the trees are equal;
    equivalent, where their canonical forms are; partial, where the prediction is one of the reference's parts; different; and not_evaluable where a formula that must be read can't be.
    parts: formulas (array of strings) that count as a part of the answer; each must be a proper subtree of the reference, else sound is false and it counts for nothing. A null or
    empty array has none.
    """
    found = cases.withColumn("_f", formulas.formula_verdict("status", "reference", "prediction", "parts"))
    return found.select(*cases.columns, "_f.verdict", "_f.differences", "_f.sound")
