"""Workflow and job control over tables: availability, staleness along a graph, order of stages, coverage of schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.base import materialized


def available(beats: DataFrame, now: Column, ttl_seconds: float) -> DataFrame:
    """Workers whose last sign of life is recent enough."""
    last = beats.groupBy("worker_id").agg(F.max("at").alias("last"))
    return last.withColumn("available", F.col("last") >= now - F.make_interval(secs=F.lit(ttl_seconds)))


def levels(stages: DataFrame) -> DataFrame:
    """(stage_id, level) of stages with an array `after`; a stage comes after all that it names. A cycle is an error.

    Each round places the stages whose predecessors are all placed, so there are as many rounds as levels.
    """
    edges = materialized(stages.select("stage_id", F.explode_outer("after").alias("before")))
    placed = materialized(stages.where(F.size(F.coalesce("after", F.array())) == 0).select("stage_id", F.lit(0).alias("level")))
    total, level = stages.count(), 0
    while (n := placed.count()) < total:
        level += 1
        open_ = edges.join(placed.select("stage_id"), "stage_id", "left_anti")
        waiting = open_.join(placed.select(F.col("stage_id").alias("before"), F.lit(True).alias("_done")), "before", "left")
        ready = waiting.groupBy("stage_id").agg(F.bool_and(F.coalesce("_done", F.lit(False))).alias("ok")).where("ok").select("stage_id", F.lit(level).alias("level"))
        placed = materialized(placed.union(ready))
        if placed.count() == n:
            raise ValueError("the stages have a cycle, or one of them names a stage that isn't there")
    return placed


def preview(stages: DataFrame, done: DataFrame) -> DataFrame:
    """(stage_id, state) of stages (stage_id, after, config_hash) given finished ones (stage_id, config_hash).

    stale: finished with another configuration, or after a stage that isn't up to date; ready: all before it are up to date;
    blocked: some aren't there yet; skipped: up to date.
    """
    order = levels(stages).join(stages, "stage_id").join(done.select("stage_id", F.col("config_hash").alias("_done")), "stage_id", "left")
    rows = materialized(order.withColumn("_own", F.col("_done").eqNullSafe(F.col("config_hash"))))
    top = rows.agg(F.max("level")).first()[0] or 0
    state = rows.where("level = 0").select("stage_id", F.when(F.col("_own"), "skipped").when(F.col("_done").isNotNull(), "stale").otherwise("ready").alias("state"))
    for level in range(1, top + 1):
        state = materialized(state)
        here = rows.where(F.col("level") == level).withColumn("before", F.explode("after"))
        above = here.join(state.select(F.col("stage_id").alias("before"), F.col("state").alias("_s")), "before")
        fresh = F.bool_and(F.col("_s") == "skipped")
        new = above.groupBy("stage_id").agg(
            F.when(F.first("_done").isNotNull() & ~(F.first("_own") & fresh), "stale").when(F.first("_own"), "skipped").when(fresh, "ready").otherwise("blocked").alias("state")
        )
        state = state.union(new)
    return state


def schedule(chunks: DataFrame) -> DataFrame:
    """State of each lecture from its chunks (lecture_id, status)."""
    n = F.count("*")
    done, failed, unknown = (F.count_if(F.col("status") == s) for s in ("done", "failed", "unknown"))
    state = F.when(done == n, "complete").when(unknown > 0, "unknown").when(failed > 0, "partial").when(done > 0, "running").otherwise("pending")
    return chunks.groupBy("lecture_id").agg(n.alias("chunks"), done.alias("done"), state.alias("state"))


def pending(plan: DataFrame, receipts: DataFrame, key: str) -> DataFrame:
    """What is planned and has no receipt that it was done."""
    return plan.join(receipts.where("status = 'done'").select(key), key, "left_anti")
