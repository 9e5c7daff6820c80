"""Score multipliers learned from failed tasks, and their decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .score import clamp

STEP, MOST, GATE, DECAY, DAYS = 1.2, 3.0, 3, 0.95, 30


def implicated_pairs(failures: DataFrame, traces: DataFrame, reruns: DataFrame | None = None) -> DataFrame:
    """Distinct (task_id, tool_name, chunk_type) pruned in traces of implicated failures; a rerun that fails as well clears its task."""
    bad = failures.where("implicated").select("task_id", "created_at")
    if reruns is not None:
        bad = bad.join(reruns.where("not success").select("task_id"), "task_id", "left_anti")
    return bad.join(traces.select("task_id", "tool_name", F.explode("chunk_types_pruned").alias("chunk_type")), "task_id").distinct()


def history(pairs: DataFrame) -> DataFrame:
    """Each third failure of a (tool, type) raises its multiplier by a fifth, up to 3; a row for each change."""
    w = Window.partitionBy("tool_name", "chunk_type").orderBy("created_at", "task_id")
    n = F.row_number().over(w)
    at = lambda k: F.least(F.pow(F.lit(STEP), k), F.lit(MOST))
    steps = pairs.withColumn("n", n).where(F.col("n") % GATE == 0).withColumn("k", F.col("n") / GATE)
    rows = steps.select("tool_name", "chunk_type", F.round(at(F.col("k") - 1), 6).alias("old_multiplier"), F.round(at(F.col("k")), 6).alias("new_multiplier"), "task_id", "created_at")
    return rows.where("old_multiplier <> new_multiplier")


def guidelines(pairs: DataFrame) -> DataFrame:
    """The multipliers after all failures: 1.2 to the power of a third of their number, at most 3."""
    k = F.floor(F.count("*") / GATE)
    return pairs.groupBy("tool_name", "chunk_type").agg(F.count("*").alias("failures"), F.round(F.least(F.pow(F.lit(STEP), k), F.lit(MOST)), 6).alias("score_multiplier"), F.max("created_at").alias("last_failure_at"))


def decayed(multiplier: Column, last_failure: Column, now: Column, runs: int = 1) -> Column:
    old = last_failure.isNull() | (last_failure <= now - F.make_dt_interval(F.lit(DAYS)))
    return F.when((multiplier > 1) & old, clamp(multiplier * DECAY**runs, MOST)).otherwise(multiplier)


def decayed_always(multiplier: Column, runs: int = 1) -> Column:
    """Raised multipliers ``runs`` decays later, however recent their last failure."""
    return F.when(multiplier > 1, clamp(multiplier * DECAY**runs, MOST)).otherwise(multiplier)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row of each key; among equal ones the update's."""
    both = target.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def append_new(target: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows not in the target yet, each once: an idempotent sink's input."""
    return rows.dropDuplicates([key]).join(target.select(key), key, "left_anti")
