"""Smaller views: histograms, session marks, metadata of calls, merged failures, evidence, benchmark conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reports import metric_stats


def chunk_type_histogram(traces: DataFrame) -> DataFrame:
    """(chunk_type, n) over all chunks that were pruned."""
    return traces.select(F.explode("chunk_types_pruned").alias("chunk_type")).groupBy("chunk_type").agg(F.count("*").alias("n"))


def kept_and_pruned(diff: DataFrame) -> DataFrame:
    """Tokens on both sides of each trace, from trace_diff(); chunks without a recorded count are 0."""
    side = lambda keep: F.coalesce(F.sum(F.when(F.col("selected") == keep, F.col("tokens"))), F.lit(0)).cast("long")
    return diff.groupBy("id").agg(side(True).alias("kept_tokens"), side(False).alias("pruned_tokens"))


def active_sessions(summaries: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """Sessions seen in the last ``minutes`` before ``now``, which is stated so that a task that runs twice finds the same."""
    return summaries.where(F.col("last_seen") >= now - F.make_dt_interval(mins=F.lit(minutes)))


def metrics_summary(rows: DataFrame, metrics: list[str], success: str) -> DataFrame:
    """metric_stats() of each metric in its own row, with the share of successes among all rows."""
    long = rows.unpivot(success, metrics, "metric", "value").withColumn("value", F.col("value").cast("double"))
    rate = rows.agg(F.round(F.avg(F.col(success).cast("int")), 9).alias("success_rate"))
    return metric_stats(long, ["metric"], "value").crossJoin(rate)


def task_sessions(calls: DataFrame, key: str, order: list[str], starts: Column) -> DataFrame:
    """Adds session_ordinal: a call where ``starts`` holds opens a new session of its key, with steps and used tokens counted anew; calls before the first are session 0."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("session_ordinal", F.sum(F.when(starts, 1).otherwise(0)).over(w).cast("long"))


def call_metadata(items: DataFrame, session: str = "session_id", call: str = "call_id") -> DataFrame:
    """One row for each call from its compressed items: items, tokens before and after, ratio, and what its session has used up to it."""
    calls = items.groupBy(session, call).agg(F.count("*").alias("items"), F.sum("original_tokens").cast("long").alias("original_tokens"), F.sum("compressed_tokens").cast("long").alias("compressed_tokens"))
    w = Window.partitionBy(session).orderBy(call).rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.when(F.col("original_tokens") > 0, F.col("compressed_tokens") / F.col("original_tokens")).otherwise(1.0)
    return calls.withColumn("ratio", F.round(ratio, 9)).withColumn("session_tokens", F.sum("compressed_tokens").over(w).cast("long"))


def merged_failures(recent: DataFrame, stored: DataFrame, key: str = "task_id") -> DataFrame:
    """Recent failures, and stored ones of tasks that aren't among them."""
    return recent.unionByName(stored.join(recent.select(key).distinct(), key, "left_anti").select(*recent.columns))


def as_map(guidelines: DataFrame) -> DataFrame:
    """One row: a map from "tool:type" to the multiplier; there is one entry for each tool and chunk type."""
    pair = F.struct(F.concat_ws(":", "tool_name", "chunk_type").alias("k"), F.col("score_multiplier").alias("v"))
    return guidelines.agg(F.map_from_entries(F.array_sort(F.collect_set(pair))).alias("multipliers"))


def pruned_evidence(pruned: DataFrame, reruns: DataFrame, probe: int = 200) -> DataFrame:
    """``pruned`` (task_id, content, ...) with accessed: whether the task's rerun holds the chunk's first ``probe`` characters; true where there is no rerun text."""
    seen = reruns.groupBy(F.col("task_id").alias("__task")).agg(F.max("accessed_content").alias("__seen"))
    joined = pruned.join(seen, F.col("task_id") == F.col("__task"), "left")
    return joined.withColumn("accessed", F.coalesce(F.contains("__seen", F.substring(F.trim("content"), 1, probe)), F.lit(True))).drop("__task", "__seen")


def cache_stats(keys: DataFrame, key: str) -> DataFrame:
    """Size, hits, misses and hit rate of an unbounded cache that is asked for each row's key."""
    return keys.agg(F.countDistinct(key).alias("size"), (F.count(key) - F.countDistinct(key)).alias("hits"), F.countDistinct(key).alias("misses")).withColumn("hit_rate", F.round(F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0), 9))


def conditions(tasks: DataFrame, budgets: list[int]) -> DataFrame:
    """Every task under every condition: baseline (no budget), and one for each budget, named by its thousands."""
    named = [("baseline", None), *[(f"budget_{b // 1000}k" if b % 1000 == 0 else f"budget_{b}", b) for b in budgets]]
    return tasks.withColumn("c", F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(b).cast("long").alias("budget_tokens")) for n, b in named]))).select(*tasks.columns, "c.condition", "c.budget_tokens")


def upsert_outcomes(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Outcomes (task_id, outcome, failure_reason, evaluation_score, agent_final_output, created_at), one for each task: the latest outcome, reason and score, but the first final output."""
    both = target.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    at = F.struct("__new", "created_at")
    latest = lambda c: F.max_by(F.struct(c), at)[c].alias(c)
    return both.groupBy("task_id").agg(*[latest(c) for c in ("outcome", "failure_reason", "evaluation_score")], F.min_by(F.struct("agent_final_output"), at)["agent_final_output"].alias("agent_final_output"), F.max("created_at").alias("created_at"))
