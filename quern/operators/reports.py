"""Aggregates over traces, outcomes, guidelines and benchmark rows."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.detect import implicated


def _ratio() -> Column:
    return F.when(F.sum("original_token_count") > 0, F.sum("compressed_token_count") / F.sum("original_token_count")).otherwise(1.0)


def session_summaries(traces: DataFrame) -> DataFrame:
    return traces.groupBy("session_id").agg(
        F.countDistinct("task_id").alias("tasks"), F.count("*").alias("calls"), F.sum("original_token_count").alias("original_tokens"), F.sum("compressed_token_count").alias("compressed_tokens"),
        (F.sum("original_token_count") - F.sum("compressed_token_count")).alias("saved_tokens"), F.round(_ratio(), 9).alias("ratio"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"),
    )


def tool_stats(traces: DataFrame) -> DataFrame:
    return traces.groupBy("tool_name").agg(
        F.count("*").alias("calls"), F.sum("original_token_count").alias("original_tokens"), F.sum("compressed_token_count").alias("compressed_tokens"), F.round(_ratio(), 9).alias("ratio"),
        F.round(F.avg("n_selected"), 9).alias("avg_selected"), F.round(F.avg(F.col("n_selected") + F.col("n_pruned")), 9).alias("avg_total"),
    )


def tool_report(traces: DataFrame, failures: DataFrame) -> DataFrame:
    counts = failure_counts_by_tool(failures)
    return tool_stats(traces).join(counts, "tool_name", "left").withColumn("failures", F.coalesce("failures", F.lit(0).cast("long")))


def overview(traces: DataFrame, failures: DataFrame, guidelines: DataFrame) -> DataFrame:
    a = traces.agg(F.count("*").alias("calls"), F.countDistinct("session_id").alias("sessions"), F.round(_ratio(), 9).alias("ratio"), (F.sum("original_token_count") - F.sum("compressed_token_count")).alias("saved_tokens"), F.count_if("low_signal").alias("low_signal"))
    b = failures.agg(F.count("*").alias("failures"), F.count_if("implicated").alias("implicated"))
    c = guidelines.agg(F.count_if(F.col("score_multiplier") > 1).alias("active_guidelines"))
    return a.crossJoin(b).crossJoin(c)


def failure_records(outcomes: DataFrame, traces: DataFrame) -> DataFrame:
    """One row for each failed task: implicated only if its reason is one of the known ones and it has traces; its tools and the types pruned for it, sorted."""
    per_task = traces.groupBy("task_id").agg(F.array_sort(F.collect_set("tool_name")).alias("tool_names"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("chunk_types_pruned")))).alias("pruned_types"), F.count("*").alias("n_traces"))
    failed = outcomes.where("outcome = 'failed'").join(per_task, "task_id", "left")
    return failed.select("task_id", "failure_reason", (implicated(F.col("outcome"), F.col("failure_reason")) & F.col("n_traces").isNotNull()).alias("implicated"), F.coalesce("tool_names", F.array().cast("array<string>")).alias("tool_names"), F.coalesce("pruned_types", F.array().cast("array<string>")).alias("pruned_types"))


def failure_counts_by_tool(failures: DataFrame) -> DataFrame:
    return failures.where("implicated").select(F.explode("tool_names").alias("tool_name")).groupBy("tool_name").agg(F.count("*").alias("failures"))


def trace_diff(traces: DataFrame) -> DataFrame:
    """One row for each chunk of a trace: selected or pruned, with preview, tokens and score where recorded."""
    side = lambda ids, flag: traces.select("id", "chunk_previews", "chunk_token_counts", "chunk_scores", F.explode(ids).alias("chunk_id"), F.lit(flag).alias("selected"))
    both = side("chunk_ids_selected", True).union(side("chunk_ids_pruned", False))
    return both.select("id", "chunk_id", "selected", *[F.try_element_at(m, F.col("chunk_id")).alias(n) for m, n in ((F.col("chunk_previews"), "preview"), (F.col("chunk_token_counts"), "tokens"), (F.col("chunk_scores"), "score"))])


def metric_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, median, sample deviation (0 for one row), extremes, and percentiles by index without interpolation.

    Places come from running counts over a key's distinct values, counted map-side before: no array of a key's values.
    """
    n = F.count(value)
    spread = F.when(n > 1, F.stddev_samp(value)).otherwise(0.0)
    sums = rows.groupBy(*keys).agg(
        n.alias("n"), F.avg(value).alias("mean"), spread.alias("stdev"), F.min(value).alias("least"), F.max(value).alias("most")
    )
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__value")).agg(F.count("*").alias("__count"))
    w = Window.partitionBy(*keys).orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], "__value", F.sum("__count").over(w).alias("__upto"))
    same = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    at = lambda i: F.min(F.when(F.col("__upto") > i, F.col("__value")))
    marks = {f"p{p}": F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1) for p in (50, 90, 95, 99)}
    middle = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    own = ["n", "mean", "stdev", "least", "most"]
    out = sums.join(upto, same, "left").groupBy(*keys, *own).agg(middle.alias("median"), *[at(i).alias(name) for name, i in marks.items()])
    return out.select(*keys, "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "stdev")], "least", "most", *marks)


def bench_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("condition").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("success").cast("int")), 9).alias("success_rate"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("delivered_tokens").alias("delivered_tokens"),
        F.round(F.when(F.sum("raw_tokens") > 0, 1 - F.sum("delivered_tokens") / F.sum("raw_tokens")).otherwise(0.0), 9).alias("reduction"),
    )


def recent_steps(calls: DataFrame, key: str, order: str, step: str, n: int = 3) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    return calls.withColumn("recent_steps", F.collect_list(step).over(w))


def adaptive_budget(calls: DataFrame, key: str, order: str, used: str, limit: int, budget: int, least: float = 0.3) -> DataFrame:
    """Budget of each call from the tokens that its session's earlier calls used: full up to half the limit, then falling to a share of ``least``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    usage = F.coalesce(F.sum(used).over(w), F.lit(0)) / F.lit(float(limit))
    factor = F.when(usage <= 0.5, 1.0).otherwise(F.greatest(F.lit(least), 1 - (usage - 0.5) / 0.5 * (1 - least)))
    return calls.withColumn("effective_budget", F.floor(budget * factor + 0.5).cast("long"))


def routed_names(tools: DataFrame) -> DataFrame:
    """Names that several upstreams list get the upstream in front."""
    n = F.count("*").over(Window.partitionBy("name"))
    return tools.withColumn("exposed", F.when(n > 1, F.concat_ws("__", "upstream", "name")).otherwise(F.col("name")))


def newest(rows: DataFrame, order: str, tie: str, n: int = 500) -> DataFrame:
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(n)
