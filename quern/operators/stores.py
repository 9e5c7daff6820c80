"""Trace stores read as one, evidence of guidelines, cached results, the size gate, needles, and closures seen from the other end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_traces(*stores: DataFrame) -> DataFrame:
    """All traces of all stores (persisted, in memory, buffered), by column name; a trace that two stores hold is there twice, a column that a store lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stores)


def traces_of(traces: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Traces whose ``key`` (task_id, session_id) is among ``wanted``; each once, whatever repeats there. Null keys are of nobody."""
    return traces.join(wanted.select(key), key, "left_semi").select(traces.columns)


def ordered_traces(traces: DataFrame, newest_first: bool = False) -> DataFrame:
    """Traces by time, then id."""
    way = F.desc if newest_first else F.asc
    return traces.orderBy(way("created_at"), way("id"))


def evidence(pairs: DataFrame) -> DataFrame:
    """(tool_name, chunk_type, position, task_id): the tasks that each guideline rests on, each once, by when they first did, then by task.

    Rows, not one list for each guideline, as lists would grow without bound.
    """
    first = pairs.groupBy("tool_name", "chunk_type", "task_id").agg(F.min("created_at").alias("__at"))
    w = Window.partitionBy("tool_name", "chunk_type").orderBy("__at", "task_id")
    return first.select("tool_name", "chunk_type", F.row_number().over(w).alias("position"), "task_id")


def size_gate(text: Column, is_error: Column | None = None, least: int = 4000) -> Column:
    """Whether an item of a tool's answer is to be compressed: text of ``least`` characters or more, of an answer that is no error. Null texts aren't."""
    big = F.coalesce(F.length(text) >= least, F.lit(False))
    return big if is_error is None else big & ~F.coalesce(is_error, F.lit(False))


def from_cache(calls: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Calls with first_call (the call of the same key that comes first by ``order``, whose result they get), hit (whether that is another) and a trace id of their own.

    Keys are hashed with nulls told apart from empty values. First calls are found by an aggregate with partial sums
    and joined back, so that a very common key is one row on one side of the join.
    """
    key = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    keyed = calls.withColumn("__cache", key)
    first = keyed.groupBy("__cache").agg(F.min(order).alias("first_call"))
    trace = F.sha2(F.concat_ws(":", "__cache", F.col(order).cast("string")), 256)
    return keyed.join(first, "__cache").withColumn("hit", F.col(order) != F.col("first_call")).withColumn("trace_id", trace).drop("__cache")


def needle_hits(outputs: DataFrame, needles: DataFrame, key: str) -> DataFrame:
    """``outputs`` (``key``, raw_output, output) joined to the ``needles`` (``key``, pattern) of their task: in_raw, survives (in what was delivered) and the line of evidence. A null text holds none."""
    return needles_in(outputs.join(needles.select(key, "pattern"), key))


def needles_in(rows: DataFrame) -> DataFrame:
    """needle_hits() of rows (raw_output, output, pattern) that are joined already.

    Evidence is looked for from the beginnings of lines only, where the leftmost match starts anyway; without that,
    a line that holds no needle takes the square of its length.
    """
    found = lambda c: F.coalesce(F.regexp_like(c, F.col("pattern")), F.lit(False))
    line = F.regexp_substr(F.col("output"), F.concat(F.lit(r"(?<![^\n])[^\n]*(?:"), F.col("pattern"), F.lit(r")[^\n]*")))
    return rows.withColumn("in_raw", found(F.col("raw_output"))).withColumn("survives", found(F.col("output"))).withColumn("evidence", F.coalesce(F.when(found(F.col("output")), line), F.lit("")))


def dependents(closure: DataFrame, key: str) -> DataFrame:
    """(key, chunk, dependent) from select.closures(): what depends on each chunk, directly or not."""
    return closure.select(key, F.col("dst").alias("chunk"), F.col("src").alias("dependent"))


def selection_cost(selected: DataFrame, closure: DataFrame, chunks: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, needed, total_tokens, fits): chunks and tokens that the ``selected`` (key, id) need with all their dependencies, each counted once.

    Chunks that are not among ``chunks`` (key, id, tok) cost nothing and are not counted.
    """
    wanted = selected.select(key, "id")
    more = closure.join(wanted.withColumnRenamed("id", "src"), [key, "src"], "left_semi").select(key, F.col("dst").alias("id"))
    needed = wanted.union(more).distinct().join(chunks.select(key, "id", "tok"), [key, "id"])
    cost = needed.groupBy(key).agg(F.count("*").alias("needed"), F.sum("tok").cast("long").alias("total_tokens"))
    return cost.withColumn("fits", F.col("total_tokens") <= budget)


def placeholders(edges: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, id, content, tok, start_pos): an empty chunk at -1 for each referenced id that is no chunk of its call."""
    named = edges.select(key, F.col("dst").alias("id")).where("id is not null").distinct()
    absent = named.join(chunks.select(key, "id"), [key, "id"], "left_anti")
    return absent.select(key, "id", F.lit("").alias("content"), F.lit(0).cast("long").alias("tok"), F.lit(-1).alias("start_pos"))


def line_windows(text: Column, size: int = 3) -> Column:
    """Array of struct(start_line, num_lines, content): runs of ``size`` lines, the last one shorter; for shell output without prompts."""
    lines = F.split(text, "\n")
    starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(size))
    part = lambda i: F.slice(lines, i + 1, F.lit(size))
    return F.transform(starts, lambda i: F.struct(i.alias("start_line"), F.size(part(i)).alias("num_lines"), F.array_join(part(i), "\n").alias("content")))
