"""Compression of calls in any format: results and traces, without a shuffle of the texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import detect_format
from ..functions.text import count_tokens, language
from ..operators.formats import decided, lexical
from ..operators.segment import prefilter
from .compress import MIN_TOKENS

BUDGET = 8000
#: Guidelines of so many tools are broadcast (a map of the few chunk types for each); those of more are joined by exchange.
MOST_TOOLS = 10_000


def compress_calls(calls: DataFrame, guidelines: DataFrame | None = None, budget: int = BUDGET, min_tokens: int = MIN_TOKENS, score: Callable[[str, list[str]], list[float]] = lexical) -> DataFrame:
    """One row for each call: call_id, format, output, original_tokens, compressed_tokens, ratio, chunks_selected, chunks_total, signal, trace.

    ``calls``: call_id, raw_output, task; tool_name, tool_args (map) and budget_tokens if there are such columns (a
    budget that is null or 0 is ``budget``). Texts of fewer than ``min_tokens`` pass unchanged and have no trace.
    Others are cut by their format, and their chunks scored against the task; ``guidelines`` (tool_name, chunk_type,
    score_multiplier) adjust the scores; chunks are taken by adjusted score, score, order with what they depend on
    while they fit; JSON that doesn't parse is left out, and the rest put together in the order of the text. A call
    passes unchanged, with all chunks in its trace, if its scores are all equal (four chunks or more), if nothing
    fits, or if it would save less than 30 %; without chunks it passes unchanged, without trace.

    All that a call needs is in its own row: guidelines, one map for each tool, are broadcast if they are few (counted
    first), else joined. Of equal chunks, which only a split leaves, the maps of the trace hold the first. Null texts are null again; repeated calls stay repeated; no calls give no rows.
    """
    has = set(calls.columns)
    args = F.col("tool_args") if "tool_args" in has else F.create_map().cast("map<string,string>")
    most = F.coalesce(F.nullif(F.col("budget_tokens"), F.lit(0)), F.lit(budget)) if "budget_tokens" in has else F.lit(budget)
    own = calls.select(
        "call_id", F.col("raw_output").cast("string").alias("raw_output"), F.col("task").cast("string").alias("task"), (F.col("tool_name") if "tool_name" in has else F.lit(None)).cast("string").alias("tool_name"),
        language(F.coalesce(args, F.create_map().cast("map<string,string>"))).alias("language"), most.cast("int").alias("budget"),
        count_tokens(F.col("raw_output")).cast("long").alias("original_tokens"), detect_format(F.col("raw_output")).alias("format"),
    )
    if guidelines is None:
        own = own.withColumn("multipliers", F.create_map().cast("map<string,double>"))
    else:
        pairs = F.map_from_entries(F.collect_list(F.struct("chunk_type", F.col("score_multiplier").cast("double"))))
        by_tool = guidelines.dropDuplicates(["tool_name", "chunk_type"]).groupBy(F.col("tool_name").alias("__tool")).agg(pairs.alias("multipliers"))
        if by_tool.limit(MOST_TOOLS + 1).count() <= MOST_TOOLS:
            by_tool = F.broadcast(by_tool)
        own = own.join(by_tool, F.col("tool_name") == F.col("__tool"), "left").drop("__tool")
    text = F.when(F.col("original_tokens") >= min_tokens, prefilter(F.col("raw_output")))
    done = own.withColumn("d", decided(text, F.col("format"), F.col("language"), F.col("budget"), F.col("task"), F.col("original_tokens"), F.col("multipliers"), score))
    ok, n = F.coalesce("d.ok", F.lit(False)), F.coalesce("d.total", F.lit(0))
    ratio = F.col("d.made_tokens") / F.nullif(F.col("original_tokens"), F.lit(0))
    lists = [F.col(f"d.trace.{x}").alias(x) for x in ("chunk_ids_selected", "chunk_ids_pruned", "chunk_types_selected", "chunk_types_pruned", "chunk_previews", "chunk_token_counts")]
    trace = F.struct(*lists, F.transform_values("d.trace.chunk_scores", lambda _, v: F.round(v, 4)).alias("chunk_scores"), (F.col("d.signal") != "ok").alias("low_signal"))
    return done.select(
        "call_id",
        "format",
        F.when(ok, F.col("d.made")).otherwise(F.col("raw_output")).alias("output"),
        "original_tokens",
        F.when(ok, F.col("d.made_tokens")).otherwise(F.col("original_tokens")).alias("compressed_tokens"),
        F.round(F.when(ok, ratio).otherwise(1.0), 9).alias("ratio"),
        F.when(ok, F.col("d.parts")).when(F.col("d.signal") == "none", n).otherwise(F.lit(1)).cast("long").alias("chunks_selected"),
        F.greatest(n, F.lit(1)).cast("long").alias("chunks_total"),
        F.coalesce("d.signal", F.lit("ok")).alias("signal"),
        F.when(n > 0, trace).alias("trace"),
    )


def traces_of(results: DataFrame, calls: DataFrame) -> DataFrame:
    """Trace rows of compress_calls() for a trace table: results joined with their calls (call_id, session_id, task_id, tool_name, created_at); ids are hashes of session, task and call, so that a task that runs twice writes the same."""
    about = calls.select(F.col("call_id").alias("__call"), "session_id", "task_id", "tool_name", "created_at")
    key = F.substring(F.sha2(F.concat_ws("|", F.col("session_id").cast("string"), F.col("task_id").cast("string"), F.col("call_id").cast("string")), 256), 1, 32)
    rows = results.where("trace is not null").join(about, F.col("call_id") == F.col("__call"))
    return rows.select(key.alias("id"), "session_id", "task_id", "tool_name", "created_at", F.col("original_tokens").alias("original_token_count"), F.col("compressed_tokens").alias("compressed_token_count"), F.col("ratio").alias("compression_ratio"), "trace.*")
