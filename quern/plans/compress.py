"""The compression pipeline over a DataFrame of calls, for the formats whose segmentation needs no parser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import detect_format, signal_of
from ..functions.text import count_tokens, split_tokens
from ..operators.formats import MIN_SAVINGS
from ..operators.score import crc_bucket, hashed, overlap
from ..operators.select import greedy

MIN_TOKENS = 1000


def compress(calls: DataFrame, chunks: DataFrame | None = None, budget: int = 8000, window: int = 200, min_tokens: int = MIN_TOKENS, bucket=crc_bucket, keep: tuple[str, ...] = (), head: int | None = None) -> DataFrame:
    """One row for each call (call_id, raw_output, task): output, original_tokens, compressed_tokens, ratio, chunks_selected, chunks_total, signal, and the columns of calls named in ``keep``.

    Texts below ``min_tokens`` pass unchanged. Others are cut (into ``chunks`` (call_id, ord, content) if given, else
    into token windows), scored against the task, and chosen greedily by score, then order, under ``budget``. A call
    whose scores say nothing, of which nothing fits, or that saves less than 30 % passes unchanged as well. All that
    a call needs is in its own row: without ``chunks`` nothing is exchanged; repeated calls stay repeated. Texts are
    cut and chunks are scored whole, however long; with ``head`` only so many characters of a chunk count for its score.
    """
    sized = calls.withColumn("original_tokens", count_tokens(F.col("raw_output")).cast("long"))
    big = F.col("original_tokens") >= min_tokens
    if chunks is None:
        cut = F.transform(split_tokens(F.col("raw_output"), window), lambda c, i: F.struct(i.alias("ord"), c.alias("content")))
        sized = sized.withColumn("pieces", F.when(big, cut))
    else:
        given = chunks.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("ord", "content"))).alias("given"))
        sized = sized.join(given, "call_id", "left").withColumn("pieces", F.when(big, F.col("given"))).drop("given")
    asked = F.when(F.size("pieces") > 0, hashed(F.col("task"), bucket))
    told = lambda c: F.substring(c["content"], 1, head) if head else c["content"]
    scored = lambda c: F.struct(c["ord"].alias("ord"), count_tokens(c["content"]).cast("long").alias("tok"), c["content"].alias("content"), F.round(overlap(hashed(told(c), bucket), F.col("asked")), 9).alias("score"))
    rows = sized.withColumn("asked", asked).withColumn("parts", F.transform(F.filter("pieces", lambda c: F.trim(c["content"]) != ""), scored))
    ordered = F.array_sort(F.transform("parts", lambda p: F.struct((-p["score"]).alias("rank"), p["ord"].alias("ord"), p["tok"].alias("tok"))))
    chosen = rows.withColumn("selected", greedy(ordered, F.lit(budget))["selected"]).withColumn("signal", F.when(F.size("parts") > 0, signal_of(F.transform("parts", lambda p: p["score"]))))
    picked = chosen.withColumn("kept", F.filter("parts", lambda p: F.array_contains("selected", p["ord"])))
    out = picked.withColumn("made_tokens", F.aggregate("kept", F.lit(0).cast("long"), lambda s, p: s + p["tok"]))
    ratio = F.col("made_tokens") / F.nullif(F.col("original_tokens"), F.lit(0))
    fine = F.coalesce((F.size("selected") > 0) & (F.col("signal") != "none") & (ratio <= 1 - MIN_SAVINGS), F.lit(False))
    ok = F.col("ok")
    return out.withColumn("ok", fine).select(
        "call_id",
        detect_format(F.col("raw_output")).alias("format"),
        F.when(ok, F.array_join(F.transform("kept", lambda p: p["content"]), "\n")).otherwise(F.col("raw_output")).alias("output"),
        "original_tokens",
        F.when(ok, F.col("made_tokens")).otherwise(F.col("original_tokens")).alias("compressed_tokens"),
        F.round(F.when(ok, ratio).otherwise(1.0), 9).alias("ratio"),
        F.when(ok, F.size("selected")).otherwise(F.lit(1)).cast("long").alias("chunks_selected"),
        F.when(F.size("parts") > 0, F.size("parts")).otherwise(F.lit(1)).cast("long").alias("chunks_total"),
        F.coalesce("signal", F.lit("ok")).alias("signal"),
        *keep,
    )


def distinct_work(calls: DataFrame, keys: list[str]) -> DataFrame:
    """The result cache as a plan: one row for each distinct key (output, tool, args, task, last steps, budget), with the first call of it; results are joined back to all calls."""
    return calls.groupBy(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256).alias("cache_key")).agg(F.min("call_id").alias("first_call"), F.count("*").alias("calls"))


def undelivered(chunks: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """Chunks whose id the session has not had before: session dedup over a batch, for chunks that are all delivered."""
    first = chunks.groupBy(session, "id").agg(F.min(F.struct(order, "ord")).alias("first"))
    return chunks.join(first, [session, "id"]).where((F.col(order) == F.col("first")[order]) & (F.col("ord") == F.col("first.ord"))).drop("first")
