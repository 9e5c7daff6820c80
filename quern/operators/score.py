"""Scores of chunks against a task: hashed words, cosine, blends, rolling context, guideline multipliers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words

BUCKETS, HEAD = 512, 400
#: Rows and query rows that are held against each other at once.
ROW_BLOCK, QUERY_BLOCK = 8192, 256
#: Tasks in one plan, and chunks in one product with them.
TASK_BLOCK, CHUNK_BLOCK = 4096, 256


def crc_bucket(word: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(F.encode(word, "UTF-8")), F.lit(buckets))


def md5_bucket(word: Column, buckets: int = BUCKETS) -> Column:
    """The same in functions that other SQL engines have too."""
    return F.pmod(F.conv(F.substring(F.md5(F.encode(word, "UTF-8")), 1, 7), 16, 10).cast("long"), F.lit(buckets))


def bag(df: DataFrame, keys: list[str], text: Column, bucket=crc_bucket) -> DataFrame:
    """(keys, bucket, w): term counts of hashed words, scaled to unit length for each key. Sparse: a text without words has no rows."""
    counts = df.select(*keys, F.explode(words(text)).alias("word")).groupBy(*keys, bucket(F.col("word")).alias("bucket")).agg(F.count("*").alias("n"))
    norms = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, keys).select(*keys, "bucket", (F.col("n") / F.col("norm")).alias("w"))


def lexical_scores(chunks: DataFrame, tasks: DataFrame, keys: list[str], on: list[str], text: str = "content", task: str = "task", bucket=crc_bucket, head: int | None = HEAD) -> DataFrame:
    """(keys, score): cosine of each chunk's and its task's bags. ``tasks`` has one row for each value of ``on`` (a subset of ``keys``)."""
    own = bag(chunks, keys, F.substring(F.col(text), 1, head) if head else F.col(text), bucket)
    asked = bag(tasks, on, F.col(task), bucket).withColumnRenamed("w", "task_w")
    hits = own.join(asked, [*on, "bucket"]).groupBy(*keys).agg(F.sum(F.col("w") * F.col("task_w")).alias("score"))
    return chunks.select(*keys).join(hits, keys, "left").select(*keys, F.coalesce("score", F.lit(0.0)).alias("score"))


def hashed(text: Column, bucket=crc_bucket) -> Column:
    """Buckets of a text's words, sorted; a word that repeats is there as often. Empty for null."""
    return F.sort_array(F.coalesce(F.transform(words(text), lambda w: bucket(w).cast("int")), F.array().cast("array<int>")))


def overlap(own: Column, asked: Column) -> Column:
    """Cosine of two bags given as hashed(): the score of lexical_scores() within a row, 0 where one is empty."""
    none = F.lit(0).cast("long")

    def met(acc: Column, x: Column) -> Column:
        again = F.when(x == acc["last"], acc["run"]).otherwise(none) + 1
        return F.struct(x.alias("last"), again.alias("run"), (acc["total"] + 2 * again - 1).alias("total"))

    def squares(bag: Column) -> Column:
        return F.aggregate(bag, F.struct(F.lit(-1).alias("last"), none.alias("run"), none.alias("total")), met, lambda acc: acc["total"])

    def cosine_of(own: Column) -> Column:
        hits = F.aggregate(F.array_intersect(own, asked), none, lambda s, b: s + F.size(F.filter(own, lambda x: x == b)).cast("long") * F.size(F.filter(asked, lambda x: x == b)))
        return F.coalesce(F.when(hits > 0, hits / F.sqrt(squares(own).cast("double") * squares(asked))), F.lit(0.0))

    # own in an array of one, so that it is made once and not for each bucket that both have
    return F.element_at(F.transform(F.array(own), cosine_of), 1)


def _dense(buckets: list[list[int] | None]) -> np.ndarray:
    """Bags as rows of unit length, zero for a text without words."""
    at = np.array([i * BUCKETS + b for i, x in enumerate(buckets) for b in x or ()], dtype=np.int64)
    n = np.bincount(at, minlength=len(buckets) * BUCKETS).reshape(len(buckets), BUCKETS).astype(float)
    return n / np.maximum(np.sqrt((n * n).sum(1, keepdims=True)), 1)


def scores_against_all(chunks: DataFrame, tasks: DataFrame, key: str, task_key: str, text: str = "content", task: str = "task", bucket=crc_bucket, head: int | None = HEAD) -> DataFrame:
    """(key, task_key, score): the score of lexical_scores(), of every chunk against every task, to six places. Keys are longs.

    Chunks stay where they are: bags of tasks, 4,096 in one plan, go to them. No tasks give no rows.
    """
    hashed = lambda df, k, t: df.select(F.col(k).cast("long"), F.transform(words(t), lambda w: bucket(w)).cast("array<int>").alias("buckets"))
    own, schema = hashed(chunks, key, F.substring(F.col(text), 1, head) if head else F.col(text)), f"{key} long, {task_key} long, score double"

    def scored(part: list) -> DataFrame:
        ids, asked = np.array([r[0] for r in part]), _dense([r[1] for r in part]).T

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, CHUNK_BLOCK):
                    some = batch.slice(i, CHUNK_BLOCK)
                    made = np.round(_dense(some.column(1).to_pylist()) @ asked, 6)
                    keys = some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), len(ids))))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(ids, some.num_rows)), pa.array(made.ravel())], [key, task_key, "score"])

        return own.mapInArrow(run, schema)

    out, part = None, []
    rows = hashed(tasks, task_key, F.col(task)).toLocalIterator()
    for row in rows:
        part.append(row)
        if len(part) == TASK_BLOCK:
            out, part = scored(part) if out is None else out.union(scored(part)), []
    if part:
        out = scored(part) if out is None else out.union(scored(part))
    return chunks.sparkSession.createDataFrame([], schema) if out is None else out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def hybrid(semantic: Column, lexical: Column, weight: float = 0.25) -> Column:
    return semantic * (1 - weight) + lexical * weight


def rolling(base: Column, steps: Column, share: float = 0.4) -> Column:
    """0.4 of the base task's vector and 0.6 of the steps', scaled to unit length."""
    mixed = F.array(F.zip_with(base, steps, lambda x, y: x * share + y * (1 - share)))
    return F.element_at(F.transform(mixed, lambda v: F.transform(v, lambda x: x / F.sqrt(dot(v, v)))), 1)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row for each block of about ``size`` rows (vec_id, embedding, label)."""
    n = max(1, -(-rows.count() // size))
    return rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("vec_id", "embedding", "label")).alias("x")).select("x")


def _unpacked(block: pa.StructArray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and labels; what is null is NaN."""
    ids, vectors, labels = (block.field(i) for i in range(3))
    full = np.full((len(block), dim), np.nan)
    full[np.asarray(vectors.is_valid())] = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return ids.to_numpy(zero_copy_only=False), full, labels.cast("double").to_numpy(zero_copy_only=False)


def against_all(rows: DataFrame, queries: DataFrame, values: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], names: list[str], k: int | None = None) -> DataFrame:
    """(query_id, vec_id, names): every row of ``queries`` against every row of ``rows`` (vec_id, embedding, label), in blocks.

    ``values`` makes from query vectors, row vectors and row labels one matrix (queries x rows) for each name. Values are
    rounded to six places; with ``k`` the best ``k`` of each query by the first of them stay, ties by vec_id. What has no
    value (no vector, or one of length zero) is null and comes last.
    """
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    schema = ", ".join(["query_id long", "vec_id long", *(f"{n} double" for n in names)])
    types = [pa.int64(), pa.int64(), *[pa.float64()] * len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, _ = _unpacked(batch.column(1)[i].values, dim)
                ids, v, labels = _unpacked(batch.column(0)[i].values, dim)
                with np.errstate(invalid="ignore", divide="ignore"):
                    made = {n: np.round(m, 6) for n, m in values(q, v, labels).items()}
                for j, query in enumerate(q_ids):
                    mine = [made[n][j] for n in names]
                    keep = slice(None) if k is None else np.lexsort((ids, -mine[0]))[:k]
                    out = [np.full(len(ids[keep]), query), ids[keep], *(m[keep] for m in mine)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    pairs = _blocks(rows, ROW_BLOCK).crossJoin(_blocks(queries, QUERY_BLOCK).withColumnRenamed("x", "q"))
    out = pairs.mapInArrow(run, schema)
    if k is None:
        return out
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last(names[0]), "vec_id"))
    return out.withColumn("place", place).where(F.col("place") <= k).drop("place")


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (q @ v.T) / np.sqrt(np.outer((q * q).sum(1), (v * v).sum(1)))


def rolled(q: np.ndarray, v: np.ndarray, share: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """Of rolling(v, q), for all pairs: the first component and the squared length after scaling. No pair's vector is held."""
    size = np.sqrt(np.maximum(share**2 * (v * v).sum(1)[None, :] + (1 - share) ** 2 * (q * q).sum(1)[:, None] + 2 * share * (1 - share) * (q @ v.T), 0))
    first = (share * v[:, 0][None, :] + (1 - share) * q[:, 0][:, None]) / size
    return first, np.where(np.isnan(first), np.nan, 1.0)


def clamp(multiplier: Column, most: float = 3.0) -> Column:
    return F.least(F.greatest(multiplier, F.lit(1.0)), F.lit(most))


def apply_guidelines(scored: DataFrame, guidelines: DataFrame) -> DataFrame:
    """Adds adjusted_score: score times the multiplier of (tool_name, chunk_type), 1 where there is none."""
    g = guidelines.select("tool_name", "chunk_type", "score_multiplier")
    return scored.join(g, ["tool_name", "chunk_type"], "left").withColumn("adjusted_score", F.col("score") * F.coalesce("score_multiplier", F.lit(1.0))).drop("score_multiplier")
