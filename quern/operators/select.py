"""Choice of chunks under a token budget, with their dependencies; repair and reconstruction."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

SLACK = 0.15


def _written(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` computed once, as a table in the shared folder (spark.checkpoint.dir; one of this machine where it is unset, as in tests), and its number of rows. The table is removed when the driver ends."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
    path = f"{base.rstrip('/')}/quern-closure-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), rows.get.get("n", 0)


def closures(edges: DataFrame, key: str) -> DataFrame:
    """(key, src, dst): what each chunk depends on, directly or not, itself excluded; cycles are legal.

    Paths double in each round, until a round finds no more: the logarithm of the longest chain in joins within
    calls, each written before the next so that plans stay small. Edges with a null in them lead nowhere.
    """
    paths, found = _written(edges.select(key, "src", "dst").where(F.col(key).isNotNull() & (F.col("src") != F.col("dst"))).distinct())
    before = -1
    while found > before:
        step = paths.select(F.col(key).alias("__key"), F.col("src").alias("__mid"), F.col("dst").alias("__end"))
        longer = paths.join(step, (F.col(key) == F.col("__key")) & (F.col("dst") == F.col("__mid"))).where(F.col("src") != F.col("__end")).select(key, "src", F.col("__end").alias("dst"))
        before = found
        paths, found = _written(paths.union(longer).distinct())
    return paths


def greedy(ordered: Column, budget: Column, tokens: Column | None = None) -> Column:
    """struct(remaining, selected): one fold over chunks in order of preference.

    ``ordered``: array of struct(ord, tok[, closure]). Without ``tokens`` a chunk is taken if it fits. With it (array
    of token counts by ord) what a chunk needs is its closure less what is selected; it is taken if that fits the
    rest, with a slack of 15 % of the budget if it needs more than itself.
    """
    zero = F.struct(budget.cast("long").alias("remaining"), F.array().cast("array<int>").alias("selected"))

    def alone(acc: Column, x: Column) -> Column:
        fits = x["tok"] <= acc["remaining"]
        return F.struct(F.when(fits, acc["remaining"] - x["tok"]).otherwise(acc["remaining"]).alias("remaining"), F.when(fits, F.concat(acc["selected"], F.array(x["ord"]))).otherwise(acc["selected"]).alias("selected"))

    def needy(acc: Column, x: Column) -> Column:
        need = F.array_except(x["closure"], acc["selected"])
        cost = F.aggregate(need, F.lit(0).cast("long"), lambda s, i: s + F.get(tokens, i))
        fits = ~F.array_contains(acc["selected"], x["ord"]) & (cost <= acc["remaining"] + F.when(F.size(need) > 1, F.floor(budget * SLACK)).otherwise(0))
        return F.struct(F.when(fits, acc["remaining"] - cost).otherwise(acc["remaining"]).alias("remaining"), F.when(fits, F.array_union(acc["selected"], x["closure"])).otherwise(acc["selected"]).alias("selected"))

    return F.aggregate(ordered, zero, alone if tokens is None else needy)


def repair_json(chunks: DataFrame) -> DataFrame:
    """Without JSON chunks that don't parse."""
    return chunks.where((F.col("format") != "json") | F.expr("try_parse_json(content)").isNotNull())


def add_direct_dependencies(selected: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Selected (key, id) code chunks with their direct dependencies, three levels deep."""
    out = selected.select(key, "id").distinct()
    for _ in range(3):
        wanted = edges.select(F.col(key).alias("__key"), F.col("src").alias("__src"), F.col("dst").alias("__dst"))
        out = out.union(out.join(wanted, (F.col(key) == F.col("__key")) & (F.col("id") == F.col("__src"))).select(key, F.col("__dst").alias("id"))).distinct()
    return out


def log_violations(chunks: DataFrame, key: str, reach: int = 1000) -> DataFrame:
    """Errors with no INFO of their component in the ``reach`` characters before them; counted only."""
    errors = chunks.where("chunk_type = 'error'").select(key, "ord", F.col("start_pos").alias("at"), F.col("component").alias("of"))
    infos = chunks.where("level = 'INFO'").select(F.col(key).alias("info_key"), "start_pos", "component")
    near = (F.col(key) == F.col("info_key")) & (F.col("component") == F.col("of")) & F.col("start_pos").between(F.col("at") - reach, F.col("at"))
    return errors.join(infos, near, "left_anti").select(key, "ord")


def reconstruct(chunks: DataFrame, key: str) -> DataFrame:
    """(key, output): contents by position, then order, one to a line."""
    return chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_pos", "ord", "content"))), lambda x: x["content"]), "\n").alias("output"))
