"""Sources and sinks: text files, task files, requests, trace and guideline tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.feedback import append_new, upsert
from ..operators.stores import ordered_traces

TRACE_KEY, GUIDELINE_KEYS = "id", ["tool_name", "chunk_type"]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, raw_output): one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("raw_output"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length").orderBy("name")


def read_tasks(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` tasks of JSON files, by file name."""
    return spark.read.json(path, multiLine=True).withColumn("file", F.input_file_name()).orderBy("file").limit(n)


def parse_requests(requests: DataFrame) -> DataFrame:
    """Calls from requests with tool_args as JSON text; text that isn't an object gives no arguments; a budget of 0 is open."""
    args = F.coalesce(F.from_json("tool_args_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return requests.withColumn("tool_args", args).withColumn("budget_tokens", F.nullif("budget_tokens", F.lit(0))).drop("tool_args_json")


def parse_upstreams(configs: DataFrame, column: str = "upstreams") -> DataFrame:
    """(position, name, command, url) from a JSON array; unnamed ones are upstream1, upstream2, ...; those without command and url are left out."""
    items = F.from_json(column, "array<struct<name:string,command:string,url:string>>")
    rows = configs.select(F.posexplode(items).alias("i", "u"))
    return rows.where("u.command is not null or u.url is not null").select((F.col("i") + 1).alias("position"), F.coalesce("u.name", F.concat(F.lit("upstream"), (F.col("i") + 1).cast("string"))).alias("name"), "u.command", "u.url")


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_traces(rows: DataFrame, path: str) -> None:
    have = _existing(rows.sparkSession, path)
    (rows.dropDuplicates([TRACE_KEY]) if have is None else append_new(have, rows, TRACE_KEY)).write.mode("append").parquet(path)


def upsert_guidelines(rows: DataFrame, path: str, version: str, previous: str | None = None) -> DataFrame:
    """Write the merged table as a new version beside the previous one; readers never see half of it."""
    spark = rows.sparkSession
    have = _existing(spark, f"{path}/{previous}") if previous else None
    merged = rows if have is None else upsert(have, rows, GUIDELINE_KEYS, "last_updated")
    merged.write.mode("overwrite").parquet(f"{path}/{version}")
    return spark.read.parquet(f"{path}/{version}")


def read_traces(spark: SparkSession, path: str, newest_first: bool = False) -> DataFrame:
    """The stored traces by time, then id. A missing table is an error."""
    return ordered_traces(spark.read.parquet(path), newest_first)


def append_failures(rows: DataFrame, path: str) -> None:
    """Failed tasks, each task_id once: those that the table has are left out."""
    have = _existing(rows.sparkSession, path)
    (rows.dropDuplicates(["task_id"]) if have is None else append_new(have, rows, "task_id")).write.mode("append").parquet(path)


def write_results(results: DataFrame, path: str, fmt: str = "json") -> None:
    """Outputs with the reduction in percent, as JSON lines or as CSV with a header; as text, the outputs alone."""
    if fmt == "text":
        results.select(F.coalesce("output", F.lit("")).alias("value")).write.mode("overwrite").text(path)
        return
    out = results.withColumn("reduction_percent", (1 - F.col("ratio")) * 100)
    out.write.mode("overwrite").option("header", "true").format(fmt).save(path)
