"""The smaller views on a few rows."""

from pyspark.sql import functions as F
from quern.operators import views


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_histogram_and_sides(spark):
    traces = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, None)], "id int, chunk_types_pruned array<string>")
    assert rows(views.chunk_type_histogram(traces)) == [("a", 2), ("b", 1)]
    diff = spark.createDataFrame([(1, True, 5), (1, False, 7), (1, True, None), (2, False, 1)], "id int, selected boolean, tokens int")
    assert rows(views.kept_and_pruned(diff)) == [(1, 5, 7), (2, 0, 1)]


def test_sessions(spark):
    seen = spark.createDataFrame([("a", 0), ("b", 3600), ("c", 3599)], "session_id string, s long").withColumn("last_seen", F.timestamp_seconds("s"))
    assert {r.session_id for r in views.active_sessions(seen, F.timestamp_seconds(F.lit(7200))).collect()} == {"b"}
    calls = spark.createDataFrame([("u", 1, "x"), ("u", 2, "set_task"), ("u", 3, "x"), ("u", 4, "set_task"), ("v", 1, "set_task")], "k string, seq int, tool string")
    assert [r.session_ordinal for r in views.task_sessions(calls, "k", ["seq"], F.col("tool") == "set_task").orderBy("k", "seq").collect()] == [0, 1, 1, 2, 1]
    items = spark.createDataFrame([("s", 1, 10, 5), ("s", 1, 30, 5), ("s", 2, 0, 0)], "session_id string, call_id int, original_tokens int, compressed_tokens int")
    assert rows(views.call_metadata(items)) == [("s", 1, 2, 40, 10, 0.25, 10), ("s", 2, 1, 0, 0, 1.0, 10)]


def test_failures_and_guidelines(spark):
    recent = spark.createDataFrame([("a", "new")], "task_id string, reason string")
    stored = spark.createDataFrame([("old", "a"), ("old", "b")], "reason string, task_id string")
    assert rows(views.merged_failures(recent, stored)) == [("a", "new"), ("b", "old")]
    g = spark.createDataFrame([("read", "function", 1.2), ("read", "class", 1.44)], "tool_name string, chunk_type string, score_multiplier double")
    assert views.as_map(g).first().multipliers == {"read:function": 1.2, "read:class": 1.44}
    pruned = spark.createDataFrame([("a", " needle "), ("a", "other"), ("b", "x"), ("c", "x")], "task_id string, content string")
    reruns = spark.createDataFrame([("a", "hay needle hay"), ("c", None)], "task_id string, accessed_content string")
    assert [r.accessed for r in views.pruned_evidence(pruned, reruns).orderBy("task_id", "content").collect()] == [True, False, True, True]
    schema = "task_id string, outcome string, failure_reason string, evaluation_score double, agent_final_output string, created_at long"
    target = spark.createDataFrame([("a", "failed", "r", 0.1, "first", 1)], schema)
    updates = spark.createDataFrame([("a", "success", None, 0.9, "second", 2), ("b", "failed", "q", None, None, 2)], schema)
    assert rows(views.upsert_outcomes(target, updates)) == [("a", "success", None, 0.9, "first", 2), ("b", "failed", "q", None, None, 2)]


def test_benchmark_views(spark):
    tasks = spark.createDataFrame([(1,), (2,)], "task_id int")
    assert rows(views.conditions(tasks, [8000, 1500])) == sorted([(t, c, b) for t in (1, 2) for c, b in (("baseline", None), ("budget_8k", 8000), ("budget_1500", 1500))], key=str)
    runs = spark.createDataFrame([(True, 1, 2.0), (False, 3, 4.0)], "ok boolean, tokens int, seconds double")
    got = {r.metric: r for r in views.metrics_summary(runs, ["tokens", "seconds"], "ok").collect()}
    assert (got["tokens"].mean, got["seconds"].most, got["tokens"].success_rate) == (2.0, 4.0, 0.5)
    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("a",)], "k string")
    assert rows(views.cache_stats(keys, "k")) == [(2, 2, 2, 0.5)]
    assert rows(views.cache_stats(keys.where("k = 'z'"), "k")) == [(0, 0, 0, 0.0)]
