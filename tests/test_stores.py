"""Stores, evidence, cached results, needles and closures on a few rows, nulls and empty tables included."""

from pyspark.sql import functions as F
from quern.functions import text
from quern.operators import feedback, select, stores
from quern.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_union_and_filters(spark):
    kept = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "id int, task_id string, created_at int")
    buffered = spark.createDataFrame([("a", 1)], "task_id string, id int")
    both = stores.union_traces(kept, buffered, kept.limit(0))
    assert rows(both) == [(1, "a", 5), (1, "a", None), (2, None, 6)]
    wanted = spark.createDataFrame([("a",), ("a",), (None,)], "task_id string")
    assert rows(stores.traces_of(kept, wanted, "task_id")) == [(1, "a", 5)]
    assert [r.id for r in stores.ordered_traces(kept, newest_first=True).collect()] == [2, 1]


def test_evidence_keeps_first_of_each_task(spark):
    pairs = spark.createDataFrame([("t", "c", "y", 3), ("t", "c", "x", 3), ("t", "c", "y", 1), ("u", "c", "x", 9)], "tool_name string, chunk_type string, task_id string, created_at int")
    assert rows(stores.evidence(pairs)) == [("t", "c", 1, "y"), ("t", "c", 2, "x"), ("u", "c", 1, "x")]
    assert rows(stores.evidence(pairs.limit(0))) == []


def test_size_gate(spark):
    items = spark.createDataFrame([("x" * 4000, False), ("x" * 4000, True), ("x" * 4000, None), ("x" * 3999, False), (None, False)], "t string, e boolean")
    got = items.select(stores.size_gate(F.col("t"), F.col("e")).alias("g"), stores.size_gate(F.col("t")).alias("h")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (True, True), (False, False), (False, False)]


def test_from_cache_tells_null_from_empty(spark):
    calls = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "a", None), (4, "", "a")], "call_id int, tool string, args string")
    got = stores.from_cache(calls, ["tool", "args"], "call_id")
    assert rows(got.select("call_id", "first_call", "hit")) == [(1, 1, False), (2, 2, False), (3, 1, True), (4, 4, False)]
    assert got.select("trace_id").distinct().count() == 4


def test_needles(spark):
    outputs = spark.createDataFrame([("a", "x\nkey=12\ny", "key=12"), ("b", "key=7", "gone"), ("c", None, None)], "task_id string, raw_output string, output string")
    needles = spark.createDataFrame([("a", "key=[0-9]+"), ("b", "key=[0-9]+"), ("c", "k"), ("d", "k")], "task_id string, pattern string")
    got = stores.needle_hits(outputs, needles, "task_id").select("task_id", "in_raw", "survives", "evidence")
    assert rows(got) == [("a", True, True, "key=12"), ("b", True, False, ""), ("c", False, False, "")]


def test_needles_in_long_lines(spark):
    import time

    long = "xk " * 70_000
    outputs = spark.createDataFrame([("a", long, long), ("b", "", f"head\n{long}key=1 key=2 tail\nkey=3")], "task_id string, raw_output string, output string")
    needles = spark.createDataFrame([("a", "key=[0-9]+"), ("b", "key=[0-9]+")], "task_id string, pattern string")
    began = time.time()
    got = stores.needle_hits(outputs, needles, "task_id").select("task_id", "in_raw", "survives", "evidence")
    assert rows(got) == [("a", False, False, ""), ("b", False, True, f"{long}key=1 key=2 tail")]
    assert time.time() - began < 20


def test_closures_from_the_other_end(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "d", "z"), (2, "a", "b")], "call int, src string, dst string")
    closure = select.closures(edges, "call")
    assert rows(stores.dependents(closure, "call").where("call = 1 and chunk = 'a'")) == [(1, "a", "b"), (1, "a", "c")]
    chunks = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (1, "c", 7), (1, "d", 1), (2, "a", 30)], "call int, id string, tok int")
    chosen = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a")], "call int, id string")
    assert rows(stores.selection_cost(chosen, closure, chunks, "call", 18)) == [(1, 3, 18, True), (2, 1, 30, False)]
    assert rows(stores.placeholders(edges, chunks, "call")) == [(1, "z", "", 0, -1), (2, "b", "", 0, -1)]


def test_line_windows(spark):
    df = spark.createDataFrame([("1\n2\n3\n4",), ("",), (None,)], "t string").select(stores.line_windows(F.col("t")).alias("w"))
    got = [None if r.w is None else [tuple(x) for x in r.w] for r in df.collect()]
    assert got == [[(0, 3, "1\n2\n3"), (3, 1, "4")], [(0, 1, "")], None]


def test_text_helpers(spark):
    one = spark.range(1)
    cell = lambda c: one.select(c).first()[0]
    assert cell(text.percent(F.lit(0.256))) == "25.6%"
    assert cell(text.short_id(F.lit("123456789"))) == "12345678…"
    assert cell(text.short_id(F.lit("12345678"))) == "12345678"
    assert cell(text.count_tokens(F.lit("ab, c"))) == 3
    assert cell(text.count_tokens(F.lit("ab, c"), r"\S")) == 4
    assert cell(text.count_tokens(F.lit(None).cast("string"))) == 0
    assert round(cell(feedback.decayed_always(F.lit(1.2), 2)), 6) == 1.083
    assert cell(feedback.decayed_always(F.lit(1.0))) == 1.0


def test_tables(spark, tmp_path):
    traces = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "id string, created_at int")
    tables.append_traces(traces, str(tmp_path / "traces"))
    tables.append_traces(traces, str(tmp_path / "traces"))
    assert [r.id for r in tables.read_traces(spark, str(tmp_path / "traces")).collect()] == ["c", "a", "b"]
    failed = spark.createDataFrame([("t", "x"), ("u", "y")], "task_id string, reason string")
    tables.append_failures(failed.limit(1), str(tmp_path / "failed"))
    tables.append_failures(failed, str(tmp_path / "failed"))
    assert sorted(r.task_id for r in spark.read.parquet(str(tmp_path / "failed")).collect()) == ["t", "u"]
    out = spark.createDataFrame([("one", 0.5), (None, 1.0)], "output string, ratio double")
    tables.write_results(out, str(tmp_path / "out"), "text")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["", "one"]
