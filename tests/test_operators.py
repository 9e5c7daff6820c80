"""Invariants of the compression operators, parsers, feedback, sources and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F
from quern import config
from quern.functions import detect, text
from quern.operators import feedback, parsers, reports, segment, select
from quern.plans import compress
from quern.sources import tables
from quern.streaming import sessions


def one(spark, value, col):
    return spark.createDataFrame([(value,)], "t string").select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "value,fmt",
    [('{"a": 1}', "json"), ("[x", "json"), ("<DIV>x", "html"), ("import os", "code"), ("text\ndef f():\n  pass", "code"), ("x\n$ ls\ny", "shell"), ("a,b\n1,2\n3,4", "csv"), ("a,b and so on.\nWell, no, not.\nx", "text"), ("## Head\ntext", "markdown"), ("2024-01-02 x", "log"), ("some ERROR here", "log"), ("plain", "text"), ("", "text")],
)
def test_formats(spark, value, fmt):
    assert one(spark, value, detect.detect_format(F.col("t"))) == fmt


def test_tokens_join_to_the_text(spark):
    t = "Hello,  wörld\n\t(x_1) == 2"
    assert one(spark, t, F.array_join(text.split_tokens(F.col("t"), 3), "")) == t
    assert one(spark, t, text.count_tokens(F.col("t"))) == len(one(spark, t, text.tokens(F.col("t"))))
    assert one(spark, " ", F.size(text.split_tokens(F.col("t"), 3))) == 0


def test_task_string(spark):
    df = spark.createDataFrame([("fix", "read", {"b": "2", "a": "1"}, ["w", "x", "y", "z"])], "d string, t string, a map<string,string>, s array<string>")
    got = df.select(text.task_string(*map(F.col, "dtas")).alias("x"), text.args_hash(F.col("a")).alias("h")).first()
    assert got.x.startswith("fix | tool: read | args: ") and got.x.endswith("| step-1: x | step-2: y | step-3: z") and len(got.h) == 16


def test_greedy_with_dependencies(spark):
    """The fold against a plain loop, with cycles, ties and slack."""
    rng = random.Random(1)
    rows, want = [], {}
    for call in range(60):
        n, budget = rng.randrange(1, 20), rng.randrange(20, 120)
        toks = [rng.randrange(1, 40) for _ in range(n)]
        deps = [{rng.randrange(n) for _ in range(rng.randrange(0, 3))} - {i} for i in range(n)]
        closure = []
        for i in range(n):
            seen, todo = {i}, [i]
            while todo:
                for j in deps[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            closure.append(sorted(seen))
        order = sorted(range(n), key=lambda i: (rng.random(), i))
        left, chosen = budget, set()
        for i in order:
            need = [j for j in closure[i] if j not in chosen]
            cost = sum(toks[j] for j in need)
            if i not in chosen and cost <= left + (int(budget * 0.15) if len(need) > 1 else 0):
                left -= cost
                chosen |= set(closure[i])
        want[call] = (left, chosen)
        rows.append((call, budget, toks, [(i, toks[i], closure[i]) for i in order]))
    df = spark.createDataFrame(rows, "call int, budget int, toks array<int>, o array<struct<ord:int,tok:int,closure:array<int>>>")
    for r in df.select("call", select.greedy(F.col("o"), F.col("budget"), F.col("toks")).alias("x")).collect():
        assert (r.x.remaining, set(r.x.selected)) == want[r.call]


def test_closure_with_cycles(spark):
    edges = spark.createDataFrame([("c", 1, 2), ("c", 2, 1), ("c", 2, 3), ("d", 1, 9)], "k string, src int, dst int")
    assert {tuple(r) for r in select.closures(edges, "k").collect()} == {("c", 1, 2), ("c", 1, 3), ("c", 2, 1), ("c", 2, 3), ("d", 1, 9)}
    assert select.closures(edges.where("src > 9"), "k").count() == 0
    chain = spark.range(40).select(F.lit("c").alias("k"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert select.closures(chain, "k").count() == 40 * 41 // 2


def test_json_values_are_kept_once():
    doc = {"users": [{"id": i, "name": f"n{i}", "bio": "word " * 30} for i in range(60)], "s": {"theme": "dark"}, "empty": {}}
    pieces = parsers.json_chunks(json.dumps(doc))
    assert all(isinstance(json.loads(p[0]), dict) for p in pieces)
    merged = json.loads(parsers.merge_json([p[0] for p in pieces]))
    assert sum(f"n{i}" in json.dumps(merged).split('"') for i in range(60)) == 60 and "dark" in json.dumps(merged)
    assert parsers.json_chunks("{}") == [] and len(pieces) > 10
    with pytest.raises(ValueError):
        parsers.json_chunks("{x")


def test_code():
    src = '"""Doc."""\nimport os\nimport re\n\nX = 1\n\n# note\ndef a(x):\n    return b(x)\n\n\ndef b(x):\n    return x\n\n\nclass C:\n    y = 1\n\n' + "".join(f"    def m{i}(self):\n        return {' + '.join(map(str, range(40)))}\n\n" for i in range(6)) + "print(a(1))\n"
    pieces = parsers.code_chunks(src)
    kinds = [p[1] for p in pieces]
    assert kinds[:4] == ["module_docstring", "import_block", "body", "function"] and kinds.count("class") == 1 and kinds.count("function") == 8
    deps = parsers.dependencies(pieces)
    names = [p[3] for p in pieces]
    assert deps[names.index("a")] == [names.index("b")] and deps[names.index("C.m0")] == [names.index("C")]
    kept = "".join("".join(p[0].split()) for p in sorted(pieces, key=lambda p: p[2]))
    assert kept == "".join(src.split())
    ts = 'import x from "y"\n\nexport async function f(a) {\n  return g("}") // }\n}\nexport class K {\n  m() { return f(1) }\n}\nconst g = (a) => {\n  return a\n}\nlet z = 1\n'
    got = parsers.code_chunks(ts, "typescript")
    assert [(p[1], p[3]) for p in got] == [("import_block", None), ("function", "f"), ("class", "K"), ("function", "g"), ("body", None)]
    assert parsers.dependencies(got)[1] == [3] and parsers.python_chunks("def (") == [("def (", "body", 0, None, [])]


def test_html_logs_and_mixed():
    words = "word " * 60
    page = f'<nav>x</nav><div class="row"><div class="story"><p>{words}<script>var t="</p>"</script></div></div><article>{words}<p>unclosed<section>in</section></article>'
    assert [p[1] for p in parsers.html_chunks(page)] == ["div", "article"] and all("var t" not in p[0] for p in parsers.html_chunks(page))
    log = "2024-01-01 INFO a\n2024-01-01 INFO b\n2024-01-01 ERROR c\nTraceback x\n  File y\nsvc: INFO d"
    assert [p[1] for p in parsers.log_chunks(log)] == ["event", "traceback", "event"]
    mixed = '{"a": 1}\n\nplain text here\n2024-01-01 ERROR x\ndef f():\n    return 1'
    assert [p[1] for p in parsers.mixed_chunks(mixed)] == ["object", "paragraph", "error", "function"]
    assert parsers.mixed_chunks("{broken") == [("{broken", "paragraph", 0, None, [])]


def test_parsers_refuse_without_failing(spark):
    df = spark.createDataFrame([(1, "{x"), (2, '{"a": 1}'), (3, None)], "call_id long, raw_output string")
    assert [(r.call_id, r.content) for r in parsers.parse_chunks(df, "json").collect()] == [(2, '{"$": {"a": 1}}')]


def test_compression(spark):
    task = "alpha beta gamma"
    body = "\n".join(("alpha beta gamma " if i % 40 == 0 else "lorem ipsum dolor ") * 20 for i in range(120))
    rows = [(1, body, task), (2, "short", task), (3, "same " * 4000, "nothing"), (4, "", task), (5, None, task)]
    got = {r.call_id: r for r in compress.compress(spark.createDataFrame(rows, "call_id long, raw_output string, task string"), budget=1000).collect()}
    assert got[1].compressed_tokens <= 1200 and got[1].ratio < 0.5 and "alpha" in got[1].output and got[1].chunks_total > got[1].chunks_selected
    assert got[2].output == "short" and got[2].chunks_total == 1
    assert got[3].output == rows[2][1] and got[3].signal == "none" and got[3].ratio == 1.0
    assert got[4].output == "" and got[5].output is None


def test_bounds(spark):
    t = " ".join(f"w{i}" for i in range(1000))
    head = one(spark, t, segment.prefilter(F.col("t"), 100))
    assert head.startswith("w0 w1 ") and head.endswith("w999") and "omitted" in head and len(head) < len(t)
    chunks = spark.createDataFrame([("a", i, f"c{i % 3}", 10, i, "line") for i in range(10)], "k string, ord int, content string, token_count int, start_pos int, chunk_type string")
    assert segment.cap_chunks(chunks, "k", 4).count() == 4
    assert [r.ord for r in segment.dedup_first(segment.chunked(chunks, "k"), "k").orderBy("ord").collect()] == [0, 1, 2]
    packed = spark.createDataFrame([(["a b", "c", "d e f g", "h"],)], "p array<string>").select(segment.pack(F.col("p"), 4).alias("x")).first().x
    assert packed == ["a b\n\nc", "d e f g", "h"]


def test_feedback_cycle(spark):
    ts = F.timestamp_seconds(F.col("i"))
    traces = spark.range(7).select(F.col("id").cast("string").alias("task_id"), F.lit("read").alias("tool_name"), F.array(F.lit("function"), F.lit("function")).alias("chunk_types_pruned"))
    failures = spark.range(7).select(F.col("id").cast("string").alias("task_id"), F.col("id").alias("i"), F.lit(True).alias("implicated")).withColumn("created_at", ts)
    pairs = feedback.implicated_pairs(failures, traces)
    assert pairs.count() == 7
    g = feedback.guidelines(pairs).first()
    assert (g.failures, g.score_multiplier) == (7, 1.44)
    assert [(r.old_multiplier, r.new_multiplier) for r in feedback.history(pairs).orderBy("created_at").collect()] == [(1.0, 1.2), (1.2, 1.44)]
    cleared = spark.createDataFrame([("0", False), ("1", True)], "task_id string, success boolean")
    assert feedback.implicated_pairs(failures, traces, cleared).count() == 6
    now = F.timestamp_seconds(F.lit(100 * 86400))
    assert abs(feedback.guidelines(pairs).select(feedback.decayed(F.col("score_multiplier"), F.col("last_failure_at"), now).alias("x")).first().x - 1.368) < 1e-9


def test_metrics_and_routing(spark):
    stats = reports.metric_stats(spark.range(1, 11).select(F.lit("m").alias("k"), F.col("id").cast("double").alias("v0")), ["k"], "v0").first()
    assert (stats.n, stats.mean, stats.median, stats.p50, stats.p99) == (10, 5.5, 5.5, 6.0, 10.0)
    odd = [("t", 2.0)] * 98 + [("t", 7.0), ("t", 9.0), (None, 4.0), ("n", None)]
    got = {r.k: r for r in reports.metric_stats(spark.createDataFrame(odd, "k string, v double"), ["k"], "v").collect()}
    assert [got["t"][c] for c in ("n", "median", "p50", "p90", "p99", "most")] == [100, 2.0, 2.0, 2.0, 9.0, 9.0]
    assert (got[None].n, got[None].p95, got[None].stdev) == (1, 4.0, 0.0) and (got["n"].n, got["n"].p50, got["n"].median) == (0, None, None)
    tools = spark.createDataFrame([("u", "read"), ("w", "read"), ("w", "ls")], "upstream string, name string")
    assert {r.exposed for r in reports.routed_names(tools).collect()} == {"u__read", "w__read", "ls"}


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\ny")
    assert tables.read_texts(spark, str(tmp_path / "in")).collect()[0].raw_output == "x\ny"
    req = spark.createDataFrame([('{"p": "1"}', 0), ("bad", 5)], "tool_args_json string, budget_tokens int")
    assert [(r.tool_args, r.budget_tokens) for r in tables.parse_requests(req).collect()] == [({"p": "1"}, None), ({}, 5)]
    ups = spark.createDataFrame([('[{"command": "c"}, {"name": "n"}, {"url": "u", "name": "z"}]',)], "upstreams string")
    assert [(r.position, r.name) for r in tables.parse_upstreams(ups).collect()] == [(1, "upstream1"), (3, "z")]
    path = f"{tmp_path}/traces"
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "id string, n int")
    tables.append_traces(rows, path)
    tables.append_traces(rows.union(spark.createDataFrame([("c", 3)], "id string, n int")), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_streams(spark, tmp_path):
    schema = "session_id string, seq long, ord int, id string, tokens long"
    first = [("s", 1, 0, "a", 900), ("s", 1, 1, "b", 900), ("t", 1, 0, "a", 10)]
    second = [("s", 2, 0, "a", 900), ("s", 2, 1, "c", 900)]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for name, frame in (("chunks", lambda s: sessions.drop_delivered(s, None)), ("budgets", lambda s: sessions.adaptive_budgets(s.where("ord = 0"), 1000, 800, None))):
            q = frame(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c-{name}").option("path", f"{tmp_path}/o-{name}").trigger(availableNow=True).start()
            assert q.awaitTermination(60)
    got = {(r.session_id, r.seq, r.id) for r in spark.read.parquet(f"{tmp_path}/o-chunks").collect()}
    assert got == {("s", 1, "a"), ("s", 1, "b"), ("t", 1, "a"), ("s", 2, "c")}
    budgets = {(r.session_id, r.seq): r.effective_budget for r in spark.read.parquet(f"{tmp_path}/o-budgets").collect()}
    assert budgets == {("s", 1): 800, ("t", 1): 800, ("s", 2): int(800 * sessions.share(800, 1000) + 0.5)}


def test_config():
    got = config.load({"budget": {"tools": {"read": 100}}}, {"QUERN_BUDGET__DEFAULT": "4000", "QUERN_GATE__MIN_TOKENS": "7", "OTHER": "x"})
    assert config.budget_for(got, "read") == 100 and config.budget_for(got, "ls") == 4000 and got["gate"] == {"min_tokens": 7, "min_savings": 0.3}
