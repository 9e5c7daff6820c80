"""Compression of calls in every format, against a plain loop."""

import json

from pyspark.sql import functions as F
from quern.operators import formats, parsers, score
from quern.plans import engine


def texts():
    fill = "lorem ipsum dolor sit amet " * 20
    users = json.dumps({"users": [{"id": i, "name": f"n{i}", "bio": ("alpha beta " if i == 7 else "word ") * 40} for i in range(60)]})
    code = "import os\n\n" + "\n".join(f"def f{i}(x):\n    # {'alpha beta' if i == 9 else fill}\n    return f{i - 1 if i % 3 else i}(x)\n" for i in range(1, 30))
    page = "".join(f"<section><p>{'alpha beta ' if i == 3 else ''}{fill}{i}</p></section>" for i in range(20))
    table = "id,kind,note\n" + "\n".join(f"{i},k{i % 5},{'alpha beta' if i % 5 == 2 else 'some words here'}" for i in range(400))
    shell = "\n".join(f"$ run {i}\n{'alpha beta ' if i == 4 else ''}{fill}" for i in range(20))
    notes = "\n".join(f"# Part {i}\n{'alpha beta ' if i == 5 else ''}{fill}" for i in range(20))
    log = "\n".join(f"2024-01-01 {'ERROR' if i % 9 == 0 else 'INFO'} {'alpha beta' if i == 18 else 'step'} {i} {fill}" for i in range(40))
    mixed = "plain alpha words\n" + "\n".join(f"{fill}{i}\n$ ls {i}" for i in range(12))
    return {"json": users, "code": code, "html": page, "csv": table, "shell": shell, "markdown": notes, "log": log, "text": mixed.replace("$ ", "% ")}


def plain(text, fmt, budget, task):
    """(output or None, chunks): the same by a loop over one call."""
    chunks, direct = formats.bounded(formats.pieces_of(text, fmt), budget)
    near, scores = formats.closure(direct), formats.lexical(task, [c for c, _, _ in chunks])
    toks = [parsers.count(c) for c, _, _ in chunks]
    left, chosen = budget, set()
    for i in sorted(range(len(chunks)), key=lambda i: (-scores[i], i)):
        need = [j for j in near[i] if j not in chosen]
        cost = sum(toks[j] for j in need)
        if i not in chosen and cost <= left + (int(budget * 0.15) if len(need) > 1 else 0):
            left -= cost
            chosen |= set(near[i])
    parts = [chunks[i][0] for i in sorted(chosen, key=lambda i: (chunks[i][2], i))]
    if not parts or (len(chunks) >= 4 and min(scores) == max(scores)):
        return None, chunks
    made = parsers.merge_json(parts) if fmt == "json" else "\n".join(parts)
    return (made if parsers.count(made) / parsers.count(text) <= 0.7 else None), chunks


def test_every_format_against_a_loop(spark):
    task, rows = "alpha beta", list(texts().items())
    calls = spark.createDataFrame([(k, t, task) for k, t in rows], "call_id string, raw_output string, task string")
    got = {r.call_id: r for r in engine.compress_calls(calls, budget=700).collect()}
    shrunk = 0
    for fmt, text in rows:
        made, chunks = plain(text, fmt, 700, task)
        r = got[fmt]
        assert r.format == fmt and r.output == (text if made is None else made), fmt
        assert r.chunks_total == max(len(chunks), 1) and len(r.trace.chunk_ids_selected) + len(r.trace.chunk_ids_pruned) == len(chunks)
        if made is not None:
            shrunk += 1
            assert "alpha" in r.output and r.compressed_tokens == parsers.count(made) and r.trace.chunk_ids_pruned
    assert shrunk >= 6
    assert "n7" in json.dumps(json.loads(got["json"].output))


def test_edges_of_calls(spark):
    schema = "call_id long, raw_output string, task string, tool_name string, tool_args map<string,string>, budget_tokens int, task_copy string"
    rows = [(1, None, "x", None, None, None, ""), (2, "", None, "t", {}, 0, ""), (3, "{broken " * 900, "x", "t", {"path": "a.ts"}, 5, ""), (4, "same words\n\n" * 900, "none", "t", {}, 300, ""), (2, "", None, "t", {}, 0, "")]
    rules = spark.createDataFrame([("t", "paragraph", 1.2), ("t", "paragraph", 1.2)], "tool_name string, chunk_type string, score_multiplier double")
    got = engine.compress_calls(spark.createDataFrame(rows, schema), rules).orderBy("call_id").collect()
    assert [r.call_id for r in got] == [1, 2, 2, 3, 4] and [r.output for r in got] == [None, "", "", rows[2][1], rows[3][1]]
    assert all(r.ratio == 1.0 for r in got) and got[0].trace is None and got[3].trace is None
    assert engine.compress_calls(spark.createDataFrame([], schema)).count() == 0


def test_guidelines_and_traces(spark):
    log = texts()["log"]
    rules = spark.createDataFrame([("read", "event", 3.0)], "tool_name string, chunk_type string, score_multiplier double")
    calls = spark.createDataFrame([(1, log, "alpha beta error", "read", "s", "k")], "call_id long, raw_output string, task string, tool_name string, session_id string, task_id string").withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    results = engine.compress_calls(calls, rules, budget=600)
    traces = engine.traces_of(results, calls).collect()
    assert len(traces) == 1 and len(traces[0].id) == 32 and set(traces[0].chunk_scores) == set(traces[0].chunk_ids_selected + traces[0].chunk_ids_pruned)
    plan = results._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_scores_equal_those_of_the_table_form(spark):
    docs = [(i, t[: 300 + i]) for i, t in enumerate(texts().values())] + [(90, ""), (91, "αβγ 12 x_1 12")]
    df = spark.createDataFrame(docs, "call_id long, content string")
    tasks = df.select("call_id", F.lit("alpha beta 12 words n1").alias("task"))
    want = {r.call_id: r.score for r in score.lexical_scores(df, tasks, ["call_id"], ["call_id"]).collect()}
    for i, t in docs:
        assert abs(formats.lexical("alpha beta 12 words n1", [t])[0] - want[i]) < 1e-8


def test_bounds_of_a_call():
    many = [(f"c{i}", "line", i, None, []) for i in range(4500)]
    chunks, _ = formats.bounded(many, 100)
    assert len(chunks) == 1500 and chunks[0][0] == "c0\nc1\nc2"
    big = [("w " * 900, "function", 0, "f", []), ("f()", "function", 9, "g", ["f", "h"]), ("h()", "function", 12, "h", ["g"])]
    chunks, direct = formats.bounded(big, 500)
    assert [c[2] for c in chunks] == [0, 1, 2, 3, 9, 12] and direct == [[], [], [], [], [5], [4]] and formats.closure(direct)[4] == [4, 5]
    assert formats.csv_pieces("a,b\n") == [("a,b\n", "rows", 0, None, [])] and formats.csv_pieces("") == []
    assert formats.shell_pieces("x\n$ ls\n$ cat\ny") == [("$ cat\ny", "command", 7, None, [])]
    assert [p[0] for p in formats.shell_pieces("a\nb\nc\n\nd")] == ["a\nb\nc"]
    fenced = "pre " * 30 + "\n# A\n```\n# not\n```\n" + "x " * 30 + "\n# B\ny"
    assert [p[0].split("\n")[0][:5] for p in formats.markdown_pieces(fenced)] == ["pre p", "# A", "# B"]


def test_levels_layout_words_and_shell_runs():
    from quern.operators.parsers import log_chunks, meaningful, mixed_chunks

    text = "2024-01-01 10:00:00 info start\n2024-01-01 10:00:01 Warning low\n2024-01-01 10:00:02 critical gone\n2024-01-01 10:00:03 error twice"
    assert [(c.split()[2].lower(), kind) for c, kind, *_ in log_chunks(text)] == [("info", "event"), ("warning", "event"), ("critical", "error"), ("error", "error")]
    assert [meaningful(c) for c in ("row", "col-6", "border", "span shadow-sm", "price", "row price", "", None)] == [False, False, False, False, True, True, False, False]
    mixed = "some words here\n$ ls -l\nfile one\nfile two\n$ pwd\n/root"
    assert "command" in [kind for _, kind, *_ in mixed_chunks(mixed)]


def test_calls_of_many_chunks(spark):
    import time

    rows = [(c, json.dumps({"items": [{"key": 2000 * c + i, "part": i % 7, "state": {"flag": "alpha" if i == 5 else "N", "line": "O"}, "note": "a b c d e f g h"} for i in range(800)]}), "alpha") for c in range(400)]
    began = time.time()
    got = engine.compress_calls(spark.createDataFrame(rows, "call_id int, raw_output string, task string").repartition(4), budget=1500).collect()
    assert time.time() - began < 20
    assert all(r.chunks_total == 800 and r.compressed_tokens < 1500 * 1.2 and "alpha" in r.output and len(r.trace.chunk_ids_pruned) == 800 - r.chunks_selected for r in got) and len(got) == 400


def test_counts_and_json_sizes():
    import re

    for t in ("", "a_1 b", " a", ".a", "é٠x \t\r\n\x0b-", "\ud800a", "𝒳y"):
        assert parsers.count(t) == len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]", t))
    # two paths that read the same: the later value stands at the earlier place
    text = json.dumps({"fill": "w " * 400, "a.b": [1, 2], "a": {"b": "é", "c": float("nan")}} | {f"k{i}": i for i in range(400)})
    made = [c for c, *_ in parsers.json_chunks(text)]
    assert all(json.dumps(json.loads(c), ensure_ascii=False) == c for c in made)
    assert all(parsers.count(c) >= parsers.JSON_FULL for c in made[2:-1]) and len(made) > 4
