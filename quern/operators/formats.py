"""Chunks of whole calls, by format: cut, bounded, linked and scored in one pass over the texts."""

from __future__ import annotations

import csv
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SPACED, WORD
from .parsers import Piece, code_chunks, count, dependencies, html_chunks, json_chunks, log_chunks, merge_json, mixed_chunks, shell_pieces
from .score import BUCKETS, HEAD
from .select import SLACK

_IDS = "array<string>"
#: What is decided of a call: ``made`` is null unless it is to be delivered (``ok``); ``signal`` is null without chunks, the trace's scores are not rounded.
DECIDED = f"struct<ok:boolean,made:string,made_tokens:long,parts:int,total:int,signal:string,trace:struct<chunk_ids_selected:{_IDS},chunk_ids_pruned:{_IDS},chunk_types_selected:{_IDS},chunk_types_pruned:{_IDS},chunk_previews:map<string,string>,chunk_token_counts:map<string,int>,chunk_scores:map<string,double>>>"
_LISTS = [("chunk_ids_selected", pa.string()), ("chunk_ids_pruned", pa.string()), ("chunk_types_selected", pa.string()), ("chunk_types_pruned", pa.string())]
_MAPS = [("chunk_previews", pa.string()), ("chunk_token_counts", pa.int32()), ("chunk_scores", pa.float64())]
_TRACE = pa.struct([*[(n, pa.list_(t)) for n, t in _LISTS], *[(n, pa.map_(pa.string(), t)) for n, t in _MAPS]])
_TYPE = pa.struct([("ok", pa.bool_()), ("made", pa.string()), ("made_tokens", pa.int64()), ("parts", pa.int32()), ("total", pa.int32()), ("signal", pa.string()), ("trace", _TRACE)])

#: A trace describes single chunks (the first PREVIEW characters, tokens, score) of calls with PREVIEWED chunks at most.
PREVIEW, PREVIEWED, MIN_SAVINGS = 300, 500, 0.3
CSV_WINDOW, CSV_SAMPLE, CSV_VALUES = 50, 100, (2, 20)
SECTION_SMALL, SECTION_LARGE = 20, 400
MOST_CHUNKS, LEAST_WINDOW = 2000, 200

_HEADING, _FENCE = re.compile(r"#{1,6} \S"), re.compile(r"\s*(?:```|~~~)")
_SPACED = re.compile(SPACED)
_WORD = re.compile(WORD.replace(r"\p{Nd}", r"\d"))


def csv_pieces(text: str) -> list[Piece]:
    """Rows by the first column with 2 to 20 values among the first hundred rows, in order of the value, else windows of fifty; each under the header. Rows too short for the column are dropped."""
    lines = [x for x in text.strip().split("\n") if x.strip()]
    if len(lines) < 2:
        return [(text, "rows", 0, None, [])] if lines else []
    head, mark = lines[0], "," if "," in lines[0] else "\t"
    rows = [next(csv.reader([x], delimiter=mark), []) for x in lines[1:]]
    for col in range(len(next(csv.reader([head], delimiter=mark), []))):
        if CSV_VALUES[0] <= len({r[col].strip() for r in rows[:CSV_SAMPLE] if len(r) > col}) <= CSV_VALUES[1]:
            groups: dict[str, list[str]] = {}
            for line, r in zip(lines[1:], rows, strict=True):
                if len(r) > col:
                    groups.setdefault(r[col].strip(), []).append(line)
            parts = [g for _, g in sorted(groups.items())]
            break
    else:
        parts = [lines[i : i + CSV_WINDOW] for i in range(1, len(lines), CSV_WINDOW)]
    return [("\n".join([head, *p]), "rows", i, None, []) for i, p in enumerate(parts)]


def markdown_pieces(text: str) -> list[Piece]:
    """Sections by headings outside fences, what stands before the first included; a section joins the one before while that is small, and large ones are cut between paragraphs."""
    sections: list[list] = []
    at, fenced = 0, False
    for line in text.split("\n"):
        if not fenced and _HEADING.match(line) or not sections:
            sections.append([at, []])
        fenced ^= bool(_FENCE.match(line))
        sections[-1][1].append(line)
        at += len(line) + 1
    merged: list[list] = []
    for start, lines in sections:
        if merged and count("\n".join(merged[-1][1])) < SECTION_SMALL:
            merged[-1][1] += lines
        else:
            merged.append([start, lines])
    out: list[Piece] = []
    for start, lines in merged:
        part = "\n".join(lines)
        packs: list[list[str]] = []
        size = 0
        for p in re.split(r"\n{2,}", part) if count(part) > SECTION_LARGE else [part]:
            n = count(p)
            if packs and size + n <= SECTION_LARGE:
                packs[-1].append(p)
                size += n
            else:
                packs.append([p])
                size = n
        out += [("\n\n".join(p), "section", start + i, None, []) for i, p in enumerate(packs)]
    return out


def pieces_of(text: str, fmt: str, language: str = "python") -> list[Piece]:
    """Chunks of a text by its format. Text that the format's parser refuses raises ValueError."""
    if fmt == "code":
        return code_chunks(text, language)
    cut = {"json": json_chunks, "html": html_chunks, "log": log_chunks, "csv": csv_pieces, "shell": shell_pieces, "markdown": markdown_pieces}.get(fmt, mixed_chunks)
    try:
        return cut(text)
    except csv.Error as e:
        raise ValueError(str(e)) from e


def closure(direct: list[list[int]]) -> list[list[int]]:
    """For each place itself and all places reachable, sorted; cycles are legal."""
    out = []
    for i in range(len(direct)):
        if not direct[i]:
            out.append([i])
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in direct[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append(sorted(seen))
    return out


def bounded(pieces: list[Piece], budget: int) -> tuple[list[tuple[str, str, int]], list[list[int]]]:
    """(content, chunk_type, start) of chunks and what each depends on directly.

    Of equal chunks the first stays; more than MOST_CHUNKS are put together with their neighbours, without their
    dependencies; one over the budget becomes windows of max(budget // 2, 200) tokens, on which nothing depends.
    """
    first: dict[str, Piece] = {}
    for p in pieces:
        if p[0].strip():
            first.setdefault(p[0], p)
    own = list(first.values())
    if len(own) > MOST_CHUNKS:
        own.sort(key=lambda p: p[2])
        g = -(-len(own) // MOST_CHUNKS)
        own = [("\n".join(p[0] for p in own[i : i + g]), own[i][1], own[i][2], None, []) for i in range(0, len(own), g)]
    direct = dependencies(own)
    out: list[tuple[str, str, int]] = []
    place: dict[int, int] = {}
    needs: list[list[int]] = []
    for i, (content, kind, start, _, _) in enumerate(own):
        toks = _SPACED.findall(content) if count(content) > budget else []
        if not toks:
            place[i] = len(out)
            out.append((content, kind, start))
            needs.append(direct[i])
            continue
        w = max(budget // 2, LEAST_WINDOW)
        for k in range(0, len(toks), w):
            out.append(("".join(toks[k : k + w]), kind, start + k // w))
            needs.append(direct[i])
    return out, [sorted({place[j] for j in d if j in place} - {n}) for n, d in enumerate(needs)]


@lru_cache(1 << 16)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def lexical(task: str, contents: list[str]) -> list[float]:
    """Cosine of hashed word counts (crc32 into BUCKETS) of the task and of each text's first HEAD characters: the scores of score.lexical_scores()."""

    def bag(text: str) -> Counter:
        return Counter(map(_bucket, _WORD.findall(text.lower())))

    asked = bag(task)
    norm = sum(n * n for n in asked.values()) ** 0.5
    out = []
    for c in contents:
        own = bag(c[:HEAD])
        hits = sum([own[b] * asked[b] for b in own.keys() & asked.keys()])
        out.append(round(hits / (sum([n * n for n in own.values()]) ** 0.5 * norm), 9) if hits else 0.0)
    return out


def _whole(content: str, fmt: str) -> bool:
    """Whether a chunk can be put together with others: JSON that a split has broken can't."""
    if fmt != "json":
        return True
    try:
        json.loads(content)
    except (ValueError, RecursionError):
        return False
    return True


def signal_of(scores: list[float]) -> str | None:
    """detect.signal_quality() of a call's scores, null without any."""
    if len(scores) < 4:
        return "ok" if scores else None
    if min(scores) == max(scores):
        return "none"
    mean = sum(scores) / len(scores)
    return "low" if (sum([(s - mean) * (s - mean) for s in scores]) / len(scores)) ** 0.5 < 0.05 else "ok"


def greedy(order: list[int], near: list[list[int]], tokens: list[int], budget: int) -> set[int]:
    """The chunks that select.greedy() takes in this order with what they depend on."""
    left, chosen, slack = budget, set(), math.floor(budget * SLACK)
    for i in order:
        if i in chosen:
            continue
        need = [j for j in near[i] if j not in chosen] if len(near[i]) > 1 else near[i]
        cost = sum([tokens[j] for j in need])
        if cost <= left + (slack if len(need) > 1 else 0):
            left -= cost
            chosen.update(need)
    return chosen


def decide(text: str, fmt: str, language: str, budget: int, task: str, original: int, multipliers: dict[str, float], score: Callable[[str, list[str]], list[float]] = lexical) -> dict:
    """What is delivered of a call and its trace, as DECIDED says: chunks by adjusted score, score and order with what they depend on while they fit; kept ones in the order of the text."""
    try:
        chunks, direct = bounded(pieces_of(text, fmt, language), budget)
    except (ValueError, RecursionError):
        chunks, direct = [], []
    n = len(chunks)
    scores = [float(s) for s in score(task, [c for c, _, _ in chunks])]
    near = closure(direct)
    tokens = [count(c) for c, _, _ in chunks]
    adjusted = [s * multipliers.get(c[1], 1.0) for s, c in zip(scores, chunks, strict=True)] if multipliers else scores
    chosen = greedy(sorted(range(n), key=lambda i: (-adjusted[i], -scores[i], i)), near, tokens, budget)
    parts = [chunks[i][0] for i in sorted(chosen, key=lambda i: (chunks[i][2], i)) if _whole(chunks[i][0], fmt)]
    signal = signal_of(scores)
    made = made_tokens = None
    if parts and signal != "none":
        made = merge_json(parts) if fmt == "json" else "\n".join(parts)
        made_tokens = count(made)
    ok = made is not None and original > 0 and made_tokens / original <= 1 - MIN_SAVINGS
    if not n:
        return {"ok": False, "total": 0}
    ids = [hashlib.sha256(c.encode()).hexdigest()[:16] for c, _, _ in chunks]
    taken = [i for i in range(n) if i in chosen] if ok else range(n)
    left = [i for i in range(n) if i not in chosen] if ok else []
    # of equal chunks the first
    first = {ids[i]: i for i in range(n - 1, -1, -1)} if n <= PREVIEWED else {}
    each = sorted(first.items(), key=lambda x: x[1])
    trace = {
        "chunk_ids_selected": [ids[i] for i in taken], "chunk_ids_pruned": [ids[i] for i in left], "chunk_types_selected": [chunks[i][1] for i in taken], "chunk_types_pruned": [chunks[i][1] for i in left],
        "chunk_previews": [(k, chunks[i][0][:PREVIEW]) for k, i in each], "chunk_token_counts": [(k, tokens[i]) for k, i in each], "chunk_scores": [(k, scores[i]) for k, i in each],
    }
    return {"ok": ok, "made": made if ok else None, "made_tokens": made_tokens, "parts": len(parts), "total": n, "signal": signal, "trace": trace}


def _nested(kind: pa.DataType, traces: list[dict | None], name: str) -> pa.Array:
    rows = [t[name] if t else () for t in traces]
    at = pa.array(list(accumulate(map(len, rows), initial=0)), pa.int32())
    if name.startswith("chunk_ids") or name.startswith("chunk_types"):
        return pa.ListArray.from_arrays(at, pa.array(list(chain.from_iterable(rows)), kind))
    pairs = list(chain.from_iterable(rows))
    return pa.MapArray.from_arrays(at, pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], kind))


def _column(rows: list[dict | None]) -> pa.Array:
    """Rows of decide() as an Arrow column, built by columns."""
    traces = [r.get("trace") if r else None for r in rows]
    parts = [_nested(t, traces, n) for n, t in [*_LISTS, *_MAPS]]
    trace = pa.StructArray.from_arrays(parts, fields=list(_TRACE), mask=pa.array([t is None for t in traces], pa.bool_()))
    plain = [pa.array([r.get(f.name) if r else None for r in rows], f.type) for f in list(_TYPE)[:-1]]
    return pa.StructArray.from_arrays([*plain, trace], fields=list(_TYPE), mask=pa.array([r is None for r in rows], pa.bool_()))


def decided(text: Column, fmt: Column, language: Column, budget: Column, task: Column, original: Column, multipliers: Column, score: Callable[[str, list[str]], list[float]] = lexical) -> Column:
    """decide() for each text as a DECIDED column, null for a null text; ``multipliers`` is a map of chunk types.

    ``score`` takes a task and the contents of a call's chunks. Calls are worked on one at a time in Arrow batches;
    chunks never leave them, other columns of the row stay in the JVM.
    """

    @F.arrow_udf(DECIDED)
    def run(texts: pa.Array, fmts: pa.Array, languages: pa.Array, budgets: pa.Array, tasks: pa.Array, originals: pa.Array, weights: pa.Array) -> pa.Array:
        rest = zip(fmts.to_pylist(), languages.to_pylist(), budgets.to_pylist(), tasks.to_pylist(), originals.to_pylist(), weights.to_pylist(), strict=True)
        return _column([decide(t.as_py(), f, lang, most, task or "", n, {k: v for k, v in by or () if v is not None}, score) if t.is_valid else None for t, (f, lang, most, task, n, by) in zip(texts, rest, strict=True)])

    return run(text, fmt, language, budget, task, original, multipliers)
