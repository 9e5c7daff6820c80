"""Benchmark decontamination: pigeonhole pieces found exactly, windows verified by Myers' bit-parallel edit distance."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, save, table

#: Edits allowed in a passage, as a share of the test item's length.
ERROR_RATE = 0.06
#: Characters of test items in one automaton, some 60 bytes each in every Python worker (about 120 MB); longer benchmarks take a pass over the texts for each slice.
SLICE_CHARS = 2 << 20


def normalise(text: str) -> str:
    """Lower case, with each run of white space as one blank and none at the ends."""
    return re.sub(r"\s+", " ", text).strip().lower()


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate)


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of the whole pattern to any part of the text, by Myers' bit vectors; the first such end; None if it takes more than ``most`` edits."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, end = ones, 0, m, m, 0
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph <<= 1
        mh <<= 1
        pv = mh & ones | ~(xv | ph) & ones
        mv = ph & xv & ones
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else None


class Matcher:
    """All pieces of a slice of the benchmark in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(i, t, budget(t, rate)) for i, t in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            cuts = [len(t) * p // (k + 1) for p in range(k + 2)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                at.setdefault(t[x:y], []).append((n, x))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in at.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if at:
            self.automaton.make_automaton()
        self.any = bool(at)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normalised text) for each item of which some passage lies within its budget.

        With k edits at most, one of k + 1 pieces is whole, at a place no more than k from where it belongs: hits of
        an item on neighbouring diagonals share a window, and each window is verified in full.
        """
        if not self.any:
            return []
        starts: dict[int, list[int]] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for n, offset in owners:
                starts.setdefault(n, []).append(end + 1 - size - offset)
        out = []
        for n, places in starts.items():
            item, pattern, k = self.items[n]
            exact = text.find(pattern)
            if exact >= 0:
                out.append((item, 0, exact + len(pattern)))
                continue
            places.sort()
            best: tuple[int, int] | None = None
            i = 0
            while i < len(places):
                j = i
                while j + 1 < len(places) and places[j + 1] - places[j] <= 2 * k + 1:
                    j += 1
                lo, hi = max(0, places[i] - k), places[j] + len(pattern) + k
                got = myers(pattern, text[lo:hi], k)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], lo + got[1])
                i = j + 1
            if best:
                out.append((item, *best))
        return sorted(out)


_matchers: dict[str, Matcher] = {}


def _slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items with their normalised texts, SLICE_CHARS at a time."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null").distinct().orderBy("id", "text")
    part: list[tuple[int, str]] = []
    size = 0
    for r in rows.toLocalIterator():
        text = normalise(r["text"])
        if text:
            part.append((r["id"], text))
            size += len(text)
            if size >= SLICE_CHARS:
                yield part
                part, size = [], 0
    if part:
        yield part


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, end): one row for each row of ``docs`` and test item that a passage of it matches.

    Texts are lower-cased and white space is folded. A passage matches an item if their edit distance is at most
    ``rate`` times the item's length; distance is the least over all passages of the document, end where the first
    such one ends in the folded text. The whole benchmark is held against whole texts, SLICE_CHARS of it at a time
    (one pass for each slice), so that what is broadcast stays bounded. Null and empty texts and items match nothing;
    items repeated under one id count once. Repeated documents give repeated rows; further columns are ignored;
    a null doc_id stays null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    schema = f"`{id_col}` long, item_id long, distance long, end long"
    own = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("__text")).where("__text is not null")
    out: DataFrame | None = None
    for part in _slices(benchmark, item_id, item_text):
        items, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], items=items, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _matchers:
                _matchers.clear()
                _matchers[name] = Matcher(items.value, rate)
            find = _matchers[name].find
            for batch in batches:
                rows = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in find(normalise(t.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], [id_col, "item_id", "distance", "end"])
            give_back()

        found = save(own.mapInArrow(run, schema), "leaks")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no passage of ``benchmark``.

    A row goes if any row of its id is contaminated (rows that repeat an id, or have none, go together).
    """
    leaks = find_contamination(docs, benchmark, rate, id_col).select(F.col(id_col).alias("__leak")).distinct()
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["__leak"]), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
