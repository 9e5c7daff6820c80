"""Quality classifier: random-indexing word vectors pooled for each document, and a two-layer numpy network with calibrated probabilities."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_saved, give_back, save, table
from .textscan import blocks, span_hashes

#: Word vectors: hashed vocabulary, dimensions, non-zero places of an index vector, neighbours on each side. Their size is WORDS * DIMS * 4 bytes, whatever the corpus.
WORDS, DIMS, PLACES, REACH = 1 << 15, 32, 4, 2
#: Labelled documents that the network is fitted on, at most; those with the smallest hash of their id.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4
THRESHOLD = 0.3
_FEATURES = 3 * DIMS + 4

_rng = np.random.Generator(np.random.PCG64(7))
_AT = np.argsort(_rng.random((WORDS, DIMS)), axis=1)[:, :PLACES].astype(np.int64)
_SIGN = _rng.choice([-1.0, 1.0], (WORDS, PLACES))
INDEX = np.zeros((WORDS, DIMS), dtype=np.float32)
np.put_along_axis(INDEX, _AT, _SIGN.astype(np.float32), axis=1)

#: Kinds of bytes: white space and controls 0, digits 1, letters and all that is not ASCII 2, the rest 3.
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[:33] = 0
_KIND[48:58] = 1
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 2
_DIGIT = np.arange(256, dtype=np.uint8)
_DIGIT[48:58] = 48


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words (runs of letters, of digits by their length, of marks) of a block, and where each row's begin; one entry more at the end."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    kind = _KIND[buf]
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offs] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    h = span_hashes(_DIGIT[buf], starts, ends)
    return (h % np.uint64(WORDS)).astype(np.int64), np.searchsorted(starts, offs).astype(np.int64)


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the neighbours' index vectors for each hashed word of a task's documents, with the word's count last."""
    sums, counts = np.zeros(WORDS * DIMS), np.zeros(WORDS, dtype=np.int64)
    for batch in batches:
        for _, _, buf, offs in blocks(batch.column(0)):
            w, at = tokens(buf, offs)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            counts += np.bincount(w, minlength=WORDS)
            for d in range(1, REACH + 1):
                same = doc[d:] == doc[:-d]
                a, b = w[:-d][same], w[d:][same]
                for x, y in ((a, b), (b, a)):
                    for p in range(PLACES):
                        sums += np.bincount(x * DIMS + _AT[y, p], weights=_SIGN[y, p], minlength=WORDS * DIMS)
    seen = np.flatnonzero(counts)
    rows = np.concatenate([sums.reshape(WORDS, DIMS), counts[:, None]], axis=1)[seen]
    for i in range(0, len(seen), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(seen[i : i + 1000], pa.int64()), pa.array([r.astype(np.float32).tobytes() for r in rows[i : i + 1000]], pa.binary())], ["word", "sums"])
    give_back()


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals for the words of a partition; what it holds grows with the vocabulary only."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for word, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(sums, dtype=np.float32).astype(np.float64)
            totals[word] = totals[word] + x if word in totals else x
    words = sorted(totals)
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array([totals[w].astype(np.float32).tobytes() for w in words], pa.binary())], ["word", "sums"])


@dataclass
class QualityModel:
    vectors: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    temperature: float

    def features(self, texts: pa.Array) -> np.ndarray:
        """One row for each text: weighted means and deviations of its words' vectors, mean of their index vectors, and the length, weight, norm and self-likeness of neighbours."""
        out = np.zeros((len(texts), _FEATURES), dtype=np.float32)
        for i, j, buf, offs in blocks(texts, 1 << 18):
            w, at = tokens(buf, offs)
            n = np.diff(at)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            cut = at[:-1][some]
            k = self.weight[w]
            total = np.add.reduceat(k, cut)
            v = self.vectors[w] * k[:, None]
            mean = np.add.reduceat(v, cut, axis=0) / total[:, None]
            square = np.add.reduceat(v * self.vectors[w], cut, axis=0) / total[:, None]
            index = np.add.reduceat(INDEX[w] * k[:, None], cut, axis=0) / total[:, None]
            again = np.zeros(len(w))
            again[1:] = w[1:] == w[:-1]
            again[cut] = 0
            more = np.stack([np.log1p(n[some]), total / n[some], np.sqrt((index**2).sum(1)), np.add.reduceat(again, cut) / n[some]], axis=1)
            out[i + some] = np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0)), index, more], axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        a, b, c, d = self.layers
        logit = np.maximum(z @ a + b, 0) @ c + d
        return 1 / (1 + np.exp(-np.clip(logit[:, 0] / self.temperature, -30, 30)))


def word_vectors(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and weights of all hashed words, from all of every text; words that never occur have zeros."""
    parts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").mapInArrow(_count_contexts, "word long, sums binary")
    found = save(parts.repartition("word").mapInArrow(_add_up, "word long, sums binary"), "quality-words")
    sums = np.zeros((WORDS, DIMS + 1))
    for r in found.toLocalIterator():
        sums[r["word"]] = np.frombuffer(r["sums"], dtype=np.float32)
    drop_saved(found)
    count = sums[:, -1]
    vectors = sums[:, :-1] / np.maximum(np.linalg.norm(sums[:, :-1], axis=1, keepdims=True), 1e-9)
    share = count / max(count.sum(), 1)
    return vectors.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, tuple, float]:
    """Mean, scale, layers and temperature. Every sixth row is for calibration only. One class or none gives a constant."""
    if len(np.unique(y)) < 2:
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        zero = (np.zeros((_FEATURES, 1)), np.zeros(1), np.zeros((1, 1)), np.array([np.log(p / (1 - p))]))
        return np.zeros(_FEATURES), np.ones(_FEATURES), zero, 1.0
    rng = np.random.default_rng(seed)
    side = np.arange(len(y)) % 6 == 0
    mean, scale = x.mean(0), x.std(0) + 1e-4
    z = (x - mean) / scale
    zt, yt, zc, yc = z[~side], y[~side], z[side], y[side]
    p = [rng.normal(0, (2 / _FEATURES) ** 0.5, (_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(yt))
        for i in range(0, len(order), BATCH):
            b = order[i : i + BATCH]
            h = np.maximum(zt[b] @ p[0] + p[1], 0)
            err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yt[b, None]) / len(b)
            back = (err @ p[2].T) * (h > 0)
            grads = [zt[b].T @ back + DECAY * p[0], back.sum(0), h.T @ err + DECAY * p[2], err.sum(0)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    logit = (np.maximum(zc @ p[0] + p[1], 0) @ p[2] + p[3])[:, 0]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, np.where(yc > 0, -1, 1) * logit / s)) for s in grid]
    return mean, scale, tuple(p), float(grid[int(np.argmin(loss))])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Word vectors from all documents; the network from at most TRAIN_ROWS labelled ones outside the held-out fifth.

    Labels that are null count as absent; a document labelled more than once has the mean, rounded.
    """
    vectors, weight = word_vectors(docs, text_col)
    blank = QualityModel(vectors, weight, np.zeros(_FEATURES), np.ones(_FEATURES), (), 1.0)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("lab_id")).agg(F.round(F.avg("quality")).cast("int").alias("y"))
    few = save(known.orderBy(F.xxhash64("lab_id"), "lab_id").limit(TRAIN_ROWS), "quality-labels")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(few), F.col("id") == F.col("lab_id")).select("id", "y", "text")
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(blank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.features(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    seen = save(rows.mapInArrow(run, "id long, y int, x binary").dropDuplicates(["id", "x"]), f"quality-features-{name}")
    got = sorted((r["id"], r["y"], bytes(r["x"])) for r in seen.orderBy("id").limit(TRAIN_ROWS).toLocalIterator())
    drop_saved(few, seen)
    x = np.array([np.frombuffer(r[2], dtype=np.float32) for r in got], dtype=np.float64).reshape(len(got), _FEATURES)
    return QualityModel(vectors, weight, *fit_network(x, np.array([r[1] for r in got], dtype=np.float64)))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None, score_col: str = "score", write: bool = True) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with ``score_col``: the calibrated probability of good quality, from the text alone.

    Null and empty texts count as texts without words and get the score that the network gives these. Very long texts
    are read whole. Repeated rows and other columns stay (a column of that name is replaced). No rows give no rows.
    The result is a table of its own, unless ``write`` is false: then it is computed by whoever reads it.
    """
    keep = [c for c in keep or docs.columns if c != score_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.score(shared.value.features(batch.column("__text")).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(p, pa.float64())], [*keep, score_col])
        give_back()

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep], f"`{score_col}` double"])
    scored = inner.mapInArrow(run, schema)
    return save(scored, "quality-scores") if write else scored


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
