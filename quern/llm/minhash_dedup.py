"""Near-duplicate documents by SetSketch registers, banded, estimated by likelihood and confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_saved, give_back, join_hot, probably_in, save, save_counted, table
from .components import connected_components
from .textscan import shingle_sets

#: SetSketch: base of the register scale, rate of the exponential variates, and the largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65535
BANDS, ROWS = 25, 5
#: Candidates whose estimated similarity lies further below the threshold than so many standard errors are not read again.
SIGMAS = 5.0
#: Buckets and families of more members are dealt into blocks, which are compared in pairs.
BLOCK = 256
#: Sets of so few shingles, in which one collision of hashes could make a link, are known by two independent hashes.
FEW = 64

_rng = np.random.Generator(np.random.PCG64(20240229))
_XOR = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def registers(elements: np.ndarray) -> np.ndarray:
    """SetSketch of a set of 64-bit hashes: for each register the smallest exponential variate of an element, on a scale of powers of BASE, truncated to 16 bits. The element-wise maximum of two sketches is the sketch of the union."""
    least = np.full(len(_XOR), np.iinfo(np.uint64).max)
    for i in range(0, len(elements), 4096):
        part = (elements[None, i : i + 4096] ^ _XOR[:, None]) * _ODD[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def joint_estimate(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely similarity of each pair of sketches (rows), given the true set sizes, from the counts of larger, smaller and equal registers."""
    more, less = (ka > kb).sum(1), (ka < kb).sum(1)
    same = ka.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def loss(j: np.ndarray) -> np.ndarray:
        a, b = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return -(more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12)))

    lo, hi = np.zeros(len(na)), np.minimum(u / v, v / u)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = loss(c) < loss(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2


def _floor(num: int, den: int) -> float:
    s = num / den
    return s - SIGMAS * (s * (1 - s) / (BANDS * ROWS)) ** 0.5


def _plausible(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    fits = den * np.minimum(na, nb) >= num * np.maximum(na, nb)
    return fits & (joint_estimate(ka, kb, na.astype(float), nb.astype(float)) >= _floor(num, den))


def _sketch_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, regs = [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            few = [i for i, size in enumerate(n) if 0 < size <= FEW]
            for i, s in zip(few, shingle_sets(batch.column(1).take(pa.array(few, pa.int64())), k, seed=1), strict=True):
                digests[i].update(s.tobytes())
            digests = [d and d.digest() for d in digests]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], ["id", "text_hash", "n", "digest", "regs"])
        give_back()

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def _estimated(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = _plausible(_matrix(batch.column(2)), _matrix(batch.column(3)), batch.column(4).to_numpy(), batch.column(5).to_numpy(), num, den)
                batch = batch.filter(pa.array(ok))
            yield batch.select([0, 1])

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest one that the pairs (a, b) connect it with."""
    root = np.arange(n)
    while len(a):
        was = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = np.minimum(root, root[root])
        if (root == was).all():
            break
    return root


def _by_group(batches: Iterator[pa.RecordBatch], keys: int, make) -> Iterator[tuple[tuple, list]]:
    """Groups of rows that are equal in their first ``keys`` columns and stand together; ``make`` turns a batch into a list of rows' values."""
    last, held = None, []
    for batch in batches:
        names = list(zip(*[batch.column(c).to_pylist() for c in range(keys)], strict=True))
        for name, row in zip(names, make(batch), strict=True):
            if name != last and held:
                yield last, held
                held = []
            last = name
            held.append(row)
    if held:
        yield last, held


def _edges(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches of edges from each group's (ids, roots)."""
    a: list[int] = []
    b: list[int] = []
    for ids, root in found:
        off = np.flatnonzero(root != np.arange(len(root)))
        a += ids[off].tolist()
        b += ids[root[off]].tolist()
        if len(a) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _plausible_blocks(num: int, den: int):
    """Rows key, i, j, rep, family, n, blk, regs: compares the members of a bucket's two blocks across families by their sketches."""

    #: So few equal registers are out of reach of the floor whatever the others say; it saves most estimates.
    few = (_floor(num, den) - 0.15) * BANDS * ROWS

    def make(batch: pa.RecordBatch) -> list:
        return list(zip(*[batch.column(c).to_pylist() for c in range(3, 8)], strict=True))

    def compare(name: tuple, rows: list) -> tuple[np.ndarray, np.ndarray]:
        ids, family, n, blk = (np.array([r[c] for r in rows]) for c in range(4))
        regs = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint16).reshape(len(rows), -1)
        out_a, out_b = [], []
        for r in range(len(rows)):
            w = r + 1 + np.flatnonzero((family[r + 1 :] != family[r]) & ((blk[r + 1 :] == blk[r]) == (name[1] == name[2])))
            if len(w):
                w = w[(regs[w] == regs[r]).sum(1) >= few]
            if len(w):
                w = w[_plausible(np.broadcast_to(regs[r], (len(w), regs.shape[1])), regs[w], np.full(len(w), n[r]), n[w], num, den)]
                out_a.append(np.full(len(w), r))
                out_b.append(w)
        empty = [np.empty(0, np.int64)]
        return ids, _roots(len(rows), np.concatenate(out_a or empty), np.concatenate(out_b or empty))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _edges(compare(name, rows) for name, rows in _by_group(batches, 3, make) if len(rows) > 1)

    return run


def _exact_blocks(k: int, num: int, den: int):
    """Rows family, i, j, rep, blk, text: links the members of a family's two blocks by their full sets."""

    def make(batch: pa.RecordBatch) -> list:
        # hashes of their own: a collision that made the candidates doesn't make the link
        return list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), shingle_sets(batch.column(5), k, seed=1), strict=True))

    def compare(name: tuple, rows: list) -> tuple[np.ndarray, np.ndarray]:
        ids, blk = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        sizes, n = np.array([len(r[2]) for r in rows]), len(rows)
        known = np.unique(np.concatenate([np.unique(np.concatenate([r[2] for r in rows[i : i + 32]])) for i in range(0, n, 32)]))
        place = np.concatenate([np.searchsorted(known, r[2]).astype(np.int32) for r in rows])
        rows.clear()  # the sets are needed no more, and the next group is read while this list is still held
        at = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(len(known), dtype=np.uint8)
        out_a, out_b = [], []
        for r in range(n - 1):
            own = place[at[r] : at[r + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[place[at[r + 1] :]], at[r + 1 : -1] - at[r + 1], dtype=np.int64)
            mark[own] = 0
            w = np.flatnonzero((den * both >= num * (sizes[r] + sizes[r + 1 :] - both)) & ((blk[r + 1 :] == blk[r]) == (name[1] == name[2])))
            out_a.append(np.full(len(w), r))
            out_b.append(r + 1 + w)
        return ids, _roots(n, np.concatenate(out_a), np.concatenate(out_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _edges(compare(name, rows) for name, rows in _by_group(batches, 3, make) if len(rows) > 1)

    return run


def _in_blocks(rows: DataFrame, group: str, id_col: str) -> DataFrame:
    """Each row (with ``size``, of its group) once for each pair of blocks (i, j) that its block is in, the rows of a pair standing together. Groups up to BLOCK rows are one pair; no pair has more than about 2 * BLOCK rows. Work goes with the pairs, not with the bytes, so the number of tasks is stated and small ones aren't put together."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.withColumn("blk", F.pmod(F.xxhash64(id_col), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("i", F.least("blk", "with")).withColumn("j", F.greatest("blk", "with"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, group, "i", "j").sortWithinPartitions(group, "i", "j", id_col)


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_shingles, component_id, kept.

    A document's set holds its distinct ``k``-word shingles (words are runs of other than ASCII white space, A-Z
    lower-cased); with fewer words the whole sequence is the one shingle. Documents with
    den * |A and B| >= num * |A or B| are linked, component_id is the smallest id reachable by links.

    1. One pass over the texts makes each document's set digest and SetSketch registers.
    2. Documents with equal sets are one class, with a number (aggregate, combined map-side).
    3. Bands of register values key the classes. In each bucket all members are paired with one hub, the member
       that shares buckets with most others; pairs whose joint likelihood estimate is not far below the threshold
       are plausible, and components over these are families.
    4. Buckets with members of several families are compared throughout, by sketches, across families only; each
       block passes on what connects its members, never pairs. This completes the families.
    5. Each family's members are compared on their full sets, in blocks, so that a text moves once for each pair of
       blocks that it is in (once in all, for families up to BLOCK members). What these links connect is the result.

    Joins on keys that many rows may share (bands, hubs, families, copies) go through join_hot(). Sets are compared on
    64-bit hashes: candidates on one, links on another one that is independent of it.

    Two more columns tell rows with one id apart: text_hash (xxhash64 of the text) and group_id (equal for linked
    rows, null without shingles). Null or empty texts, and texts without words, have no shingles and link with
    nothing. A null id links with nothing and keeps its row (component_id null, kept true). Repeated rows stay
    repeated; rows that repeat an id with other texts are documents of their own under that id. Other columns are
    ignored. No rows give no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sig = save(own.mapInArrow(_sketch_batches(k), "id long, text_hash long, n long, digest binary, regs binary"), "near-sketches")
    named = sig.where("id is not null and n > 0")
    grouped = named.groupBy("digest").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.min_by("regs", "id").alias("regs"), F.first("n").alias("n"), F.count("*").alias("copies"))
    classes = save(grouped.withColumn("rep", F.monotonically_increasing_id()), "near-classes")
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width)) for i in range(BANDS)])
    bands = classes.select("rep", F.explode(keys).alias("key"))
    shared = save(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "near-keys")
    held = shared.agg(F.sum("size")).first()[0] or 0
    members = save(join_hot(bands, shared, "key", "size", held), "near-members")
    central = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    best = F.max(F.struct("weight", (-F.col("rep")).alias("neg"), "size")).alias("top")
    hubs = save(members.join(central, "rep").groupBy("key").agg(best).select("key", (-F.col("top.neg")).alias("hub"), F.col("top.size").alias("size")), "near-hubs")
    met = join_hot(members.drop("size"), hubs, "key", "size", held).where("rep <> hub")
    pairs, found = save_counted(met.select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "near-pairs")
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n").alias(f"n_{x}"))
    of_hub = pairs.groupBy("b").agg(F.count("*").alias("times")).join(side("b"), "b")
    wide = join_hot(pairs, of_hub, "b", "times", found).join(side("a"), "a").select("a", "b", "regs_a", "regs_b", "n_a", "n_b")
    starred = save(wide.mapInArrow(_estimated(num, den), "a long, b long"), "near-starred")
    drop_saved(hubs, pairs)

    families = connected_components(starred)
    placed = save(members.join(families, F.col("rep") == F.col("id"), "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("family")), "near-placed")
    split = placed.groupBy("key").agg(F.min("family").alias("lo"), F.max("family").alias("hi"), F.count("*").alias("times")).where("lo <> hi").select("key", "times")
    rest = join_hot(placed, split, "key", "times", held).join(classes.select("rep", "regs", "n"), "rep")
    blocks = _in_blocks(rest, "key", "rep").select("key", "i", "j", "rep", "family", "n", "blk", "regs")
    more = save(blocks.mapInArrow(_plausible_blocks(num, den), "a long, b long"), "near-more")
    families = save(connected_components(starred.union(more)).select(F.col("id").alias("rep"), F.col("component").alias("family")), "near-families")
    drop_saved(shared, members, placed, starred, more)

    sizes, members_held = families.groupBy("family").agg(F.count("*").alias("size")), families.count()
    sized = join_hot(families, sizes, "family", "size", members_held)
    wanted = sized.join(classes.select("rep", F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash")), "rep")
    texts = probably_in(own, "id", wanted.select("id")).join(wanted, ["id", "text_hash"]).dropDuplicates(["rep"]).select("rep", "family", "size", "text")
    full = _in_blocks(texts, "family", "rep").select("family", "i", "j", "rep", "blk", "text")
    links = save(full.mapInArrow(_exact_blocks(k, num, den), "a long, b long"), "near-links")
    comps = connected_components(links)
    grouped = save(classes.join(comps, F.col("rep") == F.col("id"), "left").select("digest", "copies", "first.id", F.coalesce("component", "rep").alias("group_id")), "near-groups")
    least = grouped.groupBy("group_id").agg(F.min("id").alias("component_id"), F.count("*").alias("size"))
    by_class = save(join_hot(grouped, least, "group_id", "size", grouped.count()).select("digest", "copies", "group_id", "component_id"), "near-components")
    drop_saved(classes, families, links, grouped)
    mine = sig.select(F.col("id").alias(id_col), "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    total = by_class.agg(F.sum("copies")).first()[0] or 0
    out = join_hot(mine, by_class, "digest", "copies", total, "left").withColumn("component_id", F.coalesce("component_id", F.col(id_col)))
    kept = F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True))
    return out.select(id_col, "n_shingles", "component_id", kept.alias("kept"), "text_hash", "group_id")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100).select("doc_id", "n_shingles", "component_id", "kept")
