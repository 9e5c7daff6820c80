"""Near-duplicate embeddings by a robust-pruned flat graph, built on overlapping cluster shards and searched by range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_saved, save, table
from .components import connected_components

#: Centroids: fitted on so many vectors at most, one for so many rows, at most so many; each vector goes to its OVERLAP nearest.
SAMPLE_ROWS, ROWS_A_CENTROID, MOST_CENTROIDS, OVERLAP = 20_000, 2_500, 4096, 4
#: Shards of more members are dealt into blocks, and each pair of blocks is a shard of its own.
BLOCK = 1_024
#: Graph: candidates and neighbours of a vertex, slack of the pruning rule, beam of the search, similarity below the threshold down to which the range search spreads.
CANDIDATES, DEGREE, ALPHA, BEAM, SPREAD = 48, 24, 1.2, 16, 0.03
#: Queries of a shard that are audited against brute force, and the recall below which the beam is doubled and the search repeated.
AUDITED, RECALL = 48, 0.99


def robust_prune(sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbour lists (-1 where none) of all vertices of a shard from its similarities.

    Candidates are a vertex's most similar ones; going outwards, one is kept unless a kept one is alpha times nearer
    to it than the vertex is.
    """
    n = len(sims)
    c = min(CANDIDATES, n - 1)
    own = sims.copy()
    np.fill_diagonal(own, -np.inf)
    near = np.argpartition(-own, c - 1, axis=1)[:, :c] if c else np.empty((n, 0), np.int64)
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(own, near, 1), axis=1, kind="stable"), 1)
    out = np.full((n, degree), -1, dtype=np.int64)
    size = np.zeros(n, dtype=np.int64)
    rows = np.arange(n)
    for r in range(c):
        cand = near[:, r]
        far = np.sqrt(np.maximum(2 - 2 * sims[rows, cand], 0))
        between = np.sqrt(np.maximum(2 - 2 * sims[np.maximum(out, 0), cand[:, None]], 0))
        covered = ((alpha * between <= far[:, None]) & (out >= 0)).any(1)
        add = np.flatnonzero(~covered & (size < degree))
        out[add, size[add]] = cand[add]
        size[add] += 1
    return out


def range_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, floor: float, beam: int) -> np.ndarray:
    """Boolean (queries, vertices): what a greedy search with a beam, then an expansion of all vertices at least ``floor`` similar, meets in that range.

    ``queries`` are vertices themselves: each enters at the medoids in ``starts`` and at its own place.
    """
    n, q = len(x), len(queries)
    beam = min(max(beam, len(starts) + 1), n)
    seen = np.zeros((q, n), dtype=bool)
    seen[:, starts] = True
    ids = np.full((q, beam), -1, dtype=np.int64)
    sim = np.full((q, beam), -np.inf)
    done = np.ones((q, beam), dtype=bool)
    first = starts[:beam]
    ids[:, : len(first)], sim[:, : len(first)], done[:, : len(first)] = first, x[queries] @ x[first].T, False
    every = np.arange(q)
    inside = [(np.repeat(every, len(starts)), np.tile(starts, q), (x[queries] @ x[starts].T).ravel())]
    apart = np.flatnonzero(~seen[every, queries])
    if len(apart) and len(first) < beam:
        ids[apart, len(first)], sim[apart, len(first)], done[apart, len(first)] = queries[apart], 1.0, False
        seen[apart, queries[apart]] = True
        inside.append((apart, queries[apart], np.ones(len(apart))))
    while True:
        pick = np.argmax(np.where(done, -np.inf, sim), axis=1)
        act = np.flatnonzero(~done[every, pick])
        if not len(act):
            break
        done[act, pick[act]] = True
        new = graph[ids[act, pick[act]]]
        good = (new >= 0) & ~seen[act[:, None], np.maximum(new, 0)]
        r, c = np.nonzero(good)
        rows, verts = act[r], new[r, c]
        seen[rows, verts] = True
        s = np.einsum("ij,ij->i", x[queries[rows]], x[verts])
        inside.append((rows, verts, s))
        wide_s = np.full(new.shape, -np.inf)
        wide_s[r, c] = s
        all_s, all_i = np.concatenate([sim[act], wide_s], 1), np.concatenate([ids[act], new], 1)
        all_d = np.concatenate([done[act], ~good], 1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        ids[act], sim[act], done[act] = (np.take_along_axis(a, top, 1) for a in (all_i, all_s, all_d))
    found = np.zeros((q, n), dtype=bool)
    rows, verts = (np.concatenate([p[i][p[2] >= floor] for p in inside]) for i in (0, 1))
    while len(rows):
        found[rows, verts] = True
        next_rows, next_verts = [], []
        for i in range(0, len(rows), 1 << 16):
            new = graph[verts[i : i + (1 << 16)]]
            who = np.repeat(rows[i : i + (1 << 16)], new.shape[1])
            new = new.ravel()
            fresh = new >= 0
            fresh[fresh] = ~seen[who[fresh], new[fresh]]
            flat = np.unique(who[fresh] * n + new[fresh])
            who, new = flat // n, flat % n
            seen[who, new] = True
            near = np.einsum("ij,ij->i", x[queries[who]], x[new]) >= floor
            next_rows.append(who[near])
            next_verts.append(new[near])
        rows, verts = np.concatenate(next_rows), np.concatenate(next_verts)
    return found


def _unit(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(rows: pd.DataFrame) -> np.ndarray:
    return _unit(np.stack(rows.embedding.to_numpy()).astype(np.float64))


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Pruned neighbour lists of one shard."""
    rows = rows.sort_values("rep", ignore_index=True)
    ids = rows.rep.to_numpy()
    if len(ids) < 2:
        return pd.DataFrame({"rep": ids, "near": [[] for _ in ids]})
    x = _vectors(rows).astype(np.float32)
    graph = robust_prune(x @ x.T)
    return pd.DataFrame({"rep": ids, "near": [ids[g[g >= 0]].tolist() for g in graph]})


def _search(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Range search of every member of a shard from the shard's medoid in the united graph; audit; exact check; links that this shard owns, and what connects them."""
        cluster, i, j = key[1], key[2], key[3]
        rows = rows.sort_values("rep", ignore_index=True)
        ids, n = rows.rep.to_numpy(), len(rows)
        x = _vectors(rows)
        place = {v: k for k, v in enumerate(ids.tolist())}
        lists = [[place[v] for v in near if v in place] for near in rows.near]
        graph = np.full((n, max(1, max(map(len, lists)))), -1, dtype=np.int64)
        for k, near in enumerate(lists):
            graph[k, : len(near)] = near
        small = x.astype(np.float32)
        start = np.array([int(np.argmax(small @ small.mean(0)))])
        blk = rows.blk.to_numpy()
        if i != j:  # one more start in the other block
            other = np.flatnonzero(blk != blk[start[0]])
            start = np.append(start, other[np.argmax(small[other] @ small[other].mean(0))]) if len(other) else start
        floor, beam = threshold - SPREAD, BEAM
        audit = np.linspace(0, n - 1, min(n, AUDITED)).astype(np.int64)
        truth = small[audit] @ small.T >= threshold
        truth[np.arange(len(audit)), audit] = False
        while True:
            found = np.zeros((n, n), dtype=bool)
            for a in range(0, n, 512):
                q = np.arange(a, min(n, a + 512))
                found[q] = range_search(small, graph, start, q, floor, beam)
            found |= found.T
            if beam >= n or (found[audit] & truth).sum() >= RECALL * truth.sum():
                break
            beam *= 2
        a, b = np.nonzero(np.triu(found, 1))
        exact = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        a, b = a[exact], b[exact]
        root = np.arange(n)
        while True:  # smallest member that links reach within the shard
            was = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
            root = np.minimum(root, root[root])
            if (root == was).all():
                break
        mine = np.stack(rows.clusters.to_numpy())
        common = (mine[a][:, :, None] == mine[b][:, None, :]).any(2)
        least = np.where(common, mine[a], np.iinfo(np.int64).max).min(axis=1) if len(a) else np.empty(0, np.int64)
        owned = (least == cluster) & ((blk[a] == blk[b]) if i == j else (blk[a] != blk[b]))
        weight = rows.copies.to_numpy()
        links = np.bincount(a[owned], weights=weight[b[owned]], minlength=n) + np.bincount(b[owned], weights=weight[a[owned]], minlength=n)
        return pd.DataFrame({"rep": ids, "links": links.astype(np.int64), "root": ids[root]})

    return run


def fit_centroids(points: DataFrame, dim: int, rows: int) -> np.ndarray:
    """Unit centroids from at most SAMPLE_ROWS vectors (those with the smallest hash of their id), by a few rounds of spherical k-means."""
    k = int(np.clip(-(-rows // ROWS_A_CENTROID), 1, MOST_CENTROIDS))
    got = points.where(F.size("embedding") == dim).select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).collect()
    x = _unit(np.array([r["embedding"] for r in got])).astype(np.float32)
    k = min(k, len(x))
    centres = x[np.random.default_rng(3).permutation(len(x))[:k]]
    for _ in range(6):
        at = np.concatenate([np.argmax(x[i : i + 1024] @ centres.T, axis=1) for i in range(0, len(x), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), centres)
    return centres


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each row of ``vectors``: ``id_col``, n_links, component_id, kept.

    Vectors with equal labels (not null) and sizes are linked if their cosine in double precision is at least
    ``threshold``; n_links counts the other vectors linked directly, component_id is the smallest id reachable.

    1. Equal vectors under a label are one class (aggregate, combined map-side); copies are links by definition.
    2. Centroids from a bounded sample; each class goes to the shards of its OVERLAP nearest centroids. Shards of
       more than BLOCK members are dealt into blocks, and pairs of blocks are shards.
    3. Each shard yields robust-pruned neighbour lists; a class's lists are united.
    4. In each shard every member searches the united graph from the medoid and its own place, then expands over all in
       range. Recall is audited against brute force; below RECALL the beam grows, at last to the whole shard.
    5. What was found is checked in double precision. A link is counted by the first cluster that both ends share;
       a shard passes on one root for each member, never pairs; components join the roots.

    Vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with nothing
    (n_links 0, own component). A null id keeps its row: no links, component_id null, kept true. Rows that repeat an
    id count as vectors of their own in n_links. Further columns are ignored. No rows give no rows.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fine = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    own = own.withColumn("usable", F.col("id").isNotNull() & F.col("label").isNotNull() & fine & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False)))
    classes = save(own.where("usable").groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vec-classes")
    dims = [r["d"] for r in classes.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()]
    parts = [_linked(classes.where(F.size("embedding") == d), d, threshold) for d in dims]
    links = edges = None
    for part in parts:
        summed = part.groupBy("rep").agg(F.sum("links").alias("links"))
        ends = part.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
        links, edges = (summed, ends) if links is None else (links.union(summed), edges.union(ends))
    if links is None:
        of_class = classes.select("label", "embedding", "rep", F.lit(0).cast("long").alias("links"), F.col("rep").alias("comp"))
    else:
        comps = connected_components(edges)
        l2, c2 = links.withColumnRenamed("rep", "l_rep"), comps.select(F.col("id").alias("c_rep"), F.col("component"))
        of_class = save(classes.join(l2, F.col("rep") == F.col("l_rep"), "left").join(c2, F.col("rep") == F.col("c_rep"), "left").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("comp")), "vec-of-class")
    right = of_class.select(F.col("label").alias("r_label"), F.col("embedding").alias("r_embedding"), "links", "comp")
    out = own.join(right, F.col("usable") & (F.col("label") == F.col("r_label")) & (F.col("embedding") == F.col("r_embedding")), "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _linked(classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(rep, links, root) of each class in each of its shards."""
    spark = classes.sparkSession
    centres = spark.sparkContext.broadcast(fit_centroids(classes, dim, classes.count()))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)).astype(np.float32)
            k = min(OVERLAP, len(c))
            near = np.argpartition(-(x @ c.T), k - 1, axis=1)[:, :k].astype(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, k, dtype=np.int32)), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "clusters"])

    label = classes.schema["label"].dataType.simpleString()
    placed = classes.mapInArrow(assign, f"label {label}, embedding array<double>, rep long, copies long, clusters array<long>")
    members = save(placed.select("label", "rep", "copies", "embedding", "clusters", F.explode("clusters").alias("cluster")), "vec-members")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    sizes = members.groupBy("label", "cluster").agg(F.count("*").alias("size")).select(F.col("label").alias("s_label"), F.col("cluster").alias("s_cluster"), "size")
    sized = members.join(sizes, (F.col("label") == F.col("s_label")) & (F.col("cluster") == F.col("s_cluster"))).withColumn("blk", F.pmod(F.xxhash64("rep"), blocks).cast("long"))
    dealt = sized.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1))).select("label", "cluster", F.least("blk", "with").alias("i"), F.greatest("blk", "with").alias("j"), "rep", "copies", "embedding", "clusters", "blk")
    key = ["label", "cluster", "i", "j"]
    lists = dealt.select(*key, "rep", "embedding").groupBy(*key).applyInPandas(_build, "rep long, near array<long>")
    graph = save(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")).select(F.col("rep").alias("g_rep"), "near"), "vec-graph")
    ready = dealt.join(graph, F.col("rep") == F.col("g_rep"))
    found = save(ready.groupBy(*key).applyInPandas(_search(threshold), "rep long, links long, root long"), "vec-found")
    drop_saved(members, graph)
    return found


def audit_recall(vectors: DataFrame, threshold: float = 0.98, every: int = 100) -> float:
    """Share of the links of every ``every``-th vector (by id), found by brute force in blocks against all rows, that near_duplicate_vectors() counts. For tests and operation, not on the main path."""
    got = near_duplicate_vectors(vectors, threshold)
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("q"), F.col("label").alias("q_label"), F.col("embedding").alias("q_embedding"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cos = dot("embedding", "q_embedding") / F.sqrt(dot("embedding", "embedding") * dot("q_embedding", "q_embedding"))
    truth = vectors.join(asked, F.col("label") == F.col("q_label")).where(F.col("vec_id") != F.col("q")).where(cos >= threshold).groupBy("q").count()
    both = truth.join(got, F.col("q") == F.col("vec_id")).agg(F.sum(F.least("count", "n_links")).alias("found"), F.sum("count").alias("all")).first()
    return 1.0 if not both["all"] else both["found"] / both["all"]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
