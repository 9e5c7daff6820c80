import numpy as np
from quern.llm import embedding_dedup as ed


def brute(ids, x, labels, t=0.98):
    x = np.asarray(x, dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= t) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(link, False)
    comp = np.array(ids)
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], comp[:, None]).min(axis=1))
        if (new == comp).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, link.sum(1), comp, strict=True)}
        comp = new


def points(n, seed, group=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    for i in range(n // 3):
        x[n - 1 - i] = x[rng.integers(0, n // 3)] + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.2])
    if group:
        x[:group] = rng.normal(size=16) * 3 + rng.normal(size=(group, 16)) * 0.35
        x[: group // 4] = x[0]
    return x.astype(np.float32)


def test_matches_brute_force(spark, monkeypatch):
    """A dense group, copies, several labels, and shards dealt into blocks."""
    monkeypatch.setattr(ed, "BLOCK", 100)
    monkeypatch.setattr(ed, "ROWS_A_CENTROID", 150)
    x = points(900, 4, group=260)
    labels = [0] * 500 + [i % 3 for i in range(400)]
    ids = list(range(900))
    df = spark.createDataFrame([(i, v.tolist(), c) for i, v, c in zip(ids, x, labels, strict=True)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_duplicate_vectors(df).collect()}
    want = brute(ids, x, labels)
    total = sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert sum(n for n, _ in got.values()) >= 0.99 * total
    assert sum(got[i] == want[i] for i in ids) >= 0.97 * len(ids)
    assert ed.audit_recall(df, every=10) >= 0.95


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 2.0], [1.0, 0.01, 2.0]
    rows = [(5, a, 1), (3, b, 1), (4, a, 2), (6, a, None), (7, None, 1), (8, [0.0, 0.0, 0.0], 1), (9, [1.0, None, 2.0], 1), (10, [float("nan"), 0.0, 1.0], 1), (11, [float("inf"), 0.0, 1.0], 1), (12, [1.0, 0.0], 1), (None, a, 1), (20, a, 1), (21, [x * 3 for x in a], 1), (13, [], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, rep string, links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.near_duplicate_vectors(df).collect()}
    assert {k: got[k] for k in (3, 5, 20, 21)} == {3: (3, 3, True), 5: (3, 3, False), 20: (3, 3, False), 21: (3, 3, False)}
    assert all(got[k] == (0, k, True) for k in (4, 6, 7, 8, 9, 10, 11, 12, 13)) and got[None] == (0, None, True)
    assert ed.near_duplicate_vectors(df.where("vec_id > 99")).collect() == []


def test_components_whose_squares_leave_the_range(spark):
    rows = [(1, [1e200, 2e200]), (2, [1.001e200, 2e200]), (3, [2e200, -1e200]), (4, [1e-200, 2e-200]), (5, [3.0, 6.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_duplicate_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (0, 3), 4: (3, 1), 5: (3, 1)}


def test_prune_keeps_reach():
    x = points(300, 9)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = ed.robust_prune(u @ u.T)
    assert graph.shape == (300, ed.DEGREE) and (graph[:, 0] >= 0).all()
    found = ed.range_search(u, graph, np.array([0]), np.arange(300), 0.95, 32)
    truth = u @ u.T >= 0.95
    assert (found & truth).sum() >= 0.95 * truth.sum()
