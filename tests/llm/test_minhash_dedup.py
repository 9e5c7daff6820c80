import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quern.llm.common import join_hot
from quern.llm.components import connected_components
from quern.llm.minhash_dedup import near_duplicates, op3_minhash_dedup
from quern.llm.textscan import shingle_sets


def brute(rows, k, num, den):
    """doc_id -> (n_shingles, component)."""
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            ra, rb = sorted((root(a), root(b)))
            up[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            t = rng.choice(out)[1].split(" ")
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            text = " ".join(t)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 40, 90])))
        out.append((i, text))
    return out


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 80, 100)])
def test_matches_brute_force(spark, k, num, den):
    rows = corpus(160, k)
    rows += [(900, ""), (901, None), (902, " \n\t"), (903, "Abc def"), (904, "aBC def"), (905, "x" * 200_000)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_large_bucket_without_a_common_hub(spark):
    """Chains of edits: neighbours are alike, ends are not; all of it is one component only by way of the links between."""
    rng = random.Random(5)
    text, rows = [f"a{i}" for i in range(60)], []
    for i in range(80):
        rows.append((i, " ".join(text)))
        text[rng.randrange(60)] = f"b{i}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()}
    assert got == brute(rows, 3, 85, 100)


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_cancel_out_in_a_polynomial(spark):
    """Two words without a place in common; their sets share nothing."""
    rows = [(1, "x " + thue_morse(1024, "a", "b") + " y"), (2, "x " + thue_morse(1024, "b", "a") + " y"), (3, thue_morse(64, "a", "b")), (4, thue_morse(64, "b", "a")), (5, thue_morse(2048, "a", "b")), (6, thue_morse(2048, "b", "a"))]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i, True) for i in range(1, 7)}


def test_word_hashes_differ_by_seed_and_by_every_byte():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(n)) for n in list(range(1, 70)) * 30})
    both = [list(shingle_sets(pa.array(words), 1, seed=s)) for s in (0, 1)]
    flat = [np.concatenate(x) for x in both]
    assert all(len(np.unique(x)) == len(words) for x in flat) and not np.intersect1d(*flat).size


def test_one_id_with_other_texts(spark):
    """Each text has its own links; the ids they share are the same."""
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (1, two), (5, one + " z"), (7, two + " z"), (9, "c d e f g")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, True), (1, 1, True), (5, 1, False), (7, 1, False), (9, 9, True)]


def test_query_parameters(spark, tmp_path):
    rows = corpus(120, 9)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op3_minhash_dedup(spark, str(tmp_path)).collect()}
    assert got == brute(rows, 3, 85, 100)


def test_hot_keys_join_without_an_exchange_of_their_rows(spark):
    rows = spark.createDataFrame([(i, 7 if i < 900 else i % 40 if i < 990 else None) for i in range(1000)], "i long, k long")
    for how in ("inner", "left"):
        one = rows.where("k is not null and k <> 3").groupBy("k").agg(F.count("*").alias("size")).withColumn("v", F.col("k") * 2)
        want = rows.join(one, "k", how).select("i", "k", "v").collect()
        got = join_hot(rows, one, "k", "size", 1000, how).select("i", "k", "v").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_nulls_repeats_extra_columns_and_empty_table(spark):
    rows = [(None, "a b c d", 1, 2), (1, "a b c d", 3, 4), (1, "a b c d", 3, 4), (2, "a b c d", 5, 6), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest long, component_id long")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_duplicates(df, 3, 85, 100).collect())
    assert got == [(-1, 0, -1, True), (-1, 2, -1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert near_duplicates(df.where("doc_id > 5")).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, x) for x in range(201, 240)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, **{i: 200 for i in range(200, 240)}}


@pytest.mark.parametrize("n,ids", [(3000, "sorted"), (3000, "shuffled")])
def test_rounds_of_a_long_chain(spark, n, ids):
    name = list(range(n + 1))
    if ids == "shuffled":
        random.Random(3).shuffle(name)
    df = spark.createDataFrame([(name[i], name[i + 1]) for i in range(n)], "a long, b long")
    out = connected_components(df)
    assert out._quern_rounds <= 10
    assert out.where("component = 0").count() == out.count() == n + 1


def test_rounds_of_stars(spark):
    edges = [(0, 10_000 + i) for i in range(500)] + [(99_999, 20_000 + i) for i in range(500)] + [(99_999, 10_000)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert out._quern_rounds <= 3 and {r.component for r in out.collect()} == {0} and out.count() == 1002


def test_blocks(spark, monkeypatch):
    """Families over several blocks, with a hub that few are alike to."""
    import quern.llm.minhash_dedup as md

    monkeypatch.setattr(md, "BLOCK", 8)
    rng = random.Random(6)
    base, rows = [f"a{i}" for i in range(120)], []
    for i in range(70):
        text = list(base)
        for _ in range(rng.randrange(1, 8)):
            text[rng.randrange(120)] = f"b{rng.randrange(9999)}"
        rows.append((i, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()}
    assert got == brute(rows, 3, 85, 100)


def test_id_filter(spark):
    from quern.llm.common import probably_in

    ids = spark.range(0, 3000, 7).toDF("x")
    rows = spark.createDataFrame([(i, "t") for i in range(-3000, 3000)] + [(None, "t")], "id long, text string")
    got = [r.id for r in probably_in(rows, "id", ids).collect()]
    assert set(range(0, 3000, 7)) <= set(got) and len(got) < 450
