import random

from hypothesis import given, settings
from hypothesis import strategies as st
from quern.llm.decontaminate import budget, decontaminate, find_contamination, myers, normalise


def best(pattern, text):
    """Least edit distance of pattern to any part of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, c in enumerate(text):
            new.append(min(row[j] + (p != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=80), st.text("abc", max_size=90))
def test_myers(pattern, text):
    want = best(pattern, text)
    got = myers(pattern, text, len(pattern))
    assert got[0] == want and best(pattern, text[: got[1]]) == want
    assert myers(pattern, text, want - 1) is None


def corpus():
    rng = random.Random(2)
    words = ["alpha", "bet", "gamma", "de", "epsilon", "é", "Tion", "the", "of"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(4, 40)))) for i in range(25)] + [(90, ""), (91, None), (92, "ab")]
    docs = []
    for i in range(80):
        t = [rng.choice(words) for _ in range(30)]
        if i % 2:
            leak = list(rng.choice(items[:25])[1])
            for _ in range(rng.randrange(0, 1 + len(leak) // 8)):
                leak[rng.randrange(len(leak))] = rng.choice("xyz ")
            t.insert(rng.randrange(30), "".join(leak).upper() if i % 3 else "".join(leak))
        docs.append((i, rng.choice([" ", "\n", "  "]).join(t), "en"))
    docs += [(500, "", "x"), (501, None, None), (None, items[3][1], "y"), (502, "x" * 100_000 + items[4][1] + "y " * 50_000, "z")]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in find_contamination(d, b).collect()}
    want = {}
    for i, t, _ in docs:
        for j, x in items:
            t0, x0 = normalise(t or ""), normalise(x or "")
            if not x0:
                continue
            dist = 0 if x0 in t0 else best(x0, t0[-3000:]) if len(t0) > 3000 else best(x0, t0)
            if dist <= budget(x0):
                want[i, j] = dist
    assert {k: v for k, v in got.items() if k[0] != 502} == {k: v for k, v in want.items() if k[0] != 502}
    assert got[502, 4] == 0
    bad = {k[0] for k in want} | {502}
    assert {r.doc_id for r in decontaminate(d, b).collect()} == {i for i, *_ in docs} - bad
    assert find_contamination(d, b.where("item_id < 0")).collect() == []
    assert find_contamination(d.where("doc_id < 0"), b).collect() == []
