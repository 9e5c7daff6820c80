"""Secrets and personal data against plain Python regular expressions."""

import hashlib
import math
import random
import re

from pyspark.sql import functions as F
from quern.llm import pii, secret_scan
from quern.llm.common import apart, listed


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def base_secrets(t):
    out = []
    for m in re.finditer(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def base_pii(t):
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return ",".join(out)


def texts():
    rng = random.Random(3)
    bits = ["é", "ßx ", "password", "PassWord", "api_key", "token", "secret", "=", ": ", '"', "'", " ", "a", "f00d", "AKIA", "ABCDEF12", "0123456789abcdef" * 2, "deadbeef", "@", "mail", ".", "b-c", "com", "+", "1", "4111 1111 1111 1111", "4111111111111111", "555", "(", ")", "-", "10.0.0.1", "300", "007", "%", "_", "\n", "ſecret", "Key", "x.y.z"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    out += ["", None, "a." * 60_000, "a@" + "b." * 40_000 + "c", "1" * 100_000, "1.2" * 30_000, "x@y.z " * 3000, "password: " + "q" * 50_000, "\U0001f600 a@b.co +1 (269) 555-3296 \U0001f600 1.2.3.4", "a@b.c+x@d.e", "token: abc password: longvalue1"]
    return list(enumerate(out))


def test_base_spans(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.s, r.p) for r in pii.find_pii(secret_scan.find_secrets(df).withColumnRenamed("base_spans", "s0")).select("doc_id", listed(F.col("s0")).alias("s"), listed(F.col("base_spans")).alias("p")).collect()}
    for i, t in rows:
        assert got[i] == (base_secrets(t or ""), base_pii(t or "")), (i, (t or "")[:200])


def test_entropy_windows(spark):
    rng = random.Random(1)
    alphabet = "ABCDEFabcdef0123456789+/=_-zZ"
    rows = [("".join(rng.choice(alphabet[: rng.randrange(1, 29)]) for _ in range(rng.randrange(15, 70))),) for _ in range(60)]

    def best(t, w=20):
        return max((-sum(t[i : i + w].count(c) / w * math.log2(t[i : i + w].count(c) / w) for c in set(t[i : i + w])) for i in range(len(t) - w + 1)), default=None)

    for r in spark.createDataFrame(rows, "t string").select("t", secret_scan.window_entropy(F.col("t")).alias("h")).collect():
        want = best(r.t)
        assert (r.h is None) == (want is None) and (want is None or abs(r.h - want) < 1e-9)


def test_entropy_spans_and_allow_list(spark):
    rows = [
        (1, "key k9Xq2LmZ8vRt4WbY7nCe3Hd here"),
        (2, "id 123e4567-e89b-12d3-a456-426614174000 here"),
        (3, "see docs/some-long-path/of-words/page-2024 here"),
        (4, "k9Xq2LmZexample8vRt4WbY7nCe"),
        (5, "token=k9Xq2LmZ8vRt4WbY7nCe3Hd"),
        (6, "11111111111111111111111111"),
        (7, None),
    ]
    got = {r.doc_id: r.x for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", listed(F.col("secret_spans")).alias("x")).collect()}
    assert got == {1: "entropy:4:27", 2: "", 3: "", 4: "", 5: "assign:0:29", 6: "", 7: ""}
    assert secret_scan.find_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_weak_supervision(spark):
    """Labelers that agree get reliable, and decide on loose candidates."""
    rows = [(i, f"call phone 555-0{i:02d}-{1000 + i} now") for i in range(60)] + [(100 + i, f"order 4111 1111 1111 1{i:03d} x") for i in range(60)] + [(200 + i, f"mail a{i}@b.com or visa card 4111111111111111") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit_pii(df)
    assert 0 < model.prior < 1 and all(abs(sum(side) - 1) < 1e-9 for x in model.reliability for side in x)
    got = {r.doc_id: [s["kind"] for s in r.pii_spans] for r in pii.find_pii(df, model=model).collect()}
    assert all("loose_card" not in got[i] for i in range(100, 160) if "card" not in got[i])
    assert all(got[i] == ["email", "card"] for i in range(200, 260))
    assert pii.fit_votes([]).weights["bias"] < 0
    assert pii.find_pii(df.where("doc_id < 0")).collect() == []


def planted(seed, n=400):
    """Texts with one span each that base patterns don't find, and decoys: (text, kind or None, start, end)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    sure = {
        "name": lambda: (rng.choice(["Dear ", "signed, ", "contact: ", "Herr ", "Liebe ", "estimada "]), f"{rng.choice(pii.FIRST_NAMES)} {word().title()}"),
        "address": lambda: (rng.choice(["address: ", "we live at ", "Anschrift: ", "elle habite "]), rng.choice([f"{rng.randrange(1, 999)} {word().title()} Street", f"{word().title()}straße {rng.randrange(1, 99)}", f"{rng.randrange(1, 99)} rue de {word().title()}", f"Calle {word().title()} {rng.randrange(1, 99)}"])),
        "loose_phone": lambda: (rng.choice(["phone ", "call ", "Telefon ", "tel. "]), f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"),
        "loose_email": lambda: (rng.choice(["mail ", "write to ", "kontakt "]), f"{word()} [at] {word()} [dot] com"),
    }
    decoys = [lambda: f"order {rng.randrange(10, 99)}-{rng.randrange(100, 999)}-{rng.randrange(100, 999)}", lambda: f"serial {rng.randrange(10**15, 10**16) // 10 * 10 + 1}", lambda: f"{word().title()} {word().title()}", lambda: f"version {rng.randrange(10, 99)}.{rng.randrange(100, 999)}.{rng.randrange(100, 999)}", lambda: f"in {rng.randrange(1900, 2020)} {word().title()}"]
    out = []
    for i in range(n):
        head, tail = prose(rng.randrange(3, 20)), prose(rng.randrange(3, 20))
        if i % 2:
            out.append((f"{head} {rng.choice(decoys)()} {tail}", None, 0, 0))
        else:
            kind = rng.choice(sorted(sure))
            lead, span = sure[kind]()
            at = len(head) + 1 + len(lead)
            out.append((f"{head} {lead}{span}, {tail}", kind, at, at + len(span)))
    return out


def test_precision_and_recall_of_added_spans(spark):
    rows = planted(21)
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    hits = wrong = 0
    for i, (_, kind, start, end) in enumerate(rows):
        base = {(s["start"], s["end"], s["kind"]) for s in got[i].base_spans}
        added = {(s["start"], s["end"], s["kind"]) for s in got[i].pii_spans} - base
        found = {x for x in added if kind and x[2] == kind and x[0] <= start and x[1] == end}
        hits += bool(found)
        wrong += len(added - found)
    real = sum(k is not None for _, k, _, _ in rows)
    assert hits >= 0.9 * real and wrong <= 0.05 * real, (hits, wrong, real)


def test_secrets_without_assignment(spark):
    """Keys of several kinds in prose are found; identifiers, paths, words and counters are not."""
    rng = random.Random(31)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    base64, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789"
    keys = [lambda: draw(base64, 40), lambda: draw(lower, 32) + "7k", lambda: "sk-" + draw(base64[:62], 40), lambda: draw(base64[:62], 24) + "==", lambda: draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32)]
    decoys = [lambda: "-".join(draw("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), lambda: "/usr/local/share/" + draw("abcdefgh", 8) + "/file-2024", lambda: draw("abcdefghijklm", 30), lambda: "some-long-slug-of-plain-words-" + draw("12", 2), lambda: "1" * 24, lambda: draw("ab1", 30), lambda: "0123456789" * 3]
    rows = [(i, f"the {rng.choice(keys if i % 2 else decoys)()} end") for i in range(400)]
    got = {r.doc_id: [s["kind"] for s in r.secret_spans if s["kind"] == "entropy"] for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found, false = sum(bool(got[i]) for i in range(1, 400, 2)), sum(bool(got[i]) for i in range(0, 400, 2))
    assert found >= 0.95 * 200 and false <= 0.02 * 200, (found, false)


def test_very_many_spans_in_one_text(spark):
    """50,000 base spans and as many candidates: no step is quadratic."""
    n = 50_000
    text = " ".join(f"a{i}@b.com call 555-{i % 900 + 100}-{i % 9000 + 1000}" for i in range(n))
    secret = " ".join(f"token={i:08d} k9Xq2LmZ8vRt4WbY7nCe{i}" for i in range(5000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.find_pii(df).select(F.size("base_spans").alias("n"), pii.redact(F.col("text"), F.col("pii_spans")).alias("t")).first()
    assert row.n == n and row.t.count("[EMAIL]") == n
    assert secret_scan.find_secrets(df.select("doc_id", F.lit(secret).alias("text"))).select(F.size("base_spans")).first()[0] == 5000


def test_overlaps_by_binary_search(spark):
    rng = random.Random(17)
    rows = []
    for i in range(60):
        cuts = sorted(rng.sample(range(200), 2 * rng.randrange(0, 20)))
        spans = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        asked = [(a, a + rng.randrange(1, 30)) for a in rng.sample(range(200), 10)]
        rows.append((i, spans, asked))
    df = spark.createDataFrame(rows, "i int, spans array<struct<start:int,end:int>>, asked array<struct<start:int,end:int>>")
    for r in df.withColumn("left", apart(F.col("asked"), F.col("spans"))).collect():
        assert r.left == [s for s in r.asked if not any(s.start < b.end and b.start < s.end for b in r.spans)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a@b.co token=abcdefgh", "x", "y", "z")], "doc_id long, text string, base_spans string, secret_spans string, pii_spans string")
    assert set(secret_scan.find_secrets(df).columns) == set(pii.find_pii(df).columns) == set(df.columns)
    assert listed_first(secret_scan.find_secrets(df), "secret_spans") == "assign:7:21" and listed_first(pii.find_pii(df), "pii_spans") == "email:0:6"


def listed_first(df, column):
    return df.select(listed(F.col(column)).alias("x")).first().x


def test_redaction(spark):
    rows = [(1, "é a@b.co, +1 (269) 555-3296; 1.2.3.4", "k"), (2, None, None), (3, "clean", "k")]
    df = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, base_spans string"))
    got = {r.doc_id: r.t for r in df.select("doc_id", pii.redact(F.col("text"), F.col("pii_spans")).alias("t")).collect()}
    assert got == {1: "é [EMAIL], [PHONE]; [IP]", 2: None, 3: "clean"}


def test_digest_columns(spark, tmp_path):
    rows = [(i, t) for i, t in texts()[:50]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for op, base in ((secret_scan.op4_secret_scan, base_secrets), (pii.op9_pii, base_pii)):
        got = {r.doc_id: r for r in op(spark, str(tmp_path)).collect()}
        for i, t in rows:
            assert got[i].base_sha256 == hashlib.sha256(base(t or "").encode()).hexdigest()
            assert set(filter(None, base(t or "").split(","))) <= set(got[i].spans.split(","))
