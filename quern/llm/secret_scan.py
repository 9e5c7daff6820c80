"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, find_spans, joined, let, listed, sha256_hex, table

#: Fixed by the contract.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}+", r"[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates: whole runs of so many characters at least, with a digit and a letter in them.
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*+[0-9])[A-Za-z0-9+/=_-]{20,}+"
WINDOW = 20
#: Character class of a candidate and the bits a character that its best window needs; the first class that fits counts.
CLASSES = ((r"^[0-9]+$", None), (r"^[0-9a-fA-F]+$", 3.0), (r"^[A-Z0-9]+$", 3.5), (r"^[a-z0-9]+$", 3.5), (r"^.*$", 3.8))
#: Never a secret: identifiers and digests of known form, placeholders, paths and slugs of lower-case words, rows of one or of counting characters.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^sha(?:1|256|384|512)-",
    r"(?i)example|sample|dummy|placeholder|changeme|your[-_]|x{6}|lorem",
    r"^/?[a-z]+(?:[-_/]+(?:[a-z]+|[0-9]+))+/?$",
    r"(.)\1{7}",
    r"0123456789|1234567890|abcdefghijkl|ABCDEFGHIJKL",
)
_LOW, _HIGH = ord("+"), ord("z")


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits a character) of the windows of ``text``; null if it is shorter than one.

    One fold over the characters: each step adds one character to the counts and takes one out, and changes the sum
    of c log c by these two terms.
    """
    clogc = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    width = _HIGH - _LOW + 1
    zero = F.struct(F.array_repeat(F.lit(0), width).alias("n"), F.lit(0.0).alias("s"), F.lit(-1.0).alias("best"))

    def change(counts: Column, code: Column, by: int) -> Column:
        return F.transform(counts, lambda c, j: F.when(j == code, c + by).otherwise(c))

    def fold(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            def remove(k: Column) -> Column:
                old = F.get(codes, i - window)
                c = F.get(k["n"], old)
                return F.when(i < window, k).otherwise(F.struct(change(k["n"], old, -1).alias("n"), (k["s"] + F.get(clogc, c - 1) - F.get(clogc, c)).alias("s"), k["best"].alias("best")))

            def add(k: Column) -> Column:
                new = F.get(codes, i)
                c = F.get(k["n"], new)
                s = k["s"] + F.get(clogc, c + 1) - F.get(clogc, c)
                full = F.greatest(k["best"], F.lit(math.log2(window)) - s / window)
                return F.struct(change(k["n"], new, 1).alias("n"), s.alias("s"), F.when(i >= window - 1, full).otherwise(k["best"]).alias("best"))

            return let(remove(acc), add)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda k: k["best"])

    return F.when(F.length(text) >= window, let(F.transform(F.split(text, ""), lambda c: F.ascii(c) - _LOW), fold))


def _is_secret(text: Column) -> Column:
    allowed = F.lit(False)
    for p in ALLOWED:
        allowed = allowed | text.rlike(p)
    need = F.lit(None).cast("double")
    for p, bits in reversed(CLASSES):
        need = F.when(text.rlike(p), F.lit(bits).cast("double")).otherwise(need)
    return ~allowed & need.isNotNull() & (window_entropy(text) >= need)


def secret_spans(text: Column) -> tuple[Column, Column, Column, Column]:
    """Arrays of (start, end, text) for each kind of KINDS; entropy spans that overlap others are still in."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    assign = F.filter(find_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 1)) >= 8)
    access = find_spans(text, ACCESS, text.contains("AKIA"))
    return assign, access, find_spans(text, HEX), F.filter(find_spans(text, CANDIDATE), lambda s: _is_secret(s["text"]))


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with base_spans and secret_spans: arrays of (start, end, kind) by start, then kind.

    Base spans are the fixed patterns; secret_spans adds candidates whose best window is random enough for their
    character class, that no allow-list pattern suppresses and that overlap no base span. Positions are code points.
    Null texts are empty and have no spans. Repeated rows and other columns stay (a column of these two names is
    replaced); each row is worked on alone, in one task step without exchange. No rows give no rows.
    """
    found = docs
    parts = secret_spans(F.col(text_col))
    for kind, spans in zip(KINDS, parts, strict=True):
        found = found.withColumn(f"__{kind}", spans)
    order = lambda x: F.transform(F.array_sort(F.transform(x, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    base = order(F.concat(*[joined(k, F.col(f"__{k}")) for k in KINDS[:3]]))
    found = found.withColumn("base_spans", base)
    added = joined("entropy", apart(F.col("__entropy"), *[F.col(f"__{k}") for k in KINDS[:3]]))
    return found.withColumn("secret_spans", order(F.concat("base_spans", added))).drop(*[f"__{k}" for k in KINDS])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], sha256_hex(listed(F.col("base_spans"))).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))
