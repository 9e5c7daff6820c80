"""Personal data: fixed patterns, and weak supervision over wider candidates; DataFrame functions only on the rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, find_spans, let, listed, piece, save, sha256_hex, table, text_blocks

#: Fixed by the contract, written so that Java's matcher neither recurses nor starts within a run that it has tried.
_WORD = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_WORD}]))[{_WORD}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

#: Gazetteers and context words, in the four languages of the corpus.
TLDS = "com org net edu gov info de fr es uk eu io at ch it nl".split()
FIRST_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Susan Richard Jessica Thomas Sarah "
    "Hans Ursula Klaus Monika Jürgen Petra Wolfgang Sabine Stefan Claudia Andreas Birgit Uwe Karin Günter Heike "
    "Jean Marie Pierre Nathalie Michel Isabelle Philippe Sylvie Alain Catherine Nicolas Françoise Laurent Céline Luc Hélène "
    "José María Antonio Carmen Manuel Ana Francisco Isabel Juan Dolores Javier Pilar Carlos Teresa Miguel Lucía"
).split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra".split()
CITIES = (
    "London Manchester Leeds Boston Chicago Seattle Austin Denver Berlin Hamburg München Köln Leipzig Wien Zürich Dresden "
    "Paris Lyon Marseille Toulouse Nantes Lille Genève Bruxelles Madrid Barcelona Sevilla Valencia Bilbao Málaga Bogotá Lima"
).split()
SAYS = {
    "email": "mail|contact|write|kontakt|correo|courriel|escrib",
    "ip": "server|host|address|login|addr|serveur|servidor|rechner",
    "card": "card|visa|master|credit|payment|karte|carte|tarjeta|zahlung",
    "phone": "phone|tel|call|fax|mobile|telefon|handy|portable|llam|anruf",
    "name": r"name|dear|signed|regards|contact|sincerely|grüße|nom\b|nombre|liebe|cher|querid|estimad|geehrt",
    "address": r"address|live|resid|deliver|ship|adresse|anschrift|wohn|habit|domicil|direcci|viv[eo]",
}
DENIES = r"order|invoice|isbn|version|serial|ticket|item no|bestell|commande|pedido|rechnung|chapter|kapitel"

#: Wider candidates, kept only if the classifier says so: written-out addresses, numbers of a card's length, numbers grouped like a phone's, persons' names, street addresses.
#: Patterns begin with a look at the first character, which is cheaper at each place than a look back.
LOOSE = ("loose_email", "loose_card", "loose_phone", "name", "address")
KINDS = BASE + LOOSE
SORTS = ("email", "ip", "card", "phone", "name", "address")
LOOSE_EMAIL = rf"(?<![{_WORD}])[{_WORD}]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++"
LOOSE_PHONE = r"(?=[0-9(])(?<![0-9+.(])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.])"
_TITLE, _SURNAME = rf"(?:{'|'.join(TITLES)})\.?\x20", r"\p{Lu}[\p{Ll}]{1,24}+"
NAME = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{_TITLE})?(?:{'|'.join(FIRST_NAMES)})\x20{_SURNAME}|{_TITLE}{_SURNAME}(?:\x20{_SURNAME})?)"
ADDRESS = (
    r"(?=[0-9\p{Lu}])(?<![\p{L}\p{N}])(?:[0-9]{1,5}\x20(?:\p{Lu}\p{L}{1,24}+\x20){1,3}(?:Street|Road|Avenue|Lane|Drive|Square|Boulevard)(?!\p{L})"
    r"|\p{Lu}\p{L}{1,24}(?:straße|strasse|weg|platz|allee|gasse)\x20[0-9]{1,4}+"
    r"|[0-9]{1,4},?\x20(?:rue|avenue|boulevard|place|quai)\x20(?:(?:de|du|des|la|le|les)\x20){0,2}\p{Lu}\p{L}{1,24}+"
    r"|(?:Calle|Avenida|Plaza|Paseo)\x20(?:(?:de|del|la|las|los)\x20){0,2}\p{Lu}\p{L}{1,24}+,?\x20[0-9]{1,4}+)"
)

LABELERS = ("pattern", "gazetteer", "context", "shape", "edges")
#: What a labeler is taken to say (silent, yes, no) of a span that isn't and one that is personal data, with the weight of so many spans, before any are seen.
EXPECTED, EXPECTED_SPANS = ((0.3, 0.1, 0.6), (0.3, 0.6, 0.1)), 20.0
#: Characters of context on each side, and the probability from which a span is taken.
AROUND, ACCEPT = 28, 0.7
YES, NO, SILENT = 1, 2, 0


def _sort(kind: str) -> str:
    return kind.removeprefix("loose_")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes; only for short strings."""
    terms = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.expr("0") + d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_parts(ip: Column) -> Column:
    return F.forall(F.transform(F.split(ip, r"\."), lambda p: F.regexp_replace(p, "^0+", "")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _length(text: Column, least: int, most: int) -> Column:
    return F.length(_digits(text)).between(least, most)


def _votes(kind: str, span: Column) -> list[Column]:
    """What each labeler says of a span (text, before, after): YES, NO or SILENT."""
    of = lambda test, otherwise=NO: F.when(test, YES).otherwise(otherwise)
    sort, s, before, after = _sort(kind), span["text"], span["before"], span["after"]
    digits = _digits(s)
    both = F.lower(F.concat(before, F.lit("\n"), after))
    last, first = F.substring(before, -1, 1), F.substring(after, 1, 1)
    gazetteer = {
        "email": lambda: of(F.lower(F.regexp_extract(s, r"([A-Za-z0-9-]+)$", 1)).isin(TLDS)),
        "ip": lambda: of(~s.rlike(r"^(?:0|10|127|255)\.")),
        "card": lambda: of(digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)")),
        "phone": lambda: of(digits.rlike(r"^(?:0|1[2-9]|3[0-9]|4[0-9]|[2-9])"), SILENT),
        "name": lambda: of(F.regexp_extract(s, rf"^(?:{_TITLE})?(\p{{L}}+)", 1).isin(FIRST_NAMES), SILENT),
        "address": lambda: of(after.rlike("|".join(CITIES)) | after.rlike(r"^,?\s*(?:[A-Z]{2}\s+)?[0-9]{4,5}\b"), SILENT),
    }[sort]()
    shape = {
        "email": lambda: of(~s.contains("..") & (F.length(s) < 255)),
        "ip": lambda: of(~s.rlike(r"(?:^|\.)0[0-9]")),
        "card": lambda: of(_luhn(digits)),
        "phone": lambda: of(F.length(digits).between(9, 15)),
        "name": lambda: of(~s.rlike(r"\x20(?:\p{L}\p{L}|The|And|Street|Road|Avenue|City|University|Day|January|Monday)$")),
        "address": lambda: of(~s.rlike(r"(?<![0-9])0")),
    }[sort]()
    context = F.when(both.rlike(SAYS[sort]), YES).when(F.lower(before).rlike(DENIES), NO).otherwise(SILENT)
    if sort == "name":
        context = F.when(s.rlike("^" + _TITLE), YES).otherwise(context)
    inside = r"^[\p{L}\p{N}_]$"
    return [F.lit(SILENT if kind in LOOSE else YES), gazetteer, context, shape, of(~last.rlike(inside) & ~first.rlike(inside))]


def _traits(span: Column) -> list[Column]:
    """Of a span's form: its length (four steps), and what stands before it (start or blank, mark, other)."""
    before = span["before"]
    return [F.least(F.lit(3), F.floor(F.length(span["text"]) / 8)).cast("int"), F.when(before.rlike(r"(?:^|\s)$"), 0).when(before.rlike(r"\p{Punct}$"), 1).otherwise(2)]


def _of_kind(kind: str) -> Column:
    return F.transform(f"__{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))


def _kinds(names: tuple[str, ...]) -> Column:
    return F.concat(*map(_of_kind, names))


def _with_candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with __base and __loose: arrays of (start, end, kind, votes, traits). Base spans have their tests behind them; loose ones overlap no base span."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = {
        "email": find_spans(text, EMAIL, text.contains("@")),
        "ip": F.filter(find_spans(text, IP), lambda s: _small_parts(s["text"])),
        "numbers": F.filter(find_spans(text, CARD), lambda s: _length(s["text"], 13, 19)),
        "phone": F.filter(find_spans(text, PHONE, text.contains("+")), lambda s: _length(s["text"], 9, 15)),
        "loose_email": find_spans(text, LOOSE_EMAIL, text.contains("(at)") | text.contains("[at]")),
        "loose_phone": F.filter(find_spans(text, LOOSE_PHONE), lambda s: _length(s["text"], 8, 12)),
        "name": find_spans(text, NAME),
        "address": find_spans(text, ADDRESS),
    }
    out = docs.withColumns({f"__{k}": v for k, v in found.items()})
    passes = lambda s: _luhn(_digits(s["text"]))
    out = out.withColumns({"__card": F.filter("__numbers", passes), "__loose_card": F.filter("__numbers", lambda s: ~passes(s))})

    out = out.withColumns({"__all_base": _kinds(BASE), "__all_loose": _kinds(LOOSE)})
    out = out.withColumn("__all_loose", apart(F.col("__all_loose"), *[F.col(f"__{b}") for b in BASE]))
    out = out.withColumn("__blocks", F.when(F.size("__all_base") + F.size("__all_loose") > 0, text_blocks(text)))
    near = lambda s: s.withField("before", piece(F.col("__blocks"), F.greatest(s["start"] - AROUND, F.lit(0)), s["start"])).withField("after", piece(F.col("__blocks"), s["end"], s["end"] + AROUND))
    out = out.withColumns({x: F.transform(x, near) for x in ("__all_base", "__all_loose")})

    def voted(names: tuple[str, ...], spans: Column) -> Column:
        def told(s: Column) -> Column:
            votes = [F.array(*v) for v in (_votes(k, s) for k in names)]
            chosen = votes[-1]
            for k, v in zip(names[-2::-1], votes[-2::-1], strict=True):
                chosen = F.when(s["kind"] == k, v).otherwise(chosen)
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), chosen.alias("votes"), F.array(*_traits(s)).alias("traits"))

        return F.transform(spans, told)

    out = out.withColumns({"__base": voted(BASE, F.col("__all_base")), "__loose": voted(LOOSE, F.col("__all_loose"))})
    return out.drop("__all_base", "__all_loose", "__blocks", "__numbers", *[f"__{k}" for k in KINDS])


@dataclass(frozen=True)
class PiiModel:
    """Labeler reliabilities by expectation-maximisation, for each sort of data, and a logistic span classifier trained on its posteriors.

    ``reliability`` holds, sort by sort and labeler by labeler, the shares of (silent, yes, no) for spans that aren't
    and that are personal data; ``prior`` is the share of all candidates that are.
    """

    prior: float
    reliability: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]
    weights: dict[str, float]

    def accepts(self, span: Column) -> Column:
        total = F.lit(self.weights["bias"])
        for k in KINDS:
            total = total + F.when(span["kind"] == k, self.weights[k]).otherwise(0.0)
        for i, name in enumerate(LABELERS):
            v = F.get(span["votes"], F.lit(i))
            total = total + F.when(v == YES, self.weights[f"{name}+"]).when(v == NO, self.weights[f"{name}-"]).otherwise(0.0)
        for i, name in enumerate(("length", "before")):
            for v in range(4 if i == 0 else 3):
                total = total + F.when(F.get(span["traits"], F.lit(i)) == v, self.weights[f"{name}{v}"]).otherwise(0.0)
        return total >= float(np.log(ACCEPT / (1 - ACCEPT)))


def _features(kind: str, votes: tuple[int, ...], traits: tuple[int, ...]) -> list[str]:
    said = [LABELERS[i] + ("+" if v == YES else "-") for i, v in enumerate(votes) if v != SILENT]
    return ["bias", kind, *said, f"length{traits[0]}", f"before{traits[1]}"]


def fit_votes(patterns: list[tuple], rounds: int = 50, steps: int = 400) -> PiiModel:
    """From counts of patterns (kind, votes, traits, count), of which there are at most len(KINDS) * 3 ** len(LABELERS) * 12.

    Expectation-maximisation for each sort, with labelers independent given the truth, from what labelers are EXPECTED
    to say; sorts with few spans stay near that. Then weighted logistic regression on kind, votes and traits towards
    the posteriors. No patterns give a model that accepts nothing.
    """
    names = ["bias", *KINDS, *[f"{x}{s}" for x in LABELERS for s in "+-"], *[f"length{v}" for v in range(4)], *[f"before{v}" for v in range(3)]]
    n = np.array([p[3] for p in patterns], dtype=np.float64)
    votes = np.array([p[1] for p in patterns], dtype=np.int64).reshape(len(patterns), len(LABELERS))
    post, reliability = np.zeros(len(patterns)), []
    for sort in SORTS:
        mine = np.array([_sort(p[0]) == sort for p in patterns], dtype=bool)
        said = np.eye(3)[votes[mine]] if mine.any() else np.zeros((0, len(LABELERS), 3))
        rel, prior = np.tile(np.array(EXPECTED), (len(LABELERS), 1, 1)), 0.5
        for _ in range(rounds):
            odds = np.log(prior / (1 - prior)) + (said * np.log(rel[:, 1] / rel[:, 0])[None]).sum((1, 2))
            is_so = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            prior = (2 + (is_so * n[mine]).sum()) / (4 + n[mine].sum())
            for side, share in ((0, 1 - is_so), (1, is_so)):
                seen = (said * (share * n[mine])[:, None, None]).sum(0) + EXPECTED_SPANS * np.array(EXPECTED[side])
                rel[:, side] = seen / seen.sum(1, keepdims=True)
        post[mine] = is_so if mine.any() else 0.0
        reliability += [tuple(tuple(float(v) for v in side) for side in labeler) for labeler in rel]
    if not len(patterns):
        return PiiModel(0.5, tuple(reliability), dict.fromkeys(names, 0.0) | {"bias": -9.0})
    x = np.zeros((len(patterns), len(names)))
    for row, p in zip(x, patterns, strict=True):
        row[[names.index(f) for f in _features(p[0], p[1], p[2])]] = 1.0
    share, w = n / n.sum(), np.zeros(len(names))
    share = 0.5 * share + 0.5 / len(n)  # rare patterns count too
    for _ in range(steps):
        miss = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - post) * share
        w -= 2.0 * (x.T @ miss + 1e-4 * w)
    prior = float(np.clip((post * n).sum() / n.sum(), 1e-6, 1 - 1e-6))
    return PiiModel(prior, tuple(reliability), dict(zip(names, map(float, w), strict=True)))


def _fit(candidates: DataFrame) -> PiiModel:
    spans = candidates.select(F.explode(F.concat("__base", "__loose")).alias("s"))
    counts = spans.groupBy("s.kind", "s.votes", "s.traits").count().collect()
    return fit_votes(sorted((r["kind"], tuple(r["votes"]), tuple(r["traits"]), r["count"]) for r in counts))


def fit_pii(docs: DataFrame, text_col: str = "text") -> PiiModel:
    """Count the patterns of all candidates of all documents, and fit; the driver gets one row for each pattern."""
    return _fit(_with_candidates(docs.select(text_col), text_col))


def find_pii(docs: DataFrame, text_col: str = "text", model: PiiModel | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with base_spans and pii_spans: arrays of (start, end, kind), by kind, then start.

    Base spans are the fixed patterns with their tests; pii_spans adds the loose candidates that the model accepts and
    that overlap no base span. Without a model one is fitted on all of ``docs``: the texts are searched once, what was
    found is written with the kept columns, and both the fit and the result read that. Positions are code points. Null
    texts are empty and have no spans. Repeated rows and other columns stay (columns of these two names are replaced).
    Each row is worked on alone, without exchange; only pattern counts are aggregated. No rows give no rows. The plan
    is large (some seconds of planning): write a result before the next such operator is put on it.
    """
    keep = [c for c in keep or docs.columns if c not in ("base_spans", "pii_spans")]
    found = _with_candidates(docs, text_col).select(*keep, "__base", "__loose")
    if model is None:
        found = save(found, "pii-candidates")
        model = _fit(found)
    plain = lambda x: F.transform(x, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select(*keep, plain(F.col("__base")).alias("base_spans"), plain(F.concat("__base", F.filter("__loose", model.accepts))).alias("pii_spans"))


def redact(text: Column, spans: Column, block: int = 256) -> Column:
    """``text`` with each span (overlapping ones together, under the first one's kind) replaced by its kind in brackets; worked in blocks of text and of spans, so that the work stays in proportion to both."""
    def cut(x: Column) -> Column:
        spans_of = lambda b: F.slice(x["spans"], b * block + 1, F.lit(block))
        blocks = F.sequence(F.lit(0), F.floor((F.size(x["spans"]) - 1) / block).cast("int"))
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(spans_of(b), lambda s: s["end"])))

        def step(acc: Column, s: Column) -> Column:
            more = F.array(piece(x["text"], acc["pos"], s["start"]), F.concat(F.lit("["), F.upper(F.regexp_replace(s["kind"], "^loose_", "")), F.lit("]")))
            return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] >= acc["pos"], F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

        def done(e: Column, b: Column) -> Column:
            begin = F.coalesce(F.array_max(F.slice(e, F.lit(1), b)), F.lit(0))
            return F.aggregate(spans_of(b), F.struct(begin.alias("pos"), F.array().cast("array<string>").alias("out")), step)["out"]

        return let(ends, lambda e: F.concat(F.array_join(F.flatten(F.transform(blocks, lambda b: done(e, b))), ""), F.substring(text, F.array_max(e) + 1, F.length(text))))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.named_struct(F.lit("text"), text_blocks(text), F.lit("spans"), F.array_sort(spans)), cut))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], sha256_hex(listed(F.col("base_spans"))).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))
