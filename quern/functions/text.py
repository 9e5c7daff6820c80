"""Token counts, windows, hashes and task strings as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token: a run of word characters, or one other visible character. SPACED carries the white space before it, so that tokens join to the text.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"
SPACED = r"[ \t\r\n]*(?:[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n])"
WORD = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+"
EXTENSIONS = {".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".rs": "rust", ".go": "go"}
PATH_KEYS = ("path", "file", "file_path", "filename", "uri")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPACED), F.lit(0))


def count_tokens(text: Column, token: str = TOKEN) -> Column:
    """How many ``token`` (a regular expression) the text holds; 0 for null. Of TOKEN one character each is left and counted, so that no array of them is made."""
    n = F.length(F.regexp_replace(text, r"[ \t\r\n]+|(?<=[A-Za-z0-9_])[A-Za-z0-9_]+", "")) if token == TOKEN else F.regexp_count(text, F.lit(token))
    return F.coalesce(n, F.lit(0))


def truncate(text: Column, n: int | Column) -> Column:
    return F.array_join(F.slice(tokens(text), F.lit(1), F.lit(n) if isinstance(n, int) else n), "")


def split_tokens(text: Column, window: int | Column, overlap: int = 0) -> Column:
    """Array of windows of ``window`` tokens, each starting window - overlap after the last; none for a text without tokens."""
    w = F.lit(window) if isinstance(window, int) else window
    toks = F.array(tokens(text))
    made = F.transform(toks, lambda t: F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(1), F.size(t), w - overlap), lambda i: F.array_join(F.slice(t, i, w), ""))).otherwise(F.array().cast("array<string>")))
    return F.element_at(made, 1)


def chunk_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def args_json(args: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(args))))


def args_hash(args: Column) -> Column:
    return F.substring(F.sha2(args_json(args), 256), 1, 16)


def base_task(description: Column, tool: Column, args: Column) -> Column:
    pairs = F.array_join(F.transform(F.map_entries(args), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return F.concat_ws(" | ", F.nullif(description, F.lit("")), F.when(F.coalesce(tool, F.lit("")) != "", F.concat(F.lit("tool: "), tool)), F.when(F.coalesce(pairs, F.lit("")) != "", F.concat(F.lit("args: "), pairs)))


def last_steps(steps: Column, n: int = 3) -> Column:
    return F.slice(steps, F.greatest(F.size(steps) - n + 1, F.lit(1)), F.lit(n))


def task_string(description: Column, tool: Column, args: Column, steps: Column) -> Column:
    """Description, tool, args and the last three steps, oldest first, as step-1, step-2, step-3."""
    told = F.transform(last_steps(steps), lambda s, i: F.concat(F.lit("step-"), (i + 1).cast("string"), F.lit(": "), s))
    return F.concat_ws(" | ", F.nullif(base_task(description, tool, args), F.lit("")), told)


def language(args: Column) -> Column:
    """Language by the extension of the first path-like argument; python otherwise."""
    path = F.lower(F.coalesce(*[F.element_at(args, F.lit(k)) for k in PATH_KEYS], F.lit("")))
    out = F.lit("python")
    for ext, name in EXTENSIONS.items():
        out = F.when(path.endswith(ext), F.lit(name)).otherwise(out)
    return out


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def compact_number(n: Column) -> Column:
    """1234 -> 1.2k, 5600000 -> 5.6M."""
    return F.when(F.abs(n) >= 1_000_000, F.concat(F.format_number(n / 1e6, 1), F.lit("M"))).when(F.abs(n) >= 1000, F.concat(F.format_number(n / 1e3, 1), F.lit("k"))).otherwise(n.cast("string"))


def percent(share: Column, digits: int = 1) -> Column:
    """0.256 -> 25.6%; null stays null."""
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))


def short_id(text: Column, n: int = 8) -> Column:
    """The first ``n`` characters, with an ellipsis where more follow."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("\u2026"))).otherwise(text)


def within_minutes(ts: Column, now: Column, minutes: int) -> Column:
    return ts >= now - F.make_interval(mins=F.lit(minutes))
