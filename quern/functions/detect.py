"""Format of a text, of a line, and the tests that classify outcomes, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first rule that holds names the format.
HTML_STARTS = r"(?i)^(?:<html|<!doctype|<div|<article|<section|<main)"
CODE_STARTS = r"^(?:def |class |function |import |const |let |var |public |private |async |await |package |use |fn )"
CODE_LINES = r"(?m)^(?:def |class |import |from \w+ import |export |func |fn |pub fn )"
SHELL_LINES = r"(?m)^\$ "
MARKDOWN_LINES = r"(?m)^#{1,6} \S"
LOG_LINES = r"(?m)^\d{4}-\d{2}-\d{2}|^\d{2}/\d{2}/\d{4}|\bINFO\b|\bERROR\b|\bWARN\b"
FAILURES = r"(?i)NameError|ImportError|AttributeError|undefined is not|cannot import|has no attribute|is not defined|module not found"
HEAD = 4000


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def looks_like_csv(text: Column) -> Column:
    """At least three non-blank lines among the first ten, each with the same number, not zero, of commas or of tabs."""
    lines = F.filter(F.slice(F.split(strip(text), r"\n"), 1, 10), lambda x: F.trim(x) != "")

    def even(mark: str) -> Column:
        n = F.array_distinct(F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))))
        return (F.size(n) == 1) & (F.element_at(n, 1) > 0)

    return (F.size(lines) >= 3) & (even(",") | even("\t"))


def detect_format(text: Column) -> Column:
    t = strip(text)
    head = F.substring(t, 1, HEAD)
    return (
        F.when(t.startswith("{") | t.startswith("["), "json")
        .when(t.rlike(HTML_STARTS), "html")
        .when(t.rlike(CODE_STARTS) | head.rlike(CODE_LINES), "code")
        .when(t.rlike(SHELL_LINES), "shell")
        .when(looks_like_csv(text), "csv")
        .when(head.rlike(MARKDOWN_LINES) | head.contains("\n```"), "markdown")
        .when(t.rlike(LOG_LINES), "log")
        .otherwise("text")
    )


def detect_line(line: Column) -> Column:
    t = F.trim(line)
    return (
        F.when(t == "", "text")
        .when(t.startswith("{") | t.startswith("["), "json")
        .when(t.rlike(r"^<[A-Za-z!/]"), "html")
        .when(t.rlike(r"^\$ "), "shell")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}|^\d{2}/\d{2}/\d{4}|\b(?:DEBUG|INFO|WARN|ERROR|FATAL)\b"), "log")
        .when(t.rlike(r"^(?:def |class |import |from |function |const |let |var |return |fn |func |pub )"), "code")
        .otherwise("text")
    )


def implicated(outcome: Column, reason: Column) -> Column:
    return F.coalesce((outcome == "failed") & reason.rlike(FAILURES), F.lit(False))


def signal_quality(n: Column, least: Column, most: Column, deviation: Column) -> Column:
    """none if all scores are equal, low if they hardly differ, ok otherwise and for fewer than four."""
    return F.when(n < 4, "ok").when(least == most, "none").when(deviation < 0.05, "low").otherwise("ok")


def signal_of(scores: Column) -> Column:
    """signal_quality() of an array of scores."""
    n = F.size(scores)
    some = F.nullif(n, F.lit(0))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / some
    spread = F.sqrt(F.aggregate(scores, F.lit(0.0), lambda a, s: a + (s - mean) * (s - mean)) / some)
    return signal_quality(n, F.array_min(scores), F.array_max(scores), spread)
