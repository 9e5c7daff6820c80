"""Segmenting operators that need a parser: JSON, HTML, code, logs with state, and mixed text; Arrow batches in, chunk rows out."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segment import PROMPT

CHUNK = "ord int, content string, chunk_type string, token_count int, start_pos int, name string, refs array<string>"
#: (content, chunk_type, start_pos, name, refs)
Piece = tuple[str, str, int, str | None, list[str]]
#: Bytes of words, white space and other characters (their first byte; the others go).
_KINDS = bytes(97 if chr(i).isascii() and (chr(i).isalnum() or i == 95) else 32 if i in b" \t\r\n" else 46 for i in range(256))
_INNER = bytes(range(0x80, 0xC0))


def count(text: str) -> int:
    """How many TOKEN the text holds: characters that are no words, and beginnings of words."""
    kinds = text.encode("utf-8", "surrogatepass").translate(_KINDS, _INNER)
    return kinds.count(b".") + kinds.count(b" a") + kinds.count(b".a") + kinds.startswith(b"a")


# JSON: values that are leaves, deep or small stay whole under their path; small neighbours share a chunk.

JSON_DEPTH, JSON_WHOLE, JSON_SMALL, JSON_FULL = 4, 300, 30, 300
#: Characters of a large value that are counted first.
JSON_AHEAD = 4000


def json_chunks(text: str) -> list[Piece]:
    """Every value of the document is in exactly one chunk, an object from paths to values. Text that isn't JSON raises ValueError; an empty object or array gives none."""
    out: list[Piece] = []
    pending: dict[str, tuple[object, str]] = {}
    held = 0  # tokens of pending's entries

    def flush() -> None:
        nonlocal held
        if pending:
            content = ", ".join([f"{_dumps(k)}: {v}" for k, (_, v) in pending.items()])
            out.append((f"{{{content}}}", "object" if len(pending) > 1 else _json_type(next(iter(pending.values()))[0]), len(out), ",".join(pending), []))
            pending.clear()
            held = 0

    def visit(path: str, value: object, depth: int) -> None:
        # tokens of parts add up: quotes and marks stand between them
        nonlocal held
        nested = isinstance(value, (dict, list)) and value
        whole = _dumps(value)
        if nested and depth < JSON_DEPTH and len(whole) > JSON_AHEAD and count(whole[:JSON_AHEAD]) > JSON_WHOLE:
            entry = JSON_WHOLE  # at least; no more is asked of what is cut anyway
        else:
            entry = count(_dumps(path)) + 1 + count(whole)
        size = entry + 2
        if nested and depth < JSON_DEPTH and size > JSON_WHOLE:
            for k, v in value.items() if isinstance(value, dict) else enumerate(value):
                visit(f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]", v, depth + 1)
            return
        if size > JSON_SMALL and nested or size > JSON_FULL:
            flush()
            pending[path] = value, whole
            flush()
            return
        if path in pending:  # two paths that read the same
            held -= count(_dumps(path)) + 1 + count(pending[path][1])
        pending[path] = value, whole
        held += entry
        if held + len(pending) + 1 >= JSON_FULL:
            flush()

    root = json.loads(text)
    if root not in ({}, []):
        visit("$", root, 0)
    flush()
    return out


_dumps = json.JSONEncoder(ensure_ascii=False).encode


def _json_type(v: object) -> str:
    return "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "leaf"


def merge_json(contents: list[str]) -> str:
    """Reconstruction of JSON chunks: one object, later keys win."""
    merged: dict = {}
    for c in contents:
        value = json.loads(c)
        merged.update(value if isinstance(value, dict) else {"value": value})
    return json.dumps(merged, indent=1, ensure_ascii=False)


# HTML: outermost sections, else meaningful divs, with enough tokens.

HTML_LEAST = 50
SECTIONS = ("article", "section", "main", "nav", "aside")
SKIPPED = ("script", "style", "noscript")
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Class names of layout frameworks, which say nothing about content, nor do those that begin with one.
LAYOUT = (
    "container", "wrapper", "row", "col", "col-", "row-", "span", "grid", "flex", "d-", "p-", "m-", "mt-", "mb-", "ml-", "mr-",
    "px-", "py-", "text-", "bg-", "border", "shadow", "rounded", "shadow-sm", "shadow-lg",
)


def meaningful(classes: str | None) -> bool:
    return any(not c.startswith(LAYOUT) for c in (classes or "").lower().split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: dict = {"tag": "", "class": None, "kids": []}
        self.stack, self.skip = [self.root], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif not self.skip:
            node = {"tag": tag, "class": dict(attrs).get("class"), "kids": []}
            self.stack[-1]["kids"].append(node)
            if tag not in VOID:
                self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif not self.skip:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i]["tag"] == tag:
                    del self.stack[i:]
                    break

    def handle_data(self, data: str) -> None:
        if not self.skip and data.strip():
            self.stack[-1]["kids"].append(data)


def _text(node: dict) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x.strip())
        else:
            todo += reversed(x["kids"])
    return "\n".join(out)


def html_chunks(text: str) -> list[Piece]:
    """Texts of outermost article, section, main, nav and aside elements, and of divs with a meaningful class, of 50 tokens or more; what lies outside is dropped."""
    tree = _Tree()
    tree.feed(text)
    tree.close()
    out: list[Piece] = []
    todo: list = [tree.root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            continue
        if node["tag"] in SECTIONS or node["tag"] == "div" and meaningful(node["class"]):
            content = _text(node)
            if count(content) >= HTML_LEAST:
                out.append((content, node["tag"], 0, node["class"], []))
                continue
        todo += reversed(node["kids"])
    return out


# Code: Python by its syntax tree, other languages by braces.

CODE_WHOLE = 300
_DEF = re.compile(r"^[ \t]*(?:(?:export|default|pub(?:\([a-z]+\))?|public|private|protected|static|async|unsafe)\s+)*(?:(function|fn|func)\s*(?:\([^)]*\)\s*)?\*?\s*(\w+)|(class|struct|enum|trait|interface|impl|type)\s+(?:<[^>]*>\s*)?(\w+)|const\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>)", re.M)


def _refs(node: ast.AST) -> list[str]:
    found = {x.func.id if isinstance(x.func, ast.Name) else x.func.attr for x in ast.walk(node) if isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute))}
    return sorted(found)


def python_chunks(text: str) -> list[Piece]:
    """Functions, classes (large ones as head and methods), import blocks, the docstring, and what lies between as bodies; comments above a node go with it. Text that doesn't parse is one body."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [(text, "body", 0, None, [])] if text.strip() else []
    lines = text.splitlines(keepends=True)
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line))
    out: list[Piece] = []
    done = 0

    def first_line(node: ast.stmt) -> int:
        at = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]]) - 1
        while at > done and lines[at - 1].lstrip().startswith("#"):
            at -= 1
        return at

    def emit(a: int, b: int, kind: str, name: str | None, refs: list[str]) -> None:
        content = "".join(lines[a:b])
        if content.strip():
            out.append((content.rstrip("\n"), kind, offsets[a], name, refs))

    def kind_of(i: int, node: ast.stmt) -> str:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            return "function"
        if isinstance(node, ast.ClassDef):
            return "class"
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            return "import_block"
        return "module_docstring" if i == 0 and isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str) else "body"

    i = 0
    while i < len(tree.body):
        node, kind = tree.body[i], kind_of(i, tree.body[i])
        j = i + 1
        if kind in ("import_block", "body"):
            while j < len(tree.body) and kind_of(j, tree.body[j]) == kind:
                j += 1
        a, b = first_line(node), tree.body[j - 1].end_lineno
        a = max(a, done)
        emit(done, a, "body", None, [])
        refs = sorted({r for n in tree.body[i:j] for r in _refs(n)})
        name = getattr(node, "name", None)
        methods = [n for n in getattr(node, "body", []) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))] if kind == "class" else []
        if methods and count("".join(lines[a:b])) > CODE_WHOLE:
            done = a
            starts = [max(first_line(m), a + 1) for m in methods]
            emit(a, starts[0], "class", name, [])
            for m, s, e in zip(methods, starts, [*starts[1:], b], strict=True):
                emit(s, e, "function", f"{name}.{m.name}", [name, *_refs(m)])
        elif kind == "function" and count("".join(lines[a:b])) > CODE_WHOLE and len(node.body) > 1:
            cut = node.body[0].lineno - 1 if node.body[0].lineno - 1 > a else a + 1
            emit(a, cut, "function", name, [])
            at = cut
            for k, stmt in enumerate(node.body):
                end = node.body[k + 1].lineno - 1 if k + 1 < len(node.body) else b
                if end > at and (count("".join(lines[at:end])) >= CODE_WHOLE or k + 1 == len(node.body)):
                    emit(at, end, "body", None, [name, *_refs(node)])
                    at = end
        else:
            emit(a, b, kind, name, refs)
        done, i = max(done, b), j
    emit(done, len(lines), "body", None, [])
    return out


def brace_chunks(text: str) -> list[Piece]:
    """Definitions of brace languages, from their line to the brace that closes them; what lies between as bodies. Braces in strings and comments are passed over."""
    out: list[Piece] = []
    clean = re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    at = 0

    def gap(a: int, b: int) -> None:
        part = text[a:b]
        if part.strip():
            imports = all(re.match(r"\s*(?:import|use|package|require|from|#include)\b", x) for x in part.splitlines() if x.strip())
            out.append((part.strip("\n"), "import_block" if imports else "body", a, None, []))

    for m in _DEF.finditer(clean):
        if m.start() < at:
            continue
        brace = clean.find("{", m.end())
        line_end = clean.find("\n", m.end())
        if brace < 0 or 0 <= clean.find(";", m.end()) < brace:
            end = line_end if line_end >= 0 else len(text)
        else:
            depth, end = 0, len(text)
            for b in re.finditer(r"[{}]", clean[brace:]):
                depth += 1 if b[0] == "{" else -1
                if not depth:
                    end = brace + b.end()
                    break
        gap(at, m.start())
        name = m[2] or m[4] or m[5]
        refs = sorted(set(re.findall(r"\b([A-Za-z_]\w*)\s*\(", clean[m.end() : end])) - {name, "if", "for", "while", "switch", "match", "return"})
        out.append((text[m.start() : end].strip("\n"), "class" if m[3] else "function", m.start(), name, refs))
        at = end
    gap(at, len(text))
    return out


def code_chunks(text: str, language: str = "python") -> list[Piece]:
    return python_chunks(text) if language == "python" else brace_chunks(text)


def dependencies(pieces: list[Piece]) -> list[list[int]]:
    """For each chunk the places of the chunks that define what it refers to; the last definition of a name counts; never itself, never for imports."""
    where = {p[3]: i for i, p in enumerate(pieces) if p[3]}
    return [sorted({where[r] for r in p[4] if r in where and where[r] != i}) if p[1] != "import_block" else [] for i, p in enumerate(pieces)]


SHELL_LINES = 3
_PROMPT = re.compile(PROMPT)


def shell_pieces(text: str) -> list[Piece]:
    """Commands with their output; those without any, and what stands before the first prompt, are dropped. Without prompts, paragraphs of three lines or more."""
    out: list[Piece] = []
    block: list[str] = []
    at = start = 0
    prompts = False
    for line in [*text.split("\n"), "$ "]:
        if _PROMPT.match(line):
            if len(block) > 1:
                out.append(("\n".join(block), "command", start, None, []))
            prompts |= at <= len(text)
            block, start = [line], at
        elif block:
            block.append(line)
        at += len(line) + 1
    if prompts:
        return out
    at = 0
    for part in text.split("\n\n"):
        if part.strip() and part.count("\n") + 1 >= SHELL_LINES:
            out.append((part, "paragraph", at, None, []))
        at += len(part) + 2
    return out


# Logs with state.

#: Levels in the order in which they are looked for, and the words that say so, in either case.
LEVELS = {"TRACE": "TRACE", "DEBUG": "DEBUG", "INFO": "INFO", "WARN": "WARN|WARNING", "ERROR": "ERROR", "FATAL": "FATAL|CRITICAL"}
_LEVEL_WORDS = {level: re.compile(rf"\b(?:{words})\b", re.IGNORECASE) for level, words in LEVELS.items()}
LOG_LINES = 20


def log_chunks(text: str) -> list[Piece]:
    """Events: a line opens a new one if its component or level differs, or if it has no level and the event has twenty lines; tracebacks and errors are named so."""
    out: list[Piece] = []
    event: dict | None = None
    at = 0

    def close() -> None:
        if event:
            kind = "traceback" if event["trace"] else "error" if event["level"] in ("ERROR", "FATAL", "CRITICAL") else "event"
            out.append(("\n".join(event["lines"]), kind, event["at"], event["component"], []))

    for line in text.split("\n"):
        level = next((x for x, words in _LEVEL_WORDS.items() if words.search(line)), None)
        m = re.match(r"([\w.]+):", line)
        component = m[1] if m else None
        trace = line.startswith(("Traceback", "  File ", "File "))
        if line.startswith("{"):
            try:
                tail = json.loads(line)
            except ValueError:
                tail = None
            if isinstance(tail, dict):
                level = str(tail["level"]).upper() if isinstance(tail.get("level"), str) else level
                component = tail["logger"] if isinstance(tail.get("logger"), str) else component
        if trace:
            if event:
                event["trace"] = True
                event["lines"].append(line)
        elif event and not (component and component != event["component"] or level and level != event["level"] or event["level"] and not level and len(event["lines"]) >= LOG_LINES):
            event["lines"].append(line)
            event["level"], event["component"] = level or event["level"], component or event["component"]
        elif line.strip():
            close()
            event = {"lines": [line], "level": level, "component": component, "trace": False, "at": at}
        at += len(line) + 1
    close()
    return out


# Mixed text: runs of lines of one format go to that format's parser.


def line_format(line: str) -> str:
    t = line.strip(" ")
    if t.startswith(("{", "[")):
        return "json"
    if re.match(r"<[A-Za-z!/]", t):
        return "html"
    if t.startswith("$ "):
        return "shell"
    if re.match(r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}", t) or re.search(r"\b(?:DEBUG|INFO|WARN|ERROR|FATAL)\b", t):
        return "log"
    if re.match(r"(?:def |class |import |from |function |const |let |var |return |fn |func |pub )", t):
        return "code"
    return "text"


def mixed_chunks(text: str) -> list[Piece]:
    """Chunks of each run, at its place in the text; indented and blank lines stay with the run before, and plain lines with a command, up to a blank one. A JSON run that doesn't parse is text."""
    runs: list[tuple[str, int, list[str]]] = []
    at = 0
    for line in text.split("\n"):
        fmt = line_format(line)
        output = runs and runs[-1][0] == "shell" and fmt == "text" and runs[-1][2][-1].strip()
        if runs and (fmt == runs[-1][0] or output or not line.strip() or line[:1] in " \t)}]" and runs[-1][0] in ("code", "json", "html")):
            runs[-1][2].append(line)
        else:
            runs.append((fmt, at, [line]))
        at += len(line) + 1
    out: list[Piece] = []
    for fmt, start, lines in runs:
        part = "\n".join(lines)
        try:
            pieces = {"json": json_chunks, "html": html_chunks, "log": log_chunks, "code": code_chunks, "shell": shell_pieces}.get(fmt, lambda _: [])(part)
        except ValueError:
            pieces = []
        out += [(c, k, start + p, n, r) for c, k, p, n, r in pieces] or ([(part, "paragraph", start, None, [])] if part.strip() else [])
    return out


PARSERS: dict[str, Callable[[str], list[Piece]]] = {"json": json_chunks, "html": html_chunks, "code": python_chunks, "braces": brace_chunks, "log": log_chunks, "mixed": mixed_chunks}


def parse_chunks(calls: DataFrame, parser: str, key: str = "call_id", text: str = "raw_output") -> DataFrame:
    """(key, CHUNK): chunks of each call by the named parser. Texts that the parser refuses (JSON that isn't) have no chunks: their calls pass unchanged."""
    kind = calls.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in CHUNK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = PARSERS[parser]
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    pieces = parse(t.as_py() or "")
                except (ValueError, RecursionError):
                    pieces = []
                rows += [(k, i, c, kind_, count(c), p, n, r) for i, (c, kind_, p, n, r) in enumerate(pieces)]
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [key, *names])

    return calls.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, {CHUNK}")


def reference_edges(chunks: DataFrame, key: str) -> DataFrame:
    """(key, src, dst) between ordinals: a chunk's references joined with the last definition of each name in its call."""
    defs = chunks.where("name is not null").groupBy(key, "name").agg(F.max("ord").alias("dst"))
    uses = chunks.where("chunk_type <> 'import_block'").select(key, F.col("ord").alias("src"), F.explode("refs").alias("name")).distinct()
    return uses.join(defs, [key, "name"]).where("src <> dst").select(key, "src", "dst").distinct()
