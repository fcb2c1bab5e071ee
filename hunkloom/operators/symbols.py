"""Symbols of source files: Python by its own parser, JavaScript and TypeScript by `scripts.declarations`.

Listed are imports, functions, classes with their methods (and classes within classes), interfaces and type aliases; nothing within
functions or blocks. Parameters are given as they are written: in Python plain, annotated and defaulted ones, but none
that are annotated *and* defaulted, nor starred ones without annotation; in JavaScript plain and rest ones; in TypeScript all. Functions
held by variables are listed if they are arrows or function expressions, generators like other functions.

A Python file with a syntax error is cut where a line begins a definition, an import or a decorator; the pieces that parse give their
symbols, of the others the head of the definition is read and its end is told by indentation. Scripts have an error if their brackets
aren't balanced. All symbols of a file with an error carry it; a file without symbols has one row with it.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scripts import declarations

SCHEMA = "file_path string, ord int, name string, kind string, start_line int, end_line int, docstring string, parameters array<string>, return_type string, decorators array<string>, parent string, is_exported boolean, error string"
_FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
#: What a file of another language and one with syntax errors say (fixed texts).
UNSUPPORTED, BROKEN = "Unsupported language: {}", "Source contains syntax errors"
_START = re.compile(r"(?:async\s+def|def|class|import|from)\b|@")
_HEAD = re.compile(r"\s*(?:async\s+)?(def|class)\s+(\w+)\s*(?:\[[^\]]*\])?\s*(\(?)")
_QUOTES = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")


def _row(name, kind, start, end, doc=None, params=(), returns=None, decorators=(), parent=None, exported=True) -> dict:
    return {"name": name, "kind": kind, "start_line": start, "end_line": end, "docstring": doc, "parameters": list(params), "return_type": returns, "decorators": list(decorators), "parent": parent, "is_exported": exported, "error": None}


class _Source:
    """A piece of a file that parses, beginning after `offset` lines."""

    def __init__(self, text: str, offset: int):
        self.lines, self.offset, self.tree = [x.encode() for x in text.split("\n")], offset, ast.parse(text)

    def between(self, a, b) -> str:
        """The text from where node a begins to where node b ends."""
        rows = self.lines[a.lineno - 1 : b.end_lineno]
        rows[-1] = rows[-1][: b.end_col_offset]
        rows[0] = rows[0][a.col_offset :]
        return b"\n".join(rows).decode()

    def parameters(self, a: ast.arguments) -> list[str]:
        plain = [*a.posonlyargs, *a.args]
        pairs = list(zip(plain, [None] * (len(plain) - len(a.defaults)) + a.defaults, strict=True))
        starred = [("*", a.vararg)] if a.vararg and a.vararg.annotation else []
        last = [("**", a.kwarg)] if a.kwarg and a.kwarg.annotation else []
        one = lambda p, d: self.between(p, d or p)
        kept = lambda pairs: [one(p, d) for p, d in pairs if not (p.annotation and d)]
        return kept(pairs) + [m + one(p, None) for m, p in starred] + kept(zip(a.kwonlyargs, a.kw_defaults, strict=True)) + [m + one(p, None) for m, p in last]

    def docstring(self, node) -> str | None:
        first = node.body[0]
        if not (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)):
            return None
        return self.between(first, first).strip('"').strip("'").strip()

    def visit(self, nodes, parent, out) -> None:
        for n in nodes:
            at = getattr(n, "lineno", 0) + self.offset, getattr(n, "end_lineno", 0) + self.offset
            if isinstance(n, ast.Import | ast.ImportFrom):
                out.append(_row(self.between(n, n), "import", *at, parent=parent))
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                marks = [self.between(d, d).split("(")[0] for d in n.decorator_list]
                if isinstance(n, ast.ClassDef):
                    out.append(_row(n.name, "class", *at, self.docstring(n), (), None, marks, None, not n.name.startswith("_")))
                    self.visit(n.body, n.name, out)
                else:
                    returns = self.between(n.returns, n.returns) if n.returns else None
                    out.append(_row(n.name, "method" if parent else "function", *at, self.docstring(n), self.parameters(n.args), returns, marks, parent, not n.name.startswith("_")))


def _head(lines: list[str], first: int) -> tuple[list[str], int]:
    """Parameters of the definition whose head begins in that line, and the head's last line, as far as brackets tell."""
    text = "\n".join(lines[first : first + 50])
    blank = _QUOTES.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    m = _HEAD.match(blank)
    if not m[3]:
        return [], first
    depth, begin, parts = 0, m.end(), []
    for at in range(m.end() - 1, len(blank)):
        depth += (blank[at] in "([{") - (blank[at] in ")]}")
        if depth == 0 or (depth == 1 and blank[at] == ","):
            parts.append(text[begin:at].strip())
            begin = at + 1
            if depth == 0:
                break
    else:
        return [], first
    if m[1] == "class":
        return [], first + text.count("\n", 0, begin)
    keep = lambda p: p and p not in ("/", "*") and not (":" in p and re.search(r"=(?!=)", p)) and not (p[0] == "*" and ":" not in p)
    return [p for p in parts if keep(p)], first + text.count("\n", 0, begin)


def _recover(lines: list[str], clear: list[str], low: int, high: int, indent: int, parent: str | None, out: list[dict]) -> None:
    """Symbols of the lines [low, high) at an indentation, piece by piece; `clear` are the lines without what quotes hold."""
    starts = [i for i in range(low, high) if len(clear[i]) - len(clear[i].lstrip()) == indent and _START.match(clear[i].lstrip())]
    starts = [i for k, i in enumerate(starts) if not k or not lines[starts[k - 1]].lstrip().startswith("@")]  # decorators belong to what follows
    for first, stop in zip(starts, [*starts[1:], high], strict=False):
        try:
            piece = _Source("\n".join(x[indent:] if not x[:indent].strip() else x for x in lines[first:stop]), first)
            piece.visit(piece.tree.body, parent, out)
            continue
        except (SyntaxError, ValueError):
            pass
        marks = []
        while first < stop and lines[first].lstrip().startswith("@"):
            marks.append(lines[first].strip()[1:].split("(")[0])
            first += 1
        m = _HEAD.match(lines[first]) if first < stop else None
        if not m:
            continue
        params, inside = _head(lines, first)
        last, end = inside, inside + 1
        while end < stop and (not clear[end].strip() or len(clear[end]) - len(clear[end].lstrip()) > indent):
            last = end if clear[end].strip() else last
            end += 1
        own = not m[2].startswith("_")
        if m[1] == "class":
            out.append(_row(m[2], "class", first + 1, last + 1, None, (), None, marks, None, own))
            body = [len(x) - len(x.lstrip()) for x in clear[inside + 1 : last + 1] if x.strip()]
            if body:
                _recover(lines, clear, inside + 1, last + 1, body[0], m[2], out)
        else:
            out.append(_row(m[2], "method" if parent else "function", first + 1, last + 1, None, params, None, marks, parent, own))


def python_symbols(source: str) -> list[dict]:
    """Symbols in the order of the file; with a syntax error those of the pieces, and the error."""
    out: list[dict] = []
    try:
        whole = _Source(source, 0)
        whole.visit(whole.tree.body, None, out)
        return out
    except (SyntaxError, ValueError):
        lines = source.replace("\t", "    ").split("\n")
        clear = _QUOTES.sub(lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if m[0][0] != "#" else " " * len(m[0]), "\n".join(lines)).split("\n")
        _recover(lines, clear, 0, len(lines), 0, None, out)
        return [s | {"error": BROKEN} for s in out] or [dict.fromkeys(_FIELDS) | {"error": BROKEN}]


def script_symbols(source: str, typed: bool = False) -> list[dict]:
    found, balanced = declarations(source, typed)
    rows = [_row(None, None, 0, 0) | s for s in found]
    return rows if balanced else [s | {"error": BROKEN} for s in rows] or [dict.fromkeys(_FIELDS) | {"error": BROKEN}]


def file_symbols(language: str | None, content: str | None) -> list[dict]:
    if language == "python":
        return python_symbols(content or "")
    if language in ("javascript", "typescript"):
        return script_symbols(content or "", language == "typescript")
    return [dict.fromkeys(_FIELDS) | {"error": UNSUPPORTED.format(language)}]


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (file_path, language, content), each with its file's error; files of other languages have a row with an error only."""

    def run(batches):
        for pdf in batches:
            rows = [{**s, "file_path": path, "ord": k} for path, language, content in zip(pdf.file_path, pdf.language, pdf.content, strict=True) for k, s in enumerate(file_symbols(language, content))]
            yield pd.DataFrame(rows, columns=_FIELDS)

    return files.select("file_path", "language", "content").mapInPandas(run, SCHEMA)


def chunk_symbols(language: Column, content: Column) -> Column:
    """Of each file the symbols that chunks are cut by: those outside classes, without imports; none of a file with an error."""

    @F.pandas_udf("array<struct<name string, kind string, start_line int, end_line int>>")
    def run(languages: pd.Series, contents: pd.Series) -> pd.Series:
        files = (file_symbols(x, y) for x, y in zip(languages, contents, strict=True))
        keys = ("name", "kind", "start_line", "end_line")
        return pd.Series([[{k: s[k] for k in keys} for s in found if s["error"] is None and s["parent"] is None and s["kind"] != "import"] for found in files], dtype=object)

    return run(language, content)


def of_kind(found: DataFrame, kind: str) -> DataFrame:
    """Symbols of one kind."""
    return found.where(F.col("kind") == kind)


def analysis(found: DataFrame) -> DataFrame:
    """One row a file: its functions, classes and imports by name, in order, numbers of symbols, and errors."""
    names = lambda *kinds: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("ord", "name")))), lambda x: x["name"])
    return found.groupBy("file_path").agg(names("function", "method").alias("functions"), names("class").alias("classes"), names("import").alias("imports"), F.count_if(F.col("kind").isNotNull() & (F.col("kind") != "import")).alias("n_symbols"), F.max("error").alias("error"))
