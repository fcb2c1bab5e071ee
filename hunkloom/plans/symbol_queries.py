"""Queries over symbols and chunks of source files, with DuckDB statements.

The files are made of the texts of `documents`, in six shapes: Python, Python with syntax errors, JavaScript, TypeScript, a
language without parser, and a script that is never closed. A text stands in a docstring, a template literal or a comment, so its lines move what
comes after it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, symbols
from ..sources import fixtures as fx

Q, O = {}, {}


def query(name: str, sql: str):
    def add(f):
        Q[name], O[name] = f, sql
        return f

    return add


#: Sources by shape; `§` is the document's id and `@@` its text.
_SHAPES = [
    ("py", "python", 'import os\nfrom a import (\n    b,\n)\n@deco(1)\ndef f§(a, b: int, c=2, d: int = 3, *args, **kw: str) -> list[int]:\n    """@@"""\n    return a\nclass C§(Base):\n    x = 1\n    async def _m(self):\n        pass\n'),
    ("py", "python", 'import os\ndef before§(a):\n    """@@"""\n    return a\ndef broken§(x, y: str, z=")",\n           q=3):\n    if x = 1:\n        return\nclass E§:\n    def ok(self):\n        return 1\n    def bad(self):\n        retrun x y\ndef after§():\n    pass\n'),
    ("js", "javascript", "import { a,\n  b } from './x';\n// function no() {}\nexport async function f§(\n  a, b = 1,\n  ...rest\n)\n{\n  return `@@ ${a({ b: `in` })} }`;\n}\nconst g§ = async function (x) {\n  return x / 2 /1;\n}, k = v => /[}]/.test(v);\nclass C§ extends B {\n  #p() { return '}' }\n  static async load(x)\n  {\n    return \"{\";\n  }\n}\n"),
    ("ts", "typescript", "import type { X } from './x';\nexport interface I§<T> extends B<{ a: 1 }> {\n  m(): void;\n}\ntype U§ =\n  | 'a'\n  | { b: number };\n@Injectable({ x: 1 })\nexport class S§<T> implements I {\n  constructor(private readonly h: H, x?: Map<string, number>) {}\n  abstract foo(): void;\n  async find<K extends keyof T>(key: K, ...rest: any[]): Promise<{ a: T[K] }> {\n    return `@@`;\n  }\n}\nexport const fn§ = <T,>(a: T, b: number = 3): { ok: boolean } => ({ ok: true });\n"),
    ("go", "go", "package a\n// @@\nfunc main() {}\n"),
    ("js", "javascript", "function a§() { return 1 }\n/* @@ */\nconst broken = (x, {\n  y: [1,\nfunction lost() {\n"),
]
#: What the shapes hold: shape, name, kind, first and last line (with `n`, the line breaks of the text), parameters, parent, exported.
_HELD = [
    (0, "import os", "import", "1", "1", "", "", True), (0, "from a import (~    b,~)", "import", "2", "4", "", "", True), (0, "f§", "function", "6", "8 + n", "a|b: int|c=2|**kw: str", "", True), (0, "C§", "class", "9 + n", "12 + n", "", "", True), (0, "_m", "method", "11 + n", "12 + n", "self", "C§", False),
    (1, "import os", "import", "1", "1", "", "", True), (1, "before§", "function", "2", "4 + n", "a", "", True), (1, "broken§", "function", "5 + n", "8 + n", 'x|y: str|z=")"|q=3', "", True), (1, "E§", "class", "9 + n", "13 + n", "", "", True), (1, "ok", "method", "10 + n", "11 + n", "self", "E§", True), (1, "bad", "method", "12 + n", "13 + n", "self", "E§", True), (1, "after§", "function", "14 + n", "15 + n", "", "", True),
    (2, "import { a,~  b } from './x';", "import", "1", "2", "", "", False), (2, "f§", "function", "4", "10 + n", "a|...rest", "", True), (2, "g§", "function", "11 + n", "13 + n", "x", "", False), (2, "k", "function", "13 + n", "13 + n", "", "", False), (2, "C§", "class", "14 + n", "20 + n", "", "", False), (2, "load", "method", "16 + n", "19 + n", "x", "C§", False),
    (3, "import type { X } from './x';", "import", "1", "1", "", "", False), (3, "I§", "interface", "2", "4", "", "", True), (3, "U§", "type_alias", "5", "7", "", "", False), (3, "S§", "class", "9", "15 + n", "", "", True), (3, "constructor", "method", "10", "10", "private readonly h: H|x?: Map<string, number>", "S§", False), (3, "find", "method", "12", "14 + n", "key: K|...rest: any[]", "S§", False), (3, "fn§", "function", "16 + n", "16 + n", "a: T|b: number = 3", "", True),
    (4, None, None, "NULL", "NULL", "", "", None), (5, "a§", "function", "1", "1", "", "", False),
]
#: What a text may not hold where it stands, as character codes: double quote, dollar, asterisk, backslash, backtick, carriage return, NUL.
_BANNED = (34, 36, 42, 92, 96, 13, 0)


def _sql_text(value: str) -> str:
    """An expression for a text in either engine: quotes and breaks by their codes."""
    parts = []
    for line in value.split("\n"):
        parts.append(", chr(39), ".join(f"'{x}'" for x in line.split("'")))
    return "concat(" + ", chr(10), ".join(parts) + ")"


def _files() -> str:
    """File rows: doc_id, shape, repo, file_path, language, content, n (line breaks of the text)."""
    text = "coalesce(text, '')"
    for code in _BANNED[:-1]:
        text = f"replace({text}, chr({code}), '')"
    shape = lambda k: "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{s[k]}'" for i, s in enumerate(_SHAPES)) + " END"
    content = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {_sql_text(s[2])}" for i, s in enumerate(_SHAPES)) + " END"
    content = f"replace(replace({content}, '§', CAST(doc_id AS STRING)), '@@', t)".replace("replace(" + content + ", '§'", f"replace({content}, '§'")
    return f"SELECT doc_id, doc_id % 6 AS shape, 'org/r' AS repo, concat('s', doc_id, '.', {shape(0)}) AS file_path, {shape(1)} AS language, {content} AS content, length(t) - length(replace(t, chr(10), '')) AS n FROM (SELECT doc_id, {text} AS t FROM documents)"


_FILES = _files()
FILES_SQL = f"src AS ({_FILES})"
_QUOTED = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
_ROWS = " UNION ALL ".join(f"SELECT {s} AS shape, {i} AS i, {_QUOTED(name)} AS name, {_QUOTED(kind)} AS kind, {_QUOTED(p)} AS parameters, {_QUOTED(parent)} AS parent, {'NULL' if e is None else e}::BOOLEAN AS is_exported, '{a}' AS a, '{b}' AS b" for i, (s, name, kind, a, b, p, parent, e) in enumerate(_HELD))
_LINE = lambda c: f"(CASE WHEN {c} = 'NULL' THEN NULL ELSE string_split({c}, ' ')[1]::INT + CASE WHEN contains({c}, 'n') THEN n ELSE 0 END END)::INT"
_ERROR = f"CASE shape WHEN 1 THEN '{symbols.BROKEN}' WHEN 4 THEN '{symbols.UNSUPPORTED.format('go')}' WHEN 5 THEN '{symbols.BROKEN}' END"
SYMBOLS_SQL = f"""{FILES_SQL}, held AS ({_ROWS}),
sym AS (SELECT doc_id, shape, file_path, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS ord, replace(replace(name, '§', doc_id::VARCHAR), '~', chr(10)) AS name, kind, {_LINE("a")} AS start_line, {_LINE("b")} AS end_line,
  parameters, CASE WHEN parent <> '' THEN replace(parent, '§', doc_id::VARCHAR) END AS parent, is_exported, {_ERROR} AS error FROM src JOIN held USING (shape))"""


def source_files(spark, sf_dir):
    """Files of all shapes: repo, file_path, language, content."""
    docs = fx.table(spark, sf_dir, "documents")
    return spark.sql(_FILES.replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {docs}"), docs=docs).select("repo", "file_path", "language", "content")


@query("p07_symbols", f"WITH {SYMBOLS_SQL} SELECT file_path, ord, name, kind, start_line, end_line, parameters, parent, is_exported, error FROM sym")
def _(spark, sf_dir):
    found = symbols.symbols(source_files(spark, sf_dir))
    return found.select("file_path", "ord", "name", "kind", "start_line", "end_line", F.coalesce(F.array_join("parameters", "|"), F.lit("")).alias("parameters"), "parent", "is_exported", "error")


@query("f06_symbols_of_kind", f"WITH {SYMBOLS_SQL} SELECT file_path, name, start_line FROM sym WHERE kind = 'method'")
def _(spark, sf_dir):
    return symbols.of_kind(symbols.symbols(source_files(spark, sf_dir)), "method").select("file_path", "name", "start_line")


@query("p08_analysis", f"WITH {SYMBOLS_SQL} SELECT file_path, string_agg(name, '|' ORDER BY ord) FILTER (kind IN ('function', 'method')) AS functions, string_agg(name, '|' ORDER BY ord) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'import') AS n_imports, count(*) FILTER (kind <> 'import') AS n_symbols, max(error) AS error FROM sym GROUP BY file_path")
def _(spark, sf_dir):
    found = symbols.analysis(symbols.symbols(source_files(spark, sf_dir)))
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, "|")).alias(c)
    return found.select("file_path", joined("functions"), joined("classes"), F.size("imports").cast("long").alias("n_imports"), "n_symbols", "error")


#: Pieces that chunks are cut from, and their windows.
CHUNKS_SQL = f"""{SYMBOLS_SQL},
whole AS (SELECT *, string_split(content, chr(10)) AS all_lines FROM src),
pieces AS (SELECT w.file_path, w.language, s.name AS symbol_name, s.kind AS symbol_kind, s.start_line AS base, array_to_string(all_lines[s.start_line:s.end_line], chr(10)) AS body FROM whole w JOIN sym s USING (file_path) WHERE s.error IS NULL AND s.parent IS NULL AND s.kind <> 'import'
  UNION ALL SELECT file_path, language, NULL, NULL, 1, content FROM whole WHERE shape IN (1, 4, 5)),
sized AS (SELECT *, string_split(body, chr(10)) AS ls, len(string_split(body, chr(10))) AS m FROM pieces WHERE regexp_matches(body, '\\S')),
per AS (SELECT *, CASE WHEN symbol_name IS NOT NULL AND length(body) <= 2000 THEN greatest(m, 6) ELSE greatest(10, 2000 // greatest(1, length(body) // m)) END AS per FROM sized),
wins AS (SELECT *, unnest(range(0, (ceil(greatest(m - per, 0) / (per - 5)::DOUBLE) * (per - 5) + 1)::BIGINT, per - 5)) AS i FROM per),
chunks AS (SELECT file_path, language, symbol_name, symbol_kind, (base + i)::INT AS start_line, (base + least(i + per, m) - 1)::INT AS end_line, array_to_string(ls[i + 1:i + per], chr(10)) AS chunk, substr(sha256(concat('org/r:', file_path, ':', base + i, '-', base + least(i + per, m) - 1)), 1, 16) AS id FROM wins)"""


@query("p14_symbol_chunks", f"WITH {CHUNKS_SQL} SELECT file_path, symbol_name, symbol_kind, start_line, end_line, md5(chunk) AS chunk_md5, id FROM chunks")
def _(spark, sf_dir):
    return chunking.chunk_files(source_files(spark, sf_dir)).select("file_path", "symbol_name", "symbol_kind", "start_line", "end_line", F.md5("chunk").alias("chunk_md5"), "id")
