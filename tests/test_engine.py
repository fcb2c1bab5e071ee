"""Goldens and properties of the review engine, and its queries against DuckDB."""

import base64
import hashlib
import hmac
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hunkloom.functions import derive, providers
from hunkloom.operators import chunking, decision, diff, patches, prompts, security, signals, symbols, vectors
from hunkloom.plans.catalog import CATALOG, ORACLES
from hunkloom.sources import landed
from hunkloom.streaming import webhooks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FILES = "pr_id string, file_ord long, filename string, status string, additions int, deletions int, patch string"
SAMPLE = "@@ -1,5 +1,7 @@\n import os\n+import sys\n \n def main():\n-    pass\n+    x = 1\n+    return x\n # end\n"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_duckdb(spark, duck, name):
    df = CATALOG[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted([plain(r[i]) for i in at] for r in cursor.fetchall())
    assert sorted([plain(x) for x in r] for r in df.select(columns).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def files(spark, *rows):
    return spark.createDataFrame([("p", i, f, s, a, d, p) for i, (f, s, a, d, p) in enumerate(rows)], FILES)


def test_sample_diff(spark):
    got = diff.parse_patches(files(spark, ("a.py", "modified", 3, 1, SAMPLE))).orderBy("pos").collect()
    assert [(r.pos, r.kind, r.old_line, r.new_line) for r in got] == [(1, "hunk_header", None, None), (2, "context", 1, 1), (3, "added", None, 2), (4, "context", 2, 3), (5, "context", 3, 4), (6, "removed", 4, None), (7, "added", None, 5), (8, "added", None, 6), (9, "context", 5, 7), (10, "context", 6, 8)]


def test_positions_count_lines_of_no_kind(spark):
    patch = "ignored\n@@ -3 +4 @@ f\n-a\n\\ No newline at end of file\n+b\n?odd\n@@ -9,2 +10,3 @@\n x"
    got = diff.parse_patches(files(spark, ("a", "modified", 1, 1, patch), ("b", None, None, None, None), ("c", "added", 0, 0, ""))).orderBy("pos").collect()
    assert [(r.pos, r.hunk_no, r.kind, r.old_line, r.new_line) for r in got] == [(1, 1, "hunk_header", None, None), (2, 1, "removed", 3, None), (4, 1, "added", None, 4), (6, 2, "hunk_header", None, None), (7, 2, "context", 9, 10)]


def test_signals_of_a_small_change(spark):
    body = "\n".join(["@@ -1,9 +1,9 @@", "-except ValueError:", "-raise Error", "-if x is None", "+# TODO later", "+except:", "+# if a ", "+# for b ", "+# def c ", " keep"])
    f = files(spark, ("src/auth/login.py", "modified", 300, 250, body), ("x.py", "removed", 0, 9, body), ("settings.yml", "modified", 6, 0, "@@ -0,0 +1,1 @@\n+a.b"))
    lines = diff.parse_patches(f)
    got = {(r.filename, r.signal_type): r.line_number for r in signals.signals(f, lines).collect()}
    a = "src/auth/login.py"
    assert got == {("(entire PR)", "large_change"): None, (a, "large_file_change"): None, (a, "error_handling_removed"): 1, (a, "null_check_removed"): 3, (a, "todo_added"): 1, (a, "commented_code"): 1, (a, "broad_exception"): 2, (a, "sensitive_area"): None, ("settings.yml", "config_change"): None}
    p = signals.predict(f, lines).first()
    assert p.risk_score <= 0.5625 and p.high_risk_files == [a, "settings.yml"] and len(p.recommendations) == 5
    legacy = signals.signals(f, diff.parse_patches(files(spark, ("d", "modified", 1, 1, "@@ -5,1 +5,0 @@\n-x.y"))), legacy_null_regex=True)
    assert legacy.where("signal_type = 'null_check_removed'").count() == 1


def test_no_signals(spark):
    f = files(spark, ("a.go", "modified", 1, 0, "@@ -1 +1 @@\n+x"))
    r = signals.predict(f, diff.parse_patches(f)).first()
    assert (r.risk_score, r.risk_level, r.recommendations, r.high_risk_files) == (0.0, "low", [signals.NO_ADVICE], [])


def test_derivations(spark):
    rows = [("a/Dockerfile", "docker", ""), ("Makefile", "make", ""), ("x.TSX", "typescript", "TSX"), ("d.e/f", None, "e/f"), ("README.MD", "markdown", "MD")]
    got = spark.createDataFrame(rows, "p string, l string, e string").select("*", derive.language(F.col("p")).alias("x"), derive.extension(F.col("p")).alias("y")).collect()
    assert all(r.x == r.l and r.y == r.e for r in got)
    assert spark.range(1).select(derive.hashed_id("r:", F.lit("p"), ":", F.lit(1), "-", F.lit(2))).first()[0] == hashlib.sha256(b"r:p:1-2").hexdigest()[:16]


def test_secrets(spark):
    text = "\n".join(["password = 'hunter2hunter2'", "password = 'example-12345'", "  key ghp_" + "a" * 36 + "  ", "Authorization: Bearer abc.def", "latest password = 'longenough1'"])
    f = spark.createDataFrame([("a.py", text), ("b.md", text)], "filename string, content string")
    got = security.scan_secrets(f, []).collect()
    assert [(r.line_number, r.rule_id) for r in sorted(got, key=lambda r: r.line_number)] == [(1, "SEC-SECRETS-002"), (3, "SEC-SECRETS-004"), (4, "SEC-SECRETS-006")]


def test_tool_output(spark):
    raw = lambda s: spark.createDataFrame([(1, s)], "k int, output string")
    semgrep = json.dumps({"results": [{"check_id": "c", "path": "./a.js", "start": {"line": 3}, "extra": {"message": "m", "severity": "ERROR", "lines": " x ", "metadata": {"cwe": "CWE-1 critical", "fix": "f"}}}, {"path": "b", "extra": {"metadata": {"cwe": ["CWE-7"], "fix": "f", "references": ["r"]}}}]})
    got = security.parse_semgrep(raw(semgrep), ["k"]).collect()
    assert [(r.file_path, r.severity, r.cwe_id, r.remediation) for r in got] == [("a.js", "critical", "C", ""), ("b", "medium", "CWE-7", "f")]
    for parse in (security.parse_bandit, security.parse_semgrep, security.parse_ruff, security.parse_eslint, security.parse_mypy):
        assert parse(raw("no json"), ["k"]).count() == 0 and parse(raw(None), ["k"]).count() == 0
    assert security.parse_bandit(raw('log {"results": [{"issue_severity": "HIGH", "issue_confidence": "HIGH", "filename": "./x.py"}]}'), ["k"]).first().severity == "critical"


def test_parse_output_and_decision(spark):
    ok = {"summary": "s", "decision": "approve", "confidence": 0.4, "file_reviews": [{"file_path": "a", "comments": [{"message": "m", "severity": "critical"}, {"message": "n"}]}]}
    rows = [(1, json.dumps(ok)), (2, "```json\n{}\n```"), (3, "not json"), (4, "```x```")]
    got = {r.i: r for r in decision.parse_output(spark.createDataFrame(rows, "i int, content string")).collect()}
    assert (got[1].decision, got[1].confidence, got[1].total_comments, got[1].comments[1].severity) == ("request_changes", 0.9, 2, "medium")
    assert (got[2].decision, got[2].confidence) == ("approve", 0.8)
    assert (got[3].parse_ok, got[3].decision, got[3].confidence) == (False, "comment", 0.3) and not got[4].parse_ok
    assert decision.parse_output(spark.createDataFrame(rows[2:3], "i int, content string"), legacy_approve=True).first().decision == "approve"


def test_chunks_cover_all_lines_and_end(spark):
    text = "\n".join("x" * 100 for _ in range(95))
    got = chunking.window_chunks(spark.createDataFrame([("r", "f", text), ("r", "g", " \n ")], "repo string, file_path string, content string")).orderBy("start_line").collect()
    assert got[0].start_line == 1 and got[-1].end_line == 95 and all(b.start_line == a.end_line - 4 for a, b in zip(got, got[1:], strict=False))


def test_symbols(spark):
    source = "import os\n\n@wraps(f)\ndef g(a, *b, c=1) -> int:\n    'doc'\n    def inner(): pass\n\nclass A:\n    class B: pass\n    async def _m(self): pass\nif 1:\n    def no(): pass\n"
    js = "import x from 'y';\nexport function f(a, b) {\n  if (a) { return '}' }\n}\nclass C {\n  m(x) {\n  }\n}\nexport const g = (z) => {\n}\ninterface I {\n}\ntype T = string;\n"
    rows = [("a.py", "python", source), ("b.ts", "typescript", js), ("c.go", "go", "x"), ("d.py", "python", "def (")]
    got = symbols.symbols(spark.createDataFrame(rows, "file_path string, language string, content string")).orderBy("file_path", "ord").collect()
    py = [(r.name, r.kind, r.start_line, r.end_line, r.parent) for r in got if r.file_path == "a.py"]
    assert py == [("import os", "import", 1, 1, None), ("g", "function", 4, 6, None), ("A", "class", 8, 10, None), ("B", "class", 9, 9, None), ("_m", "method", 10, 10, "A")]
    g = next(r for r in got if r.name == "g" and r.file_path == "a.py")
    assert g.docstring == "doc" and g.decorators == ["wraps"] and g.return_type == "int" and g.is_exported
    ts = [(r.name, r.kind, r.start_line, r.end_line) for r in got if r.file_path == "b.ts"]
    assert ts == [("import x from 'y';", "import", 1, 1), ("f", "function", 2, 4), ("C", "class", 5, 8), ("m", "method", 6, 7), ("g", "function", 9, 10), ("I", "interface", 11, 12), ("T", "type_alias", 13, 13)]
    assert all(r.error for r in got if r.file_path in ("c.go", "d.py"))


def test_patches(spark):
    comments = spark.createDataFrame([("p", "a.py", 0, 5, "bug", "high", "m", "fixed"), ("p", "a.py", 1, 99, "bug", "high", "m", "z"), ("p", "a.py", 2, 5, "testing", "low", "m", None), ("p", "gone", 3, 5, "bug", "high", "m", "z")], "pr_id string, filename string, ordinal int, line_number int, category string, severity string, message string, suggested_fix string")
    text = "".join(f"l{i}\n" for i in range(1, 11))
    made = patches.patches(comments, spark.createDataFrame([("p", "a.py", text)], "pr_id string, filename string, content string"))
    r = made.first()
    assert made.count() == 1 and (r.start_line, r.end_line, r.fixed_code) == (2, 8, "fixed\n") and r.unified_diff.startswith("--- a/a.py\n+++ b/a.py\n@@ -2,7 +2 @@\n")
    assert patches.combined(made).first().total_files_patched == 1


def test_vectors(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [-1.0, 0.0])], "id long, embedding array<double>")
    q = docs.where("id = 1").selectExpr("id AS query_id", "embedding AS query")
    got = vectors.search(q, docs, 4).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(1, 1.0), (3, 1.0), (2, 0.0), (4, 0.0)]
    assert vectors.delete(docs).count() == 4 and vectors.delete(docs, docs.where("id < 3")).count() == 2 and vectors.delete(docs, where=F.col("id") == 4).count() == 3


def test_providers(spark):
    df = spark.createDataFrame([("abc",), (None,), ("abc",)], "t string").select(providers.embed(F.col("t")).alias("e")).collect()
    assert df[0].e == df[2].e and len(df[1].e) == 64
    with pytest.raises(ValueError, match="unknown provider"):
        providers.embed(F.lit("x"), "none")


def test_related_code_and_messages(spark):
    assert spark.range(1).select(prompts.related_code(F.expr("CAST(array() AS array<struct<start_line:int,end_line:int,file_path:string,symbol_name:string,content:string>>)"))).first()[0].startswith("No related")
    t = spark.createDataFrame([(1, 0, "system", "a"), (1, 1, "system", "b"), (2, 0, "user", "u")], "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r for r in prompts.messages(t).collect()}
    assert got[1].system == "a\nb" and got[1].messages[0].content == "Please respond." and got[2].system == ""


def test_landed_sources(spark, tmp_path):
    for k, n in ((1, 100), (2, 3)):
        (tmp_path / f"page-{k}.json").write_text(json.dumps([{"filename": f"f{k}-{i}"} for i in range(n)]))
    assert landed.paged_files(spark, f"file://{tmp_path}").count() == 103
    (tmp_path / "c").mkdir()
    (tmp_path / "c/c.json").write_text(json.dumps({"path": "a", "encoding": "base64", "content": base64.b64encode("é\n".encode()).decode()}) + "\n" + json.dumps({"path": "b", "encoding": "none", "content": "x"}))
    assert {r.path: r.content for r in landed.contents(spark, str(tmp_path / "c")).collect()} == {"a": "é\n", "b": None}
    assert landed.default_standards(spark).count() == 8 and landed.tree(spark, str(tmp_path)).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    sign = lambda p: "sha256=" + hmac.new(b"k", p.encode(), hashlib.sha256).hexdigest()
    events = []
    for i, (event, action) in enumerate([("pull_request", "opened"), ("pull_request", "closed"), ("ping", None), ("pull_request", "opened"), ("push", None)]):
        p = json.dumps({"action": action, "pull_request": {"number": i}, "repository": {"full_name": "o/r"}})
        events.append({"delivery_id": f"d{0 if i == 3 else i}", "event": event, "signature": sign(p) if i != 4 else "sha256=00", "payload": p, "received_at": "2024-01-01T00:00:00Z"})
    os.makedirs(tmp_path / "in")
    (tmp_path / "in/e.json").write_text("\n".join(map(json.dumps, events)))
    stream = webhooks.once(webhooks.routed(webhooks.source(spark, str(tmp_path / "in")), "k"))
    webhooks.write(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out/batch=*"))
    batch = webhooks.once(webhooks.routed(spark.read.schema(webhooks.SCHEMA).json(str(tmp_path / "in")), "k"))
    assert sorted((r.delivery_id, r.route) for r in got.collect()) == sorted((r.delivery_id, r.route) for r in batch.collect()) == [("d0", "review"), ("d1", "ignored"), ("d2", "pong")]
    assert webhooks.routed(spark.read.schema(webhooks.SCHEMA).json(str(tmp_path / "in")), "").count() == 0
