"""Queries over whole records: stored reviews, posted reviews, findings and rules with all their columns, with DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, context, decision, diff, history, prompts, security
from ..sources import fixtures as fx
from .engine_queries import PLACED_SQL, SECRET_LINES_SQL, _bandit, _placed, _semgrep
from .store_queries import _BODY

Q, O = {}, {}


def query(name: str, sql: str):
    def add(f):
        Q[name], O[name] = f, sql
        return f

    return add


# ---------------------------------------------------------------- stored reviews

#: Finished reviews, one a pull request: decisions, severities and categories that are known, and some that aren't.
_REVIEW = {
    "repo": "concat('o/r', CAST(substr(pr_id, 3) AS INT) % 7)", "pr_number": "CAST(substr(pr_id, 3) AS INT)", "pr_title": "concat('change ', pr_id)", "head_sha": "md5(pr_id)", "author": "concat('user', CAST(substr(pr_id, 3) AS INT) % 5)",
    "decision": "CASE CAST(substr(pr_id, 3) AS INT) % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'request_changes' WHEN 2 THEN 'merge' END", "summary": "concat('summary of ', pr_id)",
}
_COMMENT = {
    "file_path": "filename", "line_number": "CAST(file_ord % 50 AS INT)", "severity": "CASE file_ord % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'weird' WHEN 3 THEN 'low' WHEN 4 THEN 'info' END",
    "category": "CASE file_ord % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'odd' WHEN 2 THEN 'naming' END", "message": "concat('m', file_ord)", "suggested_fix": "CASE WHEN file_ord % 5 = 0 THEN 'fix' END", "rule_id": "CASE WHEN file_ord % 3 = 0 THEN concat('R', file_ord) END",
}
_AS = lambda columns: ", ".join(f"{v} AS {k}" for k, v in columns.items())
_ID = "substr(sha256(concat(repo, '#', pr_number, '@', head_sha)), 1, 16)"
STORED_SQL = f"{fx.PR_FILES_SQL}, outs AS (SELECT *, {_AS(_REVIEW)} FROM (SELECT pr_id, count(*)::INT AS files_reviewed, sum(additions)::BIGINT AS lines_added, sum(deletions)::BIGINT AS lines_deleted FROM pr_files GROUP BY pr_id))"


def _outputs(spark, sf_dir):
    files = fx.pr_files(spark, sf_dir)
    comments = F.transform(F.array_sort(F.collect_list(F.struct("file_ord", F.expr(f"struct({_AS(_COMMENT)})").alias("c")))), lambda x: x["c"])
    each = files.groupBy("pr_id").agg(F.count("*").cast("int").alias("files_reviewed"), F.sum("additions").alias("lines_added"), F.sum("deletions").alias("lines_deleted"), comments.alias("comments"))
    return each.selectExpr("*", *(f"{v} AS {k}" for k, v in _REVIEW.items()), "CAST(files_reviewed / 2 AS DOUBLE) AS duration_seconds", "files_reviewed * 100 AS llm_tokens_used")


def _known(spark):
    return spark.range(4).selectExpr("concat('id', id) AS id", "concat('o/r', id) AS full_name", "CAST(id * 10 AS INT) AS total_reviews")


@query("k04_repositories", f"WITH {STORED_SQL}, k AS (SELECT concat('id', range) AS id, concat('o/r', range) AS full_name, (range * 10)::INT AS total_reviews FROM range(4)), n AS (SELECT repo AS full_name, count(*) AS n FROM outs GROUP BY repo) SELECT coalesce(id, substr(sha256(full_name), 1, 16)) AS id, full_name, (coalesce(total_reviews, 0) + coalesce(n, 0))::INT AS total_reviews FROM k FULL JOIN n USING (full_name)")
def _(spark, sf_dir):
    return history.counted_repositories(_known(spark), _outputs(spark, sf_dir))


@query("k04_review_rows", f"WITH {STORED_SQL} SELECT {_ID} AS id, CASE WHEN pr_number % 7 < 4 THEN concat('id', pr_number % 7) ELSE substr(sha256(repo), 1, 16) END AS repository_id, pr_number, pr_title, head_sha, author, 'completed' AS status, nullif(decision, 'merge') AS decision, summary, files_reviewed, lines_added, lines_deleted, files_reviewed / 2.0::DOUBLE AS duration_seconds, files_reviewed * 100 AS llm_tokens_used FROM outs")
def _(spark, sf_dir):
    outputs = _outputs(spark, sf_dir)
    return history.stored_reviews(outputs, history.counted_repositories(_known(spark), outputs))


@query("k04_comment_rows", f"WITH {STORED_SQL}, c AS (SELECT {_ID} AS review_id, row_number() OVER (PARTITION BY pr_id ORDER BY file_ord) - 1 AS ordinal, f.* FROM outs JOIN (SELECT pr_id, file_ord, {_AS(_COMMENT)} FROM pr_files) f USING (pr_id)) SELECT substr(sha256(concat(review_id, ':', ordinal)), 1, 16) AS id, review_id, ordinal::INT AS ordinal, file_path, line_number, CASE WHEN severity IN ('critical', 'high', 'low', 'info') THEN severity ELSE 'medium' END AS severity, CASE WHEN category IN ('security', 'naming') THEN category ELSE 'best_practice' END AS category, message, suggested_fix, rule_id FROM c")
def _(spark, sf_dir):
    return history.stored_comments(_outputs(spark, sf_dir))


# ---------------------------------------------------------------- posted reviews

_J = lambda text: f"replace(replace(replace({text}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n')"
_BODY_SQL = "concat(CASE severity WHEN 'high' THEN '⚠️' WHEN 'low' THEN '💡' ELSE '🚨' END, ' **', upper(severity), '** (bug)', chr(10), chr(10), message, CASE WHEN fix IS NULL THEN '' ELSE concat(chr(10), chr(10), '```suggestion', chr(10), fix, chr(10), '```') END)"


@query("k07_review_payloads", f"""WITH {PLACED_SQL}, p AS (SELECT pr_id, CAST(substr(pr_id, 3) AS INT) AS k FROM (SELECT DISTINCT pr_id FROM pr_files)),
i AS (SELECT pr_id, count(*)::INT AS n, string_agg(concat('{{"path":"', filename, '","position":', position, ',"body":"', {_J(_BODY_SQL)}, '"}}'), ',' ORDER BY substr(message, 2)::BIGINT) AS items FROM placed GROUP BY pr_id)
SELECT pr_id, concat('{{"body":"', {_J("concat('## 🤖 Automated Code Review', chr(10), chr(10), 'summary of ', pr_id, CASE WHEN k % 3 > 0 THEN concat(chr(10), chr(10), '📦 Generated ', k % 3, ' auto-fix patches.') ELSE '' END)")}, '","event":"', CASE k % 4 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END, '"', CASE WHEN n > 0 THEN concat(',"comments":[', items, ']') ELSE '' END, '}}') AS payload, coalesce(n, 0) AS n_comments FROM p LEFT JOIN i USING (pr_id)""")
def _(spark, sf_dir):
    k = F.substring("pr_id", 3, 9).cast("int")
    reviews = fx.pr_files(spark, sf_dir).select("pr_id").distinct().select("pr_id", F.concat(F.lit("summary of "), "pr_id").alias("summary"), F.expr(_REVIEW["decision"]).alias("decision"), (k % 3).alias("n_patches"))
    return decision.review_payloads(reviews, _placed(spark, sf_dir).withColumn("ordinal", F.expr("CAST(substr(message, 2) AS BIGINT)")))


@query("k08_comment_payloads", f"WITH {fx.PR_FILES_SQL} SELECT pr_id, file_ord, CASE WHEN file_ord % 3 = 0 THEN concat('{{\"body\":\"b', file_ord, '\"}}') ELSE concat('{{\"body\":\"b', file_ord, '\",\"commit_id\":\"', md5(pr_id), '\",\"path\":\"', filename, '\",\"position\":', file_ord % 9, '}}') END AS payload FROM pr_files")
def _(spark, sf_dir):
    rows = fx.pr_files(spark, sf_dir).select("pr_id", "file_ord", F.concat(F.lit("b"), "file_ord").alias("body"), F.md5("pr_id").alias("head_sha"), F.when(F.col("file_ord") % 3 != 0, F.col("filename")).alias("filename"), (F.col("file_ord") % 9).alias("position"))
    return context.comment_payload(rows).select("pr_id", "file_ord", "payload")


# ---------------------------------------------------------------- findings, answers, headers and rules with all columns

_TOOLS = f"""{SECRET_LINES_SQL}, {fx.COMMENTS_SQL}, base AS (SELECT *, CASE severity WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS level FROM review_comments),
all_found AS (SELECT file_ord AS review_id, file_path, line_number, 'critical' AS severity, 'medium' AS confidence, title, 'secrets' AS tool, rule_id, substr(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, 100) AS code_snippet FROM sf
  UNION ALL SELECT review_id, file_path, line_number, level, CASE WHEN severity = 'critical' THEN 'high' ELSE 'low' END, message, 'bandit', coalesce(rule_id, ''), concat('code ', message) FROM base
  UNION ALL SELECT review_id, file_path, line_number, level, 'medium', message, 'semgrep', category, message FROM base)"""
_COLUMNS = ["review_id", "file_path", "line_number", "severity", "confidence", "title", "tool", "rule_id", "code_snippet"]


def _scanned(spark, sf_dir):
    return fx.secret_files(spark, sf_dir).withColumn("review_id", F.col("file_ord")), _bandit(spark, sf_dir), _semgrep(spark, sf_dir), ["review_id"]


@query("u01_all_findings", f"WITH {_TOOLS} SELECT * FROM all_found")
def _(spark, sf_dir):
    return security.scan(*_scanned(spark, sf_dir)).select(_COLUMNS)


@query("x13_findings", f"WITH {_TOOLS} SELECT * FROM all_found WHERE tool <> 'bandit' OR review_id IN (SELECT doc_id FROM documents WHERE doc_id % 8 = 0)")
def _(spark, sf_dir):
    return security.scan_by_language(*_scanned(spark, sf_dir)).select(_COLUMNS)


_SAID = {"stdout": "CASE WHEN event_id % 3 <> 0 THEN concat('out ', props) END", "stderr": "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('err ', event_type) END", "exit_code": "CAST(event_id % 5 AS INT)", "timed_out": "CASE event_id % 7 WHEN 0 THEN true WHEN 1 THEN false END"}


@query("r19_run_output", f"SELECT event_id, concat_ws(chr(10), nullif(stdout, ''), nullif(stderr, '')) AS output, exit_code = 0 AND NOT coalesce(timed_out, false) AS success FROM (SELECT event_id, {_AS(_SAID)} FROM events)")
def _(spark, sf_dir):
    runs = fx.table(spark, sf_dir, "events").selectExpr("event_id", *(f"{v} AS {k}" for k, v in _SAID.items()))
    return runs.select("event_id", security.run_output(F.col("stdout"), F.col("stderr")).alias("output"), security.run_succeeded(F.col("exit_code"), F.col("timed_out")).alias("success"))


@query("p21_comments", f"""WITH {fx.COMMENTS_SQL} SELECT review_id, file_path, line_number, severity, category, message, suggested_fix, rule_id FROM (
  SELECT review_id, file_path, line_number, CASE WHEN line_number % 3 = 0 THEN 'medium' ELSE severity END AS severity, CASE WHEN line_number % 2 = 0 THEN 'best_practice' ELSE category END AS category, CASE WHEN line_number % 5 = 0 THEN '' ELSE message END AS message, CASE WHEN line_number % 4 = 1 THEN 'fix' END AS suggested_fix, rule_id FROM review_comments) WHERE review_id % 10 <> 0""")
def _(spark, sf_dir):
    """Answers with fields left out, as text, fenced, or unreadable: their comments with the defaults of what is missing."""
    c, n = fx.review_comments(spark, sf_dir), F.col("line_number")
    item = F.struct("file_path", "line_number", F.when(n % 3 != 0, F.col("severity")).alias("severity"), F.when(n % 2 != 0, F.col("category")).alias("category"), F.when(n % 5 != 0, F.col("message")).alias("message"), F.when(n % 4 == 1, "fix").alias("suggested_fix"), "rule_id")
    files = c.groupBy("review_id", "file_path").agg(F.collect_list(item).alias("comments")).groupBy("review_id").agg(F.to_json(F.struct(F.collect_list(F.struct("file_path", "comments")).alias("file_reviews"))).alias("j"))
    said = files.select("review_id", F.when(F.col("review_id") % 10 == 0, F.concat(F.lit("no "), "j")).when(F.col("review_id") % 10 == 1, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).otherwise(F.col("j")).alias("content"))
    return decision.parse_output(said).select("review_id", F.explode("comments").alias("c")).select("review_id", "c.*")


@query("r11_pr_headers", f"""WITH {fx.PR_FILES_SQL}, t AS (SELECT pr_id, count(*) AS n, sum(additions) AS a, sum(deletions) AS d, min(file_ord) AS first FROM pr_files GROUP BY pr_id)
SELECT pr_id, md5(concat('## Pull Request: ', source, '#', substr(pr_id, 3), chr(10), '**Title:** ', substr(text, 1, 40), chr(10), '**Author:** ', lang, chr(10), '**Branch:** b', first, ' → main', chr(10), '**Files Changed:** ', n, chr(10), '**Lines:** +', a, ' -', d, chr(10),
  CASE WHEN first % 3 > 0 AND text <> '' THEN concat(chr(10), '**Description:**', chr(10), substr(text, 1, 2000), chr(10)) ELSE '' END, CASE WHEN first % 2 = 1 THEN concat('**Labels:** ', lang, ', ', source, chr(10)) ELSE '' END)) AS header_md5 FROM t JOIN documents ON doc_id = first""")
def _(spark, sf_dir):
    t = diff.pr_totals(fx.pr_files(spark, sf_dir)).join(fx.pr_files(spark, sf_dir).groupBy("pr_id").agg(F.min("file_ord").alias("doc_id")), "pr_id").join(fx.table(spark, sf_dir, "documents"), "doc_id")
    p = t.selectExpr("pr_id", "source AS repo", "substring(pr_id, 3) AS pr_number", "substring(text, 1, 40) AS title", "lang AS author", "concat('b', doc_id) AS head_branch", "'main' AS base_branch", "files_changed AS files", "total_additions AS additions", "total_deletions AS deletions", "CASE WHEN doc_id % 3 > 0 THEN text END AS description", "CASE WHEN doc_id % 2 = 1 THEN array(lang, source) END AS labels")
    return p.select("pr_id", F.md5(prompts.header(p)).alias("header_md5"))


_TITLE = "concat(CASE WHEN doc_id % 2 = 0 THEN concat('SEC-', doc_id, ': ') ELSE '' END, 'About ', lang)"
_MARKDOWN = f"concat('intro', chr(10), '## ', {_TITLE}, chr(10), '<!-- severity: high -->', chr(10), {_BODY}, chr(10), '```', chr(10), 'code of ', source, chr(10), '```', chr(10), '## Last', chr(10), '<!-- tags: a,b -->', chr(10), 'end ', {_BODY})"


@query("p02_rules_of_texts", f"""WITH d AS (SELECT doc_id, lang, source, {_BODY} AS body FROM documents)
SELECT doc_id, 1 AS section, CASE WHEN doc_id % 2 = 0 THEN concat('SEC-', doc_id) ELSE 'RULE-001' END AS rule_id, concat('About ', lang) AS title, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS description, 'general' AS category, 'high' AS severity, NULL::VARCHAR AS language, concat('code of ', source) AS examples, '' AS tags FROM d
UNION ALL SELECT doc_id, 2, 'RULE-002', 'Last', regexp_replace(concat('end ', body), '^\\s+|\\s+$', '', 'g'), 'general', 'medium', NULL, NULL, 'a|b' FROM d""")
def _(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_MARKDOWN} AS content")
    return chunking.parse_standards(docs, "doc_id").withColumn("tags", F.array_join("tags", "|"))
