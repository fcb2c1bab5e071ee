"""Queries over secrets, tool output, history, decisions, chunks, standards, vectors, prompts and events, with DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import derive, providers
from ..operators import chunking, decision, diff, history, patches, prompts, security, vectors
from ..sources import fixtures as fx
from ..streaming import webhooks
from .review_queries import LINES_SQL, REVIEWABLE_SQL, lines_of

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


RC = f"{fx.REVIEWS_SQL}, {fx.COMMENTS_SQL}"

# ---------------------------------------------------------------- secrets

_SECRETS = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (p, t, r)) + ")" for p, t, r in security.SECRETS)
_PLACE = f"len(list_filter([{', '.join(repr(w) for w in security.PLACEHOLDERS)}], lambda w: contains(lower(line), w))) > 0"
_SUFFIX = " AND ".join(f"NOT suffix(filename, '{s}')" for s in security.SKIPPED_SUFFIXES)
SECRET_LINES_SQL = f"""{fx.SECRETS_SQL},
sl AS (SELECT file_ord, filename, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_number FROM secret_files WHERE {_SUFFIX}),
sp AS (SELECT * FROM (VALUES {_SECRETS}) p(pattern, title, rule_id)),
sf AS (SELECT file_ord, filename AS file_path, line_number, title, rule_id, line FROM sl JOIN sp ON regexp_matches(line, pattern) WHERE NOT ({_PLACE}))"""


@query("j09_secrets", f"WITH {SECRET_LINES_SQL} SELECT file_ord, file_path, line_number, title, rule_id, substr(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, 100) AS code_snippet FROM sf")
def _(spark, sf_dir):
    return security.scan_secrets(fx.secret_files(spark, sf_dir), ["file_ord"]).select("file_ord", "file_path", "line_number", "title", "rule_id", "code_snippet")


@query("f07_scannable", f"WITH {fx.SECRETS_SQL} SELECT filename FROM secret_files WHERE {_SUFFIX}")
def _(spark, sf_dir):
    return fx.secret_files(spark, sf_dir).where(security.scannable(F.col("filename"))).select("filename")


@query("f08_placeholder", f"WITH {fx.SECRETS_SQL}, l AS (SELECT file_ord, unnest(string_split(content, chr(10))) AS line FROM secret_files) SELECT file_ord, count(*) FILTER ({_PLACE}) AS placeholders FROM l GROUP BY file_ord")
def _(spark, sf_dir):
    return fx.secret_files(spark, sf_dir).select("file_ord", F.explode(F.split("content", "\n", -1)).alias("line")).groupBy("file_ord").agg(F.count_if(security.is_placeholder(F.col("line"))).alias("placeholders"))


@query("f09_critical_findings", f"WITH {fx.COMMENTS_SQL} SELECT review_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical' OR (severity = 'high' AND rule_id IS NULL)) AS is_critical FROM review_comments GROUP BY review_id")
def _(spark, sf_dir):
    c, s = fx.review_comments(spark, sf_dir), F.col("severity")
    confidence = F.when(F.col("rule_id").isNull(), "high").otherwise("medium")
    return c.groupBy("review_id").agg(F.count_if(s == "critical").alias("critical"), F.count_if(s == "high").alias("high"), F.count_if(security.is_critical(s, confidence)).alias("is_critical"))


@query("f18_blocking", f"WITH {fx.COMMENTS_SQL} SELECT review_id, count(*) FILTER (severity = 'critical') > 0 OR count(*) FILTER (severity = 'high') >= 2 AS has_blocking_issues, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'high') AS n_high FROM review_comments GROUP BY review_id")
def _(spark, sf_dir):
    return security.blocking(fx.review_comments(spark, sf_dir), "review_id")


@query("f16_file_kinds", f"WITH {fx.PR_FILES_SQL} SELECT pr_id, bool_or(suffix(filename, '.py')) AS has_python, bool_or(contains(lower(filename), 'test') OR contains(lower(filename), 'spec')) AS has_tests FROM pr_files GROUP BY pr_id")
def _(spark, sf_dir):
    f = fx.pr_files(spark, sf_dir).groupBy("pr_id").agg(F.collect_list("filename").alias("paths"))
    return f.select("pr_id", security.has_python_files(F.col("paths")).alias("has_python"), security.has_test_files(F.col("paths")).alias("has_tests"))


# ---------------------------------------------------------------- tool output, made from the comments and read back


def _raw(spark, sf_dir, item, wrap):
    """Tool output by review: `item` is a struct over comments, `wrap` makes a text of their array."""
    rows = fx.review_comments(spark, sf_dir).groupBy("review_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return rows.select("review_id", wrap(F.to_json("items")).alias("output"))


def _bandit(spark, sf_dir):
    item = F.struct(F.col("line_number"), F.when(F.col("severity").isin("critical", "high"), "HIGH").when(F.col("severity") == "medium", "MEDIUM").otherwise("LOW").alias("issue_severity"), F.when(F.col("severity") == "critical", "HIGH").otherwise("LOW").alias("issue_confidence"), F.col("message").alias("issue_text"), F.concat(F.lit("./"), "file_path").alias("filename"), F.col("rule_id").alias("test_id"), F.concat(F.lit("  code "), "message").alias("code"))
    return _raw(spark, sf_dir, item, lambda j: F.concat(F.lit("Run started\n{\"results\": "), j, F.lit("}")))


def _semgrep(spark, sf_dir):
    metadata = F.struct(F.array(F.concat(F.lit("CWE-"), F.col("line_number").cast("string"))).alias("cwe"), F.when(F.col("severity") == "critical", "HIGH").otherwise("LOW").alias("impact"), F.lit("MEDIUM").alias("confidence"), F.when(F.col("rule_id").isNotNull(), F.array(F.concat(F.lit("https://"), "rule_id"))).otherwise(F.array().cast("array<string>")).alias("references"))
    extra = F.struct(F.col("message"), F.when(F.col("severity").isin("critical", "high"), "ERROR").when(F.col("severity") == "medium", "WARNING").otherwise("INFO").alias("severity"), F.col("message").alias("lines"), metadata.alias("metadata"))
    return _raw(spark, sf_dir, F.struct(F.struct(F.col("line_number").alias("line")).alias("start"), F.col("category").alias("check_id"), F.col("file_path").alias("path"), extra.alias("extra")), lambda j: F.concat(F.lit("{\"results\": "), j, F.lit("}")))


@query("p16_bandit", f"""WITH {fx.COMMENTS_SQL} SELECT review_id, file_path, line_number, CASE severity WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN severity = 'critical' THEN 'high' ELSE 'low' END AS confidence, message AS title, coalesce(rule_id, '') AS rule_id, concat('code ', message) AS code_snippet FROM review_comments""")
def _(spark, sf_dir):
    return security.parse_bandit(_bandit(spark, sf_dir), ["review_id"]).select("review_id", "file_path", "line_number", "severity", "confidence", "title", "rule_id", "code_snippet")


@query("p17_semgrep", f"""WITH {fx.COMMENTS_SQL} SELECT review_id, file_path, line_number, CASE severity WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS severity,
  concat('CWE-', line_number) AS cwe_id, category AS rule_id, CASE WHEN rule_id IS NULL THEN '' ELSE concat('https://', rule_id) END AS remediation FROM review_comments""")
def _(spark, sf_dir):
    return security.parse_semgrep(_semgrep(spark, sf_dir), ["review_id"]).select("review_id", "file_path", "line_number", "severity", "cwe_id", "rule_id", "remediation")


def _ruff(spark, sf_dir):
    item = F.struct(F.struct(F.col("line_number").alias("row"), (F.col("line_number") * 2).alias("column")).alias("location"), F.col("file_path").alias("filename"), F.when(F.col("severity").isin("critical", "high"), F.concat(F.lit("E"), "rule_id")).otherwise(F.col("rule_id")).alias("code"), F.col("message"))
    return _raw(spark, sf_dir, item, lambda j: j)


def _eslint(spark, sf_dir):
    item = F.struct(F.concat(F.lit("/tmp/workspace/"), "file_path").alias("filePath"), F.array(F.struct(F.col("line_number").alias("line"), F.when(F.col("severity").isin("critical", "high"), 2).otherwise(1).alias("severity"), F.col("message"), F.col("rule_id").alias("ruleId"))).alias("messages"))
    return _raw(spark, sf_dir, item, lambda j: F.concat(F.lit("npm warn\n"), j))


def _mypy(spark, sf_dir):
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    line = F.concat("file_path", F.lit(":"), F.col("line_number").cast("string"), F.lit(": "), level, F.lit(": "), "message", F.lit("  "))
    rows = fx.review_comments(spark, sf_dir).groupBy("review_id").agg(F.sort_array(F.collect_list(line)).alias("l"))
    return rows.select("review_id", F.concat(F.array_join("l", "\n"), F.lit("\nFound errors")).alias("output"))


RUFF_SQL = "SELECT review_id, file_path, line_number AS line, line_number * 2 AS \"column\", CASE WHEN severity IN ('critical', 'high') AND rule_id IS NOT NULL THEN 'error' ELSE 'warning' END AS severity, message, coalesce(CASE WHEN severity IN ('critical', 'high') THEN 'E' || rule_id ELSE rule_id END, '') AS rule_id FROM review_comments"
MYPY_SQL = "SELECT review_id, file_path, line_number AS line, 0 AS \"column\", CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'info' END AS severity, message, '' AS rule_id FROM review_comments"
ESLINT_SQL = "SELECT review_id, file_path, line_number AS line, 0 AS \"column\", CASE WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END AS severity, message, coalesce(rule_id, '') AS rule_id FROM review_comments"


@query("p18_ruff", f"WITH {fx.COMMENTS_SQL} {RUFF_SQL}")
def _(spark, sf_dir):
    return security.parse_ruff(_ruff(spark, sf_dir), ["review_id"]).drop("tool")


@query("p19_mypy", f"WITH {fx.COMMENTS_SQL} {MYPY_SQL}")
def _(spark, sf_dir):
    return security.parse_mypy(_mypy(spark, sf_dir), ["review_id"]).drop("tool")


@query("p20_eslint", f"WITH {fx.COMMENTS_SQL} {ESLINT_SQL}")
def _(spark, sf_dir):
    return security.parse_eslint(_eslint(spark, sf_dir), ["review_id"]).drop("tool")


def _lint(spark, sf_dir):
    k = ["review_id"]
    return security.parse_ruff(_ruff(spark, sf_dir), k).unionByName(security.parse_mypy(_mypy(spark, sf_dir), k)).unionByName(security.parse_eslint(_eslint(spark, sf_dir), k))


@query("a12_lint_counts", f"WITH {fx.COMMENTS_SQL} SELECT review_id, count(*) FILTER (severity = 'error') AS error_count, count(*) FILTER (severity = 'warning') AS warning_count FROM ({RUFF_SQL} UNION ALL {MYPY_SQL} UNION ALL {ESLINT_SQL}) GROUP BY review_id")
def _(spark, sf_dir):
    return security.lint_counts(_lint(spark, sf_dir), "review_id")


@query("u02_lint_issues", f"WITH {fx.COMMENTS_SQL} SELECT tool, count(*) AS n FROM (SELECT 'ruff' AS tool FROM review_comments UNION ALL SELECT 'mypy' FROM review_comments UNION ALL SELECT 'eslint' FROM review_comments) GROUP BY tool")
def _(spark, sf_dir):
    return _lint(spark, sf_dir).groupBy("tool").agg(F.count("*").alias("n"))


@query("u01_findings", f"WITH {SECRET_LINES_SQL}, {fx.COMMENTS_SQL} SELECT 'secrets' AS tool, count(*) AS n FROM sf HAVING count(*) > 0 UNION ALL SELECT 'bandit', count(*) FROM review_comments UNION ALL SELECT 'semgrep', count(*) FROM review_comments")
def _(spark, sf_dir):
    files = fx.secret_files(spark, sf_dir).withColumn("review_id", F.col("file_ord"))
    return security.scan(files, _bandit(spark, sf_dir), _semgrep(spark, sf_dir), ["review_id"]).groupBy("tool").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- history

PROFILE_SQL = f"""{RC},
t AS (SELECT repository_id, author, count(*) AS total_prs_reviewed, count(*) FILTER (decision = 'approve') AS approved FROM reviews GROUP BY ALL),
cc AS (SELECT repository_id, author, category, count(*) AS n FROM review_comments JOIN reviews USING (review_id) GROUP BY ALL),
ci AS (SELECT repository_id, author, list(category ORDER BY n DESC, category)[1:5] AS common_issues, sum(n)::BIGINT AS total_comments FROM cc GROUP BY ALL),
profiles AS (SELECT t.repository_id, t.author, total_prs_reviewed, approved::DOUBLE / total_prs_reviewed AS approval_rate, coalesce(common_issues, []) AS common_issues, coalesce(total_comments, 0) AS total_comments, coalesce(total_comments, 0)::DOUBLE / total_prs_reviewed AS avg_issues_per_pr FROM t LEFT JOIN ci USING (repository_id, author)),
patterns AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY repository_id ORDER BY frequency DESC, category, file_path, message))::INT AS rank FROM (SELECT repository_id, category, file_path, message, count(*) AS frequency FROM review_comments JOIN reviews USING (review_id) GROUP BY ALL)) WHERE rank <= 10 AND frequency >= 2),
fps AS (SELECT repository_id, rule_id, count(*) AS n FROM review_comments JOIN reviews USING (review_id) WHERE decision = 'approve' AND severity IN ('low', 'info') AND rule_id <> '' GROUP BY ALL HAVING count(*) >= 3),
often AS (SELECT repository_id, list('Recurring issue in this repo: ' || substr(message, 1, 80) ORDER BY rank) AS often FROM patterns WHERE frequency >= 5 GROUP BY ALL),
areas AS (SELECT p.repository_id, p.author, list_concat(list_filter([CASE WHEN list_contains(common_issues, 'security') THEN 'Author has had security issues in past PRs — review security carefully.' END,
  CASE WHEN avg_issues_per_pr > 5 THEN 'Author''s PRs typically have many issues — thorough review recommended.' END,
  CASE WHEN approval_rate < 0.3 AND total_prs_reviewed >= 3 THEN 'Author''s PRs are frequently sent back for changes — check for recurring patterns.' END], lambda x: x IS NOT NULL), coalesce(often, []))[1:5] AS areas FROM profiles p LEFT JOIN often USING (repository_id))"""


def _history(spark, sf_dir):
    return fx.reviews(spark, sf_dir), fx.review_comments(spark, sf_dir)


@query("a02_author_profile", f"WITH {PROFILE_SQL} SELECT * FROM profiles")
def _(spark, sf_dir):
    return history.author_profiles(*_history(spark, sf_dir))


@query("a03_patterns", f"WITH {PROFILE_SQL} SELECT repository_id, category, file_path, message, frequency, rank FROM patterns")
def _(spark, sf_dir):
    return history.repository_patterns(*_history(spark, sf_dir))


@query("a04_false_positive", f"WITH {PROFILE_SQL} SELECT * FROM fps")
def _(spark, sf_dir):
    return history.false_positives(*_history(spark, sf_dir))


@query("a20_comment_count", f"WITH {RC} SELECT r.review_id, count(c.review_id) AS comment_count FROM reviews r LEFT JOIN review_comments c USING (review_id) GROUP BY r.review_id")
def _(spark, sf_dir):
    return history.comment_counts(*_history(spark, sf_dir))


@query("j01_comments_of_reviews", f"WITH {RC} SELECT repository_id, author, category, count(*) AS n FROM review_comments JOIN reviews USING (review_id) GROUP BY ALL")
def _(spark, sf_dir):
    return history.comments_of(*_history(spark, sf_dir)).groupBy("repository_id", "author", "category").agg(F.count("*").alias("n"))


@query("t07_emphasis", f"WITH {PROFILE_SQL} SELECT * FROM areas")
def _(spark, sf_dir):
    r, c = _history(spark, sf_dir)
    return history.emphasis_areas(history.author_profiles(r, c), history.repository_patterns(r, c))


@query("x12_learning_context", f"WITH {PROFILE_SQL} SELECT a.repository_id, a.author, a.areas, coalesce((SELECT list(rule_id ORDER BY rule_id) FROM fps f WHERE f.repository_id = a.repository_id), []) AS suppress_rules, p.total_prs_reviewed FROM areas a JOIN profiles p USING (repository_id, author)")
def _(spark, sf_dir):
    return history.learning_context(*_history(spark, sf_dir)).select("repository_id", "author", "areas", "suppress_rules", "total_prs_reviewed")


@query("w08_ordinals", f"WITH {fx.COMMENTS_SQL} SELECT review_id, line_number, (row_number() OVER (PARTITION BY review_id ORDER BY line_number, file_path, message, severity, category) - 1)::INT AS ordinal, substr(sha256(concat('repo:', review_id, ':', row_number() OVER (PARTITION BY review_id ORDER BY line_number, file_path, message, severity, category) - 1)), 1, 16) AS id, concat('[', severity, '] [', category, '] ', file_path, ': ', message) AS text FROM review_comments")
def _(spark, sf_dir):
    c = history.with_ordinals(fx.review_comments(spark, sf_dir))
    return c.select("review_id", "line_number", "ordinal", derive.hashed_id("repo:", F.col("review_id"), ":", F.col("ordinal")).alias("id"), history.comment_text(*(F.col(x) for x in ("severity", "category", "file_path", "message"))).alias("text"))


@query("k04_stored_comments", f"WITH {fx.COMMENTS_SQL} SELECT review_id, line_number, severity, CASE WHEN category IN ('security', 'bug', 'style', 'naming', 'testing') THEN category ELSE 'best_practice' END AS category FROM (SELECT review_id, line_number, severity, category FROM review_comments)")
def _(spark, sf_dir):
    return history.normalised(fx.review_comments(spark, sf_dir)).select("review_id", "line_number", "severity", "category")


@query("k05_repositories", "SELECT full_name, min(id) AS id FROM (SELECT concat('r', c_nationkey) AS full_name, c_nationkey AS id FROM customer WHERE c_nationkey < 10 UNION ALL SELECT concat('r', c_nationkey), NULL FROM customer) GROUP BY full_name")
def _(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    known = c.where("c_nationkey < 10").selectExpr("concat('r', c_nationkey) AS full_name", "c_nationkey AS id").distinct()
    return history.new_repositories(known, c.selectExpr("concat('r', c_nationkey) AS full_name")).select("full_name", "id")


@query("k06_feedback", f"WITH {fx.COMMENTS_SQL}, f AS (SELECT DISTINCT l_orderkey AS review_id, l_linenumber AS line_number, l_linenumber % 2 = 0 AS said FROM lineitem WHERE l_suppkey % 3 = 0) SELECT c.review_id, c.line_number, coalesce(f.said, false) AS is_resolved FROM review_comments c LEFT JOIN f USING (review_id, line_number)")
def _(spark, sf_dir):
    c = fx.review_comments(spark, sf_dir).select("review_id", "line_number", F.lit(False).alias("is_resolved"))
    f = fx.table(spark, sf_dir, "lineitem").where("l_suppkey % 3 = 0").selectExpr("l_orderkey AS review_id", "l_linenumber AS line_number", "l_linenumber % 2 = 0 AS is_resolved", "l_shipdate AS at")
    return history.with_feedback(c, f, ["review_id", "line_number"]).select("review_id", "line_number", "is_resolved")


# ---------------------------------------------------------------- decisions

DECISION_SQL = f"""{RC},
n AS (SELECT r.review_id, any_value(r.decision) AS decision, count(c.review_id) AS total, count(*) FILTER (c.severity = 'critical') AS critical, count(*) FILTER (c.severity = 'high') AS high FROM reviews r LEFT JOIN review_comments c USING (review_id) GROUP BY r.review_id)"""


@query("a10_severity_counts", f"WITH {fx.COMMENTS_SQL} SELECT review_id, count(*) AS total_comments, count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count FROM review_comments GROUP BY review_id")
def _(spark, sf_dir):
    return decision.severity_counts(fx.review_comments(spark, sf_dir), "review_id")


@query("a11_decision", f"""WITH {DECISION_SQL} SELECT review_id, CASE WHEN critical > 0 OR high >= 3 THEN 'request_changes' WHEN total = 0 THEN 'approve' WHEN high = 0 AND decision = 'request_changes' THEN 'comment' ELSE decision END AS decision,
  CASE WHEN critical > 0 THEN 0.9 WHEN high >= 3 OR total = 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM n""")
def _(spark, sf_dir):
    return decision.decisions(*_history(spark, sf_dir)).select("review_id", "decision", "confidence")


@query("r15_badges_events", f"WITH {DECISION_SQL} SELECT review_id, CASE decision WHEN 'approve' THEN 'APPROVE' WHEN 'request_changes' THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS event FROM n")
def _(spark, sf_dir):
    return fx.reviews(spark, sf_dir).select("review_id", decision.event(F.col("decision")).alias("event"))


@query("r18_summary", f"WITH {DECISION_SQL} SELECT review_id, CASE WHEN total = 0 THEN concat('Reviewed ', 3, ' files with +', 10, '/-', 4, ' changes. No issues found.') ELSE concat('Reviewed ', 3, ' files. Found ', total, ' issue(s): ', critical, ' critical, ', high, ' high, ', total - critical - high, ' medium/low.') END AS summary FROM n")
def _(spark, sf_dir):
    d = decision.decisions(*_history(spark, sf_dir))
    return d.select("review_id", decision.summary(F.lit(3), F.lit(10), F.lit(4), F.col("total_comments"), F.col("critical_count"), F.col("high_count")).alias("summary"))


@query("f13_patchable", f"WITH {fx.COMMENTS_SQL} SELECT review_id, line_number FROM review_comments WHERE line_number % 5 = 0 OR (category IN ('security', 'bug', 'performance', 'style', 'naming') AND severity IN ('critical', 'high', 'medium'))")
def _(spark, sf_dir):
    c = fx.review_comments(spark, sf_dir).withColumn("fix", F.when(F.col("line_number") % 5 == 0, "x"))
    return c.where(decision.is_patchable(F.col("fix"), F.col("category"), F.col("severity"), F.col("line_number"))).select("review_id", "line_number")


@query("a17_strategy", f"WITH {fx.PR_FILES_SQL} SELECT pr_id, CASE WHEN count(*) FILTER ({REVIEWABLE_SQL}) > 10 OR sum(additions) > 1000 THEN 'per_file' ELSE 'whole' END AS strategy FROM pr_files GROUP BY pr_id")
def _(spark, sf_dir):
    f = fx.pr_files(spark, sf_dir).groupBy("pr_id").agg(F.count_if(derive.reviewable(F.col("filename"), F.col("status"))).alias("n"), F.sum("additions").alias("a"))
    return f.select("pr_id", decision.strategy(F.col("n"), F.col("a")).alias("strategy"))


def _placed(spark, sf_dir):
    """Comments on line (file_ord mod 20) of each file, with their positions in the diff."""
    c = fx.pr_files(spark, sf_dir).selectExpr("pr_id", "filename", "CAST(file_ord % 20 AS INT) AS line_number", "CASE file_ord % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'critical' END AS severity", "'bug' AS category", "concat('m', file_ord) AS message", "CASE WHEN file_ord % 4 = 0 THEN 'fix' END AS suggested_fix")
    return diff.positions(c, lines_of(spark, sf_dir))


PLACED_SQL = f"""{LINES_SQL}, placed AS (SELECT p.pr_id, p.filename, (p.file_ord % 20)::INT AS line_number, min(l.pos) AS position, any_value(CASE p.file_ord % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'critical' END) AS severity, any_value(concat('m', p.file_ord)) AS message, any_value(CASE WHEN p.file_ord % 4 = 0 THEN 'fix' END) AS fix
  FROM pr_files p JOIN lines l ON l.file_ord = p.file_ord AND l.new_line = p.file_ord % 20 WHERE p.file_ord % 20 <> 0 GROUP BY ALL)"""


@query("j04_positions", f"WITH {PLACED_SQL} SELECT pr_id, filename, line_number, position FROM placed")
def _(spark, sf_dir):
    return _placed(spark, sf_dir).select("pr_id", "filename", "line_number", "position")


@query("k09_comment_bodies", f"""WITH {PLACED_SQL} SELECT pr_id, filename, position, concat(CASE severity WHEN 'high' THEN '⚠️' WHEN 'low' THEN '💡' ELSE '🚨' END, ' **', upper(severity), '** (bug)', chr(10), chr(10), message, CASE WHEN fix IS NULL THEN '' ELSE concat(chr(10), chr(10), '```suggestion', chr(10), fix, chr(10), '```') END) AS body FROM placed""")
def _(spark, sf_dir):
    return _placed(spark, sf_dir).select("pr_id", "filename", "position", decision.comment_body(*(F.col(c) for c in ("severity", "category", "message", "suggested_fix"))).alias("body"))


@query("k07_payloads", f"WITH {PLACED_SQL} SELECT pr_id, count(*) AS n_comments FROM placed GROUP BY pr_id")
def _(spark, sf_dir):
    return decision.payloads(_placed(spark, sf_dir)).select("pr_id", "n_comments")


@query("p21_parse_output", f"""WITH {fx.COMMENTS_SQL}, n AS (SELECT review_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h FROM review_comments GROUP BY review_id)
SELECT review_id, review_id % 10 <> 0 AS parse_ok, CASE WHEN review_id % 10 = 0 THEN 'comment' WHEN c > 0 OR h >= 3 THEN 'request_changes' ELSE 'comment' END AS decision, CASE WHEN review_id % 10 = 0 THEN 0 ELSE n END::BIGINT AS total_comments FROM n""")
def _(spark, sf_dir):
    c = fx.review_comments(spark, sf_dir).groupBy("review_id", "file_path").agg(F.collect_list(F.struct("file_path", "line_number", "severity", "message")).alias("comments"))
    j = c.groupBy("review_id").agg(F.to_json(F.struct(F.lit("s").alias("summary"), F.collect_list(F.struct("file_path", "comments")).alias("file_reviews"))).alias("j"))
    answers = j.select("review_id", F.when(F.col("review_id") % 10 == 0, F.lit("not json")).when(F.col("review_id") % 10 == 1, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).otherwise(F.col("j")).alias("content"))
    return decision.parse_output(answers).select("review_id", "parse_ok", "decision", F.col("total_comments").cast("long").alias("total_comments"))


# ---------------------------------------------------------------- chunks, standards, intervals

CHUNKS_SQL = r"""f AS (SELECT concat('d', doc_id) AS file_path, doc_id, text AS content, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) AS n FROM documents WHERE regexp_matches(text, '\S')),
p AS (SELECT *, greatest(10, 2000 // greatest(1, length(content) // n)) AS per FROM f),
w AS (SELECT *, unnest(range(0, (ceil(greatest(n - per, 0) / (per - 5)::DOUBLE) * (per - 5) + 1)::BIGINT, per - 5)) AS i FROM p),
chunks AS (SELECT file_path, doc_id, (1 + i)::INT AS start_line, least(i + per, n)::INT AS end_line, array_to_string(ls[i + 1:i + per], chr(10)) AS chunk, substr(sha256(concat('repo:', file_path, ':', 1 + i, '-', least(i + per, n))), 1, 16) AS id FROM w)"""


def _source_files(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(F.lit("repo").alias("repo"), F.concat(F.lit("d"), "doc_id").alias("file_path"), "doc_id", F.col("text").alias("content"))


@query("p15_window_chunks", f"WITH {CHUNKS_SQL} SELECT file_path, start_line, end_line, md5(chunk) AS chunk_md5, id FROM chunks")
def _(spark, sf_dir):
    return chunking.window_chunks(_source_files(spark, sf_dir)).select("file_path", "start_line", "end_line", F.md5("chunk").alias("chunk_md5"), "id")


@query("r08_chunk_id", f"WITH {CHUNKS_SQL} SELECT id, count(*) AS n FROM chunks GROUP BY id")
def _(spark, sf_dir):
    return chunking.window_chunks(_source_files(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("n"))


@query("r06_chunk_metadata", f"WITH {CHUNKS_SQL} SELECT id, file_path, CASE WHEN start_line > 1 THEN 4 ELSE 3 END AS n_keys FROM chunks")
def _(spark, sf_dir):
    c = chunking.window_chunks(_source_files(spark, sf_dir))
    meta = derive.present_keys(file_path=F.col("file_path"), start_line=F.col("start_line"), end_line=F.col("end_line"), continued=F.when(F.col("start_line") > 1, F.lit("yes")))
    return c.select("id", meta["file_path"].alias("file_path"), F.size(meta).alias("n_keys"))


_MD_TEXT = r"concat('intro', chr(10), '## SEC-', doc_id, ': Title ', doc_id, chr(10), '<!-- category: security -->', chr(10), source, chr(10), '```', chr(10), 'code ', doc_id, chr(10), '```', chr(10), '## Second ', lang, chr(10), '<!-- severity: high -->', chr(10), 'see below', chr(10), '```py', chr(10), 'a', chr(10), '```', chr(10), 'between', chr(10), '```', chr(10), 'b', chr(10), '```', chr(10), '```', chr(10), 'open')"
STANDARDS_SQL = f"""SELECT doc_id, 1 AS section, concat('SEC-', doc_id) AS rule_id, concat('Title ', doc_id) AS title, source AS description, 'security' AS category, 'medium' AS severity, concat('code ', doc_id) AS examples FROM documents
UNION ALL SELECT doc_id, 2, 'RULE-002', concat('Second ', lang), concat('see below', chr(10), 'between'), 'general', 'high', concat('a', chr(10), '---', chr(10), 'b') FROM documents"""


def _rules(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_MD_TEXT} AS content")
    return chunking.parse_standards(docs, "doc_id")


@query("p02_standards", STANDARDS_SQL)
def _(spark, sf_dir):
    return _rules(spark, sf_dir).select("doc_id", "section", "rule_id", "title", "description", "category", "severity", "examples")


@query("r07_rule_text", f"SELECT doc_id, rule_id, concat('[', rule_id, '] ', title, chr(10), chr(10), description, chr(10), chr(10), 'Examples:', chr(10), examples) AS full_text FROM ({STANDARDS_SQL})")
def _(spark, sf_dir):
    r = _rules(spark, sf_dir)
    return r.select("doc_id", "rule_id", chunking.rule_text(r).alias("full_text"))


def _intervals(spark, sf_dir):
    return chunking.window_chunks(_source_files(spark, sf_dir)).select(F.col("doc_id").alias("file_ord"), "start_line", "end_line", F.col("start_line").alias("ord"))


@query("j07_innermost", f"""WITH {LINES_SQL}, {CHUNKS_SQL}, h AS (SELECT DISTINCT l.file_ord, l.new_line AS line, c.start_line, c.end_line FROM lines l JOIN chunks c ON c.doc_id = l.file_ord AND l.new_line BETWEEN c.start_line AND c.end_line WHERE l.kind = 'added')
SELECT file_ord, line, start_line, end_line, start_line AS ord FROM (SELECT *, row_number() OVER (PARTITION BY file_ord, line ORDER BY end_line - start_line, start_line) AS r FROM h) WHERE r = 1""")
def _(spark, sf_dir):
    points = lines_of(spark, sf_dir).where("kind = 'added'").select("file_ord", F.col("new_line").alias("line")).distinct()
    return chunking.innermost(points, _intervals(spark, sf_dir), "file_ord")


@query("j08_overlap", f"WITH {LINES_SQL}, {CHUNKS_SQL}, r AS (SELECT file_ord, hunk_no, min(new_line) AS from_line, max(new_line) AS to_line FROM lines WHERE new_line IS NOT NULL GROUP BY ALL) SELECT r.file_ord, hunk_no, count(*) AS n FROM r JOIN chunks c ON c.doc_id = r.file_ord AND c.start_line <= r.to_line AND c.end_line >= r.from_line GROUP BY ALL")
def _(spark, sf_dir):
    ranges = lines_of(spark, sf_dir).where("new_line IS NOT NULL").groupBy("file_ord", "hunk_no").agg(F.min("new_line").alias("from_line"), F.max("new_line").alias("to_line"))
    return chunking.overlapping(ranges, _intervals(spark, sf_dir), "file_ord").groupBy("file_ord", "hunk_no").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- vectors

VECTORS_SQL = "e AS (SELECT vec_id AS id, concat('repo', label) AS repo, embedding::DOUBLE[] AS embedding FROM embeddings), q AS (SELECT id AS query_id, repo AS query_repo, embedding AS query FROM e WHERE id % 100 = 0)"


def _queries(docs):
    return docs.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


@query("t01_cosine_topk", f"WITH {VECTORS_SQL} SELECT query_id, id, rank, score FROM (SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY 1 - s, id))::INT AS rank, greatest(0.0::DOUBLE, 1 - (1 - s)) AS score FROM (SELECT query_id, id, list_inner_product(query, embedding) / (sqrt(list_inner_product(query, query)) * sqrt(list_inner_product(embedding, embedding))) AS s FROM q, e)) WHERE rank <= 10")
def _(spark, sf_dir):
    e = fx.embeddings(spark, sf_dir)
    return vectors.search(_queries(e), e, 10).select("query_id", "id", "rank", "score")


@query("f11_filtered_topk", f"WITH {VECTORS_SQL} SELECT query_id, id, rank FROM (SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY 1 - s, id))::INT AS rank FROM (SELECT query_id, id, list_inner_product(query, embedding) / (sqrt(list_inner_product(query, query)) * sqrt(list_inner_product(embedding, embedding))) AS s FROM q, e WHERE e.repo = 'repo1')) WHERE rank <= 5")
def _(spark, sf_dir):
    e = fx.embeddings(spark, sf_dir)
    return vectors.search(_queries(e), e, 5, F.col("repo") == "repo1").select("query_id", "id", "rank")


@query("t02_retrieve", f"WITH {VECTORS_SQL}, s AS (SELECT query_id, id, repo, list_inner_product(query, embedding) / (sqrt(list_inner_product(query, query)) * sqrt(list_inner_product(embedding, embedding))) AS s FROM q, e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 1 - s, id) AS a, row_number() OVER (PARTITION BY query_id, repo ORDER BY 1 - s, id) AS b FROM s) SELECT 'code' AS collection, query_id, id FROM r WHERE a <= 10 UNION ALL SELECT x, query_id, id FROM r, (VALUES ('standards'), ('reviews')) v(x) WHERE repo = 'repo1' AND b <= 5")
def _(spark, sf_dir):
    e = fx.embeddings(spark, sf_dir)
    return vectors.retrieve(_queries(e), e, e, e, F.col("repo") == "repo1").select("collection", "query_id", "id")


@query("s08_collection_count", "SELECT concat('repo', label) AS repo, count(*) AS n FROM embeddings GROUP BY ALL")
def _(spark, sf_dir):
    return vectors.counts(fx.embeddings(spark, sf_dir), "repo")


@query("k01_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM embeddings")
def _(spark, sf_dir):
    e = fx.embeddings(spark, sf_dir)
    return vectors.upsert(e.select("id", F.lit(1).alias("version")), e.where("id % 3 = 0").select("id", F.lit(2).alias("version")))


@query("k02_drop_collection", "SELECT vec_id AS id FROM embeddings WHERE label <> 1")
def _(spark, sf_dir):
    return vectors.drop_collection(fx.embeddings(spark, sf_dir).withColumn("collection", F.col("repo")), "repo1").select("id")


@query("k03_delete", "SELECT vec_id AS id FROM embeddings WHERE NOT (label = 2 AND vec_id % 2 = 0)")
def _(spark, sf_dir):
    e = fx.embeddings(spark, sf_dir)
    return vectors.delete(e, e.where("id % 2 = 0").select("id"), F.col("repo") == "repo2").select("id")


@query("r20_collection_names", f"WITH {RC} SELECT DISTINCT repository_id, concat('repository_code_', 'org_r', repository_id) AS collection FROM reviews")
def _(spark, sf_dir):
    return fx.reviews(spark, sf_dir).select("repository_id").distinct().select("repository_id", derive.collection(F.concat(F.lit("org/r"), "repository_id")).alias("collection"))


@query("x01_embed")
def _(spark, sf_dir):
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", providers.embed(F.col("text")).alias("embedding"))


@query("x03_generate")
def _(spark, sf_dir):
    m = prompts.messages(fx.table(spark, sf_dir, "conversations"))
    return decision.parse_output(m.select("conv_id", providers.generate(F.col("system")).alias("content"))).select("conv_id", "parse_ok", "decision", "confidence")


# ---------------------------------------------------------------- prompts, patches, events

_SECTION = "concat(chr(10), '### ', filename, ' (', status, ', +', additions, ' -', deletions, ')', chr(10), '```diff', chr(10), patch, chr(10), '```', chr(10))"


def _reviewable(spark, sf_dir):
    return fx.pr_files(spark, sf_dir).where(derive.reviewable(F.col("filename"), F.col("status")))


BUDGET_SQL = f"{fx.PR_FILES_SQL}, s AS (SELECT pr_id, file_ord, {_SECTION} AS text, sum(length({_SECTION})) OVER (PARTITION BY pr_id ORDER BY file_ord) AS total FROM pr_files WHERE {REVIEWABLE_SQL})"


@query("w03_budget", f"WITH {BUDGET_SQL} SELECT pr_id, count(*) FILTER (total <= 50000) AS kept, count(*) FILTER (total > 50000) AS remaining, coalesce(max(total) FILTER (total <= 50000), 0)::BIGINT AS size FROM s GROUP BY pr_id")
def _(spark, sf_dir):
    return prompts.budgeted(_reviewable(spark, sf_dir))


@query("r12_diff_text", f"WITH {BUDGET_SQL} SELECT pr_id, md5(concat_ws(chr(10), string_agg(text, chr(10) ORDER BY file_ord) FILTER (total <= 50000), CASE WHEN count(*) FILTER (total > 50000) > 0 THEN concat(chr(10), '... (', count(*) FILTER (total > 50000), ' more files truncated due to size) ...') END)) AS diff_md5 FROM s GROUP BY pr_id")
def _(spark, sf_dir):
    return prompts.diff_text(_reviewable(spark, sf_dir)).select("pr_id", F.md5("diff").alias("diff_md5"))


@query("r11_pr_header", f"""WITH {fx.PR_FILES_SQL} SELECT pr_id, concat('## Pull Request: o/r#', substr(pr_id, 3), chr(10), '**Title:** t', chr(10), '**Author:** a', chr(10), '**Branch:** h → b', chr(10), '**Files Changed:** ', count(*), chr(10), '**Lines:** +', sum(additions), ' -', sum(deletions), chr(10), '**Labels:** x, y', chr(10)) AS header FROM pr_files GROUP BY pr_id""")
def _(spark, sf_dir):
    p = diff.pr_totals(fx.pr_files(spark, sf_dir)).selectExpr("pr_id", "'o/r' AS repo", "substring(pr_id, 3) AS pr_number", "'t' AS title", "'a' AS author", "'h' AS head_branch", "'b' AS base_branch", "files_changed AS files", "total_additions AS additions", "total_deletions AS deletions", "'' AS description", "array('x', 'y') AS labels")
    return p.select("pr_id", prompts.header(p).alias("header"))


@query("r13_related_code", f"WITH {CHUNKS_SQL} SELECT doc_id, string_agg(concat('--- ', file_path, ' (lines ', start_line, '-', end_line, ')', chr(10), id), chr(10) || chr(10) ORDER BY start_line) FILTER (r <= 5) AS related FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS r FROM chunks) GROUP BY doc_id")
def _(spark, sf_dir):
    c = chunking.window_chunks(_source_files(spark, sf_dir)).withColumn("symbol_name", F.lit(None).cast("string"))
    g = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "file_path", "symbol_name", F.col("id").alias("content")))).alias("r"))
    return g.select("doc_id", prompts.related_code(F.col("r")).alias("related"))


@query("r22_messages", "SELECT conv_id, coalesce(regexp_replace(string_agg(text || chr(10), '' ORDER BY turn) FILTER (role = 'system'), '^\\s+|\\s+$', '', 'g'), '') AS system, greatest(count(*) FILTER (role <> 'system'), 1)::INT AS n_messages, coalesce(string_agg(text, chr(30) ORDER BY turn) FILTER (role <> 'system'), 'Please respond.') AS contents FROM conversations GROUP BY conv_id")
def _(spark, sf_dir):
    m = prompts.messages(fx.table(spark, sf_dir, "conversations"))
    return m.select("conv_id", "system", F.size("messages").alias("n_messages"), F.array_join("messages.content", "\x1e").alias("contents"))


@query("t06_query_texts", f"WITH {LINES_SQL}, few AS (SELECT * FROM (SELECT pr_id, file_ord, row_number() OVER (PARTITION BY pr_id ORDER BY file_ord) AS n FROM pr_files WHERE {REVIEWABLE_SQL}) WHERE n <= 5), t AS (SELECT l.pr_id, l.file_ord, l.hunk_no, string_agg(l.content, chr(10) ORDER BY l.pos) AS text FROM lines l JOIN few USING (pr_id, file_ord) WHERE l.kind = 'added' GROUP BY ALL) SELECT pr_id, n, query_text FROM (SELECT pr_id, (row_number() OVER (PARTITION BY pr_id ORDER BY file_ord, hunk_no))::INT AS n, substr(text, 1, 500) AS query_text FROM t WHERE regexp_matches(text, '\\S')) WHERE n <= 5")
def _(spark, sf_dir):
    return prompts.query_texts(_reviewable(spark, sf_dir), lines_of(spark, sf_dir))


@query("x11_patches")
def _(spark, sf_dir):
    files = fx.pr_files(spark, sf_dir)
    comments = files.selectExpr("pr_id", "filename", "CAST(file_ord AS INT) AS ordinal", "CAST(file_ord % 7 AS INT) AS line_number", "'bug' AS category", "'high' AS severity", "'m' AS message", "concat('fixed ', file_ord) AS suggested_fix")
    return patches.combined(patches.patches(comments, files.select("pr_id", "filename", F.col("patch").alias("content"))))


@query("f14_route", "SELECT event_id, CASE event_type WHEN 'click' THEN 'review' WHEN 'view' THEN 'pong' ELSE 'ignored' END AS route FROM events")
def _(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    event = F.when(F.col("event_type") == "view", "ping").otherwise("pull_request")
    return e.select("event_id", webhooks.route(event, F.when(F.col("event_type") == "click", "opened").otherwise(F.col("event_type"))).alias("route"))


@query("m06_dedup", "SELECT DISTINCT event_id // 2 AS delivery_id FROM events")
def _(spark, sf_dir):
    return webhooks.once(fx.table(spark, sf_dir, "events").select(F.expr("event_id div 2").alias("delivery_id"))).select("delivery_id")


@query("f15_signatures", "SELECT event_id, event_id % 2 = 0 AS ok FROM events")
def _(spark, sf_dir):
    import hashlib
    import hmac

    @F.pandas_udf("string")
    def sign(p):
        return p.map(lambda x: "sha256=" + hmac.new(b"key", x.encode(), hashlib.sha256).hexdigest())

    e = fx.table(spark, sf_dir, "events").select("event_id", F.coalesce("props", F.lit("")).alias("payload"))
    s = e.withColumn("signature", F.when(F.col("event_id") % 2 == 0, sign("payload")).otherwise("sha256=0"))
    return s.select("event_id", providers.signature_ok(F.col("payload"), F.col("signature"), "key").alias("ok"))


@query("s12_requests", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -32700 WHEN event_id % 3 = 1 THEN -32601 END AS error_code FROM events")
def _(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{bad "), "event_id")).otherwise(F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 3 == 1, "none").otherwise("tools/list").alias("method")))).alias("value"))
    r = webhooks.requests(e)
    bad = F.regexp_extract("value", r"\{bad (\d+)", 1)
    return e.join(r.select("id", "error_code"), F.get_json_object(F.when(F.col("value").startswith("{bad"), F.lit(None)).otherwise(F.col("value")), "$.id") == F.col("id")).select(F.col("id").cast("long").alias("event_id"), "error_code").unionByName(e.where(F.col("value").startswith("{bad")).select(bad.cast("long").alias("event_id"), F.lit(-32700).alias("error_code")))
