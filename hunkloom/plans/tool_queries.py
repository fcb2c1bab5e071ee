"""Queries over review contexts, the agent's tools and dispatch by language, with their DuckDB statements."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from ..functions import derive, providers
from ..operators import context, security, tools
from ..sources import fixtures as fx
from ..sources import landed
from .engine_queries import _PLACE, _SECRETS, ESLINT_SQL, MYPY_SQL, RUFF_SQL, VECTORS_SQL, _bandit, _eslint, _mypy, _ruff, _semgrep
from .review_queries import _LANG_SQL, _QUOTED, LINES_SQL, SCORES_SQL, lines_of

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


# ---------------------------------------------------------------- contexts of pull requests

#: Sizes stand for what a listing of files tells: absent, 0, and on either side of the bound.
_SIZE = "CASE WHEN file_ord % 11 = 0 THEN NULL WHEN file_ord % 11 = 1 THEN 0 ELSE additions * 500 END"
FETCH_SQL = f"""{fx.PR_FILES_SQL}, sized AS (SELECT *, {_SIZE} AS size FROM pr_files),
wanted AS (SELECT * FROM sized WHERE status <> 'removed' AND (size IS NULL OR size = 0 OR size <= {context.MAX_FILE_SIZE}) AND CASE WHEN contains(filename, '.') THEN split_part(filename, '.', -1) ELSE '' END NOT IN ({_QUOTED(context.BINARY_EXTENSIONS)}))"""


def _sized(spark, sf_dir):
    return fx.pr_files(spark, sf_dir).selectExpr("*", f"{_SIZE} AS size")


@query("f02_fetchable", f"WITH {FETCH_SQL} SELECT pr_id, file_ord FROM wanted")
def _(spark, sf_dir):
    return _sized(spark, sf_dir).where(context.fetchable(F.col("status"), F.col("size"), F.col("filename"))).select("pr_id", "file_ord")


@query("s10_pr_context", f"""WITH {FETCH_SQL}, {fx.SECRETS_SQL},
own AS (SELECT pr_id, sum(additions)::BIGINT AS total_additions, sum(deletions)::BIGINT AS total_deletions, count(*) AS files_changed, list(filename ORDER BY file_ord) AS filenames FROM pr_files GROUP BY pr_id),
got AS (SELECT w.pr_id, list(w.filename ORDER BY w.file_ord) AS fetched, sum(length(s.content))::BIGINT AS n_chars, list(sha256(s.content) ORDER BY w.file_ord) AS digests FROM wanted w JOIN secret_files s USING (file_ord) WHERE s.content IS NOT NULL GROUP BY w.pr_id)
SELECT o.*, concat('o/', o.pr_id) AS repo_full_name, coalesce(fetched, []) AS fetched, coalesce(n_chars, 0)::BIGINT AS n_chars, coalesce(digests, []) AS digests FROM own o LEFT JOIN got USING (pr_id)""")
def _(spark, sf_dir):
    files, texts = _sized(spark, sf_dir), fx.secret_files(spark, sf_dir)
    prs = files.select("pr_id").distinct().withColumn("repo_full_name", context.repo_full_name(F.lit("o"), F.col("pr_id")))
    out = context.pull_request_context(prs, files, texts.select("pr_id", "filename", "content"))
    got = F.coalesce("file_contents", F.array().cast(out.schema["file_contents"].dataType))
    lengths = F.aggregate(F.transform(got, lambda x: F.length(x["content"]).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return out.select("pr_id", "repo_full_name", "total_additions", "total_deletions", "files_changed", "filenames", F.transform(got, lambda x: x["filename"]).alias("fetched"), lengths.alias("n_chars"), F.transform(got, lambda x: F.sha2(x["content"], 256)).alias("digests"))


@query("j05_get_file", f"WITH {fx.PR_FILES_SQL} SELECT w.pr_id, w.filename, f.file_ord, f.status FROM (SELECT DISTINCT pr_id, CASE WHEN file_ord % 4 = 0 THEN concat('no/', filename) ELSE filename END AS filename FROM pr_files) w LEFT JOIN (SELECT pr_id, filename, min((file_ord, status))[1] AS file_ord, min((file_ord, status))[2] AS status FROM pr_files GROUP BY ALL) f USING (pr_id, filename)")
def _(spark, sf_dir):
    files = fx.pr_files(spark, sf_dir).select("pr_id", "file_ord", "filename", "status")
    wanted = files.select("pr_id", F.when(F.col("file_ord") % 4 == 0, F.concat(F.lit("no/"), "filename")).otherwise(F.col("filename")).alias("filename")).distinct()
    return context.get_file(wanted, files)


@query("j13_line_at_position", f"WITH {LINES_SQL} SELECT w.pr_id, w.file_ord, w.pos, l.kind, l.content, l.old_line, l.new_line FROM (SELECT pr_id, file_ord, unnest([1, 3, 7, 1000000])::INT AS pos FROM pr_files) w LEFT JOIN lines l USING (pr_id, file_ord, pos)")
def _(spark, sf_dir):
    wanted = fx.pr_files(spark, sf_dir).select("pr_id", "file_ord", F.explode(F.array(*map(F.lit, (1, 3, 7, 1000000)))).alias("pos"))
    return context.line_at(wanted, lines_of(spark, sf_dir))


@query("j12_files_of_languages", f"WITH {fx.PR_FILES_SQL}, f AS (SELECT pr_id, file_ord, {_LANG_SQL} AS language FROM pr_files), w AS (SELECT DISTINCT pr_id, CASE WHEN file_ord % 2 = 0 THEN 'python' ELSE 'go' END AS language FROM pr_files) SELECT pr_id, file_ord, language FROM f JOIN w USING (pr_id, language)")
def _(spark, sf_dir):
    files = fx.pr_files(spark, sf_dir)
    wanted = files.select("pr_id", F.when(F.col("file_ord") % 2 == 0, "python").otherwise("go").alias("language"))
    return context.file_languages(files, wanted).select("pr_id", "file_ord", "language")


# ---------------------------------------------------------------- dispatch by language


@query("f10_issues_for_file", f"WITH {fx.COMMENTS_SQL} SELECT review_id, file_path, line, severity, rule_id FROM ({RUFF_SQL}) WHERE file_path = (SELECT min(file_path) FROM review_comments)")
def _(spark, sf_dir):
    path = fx.review_comments(spark, sf_dir).agg(F.min("file_path").alias("path"))
    issues = security.parse_ruff(_ruff(spark, sf_dir), ["review_id"]).crossJoin(F.broadcast(path))  # one row
    return security.issues_for_file(issues, F.col("path")).select("review_id", "file_path", "line", "severity", "rule_id")


_LANGUAGE_OF = "CASE review_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' ELSE 'go' END"


@query("x14_analysis", f"WITH {fx.COMMENTS_SQL}, i AS (SELECT 'ruff' AS tool, 'python' AS kind, * FROM ({RUFF_SQL}) UNION ALL SELECT 'mypy', 'python', * FROM ({MYPY_SQL}) UNION ALL SELECT 'eslint', 'script', * FROM ({ESLINT_SQL})) SELECT review_id, tool, file_path, line, \"column\", severity, message, rule_id FROM i WHERE kind = CASE {_LANGUAGE_OF} WHEN 'python' THEN 'python' WHEN 'go' THEN '' ELSE 'script' END")
def _(spark, sf_dir):
    groups = fx.review_comments(spark, sf_dir).select("review_id").distinct().selectExpr("review_id", f"{_LANGUAGE_OF} AS language")
    return security.analyze(groups, _ruff(spark, sf_dir), _mypy(spark, sf_dir), _eslint(spark, sf_dir), ["review_id"])


@query("x14_analyzers", f"WITH {fx.PR_FILES_SQL}, p AS (SELECT pr_id, bool_or(contains(lower(filename), 'test') OR contains(lower(filename), 'spec')) AS tests, bool_or(filename = 'package.json') AS package FROM pr_files GROUP BY pr_id), l AS (SELECT *, unnest(['python', 'javascript', 'typescript', 'go']) AS language FROM p) SELECT pr_id, language, CASE language WHEN 'python' THEN CASE WHEN tests THEN ['ruff', 'mypy', 'pytest'] ELSE ['ruff', 'mypy'] END WHEN 'go' THEN [] ELSE CASE WHEN package THEN ['eslint', 'npm test'] ELSE ['eslint'] END END AS tools FROM l")
def _(spark, sf_dir):
    p = fx.pr_files(spark, sf_dir).groupBy("pr_id").agg(F.collect_list("filename").alias("paths")).withColumn("language", F.explode(F.array(*map(F.lit, ("python", "javascript", "typescript", "go")))))
    return p.select("pr_id", "language", security.analyzers(F.col("language"), F.col("paths")).alias("tools"))


@query("x13_scanners", f"WITH {fx.PR_FILES_SQL} SELECT pr_id, CASE WHEN bool_or(suffix(filename, '.py')) THEN ['secrets', 'bandit', 'semgrep'] ELSE ['secrets', 'semgrep'] END AS tools, language, CASE language WHEN 'python' THEN ['p/security-audit', 'p/secrets', 'p/python'] WHEN 'typescript' THEN ['p/security-audit', 'p/secrets', 'p/javascript'] ELSE ['p/security-audit', 'p/secrets'] END AS rulesets FROM (SELECT pr_id, filename, unnest(['python', 'typescript', 'go']) AS language FROM pr_files) GROUP BY pr_id, language")
def _(spark, sf_dir):
    p = fx.pr_files(spark, sf_dir).groupBy("pr_id").agg(F.collect_list("filename").alias("paths")).withColumn("language", F.explode(F.array(*map(F.lit, ("python", "typescript", "go")))))
    return p.select("pr_id", security.scanners(F.col("paths")).alias("tools"), "language", security.rulesets(F.col("language")).alias("rulesets"))


@query("x13_scan", f"WITH {fx.COMMENTS_SQL}, py AS (SELECT DISTINCT doc_id AS review_id FROM documents WHERE doc_id % 8 = 0) SELECT review_id, 'semgrep' AS tool, count(*) AS n FROM review_comments GROUP BY review_id UNION ALL SELECT review_id, 'bandit', count(*) FROM review_comments WHERE review_id IN (FROM py) GROUP BY review_id")
def _(spark, sf_dir):
    files = fx.secret_files(spark, sf_dir).withColumn("review_id", F.col("file_ord"))
    found = security.scan_by_language(files, _bandit(spark, sf_dir), _semgrep(spark, sf_dir), ["review_id"])
    return found.where("tool <> 'secrets'").groupBy("review_id", "tool").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- the agent's tools

_EXT_SQL = "CASE lower(language) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in derive.SNIPPET_EXTENSIONS.items()) + " ELSE 'txt' END"
_CALLS_SQL = "calls AS (SELECT doc_id AS call_id, replace(text, 'token = ', 'secret = ') AS code, CASE doc_id % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'go' WHEN 2 THEN 'rust' ELSE 'cobol' END AS language FROM documents)"


def _calls(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").selectExpr("doc_id AS call_id", "replace(text, 'token = ', 'secret = ') AS code", "CASE doc_id % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'go' WHEN 2 THEN 'rust' ELSE 'cobol' END AS language")


_FINDINGS_SQL = f"""{_CALLS_SQL},
l AS (SELECT call_id, unnest(string_split(code, chr(10))) AS line, generate_subscripts(string_split(code, chr(10)), 1)::INT AS n FROM calls WHERE {_EXT_SQL} <> 'txt'),
p AS (SELECT * FROM (VALUES {_SECRETS}) p(pattern, title, rule_id)),
f AS (SELECT call_id, n AS line, title, concat('{security.SECRET_SAID[0]}', title, '{security.SECRET_SAID[1]}') AS description, (row_number() OVER (PARTITION BY call_id ORDER BY n, rule_id) - 1)::INT AS ord, (count(*) OVER (PARTITION BY call_id))::INT AS n FROM l JOIN p ON regexp_matches(line, pattern) WHERE NOT ({_PLACE}))"""


@query("x07_check_security", f"""WITH {_FINDINGS_SQL} SELECT call_id, coalesce(f.n, 0) AS "count", ord, line, CASE WHEN ord IS NOT NULL THEN 'critical' END AS severity, title, description, CASE WHEN ord IS NOT NULL THEN '{security.SECRET_REMEDY}' END AS remediation FROM calls LEFT JOIN f USING (call_id)""")
def _(spark, sf_dir):
    out = tools.check_security(_calls(spark, sf_dir))
    return out.select("call_id", "count", F.posexplode_outer("findings").alias("ord", "f")).select("call_id", "count", "ord", "f.*")


#: Documents of a store: those of `embeddings`, with metadata by their number.
_STORE = {"rule_id": "concat('R', id % 7)", "title": "concat('t', id)", "category": "CASE WHEN id % 2 = 0 THEN 'security' END", "severity": "CASE WHEN id % 3 = 0 THEN 'high' ELSE 'low' END", "file_path": "concat('f', id % 5, '.py')"}
_FOUND_SQL = f"""{VECTORS_SQL}, c AS (SELECT query_id, query, CASE WHEN query_id % 200 = 0 THEN '' ELSE query_repo END AS repo, CASE WHEN query_id % 300 = 0 THEN 2 ELSE 5 END AS most FROM q),
s AS (SELECT query_id, id, most, list_inner_product(query, embedding) / (sqrt(list_inner_product(query, query)) * sqrt(list_inner_product(embedding, embedding))) AS s FROM c, e WHERE c.repo = '' OR c.repo = e.repo),
hits AS (SELECT query_id AS call_id, r - 1 AS ord, id, substr(concat('text ', id, repeat(' more', (id % 90)::INT)), 1, 300) AS content, round(greatest(0.0::DOUBLE, 1 - (1 - s)), 3) AS relevance FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY 1 - s, id))::INT AS r FROM s) WHERE r <= most)"""


def _store_calls(spark, sf_dir):
    e = fx.embeddings(spark, sf_dir)
    meta = derive.present_keys(repo=F.col("repo"), **{k: F.expr(v) for k, v in _STORE.items()})
    text = F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit(" more"), (F.col("id") % 90).cast("int")))
    documents = e.select("id", text.alias("content"), meta.alias("metadata"), "embedding")
    calls = e.where("id % 100 = 0").select(F.col("id").alias("call_id"), F.col("embedding").alias("query"), F.when(F.col("id") % 200 == 0, "").otherwise(F.col("repo")).alias("repo"), F.when(F.col("id") % 300 == 0, 2).alias("limit"))
    return calls, documents


@query("x07_query_standards", f"WITH {_FOUND_SQL} SELECT call_id, ord, {_STORE['rule_id']} AS rule_id, {_STORE['title']} AS title, coalesce({_STORE['category']}, '') AS category, content, relevance, NULL::VARCHAR AS source FROM hits")
def _(spark, sf_dir):
    out = tools.query_standards(*_store_calls(spark, sf_dir))
    return out.select("call_id", F.posexplode_outer("standards").alias("ord", "x"), "source").select("call_id", "ord", "x.*", "source")


_RULES_SQL = ", ".join(f"({i}, '{r}', '{t}', '{c}')" for i, (r, t, _, c, _) in enumerate(landed.DEFAULT_STANDARDS))


@query("x07_default_standards", f"WITH r AS (SELECT * FROM (VALUES {_RULES_SQL}) r(ord, rule_id, title, category)) SELECT vec_id AS call_id, ord, rule_id, title, category, 'defaults' AS source FROM embeddings, r WHERE vec_id % 100 = 0 AND ord < CASE WHEN vec_id % 300 = 0 THEN 2 ELSE 5 END")
def _(spark, sf_dir):
    calls, _ = _store_calls(spark, sf_dir)
    out = tools.query_standards(calls, None, landed.default_standards(spark))
    return out.select("call_id", F.posexplode("standards").alias("ord", "x"), "source").select("call_id", "ord", "x.rule_id", "x.title", "x.category", "source")


@query("x07_search_past_reviews", f"WITH {_FOUND_SQL} SELECT call_id, ord, content AS comment, {_STORE['severity']} AS severity, coalesce({_STORE['category']}, '') AS category, {_STORE['file_path']} AS file_path, relevance, NULL::VARCHAR AS note FROM hits")
def _(spark, sf_dir):
    out = tools.search_past_reviews(*_store_calls(spark, sf_dir))
    return out.select("call_id", F.posexplode_outer("past_reviews").alias("ord", "x"), "note").select("call_id", "ord", "x.*", "note")


@query("x07_query_store", f"""WITH {VECTORS_SQL}, c AS (SELECT query_id, query, CASE WHEN query_id % 200 = 0 THEN '' ELSE query_repo END AS repo FROM q),
s AS (SELECT query_id, id, list_inner_product(query, embedding) / (sqrt(list_inner_product(query, query)) * sqrt(list_inner_product(embedding, embedding))) AS s FROM c, e WHERE c.repo = '' OR c.repo = e.repo)
SELECT query_id AS call_id, rank, id, concat('text ', id) AS content FROM (SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY 1 - s, id))::INT AS rank FROM s) WHERE rank <= 5""")
def _(spark, sf_dir):
    e = fx.embeddings(spark, sf_dir).withColumns({"content": F.concat(F.lit("text "), F.col("id").cast("string")), "metadata": derive.present_keys(repo=F.col("repo"))})
    calls = e.where("id % 100 = 0").select(F.col("id").alias("call_id"), F.col("embedding").alias("query"), F.when(F.col("id") % 200 == 0, "").otherwise(F.col("repo")).alias("repo"))
    return tools.query_store(calls, e).select("call_id", "rank", "id", "content")


_DIFFS_SQL = fx.PR_FILES_SQL.replace("pr_files AS (", "given AS (", 1) + ", pr_files AS (SELECT concat('d', file_ord) AS pr_id, 1 AS file_ord, 'file' AS filename, 'modified' AS status, (len(string_split(patch, chr(10) || '+')) - 1)::INT AS additions, (len(string_split(patch, chr(10) || '-')) - 1)::INT AS deletions, patch FROM given WHERE patch IS NOT NULL)"
_PREDICT_SQL = SCORES_SQL.replace(fx.PR_FILES_SQL, _DIFFS_SQL).replace("PARTITION BY file_ord", "PARTITION BY pr_id, file_ord").replace("USING (file_ord, hunk_no)", "USING (pr_id, file_ord, hunk_no)").replace("heads AS (SELECT file_ord", "heads AS (SELECT pr_id, file_ord").replace("turns AS (SELECT file_ord", "turns AS (SELECT pr_id, file_ord")


@query("x07_predict_bugs", f"WITH {_PREDICT_SQL} SELECT pr_id AS call_id, round(risk_score, 3) AS risk_score, s.risk_level, array_to_string(recommendations, '|') AS recommendations, (row_number() OVER (PARTITION BY pr_id ORDER BY (grp, file_ord, hunk_no, rule)) - 1)::INT AS ord, signal_type AS type, g.risk_level AS signal_level, description, filename AS file, confidence::DOUBLE AS confidence FROM scored s JOIN sig g USING (pr_id) UNION ALL SELECT pr_id, round(risk_score, 3), risk_level, array_to_string(recommendations, '|'), NULL, NULL, NULL, NULL, NULL, NULL FROM scored WHERE n_signals = 0")
def _(spark, sf_dir):
    calls = fx.pr_files(spark, sf_dir).where("patch IS NOT NULL").select(F.concat(F.lit("d"), F.col("file_ord").cast("string")).alias("call_id"), F.col("patch").alias("diff"))
    out = tools.predict_bugs(calls).withColumn("recommendations", F.array_join("recommendations", "|"))
    return out.select("call_id", "risk_score", "risk_level", "recommendations", F.posexplode_outer("signals").alias("ord", "s")).select("call_id", "risk_score", "risk_level", "recommendations", "ord", "s.type", F.col("s.risk_level").alias("signal_level"), "s.description", "s.file", "s.confidence")


def _digested(asked: list[str]) -> list[str]:
    """A stand-in that tells what it was asked: the digest of the prompt, or, of code to be corrected, the code itself or (for odd numbers) in capitals."""
    out = []
    for p in asked:
        if "context of a failing call" in p:
            raise RuntimeError("refused")
        if (code := re.search(r"Original code:\n```\n([\s\S]*)\n```\n", p)) is None:
            out.append(hashlib.md5(p.encode()).hexdigest())
        else:
            odd = int(re.search(r"\d+", code[1])[0]) % 2
            out.append(code[1].upper() if odd else f"```py\n{code[1]}\n```")
    return out


providers.MODELS["digested"] = _digested
_ABOUT = "CASE call_id % 3 WHEN 0 THEN concat('about ', call_id) WHEN 1 THEN '' END"
_REVIEW_SQL = f"md5(concat('{tools.REVIEWER}', chr(10), chr(10), 'Language: ', language, chr(10), CASE WHEN call_id % 3 = 0 THEN concat('Context: about ', call_id, chr(10)) ELSE '' END, chr(10), 'Diff to review:', chr(10), '```diff', chr(10), code, chr(10), '```', chr(10), chr(10), 'Provide your review as a JSON object with: summary, decision, and comments array.'))"


@query("x07_review_diff", f"WITH {_CALLS_SQL} SELECT call_id, {_REVIEW_SQL} AS content, NULL::VARCHAR AS error FROM calls")
def _(spark, sf_dir):
    return tools.review_diff(_calls(spark, sf_dir).withColumn("context", F.expr(_ABOUT)).withColumnRenamed("code", "diff"), "digested")


@query("x07_generate_patch", "SELECT doc_id AS call_id, CASE WHEN doc_id % 2 = 0 THEN '(no changes needed)' ELSE concat('--- a/m', doc_id, '.py', chr(10), '+++ b/m', doc_id, '.py', chr(10), '@@ -1,2 +1,2 @@', chr(10), '-x', doc_id, ' = ', lang, chr(10), '-y', '+X', doc_id, ' = ', upper(lang), chr(10), '+Y') END AS patch, NULL::VARCHAR AS error FROM documents")
def _(spark, sf_dir):
    calls = fx.table(spark, sf_dir, "documents").selectExpr("doc_id AS call_id", "concat('x', doc_id, ' = ', lang, chr(10), 'y') AS code", "concat('broken ', source) AS issue_description", "concat('m', doc_id, '.py') AS file_path")
    return tools.generate_patch(calls, "digested")


@query("x07_messages", f"""WITH {_CALLS_SQL} SELECT call_id, 'Language: ' || language || chr(10) || CASE WHEN call_id % 2 = 0 THEN 'Context: about it' || chr(10) ELSE '' END || chr(10) || 'Diff to review:' || chr(10) || '```diff' || chr(10) || code || chr(10) || '```' || chr(10) || chr(10) || 'Provide your review as a JSON object with: summary, decision, and comments array.' AS review,
'File: a.py' || chr(10) || 'Issue: broken' || chr(10) || chr(10) || 'Original code:' || chr(10) || '```' || chr(10) || code || chr(10) || '```' || chr(10) || chr(10) || 'Generate the corrected code that fixes this issue. Output ONLY the fixed code.' AS patch FROM calls""")
def _(spark, sf_dir):
    about = F.when(F.col("call_id") % 2 == 0, "about it").otherwise("")
    return _calls(spark, sf_dir).select("call_id", tools.review_message(F.col("code"), F.col("language"), about).alias("review"), tools.patch_message(F.lit("a.py"), F.lit("broken"), F.col("code")).alias("patch"))


_ANSWER = lambda text, failed=False: f"concat('{{\"content\":[{{\"type\":\"text\",\"text\":\"', {text}, '\"}}]{',\"isError\":true' if failed else ''}}}')"


_INNER = lambda text: "'" + text.replace('"', '\\"') + "'"
_NO_FINDINGS, _NO_REVIEWS = '{"findings":[],"count":0}', '{"past_reviews":[],"note":"No review history available."}'


@query("r23_tool_answers", f"""WITH {_FINDINGS_SQL}, one AS (SELECT call_id, concat('{{\\"findings\\":[', string_agg(concat('{{\\"line\\":', line, ',\\"severity\\":\\"critical\\",\\"title\\":\\"', title, '\\",\\"description\\":\\"', description, '\\",\\"remediation\\":\\"{security.SECRET_REMEDY}\\"}}'), ',' ORDER BY ord), '],\\"count\\":', count(*), '}}') AS found FROM f GROUP BY call_id)
SELECT call_id, CASE call_id % 7 WHEN 0 THEN {_ANSWER("'Unknown tool: other'", True)} WHEN 1 THEN {_ANSWER("concat('Error: ', chr(39), 'language', chr(39))", True)} WHEN 2 THEN {_ANSWER("'Error: RuntimeError: refused'", True)} WHEN 3 THEN {_ANSWER(_REVIEW_SQL)}
  WHEN 4 THEN {_ANSWER(f"coalesce(found, {_INNER(_NO_FINDINGS)})")} WHEN 5 THEN {_ANSWER(_INNER(_NO_REVIEWS))} ELSE {_ANSWER("concat('Error: ', chr(39), 'query', chr(39))", True)} END AS answer FROM calls LEFT JOIN one USING (call_id)""")
def _(spark, sf_dir):
    k = F.col("call_id") % 7
    name = F.when(k == 0, "other").when(k.isin(1, 2, 3), "review_diff").when(k == 4, "check_security").when(k == 5, "search_past_reviews").otherwise("query_standards")
    about = F.when(k == 2, "context of a failing call").otherwise(F.expr(_ABOUT))
    arguments = F.to_json(F.struct(F.when(k.isin(1, 2, 3), F.col("code")).alias("diff"), F.when(k != 1, F.col("language")).alias("language"), about.alias("context"), F.when(k == 4, F.col("code")).alias("code"), F.when(k == 5, F.col("code")).alias("code_snippet")))
    return tools.execute(_calls(spark, sf_dir).select("call_id", name.alias("name"), arguments.alias("arguments")), model="digested", defaults=landed.default_standards(spark))
