"""Queries over the document store, similar past comments, answers held to a schema and reviews file by file, with DuckDB statements."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..functions import derive, providers
from ..operators import answers, chunking, history, prompts, store
from ..sources import fixtures as fx
from .engine_queries import PROFILE_SQL, VECTORS_SQL, _history
from .review_queries import REVIEWABLE_SQL
from .symbol_queries import CHUNKS_SQL, source_files

Q, O = {}, {}


def query(name: str, sql: str):
    def add(f):
        Q[name], O[name] = f, sql
        return f

    return add


def _empty(spark):
    return spark.createDataFrame([], store.SCHEMA)


# ---------------------------------------------------------------- documents

#: A document's text as the body of one rule: without what Markdown would read as heading, fence or comment.
_BODY = "replace(replace(replace(coalesce(text, ''), '#', ''), '`', ''), '<', '')"
_MARKDOWN = f"concat('## R-', doc_id, ': Title ', coalesce(source, 'none'), CASE WHEN %s THEN ' again' ELSE '' END, chr(10), '<!-- category: security -->', chr(10), 'About ', {_BODY})"


def _rules(spark, sf_dir, changed: str, where: str):
    docs = fx.table(spark, sf_dir, "documents").where(where).selectExpr("doc_id", f"{_MARKDOWN % changed} AS content", "concat('o/r', doc_id % 3) AS repo")
    rules = chunking.parse_standards(docs, "doc_id").join(docs.select("doc_id", "repo"), "doc_id")
    return store.rule_documents(rules, F.col("repo"))


@query("k12_store_rules", f"""WITH d AS (SELECT doc_id, concat('o/r', doc_id % 3) AS repo, concat('Title ', coalesce(source, 'none'), CASE WHEN doc_id % 5 = 0 THEN ' again' ELSE '' END) AS title, regexp_replace(concat('About ', {_BODY}), '^\\s+|\\s+$', '', 'g') AS body FROM documents)
SELECT 'coding_standards' AS collection, substr(sha256(concat(repo, ':R-', doc_id)), 1, 16) AS id, sha256(concat('[R-', doc_id, '] ', title, chr(10), chr(10), body)) AS digest, concat('R-', doc_id) AS rule_id, title, 'security' AS category, 'medium' AS severity, repo, doc_id % 3 = 0 OR doc_id % 5 = 0 AS fresh FROM d""")
def _(spark, sf_dir):
    """A second load after a third of the rules was left out of the first, and a fifth has changed: what is embedded anew."""
    stored = store.upserted(_empty(spark), _rules(spark, sf_dir, "false", "doc_id % 3 <> 0"))
    found = store.pending(stored, _rules(spark, sf_dir, "doc_id % 5 = 0", "true"))
    meta = [F.col("metadata")[k].alias(k) for k in ("rule_id", "title", "category", "severity", "repo")]
    return found.select("collection", "id", "digest", *meta, F.col("embedding").isNull().alias("fresh"))


@query("k13_store_comments", f"""WITH {fx.REVIEWS_SQL}, {fx.COMMENTS_SQL}, c AS (SELECT c.*, r.repository_id, r.author, row_number() OVER (PARTITION BY c.review_id ORDER BY line_number, file_path, message, severity, category) - 1 AS ordinal FROM review_comments c JOIN reviews r USING (review_id))
SELECT 'review_history' AS collection, substr(sha256(concat('o/r', repository_id, ':', review_id, ':', ordinal)), 1, 16) AS id, concat('[', severity, '] [', category, '] ', file_path, ': ', message) AS content, concat('o/r', repository_id) AS repo, severity, category, file_path, (review_id % 50)::VARCHAR AS pr_number, author, 64 AS dimensions FROM c""")
def _(spark, sf_dir):
    r, c = _history(spark, sf_dir)
    rows = history.with_ordinals(c).join(r.select("review_id", "repository_id", "author"), "review_id").withColumn("pr_number", F.col("review_id") % 50)
    found = store.upserted(_empty(spark), store.comment_documents(rows, F.concat(F.lit("o/r"), "repository_id")))
    return found.select("collection", "id", "content", *(F.col("metadata")[k].alias(k) for k in ("repo", "severity", "category", "file_path", "pr_number", "author")), F.size("embedding").alias("dimensions"))


@query("x16_index_files", f"WITH {CHUNKS_SQL}, ids AS (SELECT DISTINCT file_path, language, symbol_name, id FROM chunks) SELECT file_path, language, count(*) AS chunks, count(symbol_name) AS by_symbol, CASE WHEN regexp_extract(file_path, '(\\d+)', 1)::BIGINT % 2 = 1 THEN count(*) ELSE 0 END AS embedded FROM ids GROUP BY file_path, language")
def _(spark, sf_dir):
    """A second run over all files after a first over every other one: only the new ones' chunks are embedded."""
    files = source_files(spark, sf_dir)
    stored = store.index_files(_empty(spark), files.where(F.regexp_extract("file_path", r"(\d+)", 1).cast("long") % 2 == 0))
    found = store.pending(stored, store.chunk_documents(chunking.chunk_files(files)))
    meta = lambda k: F.col("metadata")[k]
    return found.groupBy(meta("file_path").alias("file_path"), meta("language").alias("language")).agg(F.count("*").alias("chunks"), F.count(meta("symbol_name")).alias("by_symbol"), F.count_if(F.col("embedding").isNull()).alias("embedded"))


# ---------------------------------------------------------------- similar comments

_LABELS = {"severity": ["critical", "high", "medium", "low"], "category": ["bug", "style"]}
_CHOICE = lambda k, column: f"CASE {column} % {len(_LABELS[k])} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_LABELS[k])) + " END"
PAST_SQL = f"""{VECTORS_SQL}, past AS (SELECT id, repo, embedding, concat('comment number ', id, repeat(' word', (id % 40)::INT)) AS comment, {_CHOICE("severity", "id")} AS severity, {_CHOICE("category", "id")} AS category, concat('f', id % 9, '.py') AS file_path FROM e)"""
_NEAR = "list_inner_product(a.query, p.embedding) / (sqrt(list_inner_product(a.query, a.query)) * sqrt(list_inner_product(p.embedding, p.embedding)))"


def _past(spark, sf_dir):
    e = fx.embeddings(spark, sf_dir)
    text = F.concat(F.lit("comment number "), F.col("id").cast("string"), F.repeat(F.lit(" word"), (F.col("id") % 40).cast("int")))
    meta = derive.present_keys(repo=F.col("repo"), **{k: F.expr(_CHOICE(k, "id")) for k in _LABELS}, file_path=F.concat(F.lit("f"), F.col("id") % 9, F.lit(".py")))
    return e.select(F.lit(store.REVIEWS).alias("collection"), "id", text.alias("content"), F.lit("").alias("digest"), meta.alias("metadata"), "embedding")


@query("t03_similar_comments", f"WITH {PAST_SQL}, s AS (SELECT a.query_id, p.*, {_NEAR} AS s FROM q a JOIN past p ON p.repo = a.query_repo) SELECT query_id, rank, comment, severity, category, file_path, greatest(0.0::DOUBLE, 1 - (1 - s)) AS similarity FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY 1 - s, id))::INT AS rank FROM s) WHERE rank <= 5")
def _(spark, sf_dir):
    calls = fx.embeddings(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), "repo", F.col("embedding").alias("query"))
    return store.similar_comments(calls, _past(spark, sf_dir))


@query("r14_prompt_context", f"""WITH {PROFILE_SQL}, {PAST_SQL}, repos AS (SELECT DISTINCT repository_id FROM profiles), asks AS (SELECT r.repository_id, x.embedding AS query, x.repo FROM repos r JOIN e x ON x.id = r.repository_id),
near AS (SELECT a.repository_id, p.severity, p.comment, row_number() OVER (PARTITION BY a.repository_id ORDER BY 1 - {_NEAR}, p.id) AS rank FROM asks a JOIN past p ON p.repo = a.repo),
sim AS (SELECT repository_id, string_agg(concat('- [', severity, '] ', substr(comment, 1, 100)), chr(10) ORDER BY rank) AS similar FROM near WHERE rank <= 3 GROUP BY repository_id),
pat AS (SELECT repository_id, string_agg(concat('- [', category, '] ', substr(message, 1, 200), ' (seen ', frequency, 'x)'), chr(10) ORDER BY rank) AS patterns FROM patterns WHERE rank <= 5 GROUP BY repository_id),
sup AS (SELECT repository_id, string_agg(rule_id, chr(10) || '- ' ORDER BY rule_id) AS rules FROM fps GROUP BY repository_id)
SELECT p.repository_id, p.author, concat_ws(chr(10) || chr(10),
  concat('## Author History (', p.author, '):', chr(10), '- PRs reviewed: ', total_prs_reviewed, chr(10), '- Approval rate: ', round_even(approval_rate * 100, 0)::INT, '%', chr(10), '- Common issues: ', array_to_string(common_issues[1:3], ', '), chr(10), '- Avg issues/PR: ', round_even(avg_issues_per_pr, 1)),
  '## Recurring Repository Patterns:' || chr(10) || patterns, '## Similar Past Comments (avoid repeating unless still relevant):' || chr(10) || sim.similar,
  CASE WHEN len(areas) > 0 THEN '## Areas Requiring Extra Attention:' || chr(10) || '- ' || array_to_string(areas, chr(10) || '- ') END, '## Suppressed Rules (known false positives in this repo):' || chr(10) || '- ' || rules) AS prompt
FROM profiles p JOIN areas USING (repository_id, author) LEFT JOIN pat USING (repository_id) LEFT JOIN sim USING (repository_id) LEFT JOIN sup USING (repository_id)""")
def _(spark, sf_dir):
    context = history.learning_context(*_history(spark, sf_dir))
    asks = fx.embeddings(spark, sf_dir).select(F.col("id").alias("query_id"), "repo", F.col("embedding").alias("query")).join(context.select(F.col("repository_id").cast("long").alias("query_id")).distinct(), "query_id")
    found = store.similar_comments(asks, _past(spark, sf_dir), 3).withColumn("repository_id", F.col("query_id"))
    return history.prompt_context(history.with_similar(context, found, ["repository_id"]))


# ---------------------------------------------------------------- answers and reviews file by file


def _scripted(asked: list[str]) -> list:
    """A stand-in that answers by the number in the name of the file it is asked about: some are failures, some answers don't fit at first or at all."""
    out = []
    for prompt in asked:
        k = int(re.search(r"## File Under Review: \D*(\d+)", prompt)[1])
        if k % 7 == 0:
            raise RuntimeError("no answer")
        comments = [{"file_path": f"f{k}", "line_number": k, "severity": s, "category": "bug", "message": f"m{k}"} for s in ["critical"] * (k % 11 == 0) + ["high"] * (k % 3)]
        fits = json.dumps({"summary": "s", "decision": "comment", "confidence": 0.5, "file_reviews": [{"file_path": f"f{k}", "summary": "s", "comments": comments}]})
        again = "could not be used" in prompt
        text = "sorry" if k % 7 == 1 and not again else '{"decision": "approve"}' if k % 7 == 2 else fits
        out.append({"content": text, "finish_reason": "length" if k % 13 == 0 else "stop"})
    return out


providers.MODELS["scripted"] = _scripted
_HEAD = "concat('PR ', pr_id)"
MESSAGE_SQL = f"concat_ws(chr(10), {_HEAD}, concat(chr(10), '## File Under Review: ', filename), concat('Status: ', status, ' | +', additions, ' -', deletions), concat(chr(10), '### Diff:', chr(10), '```', chr(10), substr(coalesce(patch, ''), 1, 50000), chr(10), '```'), CASE WHEN coalesce(content, '') <> '' THEN concat(chr(10), '### Full File Content:', chr(10), '```', chr(10), substr(content, 1, 20000), chr(10), '```') END, CASE WHEN file_ord % 2 = 0 THEN concat(chr(10), '## Applicable Coding Standards:', chr(10), 'rule ', file_ord) END, concat(chr(10), '## Instructions:', chr(10), 'Review ONLY this file. Produce a JSON response with your findings.'))"


def _files(spark, sf_dir):
    """Files with `reviewable` and the message about each."""
    texts = fx.secret_files(spark, sf_dir).select("file_ord", "content")
    files = fx.pr_files(spark, sf_dir).join(texts, "file_ord").withColumn("reviewable", derive.reviewable(F.col("filename"), F.col("status")))
    rules = F.when(F.col("file_ord") % 2 == 0, F.concat(F.lit("rule "), F.col("file_ord")))
    return files.withColumn("message", prompts.file_message(F.expr(_HEAD), *(F.col(c) for c in ("filename", "status", "additions", "deletions", "patch", "content")), rules))


@query("r12_file_message", f"WITH {fx.PR_FILES_SQL}, {fx.SECRETS_SQL} SELECT pr_id, file_ord, md5({MESSAGE_SQL}) AS message_md5, length({MESSAGE_SQL}) AS n_chars FROM (SELECT p.*, s.content FROM pr_files p JOIN secret_files s USING (file_ord))")
def _(spark, sf_dir):
    return _files(spark, sf_dir).select("pr_id", "file_ord", F.md5("message").alias("message_md5"), F.length("message").cast("long").alias("n_chars"))


@query("x04_structured", f"WITH {fx.PR_FILES_SQL} SELECT pr_id, file_ord, CASE WHEN file_ord % 7 IN (1, 2) THEN 2 ELSE 1 END AS attempts, CASE file_ord % 7 WHEN 0 THEN 'RuntimeError: no answer' WHEN 2 THEN 'summary is missing' END AS error, file_ord % 13 = 0 AND file_ord % 7 <> 0 AS truncated FROM pr_files WHERE {REVIEWABLE_SQL}")
def _(spark, sf_dir):
    asked = _files(spark, sf_dir).where("reviewable").select("pr_id", "file_ord", F.col("message").alias("prompt"))
    return answers.structured(asked, model="scripted").select("pr_id", "file_ord", "attempts", "error", "truncated")


@query("u04_file_reviews", f"""WITH {fx.PR_FILES_SQL}, f AS (SELECT *, {REVIEWABLE_SQL} AS reviewable FROM pr_files),
t AS (SELECT pr_id, sum(additions)::BIGINT AS a, sum(deletions)::BIGINT AS d, count(*) FILTER (reviewable) AS n, count(*) FILTER (reviewable AND file_ord % 7 IN (0, 2)) AS failed_files,
  count(*) FILTER (reviewable AND file_ord % 7 NOT IN (0, 2) AND file_ord % 11 = 0)::INT AS critical_count, coalesce(sum(file_ord % 3) FILTER (reviewable AND file_ord % 7 NOT IN (0, 2)), 0)::INT AS high_count FROM f GROUP BY pr_id HAVING n > 0)
SELECT pr_id, CASE WHEN critical_count + high_count = 0 THEN concat('Reviewed ', n, ' files with +', a, '/-', d, ' changes. No issues found.') ELSE concat('Reviewed ', n, ' files. Found ', critical_count + high_count, ' issue(s): ', critical_count, ' critical, ', high_count, ' high, 0 medium/low.') END AS summary,
  CASE WHEN critical_count > 0 OR high_count >= 3 THEN 'request_changes' WHEN high_count = 0 THEN 'approve' ELSE 'comment' END AS decision, CASE WHEN critical_count > 0 THEN 0.9 WHEN high_count >= 3 OR high_count = 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence,
  (critical_count + high_count)::INT AS total_comments, critical_count, high_count, failed_files FROM t""")
def _(spark, sf_dir):
    return answers.review_files(_files(spark, sf_dir), F.col("message"), "scripted").drop("comments")
