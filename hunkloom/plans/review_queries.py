"""Queries over diffs and risk signals, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import derive
from ..operators import diff, signals
from ..sources import fixtures as fx

HDR = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
LINES_SQL = rf"""{fx.PR_FILES_SQL},
raw AS (SELECT pr_id, file_ord, filename, status, unnest(string_split(patch, chr(10))) AS raw, generate_subscripts(string_split(patch, chr(10)), 1) AS i FROM pr_files WHERE patch <> ''),
marked AS (SELECT *, regexp_matches(raw, '{HDR}') AS head FROM raw),
inside AS (SELECT * FROM (SELECT *, (sum(head::INT) OVER (PARTITION BY file_ord ORDER BY i))::INT AS hunk_no FROM marked) WHERE hunk_no > 0),
kinds AS (SELECT *, (row_number() OVER (PARTITION BY file_ord ORDER BY i))::INT AS pos,
  CASE WHEN head THEN 'hunk_header' WHEN raw LIKE '+%' THEN 'added' WHEN raw LIKE '-%' THEN 'removed' WHEN raw LIKE ' %' OR raw = '' THEN 'context' END AS kind FROM inside),
heads AS (SELECT file_ord, hunk_no, regexp_extract(raw, '{HDR}', 1)::INT AS old_start, coalesce(try_cast(regexp_extract(raw, '{HDR}', 2) AS INT), 1) AS old_count,
  regexp_extract(raw, '{HDR}', 3)::INT AS new_start, coalesce(try_cast(regexp_extract(raw, '{HDR}', 4) AS INT), 1) AS new_count FROM kinds WHERE head),
lines AS (SELECT * FROM (SELECT k.pr_id, k.file_ord, k.filename, k.status, k.hunk_no, k.pos, k.kind,
  CASE WHEN kind IN ('removed', 'context') THEN (old_start + count(*) FILTER (kind IN ('removed', 'context')) OVER w - 1)::INT END AS old_line,
  CASE WHEN kind IN ('added', 'context') THEN (new_start + count(*) FILTER (kind IN ('added', 'context')) OVER w - 1)::INT END AS new_line,
  CASE WHEN kind = 'hunk_header' THEN raw ELSE substr(raw, 2) END AS content, old_start, old_count, new_start, new_count
  FROM kinds k JOIN heads h USING (file_ord, hunk_no) WINDOW w AS (PARTITION BY k.file_ord, k.hunk_no ORDER BY k.i)) WHERE kind IS NOT NULL)"""
FACTS_SQL = f"""{LINES_SQL},
turns AS (SELECT file_ord, hunk_no, count(*) FILTER (kind <> was) AS turns FROM (SELECT *, lag(kind) OVER (PARTITION BY file_ord, hunk_no ORDER BY pos) AS was FROM lines WHERE kind IN ('added', 'removed')) GROUP BY ALL),
facts AS (SELECT pr_id, file_ord, filename, status, hunk_no, max(new_start) AS new_start, max(old_count) AS old_count,
  count(*) FILTER (kind <> 'hunk_header') AS n_lines, count(*) FILTER (kind IN ('added', 'removed')) AS n_changed,
  count(*) FILTER (kind = 'removed' AND regexp_matches(content, '(?i)(try|catch|except|finally|rescue|throw|raise|Error|Exception)')) AS n_error,
  count(*) FILTER (kind = 'added' AND regexp_matches(content, '^\\s*[#//]\\s*(if|for|while|def|class|return|import|var|let|const)\\s')) AS n_commented,
  arg_min(old_line, pos) FILTER (kind = 'removed' AND regexp_matches(content, '(is None|is not None|!= None|== None|=== null|!== null|!= null|== null|\\?\\?|\\?\\.)')) AS null_line,
  arg_min(new_line, pos) FILTER (kind = 'added' AND regexp_matches(content, '(?i)#.*\\b(TODO|FIXME|HACK|XXX|WORKAROUND)\\b')) AS todo_line,
  arg_min(new_line, pos) FILTER (kind = 'added' AND (regexp_matches(content, 'except\\s*:') OR regexp_matches(content, 'except\\s+Exception\\s*:') OR regexp_matches(content, 'catch\\s*\\(\\s*(e|err|error)?\\s*\\)\\s*\\{{?\\s*\\}}'))) AS broad_line
  FROM lines GROUP BY ALL),
hunks AS (SELECT f.*, CASE WHEN n_changed > 1 THEN coalesce(turns, 0)::DOUBLE / (n_changed - 1) ELSE 0.0::DOUBLE END AS entropy FROM facts f LEFT JOIN turns USING (file_ord, hunk_no))"""
_PATH = "len(list_filter([{}], lambda w: contains(lower(filename), w))) > 0"
_HAS = {k: _PATH.format(", ".join(f"'{w}'" for w in words)) for k, words in (("s", signals.SENSITIVE), ("c", signals.CONFIG))}
_TEXT = lambda t: "'" + t.replace("'", "''") + "'"
SIGNALS_SQL = f"""{FACTS_SQL},
totals AS (SELECT pr_id, sum(additions)::BIGINT AS total_additions, sum(deletions)::BIGINT AS total_deletions, count(*) AS files_changed FROM pr_files GROUP BY pr_id),
found AS (
  SELECT pr_id, -1 AS file_ord, '(entire PR)' AS filename, 0 AS hunk_no, NULL::INT AS line_number, 1 AS rule, (total_additions + total_deletions)::VARCHAR AS detail FROM totals WHERE total_additions + total_deletions > 500
  UNION ALL SELECT pr_id, -1, '(entire PR)', 0, NULL, 2, files_changed::VARCHAR FROM totals WHERE files_changed > 15
  UNION ALL SELECT pr_id, file_ord, filename, 0, NULL, 3, (additions + deletions)::VARCHAR FROM pr_files WHERE additions + deletions > 200
  UNION ALL SELECT pr_id, file_ord, filename, hunk_no, new_start, 4, '' FROM hunks WHERE entropy > 0.7 AND n_lines > 10
  UNION ALL SELECT pr_id, file_ord, filename, hunk_no, new_start, 5, '' FROM hunks WHERE n_lines > 50 AND old_count = 0
  UNION ALL SELECT pr_id, file_ord, filename, hunk_no, new_start, 6, n_error::VARCHAR FROM hunks WHERE status <> 'removed' AND n_error >= 2
  UNION ALL SELECT pr_id, file_ord, filename, hunk_no, null_line, 7, '' FROM hunks WHERE status <> 'removed' AND null_line IS NOT NULL
  UNION ALL SELECT pr_id, file_ord, filename, hunk_no, todo_line, 8, '' FROM hunks WHERE status <> 'removed' AND todo_line IS NOT NULL
  UNION ALL SELECT pr_id, file_ord, filename, hunk_no, new_start, 9, n_commented::VARCHAR FROM hunks WHERE status <> 'removed' AND n_commented >= 3
  UNION ALL SELECT pr_id, file_ord, filename, hunk_no, broad_line, 10, '' FROM hunks WHERE status <> 'removed' AND broad_line IS NOT NULL
  UNION ALL SELECT pr_id, file_ord, filename, 0, NULL, 11, list_filter([{', '.join(repr(w) for w in signals.SENSITIVE)}], lambda w: contains(lower(filename), w))[1] FROM pr_files WHERE {_HAS['s']}
  UNION ALL SELECT pr_id, file_ord, filename, 0, NULL, 12, '' FROM pr_files WHERE {_HAS['c']} AND additions + deletions > 5),
rules AS (SELECT * FROM (VALUES {', '.join(f"({n}, '{k}', '{lv}', {c}::DECIMAL(6,4), {signals.GROUPS[n]}, {signals.WEIGHTS[lv]}::DECIMAL(6,4), {_TEXT(signals.TEXTS[k][0])}, {_TEXT(signals.TEXTS[k][1])})" for k, (n, lv, c) in signals.RULES.items())}) r(rule, signal_type, risk_level, confidence, grp, weight, before, after)),
sig AS (SELECT f.*, r.* EXCLUDE (rule, before, after), concat(before, detail, after) AS description FROM found f JOIN rules r USING (rule))"""
SCORES_SQL = f"""{SIGNALS_SQL},
s AS (SELECT pr_id, sum(weight * confidence)::DOUBLE AS total, count(*) AS n, list(DISTINCT signal_type) AS types, bool_or(risk_level = 'critical') AS critical FROM sig GROUP BY pr_id),
p AS (SELECT pr_id, coalesce(n, 0) AS n, types, critical, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, total / n * (0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, n / 5.0::DOUBLE))) END AS risk_score
      FROM (SELECT DISTINCT pr_id FROM pr_files) LEFT JOIN s USING (pr_id)),
advice AS (SELECT *, list_filter([{', '.join(f"CASE WHEN list_contains(types, '{k}') THEN '{t}' END" for k, t in signals.ADVICE)}], lambda x: x IS NOT NULL) AS texts FROM p),
scored AS (SELECT pr_id, risk_score, CASE WHEN risk_score >= 0.8 THEN 'critical' WHEN risk_score >= 0.6 THEN 'high' WHEN risk_score >= 0.35 THEN 'medium' ELSE 'low' END AS risk_level, n AS n_signals,
  CASE WHEN len(texts) > 0 THEN texts WHEN risk_score < 0.2 THEN ['{signals.NO_ADVICE}'] ELSE [] END AS recommendations, coalesce(critical, false) AS has_critical FROM advice),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY pr_id ORDER BY file_score DESC, first))::INT AS rank FROM (SELECT pr_id, filename, sum(confidence)::DOUBLE AS file_score, min((grp, file_ord, hunk_no, rule)) AS first FROM sig WHERE filename <> '(entire PR)' GROUP BY pr_id, filename))"""


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.parse_patches(fx.pr_files(spark, sf_dir))


def signals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.signals(fx.pr_files(spark, sf_dir), lines_of(spark, sf_dir))


def _line_columns(df: DataFrame) -> DataFrame:
    return df.select("pr_id", "file_ord", "hunk_no", "pos", "kind", "old_line", "new_line", "content")


Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


@query("p1_diff_lines", f"WITH {LINES_SQL} SELECT pr_id, file_ord, hunk_no, pos, kind, old_line, new_line, content FROM lines")
def _(spark, sf_dir):
    return _line_columns(lines_of(spark, sf_dir))


@query("p1_hunks", f"WITH {LINES_SQL} SELECT DISTINCT pr_id, file_ord, hunk_no, old_start, old_count, new_start, new_count FROM lines")
def _(spark, sf_dir):
    return lines_of(spark, sf_dir).where("kind = 'hunk_header'").select("pr_id", "file_ord", "hunk_no", "old_start", "old_count", "new_start", "new_count")


@query("a01_pr_totals", f"WITH {fx.PR_FILES_SQL} SELECT pr_id, sum(additions)::BIGINT AS total_additions, sum(deletions)::BIGINT AS total_deletions, count(*) AS files_changed FROM pr_files GROUP BY pr_id")
def _(spark, sf_dir):
    return diff.pr_totals(fx.pr_files(spark, sf_dir))


_LANG_SQL = "CASE WHEN lower(split_part(filename, '/', -1)) = 'dockerfile' THEN 'docker' WHEN lower(split_part(filename, '/', -1)) = 'makefile' THEN 'make' ELSE CASE lower(split_part(filename, '.', -1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in derive.LANGUAGES.items()) + " END END"


@query("r01_language", f"WITH {fx.PR_FILES_SQL} SELECT filename, {_LANG_SQL} AS language, CASE WHEN contains(filename, '.') THEN split_part(filename, '.', -1) ELSE '' END AS extension FROM pr_files")
def _(spark, sf_dir):
    f = F.col("filename")
    return fx.pr_files(spark, sf_dir).select(f, derive.language(f).alias("language"), derive.extension(f).alias("extension"))


@query("r03_file_flags", f"WITH {fx.PR_FILES_SQL} SELECT pr_id, file_ord, additions + deletions AS total_changes, status = 'added' AS is_new_file, status = 'removed' AS is_deleted, status = 'renamed' AS is_renamed FROM pr_files")
def _(spark, sf_dir):
    return diff.with_flags(fx.pr_files(spark, sf_dir)).select("pr_id", "file_ord", "total_changes", "is_new_file", "is_deleted", "is_renamed")


@query("r05_changed_lines", f"WITH {LINES_SQL} SELECT pr_id, file_ord, hunk_no, list(new_line ORDER BY new_line) AS changed FROM lines WHERE kind = 'added' GROUP BY ALL")
def _(spark, sf_dir):
    return diff.changed_lines(lines_of(spark, sf_dir))


@query("r24_changed_filenames", f"WITH {fx.PR_FILES_SQL} SELECT pr_id, list(filename ORDER BY file_ord) AS filenames FROM pr_files GROUP BY pr_id")
def _(spark, sf_dir):
    return diff.changed_filenames(fx.pr_files(spark, sf_dir))


_QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)
REVIEWABLE_SQL = f"split_part(filename, '/', -1) NOT IN ({_QUOTED(derive.SKIPPED_NAMES)}) AND CASE WHEN contains(filename, '.') THEN split_part(filename, '.', -1) ELSE '' END NOT IN ({_QUOTED(derive.SKIPPED_EXTENSIONS)}) AND status <> 'removed'"


@query("f01_reviewable", f"WITH {fx.PR_FILES_SQL} SELECT pr_id, file_ord, filename FROM pr_files WHERE {REVIEWABLE_SQL}")
def _(spark, sf_dir):
    return fx.pr_files(spark, sf_dir).where(derive.reviewable(F.col("filename"), F.col("status"))).select("pr_id", "file_ord", "filename")


@query("f03_by_status", f"WITH {fx.PR_FILES_SQL} SELECT pr_id, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS deleted FROM pr_files GROUP BY pr_id")
def _(spark, sf_dir):
    return diff.status_counts(fx.pr_files(spark, sf_dir))


@query("f04_by_language", f"WITH {fx.PR_FILES_SQL} SELECT pr_id, file_ord FROM pr_files WHERE {_LANG_SQL} = 'python'")
def _(spark, sf_dir):
    return diff.of_language(fx.pr_files(spark, sf_dir), "python").select("pr_id", "file_ord")


@query("f05_added_removed", f"WITH {LINES_SQL} SELECT pr_id, file_ord, hunk_no, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed FROM lines GROUP BY ALL")
def _(spark, sf_dir):
    return lines_of(spark, sf_dir).groupBy("pr_id", "file_ord", "hunk_no").agg(F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"))


@query("f17_skipped_prs", f"WITH {fx.PR_FILES_SQL} SELECT DISTINCT pr_id, 'skipped' AS status FROM pr_files p WHERE NOT EXISTS (SELECT 1 FROM pr_files r WHERE r.pr_id = p.pr_id AND {REVIEWABLE_SQL.replace('filename', 'r.filename').replace('status', 'r.status')})")
def _(spark, sf_dir):
    return diff.skipped(fx.pr_files(spark, sf_dir))


@query("s09_file_defaults", f"WITH {fx.PR_FILES_SQL}, f AS (SELECT pr_id, file_ord, CASE WHEN file_ord % 5 = 0 THEN '' ELSE filename END AS filename, CASE WHEN file_ord % 3 = 0 THEN 'modified' ELSE status END AS status, CASE WHEN file_ord % 2 = 0 THEN 0 ELSE additions END AS additions, CASE WHEN file_ord % 7 = 0 THEN 0 ELSE deletions END AS deletions, CASE WHEN file_ord % 4 = 0 THEN '' ELSE patch END AS patch FROM pr_files) SELECT pr_id, file_ord, filename, status, additions, deletions, md5(patch) AS patch_md5, {_LANG_SQL} AS language FROM f")
def _(spark, sf_dir):
    gone = lambda c, k: F.when(F.col("file_ord") % k != 0, F.col(c))
    given = fx.pr_files(spark, sf_dir).withColumns({c: gone(c, k) for c, k in (("filename", 5), ("status", 3), ("additions", 2), ("deletions", 7), ("patch", 4))})
    return diff.with_defaults(given).select("pr_id", "file_ord", "filename", "status", "additions", "deletions", F.md5("patch").alias("patch_md5"), "language")


@query("a14_entropy", f"WITH {FACTS_SQL} SELECT pr_id, file_ord, hunk_no, n_changed, entropy FROM hunks")
def _(spark, sf_dir):
    return signals.hunk_facts(lines_of(spark, sf_dir)).select("pr_id", "file_ord", "hunk_no", "n_changed", "entropy")


@query("a15_hunk_counts", f"WITH {FACTS_SQL} SELECT pr_id, file_ord, hunk_no, n_lines, n_error, n_commented FROM hunks")
def _(spark, sf_dir):
    return signals.hunk_facts(lines_of(spark, sf_dir)).select("pr_id", "file_ord", "hunk_no", "n_lines", "n_error", "n_commented")


@query("a16_first_matches", f"WITH {FACTS_SQL} SELECT pr_id, file_ord, hunk_no, null_line, todo_line, broad_line FROM hunks")
def _(spark, sf_dir):
    return signals.hunk_facts(lines_of(spark, sf_dir)).select("pr_id", "file_ord", "hunk_no", "null_line", "todo_line", "broad_line")


for _name, (_number, _, _) in signals.RULES.items():

    @query(f"d{_number:02d}_{_name}", f"WITH {SIGNALS_SQL} SELECT pr_id, filename, hunk_no, line_number, signal_type, risk_level, confidence::DOUBLE AS confidence FROM sig WHERE rule = {_number}")
    def _(spark, sf_dir, n=_number):
        return signals_of(spark, sf_dir).where(F.col("rule") == n).select("pr_id", "filename", "hunk_no", "line_number", "signal_type", "risk_level", "confidence")


@query("u03_signals", f"WITH {SIGNALS_SQL} SELECT pr_id, file_ord::BIGINT AS file_ord, filename, hunk_no, line_number, signal_type, risk_level, confidence::DOUBLE AS confidence, description FROM sig")
def _(spark, sf_dir):
    return signals_of(spark, sf_dir).select("pr_id", "file_ord", "filename", "hunk_no", "line_number", "signal_type", "risk_level", "confidence", "description")


@query("a05_level_counts", f"WITH {SIGNALS_SQL} SELECT pr_id, risk_level, count(*) AS n FROM sig GROUP BY ALL")
def _(spark, sf_dir):
    return signals.level_counts(signals_of(spark, sf_dir))


@query("a06_score", f"WITH {SCORES_SQL} SELECT pr_id, risk_score, risk_level, n_signals, has_critical FROM scored")
def _(spark, sf_dir):
    return signals.scores(fx.pr_files(spark, sf_dir), signals_of(spark, sf_dir)).drop("recommendations")


@query("a08_risky_files", f"WITH {SCORES_SQL} SELECT pr_id, rank, filename, file_score FROM ranked WHERE rank <= 10")
def _(spark, sf_dir):
    return signals.risky_files(signals_of(spark, sf_dir))


@query("a09_recommendations", f"WITH {SCORES_SQL} SELECT pr_id, recommendations FROM scored")
def _(spark, sf_dir):
    return signals.scores(fx.pr_files(spark, sf_dir), signals_of(spark, sf_dir)).select("pr_id", "recommendations")


@query("x15_predict", f"WITH {SCORES_SQL} SELECT s.*, coalesce((SELECT list(filename ORDER BY rank) FROM ranked r WHERE r.pr_id = s.pr_id AND rank <= 10), []) AS high_risk_files FROM scored s")
def predict(spark, sf_dir):
    return signals.predict(fx.pr_files(spark, sf_dir), lines_of(spark, sf_dir))


@query("j10_sensitive_keyword", f"WITH {fx.PR_FILES_SQL} SELECT filename, list_filter([{_QUOTED(signals.SENSITIVE)}], lambda w: contains(lower(filename), w))[1] AS keyword FROM pr_files WHERE {_HAS['s']}")
def _(spark, sf_dir):
    word = signals.sensitive_keyword(F.col("filename"))
    return fx.pr_files(spark, sf_dir).select("filename", word.alias("keyword")).where("keyword IS NOT NULL")
