"""Risk signals of a pull request, their score, level, ranking and recommendations.

All hunk rules are columns of one aggregation by hunk, and file and PR rules of one pass over
files each; signals then leave arrays of structs. Nothing is scanned once per rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .diff import FILE, pr_totals

# Thresholds, keywords and patterns of the rules.
LARGE_FILE, LARGE_PR, MANY_FILES = 200, 500, 15
SENSITIVE = ["auth", "login", "password", "token", "session", "payment", "billing", "charge", "transaction", "encrypt", "decrypt", "hash", "crypto", "database", "migration", "schema", "permission", "access", "role", "admin"]
CONFIG = ["config", ".env", "settings", "docker-compose", "nginx", "apache", "Dockerfile"]
ERROR_HANDLING = r"(?i)(try|catch|except|finally|rescue|throw|raise|Error|Exception)"
NULL_CHECK = r"(is None|is not None|!= None|== None|=== null|!== null|!= null|== null|\?\?|\?\.)"
NULL_CHECK_LEGACY = r"(is None|is not None|!= None|== None|=== null|!== null|!= null|== null|\?\?|\.\\?)"
TODO = r"(?i)#.*\b(TODO|FIXME|HACK|XXX|WORKAROUND)\b"
COMMENTED = r"^\s*[#//]\s*(if|for|while|def|class|return|import|var|let|const)\s"
BROAD = [r"except\s*:", r"except\s+Exception\s*:", r"catch\s*\(\s*(e|err|error)?\s*\)\s*\{?\s*\}"]
# Fixed values: (rule number, signal, level, confidence), in the order in which signals are listed within their group.
RULES = {
    "large_change": (1, "high", "0.7"), "many_files": (2, "medium", "0.6"), "large_file_change": (3, "medium", "0.6"),
    "high_entropy": (4, "medium", "0.5"), "large_addition": (5, "low", "0.4"),
    "error_handling_removed": (6, "high", "0.75"), "null_check_removed": (7, "high", "0.7"), "todo_added": (8, "low", "0.4"), "commented_code": (9, "low", "0.5"), "broad_exception": (10, "medium", "0.6"),
    "sensitive_area": (11, "medium", "0.6"), "config_change": (12, "medium", "0.5"),
}
# What is said of a signal, before and after a number or word of its own.
TEXTS = {
    "large_change": ("Very large PR (", " lines changed). Large changes correlate with higher defect rates."),
    "many_files": ("Changes span ", " files. Scattered changes are harder to reason about."),
    "large_file_change": ("File has ", " lines changed. Consider breaking into smaller changes."),
    "high_entropy": ("Complex interleaved changes (high entropy). Difficult to verify correctness.", ""),
    "large_addition": ("Large block of new code without modification to existing logic.", ""),
    "error_handling_removed": ("Error handling code removed (", " lines). This may introduce unhandled exceptions."),
    "null_check_removed": ("Null/None check removed. May cause NullPointerException or TypeError at runtime.", ""),
    "todo_added": ("TODO/FIXME comment added. Indicates known incomplete or problematic code.", ""),
    "commented_code": ("Commented-out code added (", " lines). Dead code should be removed, not commented."),
    "broad_exception": ("Overly broad exception handling. May silently swallow important errors.", ""),
    "sensitive_area": ("Changes to security/business-critical area ('", "' in path). Requires careful review."),
    "config_change": ("Configuration file modified. Misconfigurations can cause production outages.", ""),
}
WEIGHTS = {"critical": "1.0", "high": "0.75", "medium": "0.4", "low": "0.15"}
LEVELS = [(0.8, "critical"), (0.6, "high"), (0.35, "medium")]
GROUPS = {**dict.fromkeys((1, 2, 3), 1), **dict.fromkeys((4, 5), 2), **dict.fromkeys(range(6, 11), 3), **dict.fromkeys((11, 12), 4)}
# Texts by signal, in this order.
ADVICE = [
    ("large_change", "Consider breaking this PR into smaller, focused changes for easier review."),
    ("error_handling_removed", "Error handling was removed. Ensure error cases are still properly handled."),
    ("null_check_removed", "Null/None checks were removed. Verify callers cannot pass null values."),
    ("sensitive_area", "Changes touch security-sensitive code. Consider requesting a security-focused review."),
    ("high_entropy", "Some changes have complex interleaved modifications. Extra attention to logic correctness is recommended."),
    ("broad_exception", "Broad exception handling detected. Consider catching specific exceptions and logging errors."),
]
NO_ADVICE = "Low-risk change. Standard review should suffice."


def _signal(name: str, when: Column, line: Column | None = None, said: Column | None = None) -> Column:
    number, level, confidence = RULES[name]
    text = F.concat(*(F.lit(TEXTS[name][0]), said.cast("string"), F.lit(TEXTS[name][1])) if said is not None else (F.lit(TEXTS[name][0]),))
    return F.when(when, F.struct(F.lit(number).alias("rule"), F.lit(name).alias("signal_type"), F.lit(level).alias("risk_level"), F.lit(float(confidence)).alias("confidence"), (F.lit(None) if line is None else line).cast("int").alias("line_number"), text.alias("description")))


def _listed(df: DataFrame, keys: list[Column], signals: list[Column]) -> DataFrame:
    return df.select(*keys, F.explode(F.filter(F.array(*signals), lambda s: s.isNotNull())).alias("s")).select("*", "s.*").drop("s")


def hunk_facts(lines: DataFrame, legacy_null_regex: bool = False) -> DataFrame:
    """What the hunk rules need: one row per hunk."""
    removed, added = F.col("kind") == "removed", F.col("kind") == "added"
    text = F.col("content")
    first = lambda line, when: F.min_by(F.when(when, F.col(line)), F.when(when, F.col("pos")))
    broad = text.rlike(BROAD[0]) | text.rlike(BROAD[1]) | text.rlike(BROAD[2])
    return lines.groupBy(*FILE, "filename", "status", "hunk_no").agg(
        F.max("new_start").alias("new_start"), F.max("old_count").alias("old_count"),
        F.count_if(F.col("kind") != "hunk_header").alias("n_lines"), F.count_if(removed | added).alias("n_changed"), F.count_if("turn").alias("turns"),
        F.count_if(removed & text.rlike(ERROR_HANDLING)).alias("n_error"), F.count_if(added & text.rlike(COMMENTED)).alias("n_commented"),
        first("old_line", removed & text.rlike(NULL_CHECK_LEGACY if legacy_null_regex else NULL_CHECK)).alias("null_line"),
        first("new_line", added & text.rlike(TODO)).alias("todo_line"), first("new_line", added & broad).alias("broad_line"),
    ).withColumn("entropy", F.when(F.col("n_changed") > 1, F.col("turns") / (F.col("n_changed") - 1)).otherwise(F.lit(0.0)))


def signals(files: DataFrame, lines: DataFrame, legacy_null_regex: bool = False) -> DataFrame:
    """All signals: pr_id, filename, line_number, risk_level, signal_type, confidence, description, rule, and their order."""
    hunks = hunk_facts(lines, legacy_null_regex)
    live = F.col("status") != "removed"
    start = F.col("new_start")
    by_hunk = _listed(hunks, [F.col("pr_id"), F.col("file_ord"), F.col("filename"), F.col("hunk_no")], [
        _signal("high_entropy", (F.col("entropy") > 0.7) & (F.col("n_lines") > 10), start),
        _signal("large_addition", (F.col("n_lines") > 50) & (F.col("old_count") == 0), start),
        _signal("error_handling_removed", live & (F.col("n_error") >= 2), start, F.col("n_error")),
        _signal("null_check_removed", live & F.col("null_line").isNotNull(), F.col("null_line")),
        _signal("todo_added", live & F.col("todo_line").isNotNull(), F.col("todo_line")),
        _signal("commented_code", live & (F.col("n_commented") >= 3), start, F.col("n_commented")),
        _signal("broad_exception", live & F.col("broad_line").isNotNull(), F.col("broad_line")),
    ])
    path, changes = F.lower("filename"), F.col("additions") + F.col("deletions")
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(path, w))
    by_file = _listed(files, [F.col("pr_id"), F.col("file_ord"), F.col("filename"), F.lit(0).alias("hunk_no")], [
        _signal("large_file_change", changes > LARGE_FILE, said=changes), _signal("sensitive_area", any_of(SENSITIVE), said=sensitive_keyword(F.col("filename"))), _signal("config_change", any_of(CONFIG) & (changes > 5)),
    ])
    total = F.col("total_additions") + F.col("total_deletions")
    by_pr = _listed(pr_totals(files), [F.col("pr_id"), F.lit(-1).cast("long").alias("file_ord"), F.lit("(entire PR)").alias("filename"), F.lit(0).alias("hunk_no")], [
        _signal("large_change", total > LARGE_PR, said=total), _signal("many_files", F.col("files_changed") > MANY_FILES, said=F.col("files_changed")),
    ])
    out = by_pr.unionByName(by_hunk).unionByName(by_file.withColumn("file_ord", F.col("file_ord").cast("long")))
    group = F.element_at(F.create_map(*(F.lit(x) for kv in GROUPS.items() for x in kv)), F.col("rule"))
    return out.withColumn("signal_ord", F.struct(group.alias("group"), F.col("file_ord").alias("file"), F.col("hunk_no").alias("hunk"), F.col("rule").alias("number")))


def sensitive_keyword(path: Column) -> Column:
    """The first keyword, in the order of the list, that a path holds."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, SENSITIVE)), lambda w: F.contains(F.lower(path), w)), F.lit(1))


def level(score: Column) -> Column:
    out = F.when(score >= LEVELS[0][0], LEVELS[0][1])
    for at, name in LEVELS[1:]:
        out = out.when(score >= at, name)
    return out.otherwise("low")


def _weighted() -> Column:
    """A signal's weight times its confidence; of decimals, so that the order of a sum plays no part."""
    weight = F.lit(None).cast("decimal(6,4)")
    for name, value in WEIGHTS.items():
        weight = F.when(F.col("risk_level") == name, F.lit(value).cast("decimal(6,4)")).otherwise(weight)
    return weight * F.col("confidence").cast("decimal(6,4)")


def scores(prs: DataFrame, found: DataFrame) -> DataFrame:
    """Score, level and recommendations of every PR, with signals or without."""
    each = found.groupBy("pr_id").agg(F.sum(_weighted()).cast("double").alias("total"), F.count("*").alias("n"), F.collect_set("signal_type").alias("types"), F.bool_or(F.col("risk_level") == "critical").alias("critical"))
    return _scored(prs, each)


def _scored(prs: DataFrame, each: DataFrame, *more: str) -> DataFrame:
    out = prs.select("pr_id").distinct().join(each, "pr_id", "left")
    n = F.coalesce("n", F.lit(0))
    score = F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col("total") / n * (0.5 + 0.5 * F.least(F.lit(1.0), n / 5.0))))
    out = out.withColumn("risk_score", score).withColumn("risk_level", level(F.col("risk_score")))
    advice = F.filter(F.array(*(F.when(F.array_contains("types", name), F.lit(text)) for name, text in ADVICE)), lambda x: x.isNotNull())
    none = F.when(F.col("risk_score") < 0.2, F.array(F.lit(NO_ADVICE))).otherwise(F.array().cast("array<string>"))
    return out.select("pr_id", "risk_score", "risk_level", n.alias("n_signals"), F.when(F.size(advice) > 0, advice).otherwise(none).alias("recommendations"), F.coalesce("critical", F.lit(False)).alias("has_critical"), *more)


def risky_files(found: DataFrame, limit: int = 10) -> DataFrame:
    """Files by summed confidence, then by first signal; the first `limit` of each PR."""
    each = found.where("filename <> '(entire PR)'").groupBy("pr_id", "filename").agg(F.sum(F.col("confidence").cast("decimal(6,4)")).cast("double").alias("file_score"), F.min("signal_ord").alias("first"))
    rank = F.row_number().over(W.partitionBy("pr_id").orderBy(F.desc("file_score"), "first"))
    return each.withColumn("rank", rank).where(F.col("rank") <= limit).select("pr_id", "rank", "filename", "file_score")


def level_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("pr_id", "risk_level").agg(F.count("*").alias("n"))


def predict(files: DataFrame, lines: DataFrame, limit: int = 10) -> DataFrame:
    """Score, level and ranked risky files of each PR: signals are found once, gathered by file and then by PR."""
    confidence = F.sum(F.col("confidence").cast("decimal(6,4)")).cast("double")
    by_file = signals(files, lines).groupBy("pr_id", "filename").agg(F.sum(_weighted()).alias("w"), F.count("*").alias("k"), F.collect_set("signal_type").alias("t"), F.bool_or(F.col("risk_level") == "critical").alias("c"), (-confidence).alias("score"), F.min("signal_ord").alias("first"))
    file = F.when(F.col("filename") != "(entire PR)", F.struct("score", "first", "filename"))
    each = by_file.groupBy("pr_id").agg(F.sum("w").cast("double").alias("total"), F.sum("k").alias("n"), F.array_distinct(F.flatten(F.collect_list("t"))).alias("types"), F.bool_or("c").alias("critical"), F.slice(F.array_sort(F.collect_list(file)), 1, limit).alias("ranked"))
    out = _scored(files, each, "ranked")
    return out.withColumn("high_risk_files", F.coalesce(F.transform("ranked", lambda x: x["filename"]), F.array().cast("array<string>"))).drop("ranked")
