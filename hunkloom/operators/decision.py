"""From comments to a decision, a summary and the payload of a posted review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.derive import lookup, strip

# Badges by severity, events by decision, what may be patched without a suggested fix.
BADGES = {"critical": "🚨", "high": "⚠️", "medium": "📝", "low": "💡", "info": "ℹ️"}
EVENTS = {"approve": "APPROVE", "request_changes": "REQUEST_CHANGES", "comment": "COMMENT"}
PATCHABLE_CATEGORIES = ["security", "bug", "performance", "style", "naming"]
PATCHABLE_SEVERITIES = ["critical", "high", "medium"]
OUTPUT_SCHEMA = "summary string, decision string, confidence double, file_reviews array<struct<file_path:string,summary:string,comments:array<struct<file_path:string,line_number:int,severity:string,category:string,message:string,suggested_fix:string,rule_id:string>>>>"
LARGE_FILES, LARGE_ADDITIONS = 10, 1000


def severity_counts(comments: DataFrame, by: str) -> DataFrame:
    return comments.groupBy(by).agg(F.count("*").alias("total_comments"), F.count_if(F.col("severity") == "critical").alias("critical_count"), F.count_if(F.col("severity") == "high").alias("high_count"))


def decide(df: DataFrame) -> DataFrame:
    """Overrule decision and confidence where the counts (total_comments, critical_count, high_count) say so."""
    critical, high, total = F.col("critical_count"), F.col("high_count"), F.col("total_comments")
    decision = F.when(critical > 0, "request_changes").when(high >= 3, "request_changes").when(total == 0, "approve").when((high == 0) & (F.col("decision") == "request_changes"), "comment").otherwise(F.col("decision"))
    confidence = F.when(critical > 0, F.greatest("confidence", F.lit(0.9))).when((high >= 3) | (total == 0), F.greatest("confidence", F.lit(0.8))).otherwise(F.col("confidence"))
    return df.withColumns({"decision": decision, "confidence": confidence})


def decisions(reviews: DataFrame, comments: DataFrame, confidence: float = 0.5) -> DataFrame:
    counts = reviews.select("review_id", "decision").join(severity_counts(comments, "review_id"), "review_id", "left").na.fill(0, ["total_comments", "critical_count", "high_count"])
    return decide(counts.withColumn("confidence", F.lit(confidence)))


def strategy(n_files: Column, additions: Column) -> Column:
    return F.when((n_files > LARGE_FILES) | (additions > LARGE_ADDITIONS), "per_file").otherwise("whole")


def summary(n_files: Column, additions: Column, deletions: Column, total: Column, critical: Column, high: Column) -> Column:
    t = lambda c: c.cast("string")
    none = F.concat(F.lit("Reviewed "), t(n_files), F.lit(" files with +"), t(additions), F.lit("/-"), t(deletions), F.lit(" changes. No issues found."))
    some = F.concat(F.lit("Reviewed "), t(n_files), F.lit(" files. Found "), t(total), F.lit(" issue(s): "), t(critical), F.lit(" critical, "), t(high), F.lit(" high, "), t(total - critical - high), F.lit(" medium/low."))
    return F.when(total == 0, none).otherwise(some)


def event(decision: Column) -> Column:
    return lookup(decision, EVENTS, "COMMENT")


def comment_body(severity: Column, category: Column, message: Column, fix: Column) -> Column:
    text = F.concat(lookup(severity, BADGES, "📝"), F.lit(" **"), F.upper(severity), F.lit("** ("), category, F.lit(")\n\n"), message)
    return F.concat(text, F.when(F.coalesce(fix, F.lit("")) != "", F.concat(F.lit("\n\n```suggestion\n"), fix, F.lit("\n```"))).otherwise(F.lit("")))


def payloads(positioned: DataFrame) -> DataFrame:
    """Inline comments of each PR (pr_id, filename, position, severity, category, message, suggested_fix) as a JSON array."""
    body = comment_body(F.col("severity"), F.col("category"), F.col("message"), F.col("suggested_fix"))
    rows = positioned.select("pr_id", F.struct(F.col("filename").alias("path"), "position", body.alias("body")).alias("c"))
    return rows.groupBy("pr_id").agg(F.to_json(F.array_sort(F.collect_list("c"))).alias("comments"), F.count("*").alias("n_comments"))


# What the body of a posted review says around its summary.
POSTED_HEAD, POSTED_PATCHES = "## 🤖 Automated Code Review\n\n", ("\n\n📦 Generated ", " auto-fix patches.")


def review_payloads(reviews: DataFrame, positioned: DataFrame) -> DataFrame:
    """(pr_id, payload, n_comments): the request that posts each review (pr_id, summary, decision, n_patches) as JSON, with its inline comments
    (pr_id, ordinal, filename, position, severity, category, message, suggested_fix) in order; without any it has no such field."""
    body = comment_body(F.col("severity"), F.col("category"), F.col("message"), F.col("suggested_fix"))
    inline = positioned.select("pr_id", F.struct("ordinal", F.struct(F.col("filename").alias("path"), "position", body.alias("body")).alias("c")).alias("o"))
    inline = inline.groupBy("pr_id").agg(F.transform(F.array_sort(F.collect_list("o")), lambda x: x["c"]).alias("comments"))
    n = F.coalesce("n_patches", F.lit(0))
    text = F.concat(F.lit(POSTED_HEAD), "summary", F.when(n > 0, F.concat(F.lit(POSTED_PATCHES[0]), n.cast("string"), F.lit(POSTED_PATCHES[1]))).otherwise(F.lit("")))
    out = reviews.join(inline, "pr_id", "left")
    return out.select("pr_id", F.to_json(F.struct(text.alias("body"), event(F.col("decision")).alias("event"), "comments")).alias("payload"), F.coalesce(F.size("comments"), F.lit(0)).alias("n_comments"))


def is_patchable(fix: Column, category: Column, severity: Column, line: Column) -> Column:
    return (F.coalesce(fix, F.lit("")) != "") | (category.isin(PATCHABLE_CATEGORIES) & severity.isin(PATCHABLE_SEVERITIES) & line.isNotNull())


def unfenced(content: Column) -> Column:
    """The inside of a fenced answer of more than two lines, or the answer itself, stripped."""
    text = strip(content)
    lines = F.split(text, "\n", -1)
    return F.when(text.startswith("```") & (F.size(lines) > 2), strip(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))).otherwise(text)


def parse_output(answers: DataFrame, content: str = "content", legacy_approve: bool = False) -> DataFrame:
    """Answers with summary, decision, confidence, comments and parse_ok. What can't be read becomes a comment with
    confidence 0.3; with `legacy_approve` it goes through the decision rule and ends as an approval."""
    text = unfenced(F.col(content))
    out = answers.withColumn("_j", F.when(F.try_parse_json(text).isNotNull() & strip(text).startswith("{"), F.from_json(text, OUTPUT_SCHEMA)))
    ok = F.col("_j").isNotNull()
    fill = lambda c: F.struct(F.coalesce(c["file_path"], F.lit("")).alias("file_path"), c["line_number"].alias("line_number"), F.coalesce(c["severity"], F.lit("medium")).alias("severity"), F.coalesce(c["category"], F.lit("best_practice")).alias("category"), F.coalesce(c["message"], F.lit("")).alias("message"), c["suggested_fix"].alias("suggested_fix"), c["rule_id"].alias("rule_id"))
    comments = F.flatten(F.transform(F.coalesce(F.col("_j.file_reviews"), F.from_json(F.lit("[]"), "array<struct<file_path:string,summary:string,comments:array<struct<file_path:string,line_number:int,severity:string,category:string,message:string,suggested_fix:string,rule_id:string>>>>")), lambda f: F.transform(F.coalesce(f["comments"], F.array()), fill)))
    out = out.select(*answers.columns, ok.alias("parse_ok"), F.when(ok, F.coalesce("_j.summary", F.lit(""))).otherwise(F.concat(F.lit("Review generated but output parsing failed: "), F.substring(text, 1, 500))).alias("summary"), F.when(ok, F.coalesce("_j.decision", F.lit("comment"))).otherwise("comment").alias("decision"), F.when(ok, F.coalesce("_j.confidence", F.lit(0.5))).otherwise(0.3).alias("confidence"), comments.alias("comments"))
    n = lambda s: F.size(F.filter("comments", lambda c: c["severity"] == s))
    out = out.withColumns({"total_comments": F.size("comments"), "critical_count": n("critical"), "high_count": n("high")})
    decided = decide(out)
    if legacy_approve:
        return decided
    return decided.withColumns({"decision": F.when(F.col("parse_ok"), F.col("decision")).otherwise("comment"), "confidence": F.when(F.col("parse_ok"), F.col("confidence")).otherwise(0.3)})
