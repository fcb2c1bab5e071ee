"""Review history: profiles, patterns, false positives, learning context, and writes of reviews and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import derive

# Known severities, categories and decisions.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
CATEGORIES = ["security", "bug", "performance", "style", "naming", "best_practice", "documentation", "testing", "maintainability"]
DECISIONS = ["approve", "request_changes", "comment"]


def comments_of(reviews: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments with their review's columns."""
    return comments.join(reviews, "review_id")


def author_profiles(reviews: DataFrame, comments: DataFrame, top: int = 5) -> DataFrame:
    """Per repository and author: reviews, approval rate, commonest categories (ties by name), comments a review.

    Comments are counted by review before the join, so a hot author is a sum of small rows."""
    by = ["repository_id", "author"]
    totals = reviews.groupBy(by).agg(F.count("*").alias("total_prs_reviewed"), F.count_if(F.col("decision") == "approve").alias("approved"))
    each = comments.groupBy("review_id", "category").agg(F.count("*").alias("n"))
    counts = each.join(reviews.select("review_id", *by), "review_id").groupBy(*by, "category").agg(F.sum("n").alias("n"))
    top_n = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "category"))), 1, top), lambda x: x["category"])
    issues = counts.groupBy(by).agg(top_n.alias("common_issues"), F.sum("n").alias("total_comments"))
    out = totals.join(issues, by, "left")
    return out.select(*by, "total_prs_reviewed", (F.col("approved") / F.col("total_prs_reviewed")).alias("approval_rate"), F.coalesce("common_issues", F.array().cast("array<string>")).alias("common_issues"), F.coalesce("total_comments", F.lit(0)).alias("total_comments"), (F.coalesce("total_comments", F.lit(0)) / F.col("total_prs_reviewed")).alias("avg_issues_per_pr"))


def repository_patterns(reviews: DataFrame, comments: DataFrame, limit: int = 10) -> DataFrame:
    """A repository's commonest (category, file, message), at least twice seen; ties by these columns."""
    found = comments_of(reviews.select("review_id", "repository_id"), comments).groupBy("repository_id", "category", "file_path", "message").agg(F.count("*").alias("frequency"))
    rank = F.row_number().over(W.partitionBy("repository_id").orderBy(F.desc("frequency"), "category", "file_path", "message"))
    return found.withColumn("rank", rank).where((F.col("rank") <= limit) & (F.col("frequency") >= 2))


def false_positives(reviews: DataFrame, comments: DataFrame, least: int = 3) -> DataFrame:
    """Rules often noted at low severity in reviews that were approved."""
    minor = comments.where(F.col("severity").isin("low", "info") & F.col("rule_id").isNotNull() & (F.col("rule_id") != ""))
    approved = reviews.where("decision = 'approve'").select("review_id", "repository_id")
    return minor.join(approved, "review_id").groupBy("repository_id", "rule_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def comment_counts(reviews: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments of each review, 0 where there are none."""
    n = comments.groupBy("review_id").agg(F.count("*").alias("comment_count"))
    return reviews.select("review_id").join(n, "review_id", "left").withColumn("comment_count", F.coalesce("comment_count", F.lit(0)))


def emphasis_areas(profiles: DataFrame, patterns: DataFrame) -> DataFrame:
    """Up to five areas per author that need attention, from their profile and their repository's patterns."""
    often = patterns.where("frequency >= 5").groupBy("repository_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "message"))), lambda x: F.concat(F.lit("Recurring issue in this repo: "), F.substring(x["message"], 1, 80))).alias("often"))
    p = profiles.join(often, "repository_id", "left")
    own = F.filter(F.array(
        F.when(F.array_contains("common_issues", "security"), F.lit("Author has had security issues in past PRs — review security carefully.")),
        F.when(F.col("avg_issues_per_pr") > 5, F.lit("Author's PRs typically have many issues — thorough review recommended.")),
        F.when((F.col("approval_rate") < 0.3) & (F.col("total_prs_reviewed") >= 3), F.lit("Author's PRs are frequently sent back for changes — check for recurring patterns.")),
    ), lambda x: x.isNotNull())
    return p.select("repository_id", "author", F.slice(F.concat(own, F.coalesce("often", F.array().cast("array<string>"))), 1, 5).alias("areas"))


def comment_text(severity: Column, category: Column, path: Column, message: Column) -> Column:
    return F.concat(F.lit("["), severity, F.lit("] ["), category, F.lit("] "), path, F.lit(": "), message)


def with_ordinals(comments: DataFrame) -> DataFrame:
    """Place of each comment in its review, by line and then by what it says."""
    return comments.withColumn("ordinal", F.row_number().over(W.partitionBy("review_id").orderBy("line_number", "file_path", "message", "severity", "category")) - 1)


def normalised(comments: DataFrame) -> DataFrame:
    """Severities and categories as they are stored: unknown ones become medium and best_practice."""
    return comments.withColumns({"severity": F.when(F.col("severity").isin(SEVERITIES), F.col("severity")).otherwise("medium"), "category": F.when(F.col("category").isin(CATEGORIES), F.col("category")).otherwise("best_practice")})


def stored_decision(decision: Column) -> Column:
    return F.when(decision.isin(DECISIONS), decision)


def review_id(repo: Column, number: Column, sha: Column) -> Column:
    """A review's id: the same pull request at the same commit has the same one."""
    return derive.hashed_id(repo, "#", number, "@", sha)


def stored_reviews(outputs: DataFrame, repositories: DataFrame) -> DataFrame:
    """Rows of the reviews table for finished reviews (repo, pr_number, pr_title, head_sha, author, decision, summary, files_reviewed,
    lines_added, lines_deleted, duration_seconds, llm_tokens_used, comments) of known repositories (id, full_name)."""
    own = outputs.join(repositories.select(F.col("id").alias("repository_id"), F.col("full_name").alias("repo")), "repo")
    return own.select(review_id(F.col("repo"), F.col("pr_number"), F.col("head_sha")).alias("id"), "repository_id", "pr_number", "pr_title", "head_sha", "author", F.lit("completed").alias("status"), stored_decision(F.col("decision")).alias("decision"), "summary", "files_reviewed", "lines_added", "lines_deleted", "duration_seconds", "llm_tokens_used")


def stored_comments(outputs: DataFrame) -> DataFrame:
    """Rows of the comments table: one for each comment of a finished review, with known severities and categories."""
    rows = outputs.select(review_id(F.col("repo"), F.col("pr_number"), F.col("head_sha")).alias("review_id"), F.posexplode("comments").alias("ordinal", "c"))
    rows = normalised(rows.select("review_id", "ordinal", "c.*"))
    return rows.select(derive.hashed_id(F.col("review_id"), ":", F.col("ordinal")).alias("id"), "review_id", "ordinal", "file_path", "line_number", "severity", "category", "message", "suggested_fix", "rule_id")


def counted_repositories(known: DataFrame, outputs: DataFrame) -> DataFrame:
    """Repositories (id, full_name, total_reviews) with those that are new, and their finished reviews added to the totals."""
    n = outputs.groupBy(F.col("repo").alias("full_name")).agg(F.count("*").cast("int").alias("_n"))
    both = known.join(n, "full_name", "full_outer")
    return both.select(F.coalesce("id", derive.hashed_id(F.col("full_name"))).alias("id"), "full_name", (F.coalesce("total_reviews", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("total_reviews"))


def new_repositories(known: DataFrame, seen: DataFrame, key: str = "full_name") -> DataFrame:
    """Known repositories and those seen for the first time."""
    return known.unionByName(seen.select(key).distinct().join(known.select(key), key, "left_anti"), allowMissingColumns=True)


def with_feedback(comments: DataFrame, feedback: DataFrame, key: list[str]) -> DataFrame:
    """Comments with the latest feedback (by `at`) on whether they are resolved."""
    last = feedback.groupBy(*key).agg(F.max_by("is_resolved", "at").alias("said"))
    return comments.join(last, key, "left").withColumn("is_resolved", F.coalesce("said", "is_resolved")).drop("said")


def learning_context(reviews: DataFrame, comments: DataFrame) -> DataFrame:
    """Per repository and author: profile, areas, patterns and rules to suppress."""
    profiles, patterns = author_profiles(reviews, comments), repository_patterns(reviews, comments)
    rules = false_positives(reviews, comments).groupBy("repository_id").agg(F.array_sort(F.collect_list("rule_id")).alias("suppress_rules"))
    seen = patterns.groupBy("repository_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "category", "message", "frequency"))), lambda x: F.concat(F.lit("- ["), x["category"], F.lit("] "), F.substring(x["message"], 1, 200), F.lit(" (seen "), x["frequency"].cast("string"), F.lit("x)"))).alias("patterns"))
    none = F.array().cast("array<string>")
    return profiles.join(emphasis_areas(profiles, patterns), ["repository_id", "author"]).join(rules, "repository_id", "left").join(seen, "repository_id", "left").withColumns({"suppress_rules": F.coalesce("suppress_rules", none), "patterns": F.coalesce("patterns", none)})


# Heads of the sections of a context.
AUTHOR_HEAD, PATTERNS_HEAD, SIMILAR_HEAD = "## Author History (", "## Recurring Repository Patterns:", "## Similar Past Comments (avoid repeating unless still relevant):"
AREAS_HEAD, RULES_HEAD = "## Areas Requiring Extra Attention:", "## Suppressed Rules (known false positives in this repo):"


def with_similar(context: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """The context with the past comments that were found for it (rank, severity, comment, and the columns `by`), in order."""
    each = found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "severity", "comment"))), lambda x: F.struct(x["severity"].alias("severity"), x["comment"].alias("comment"))).alias("similar"))
    return context.join(each, by, "left")


def prompt_context(context: DataFrame, top: int = 3) -> DataFrame:
    """The sections of the context that have something to say, as one text; `similar` comments are a section where the column is there."""
    bullets = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(head + "\n- "), F.array_join(c, "\n- ")))
    t = lambda c: c.cast("string")
    profile = F.concat(F.lit(AUTHOR_HEAD), "author", F.lit("):\n- PRs reviewed: "), t(F.col("total_prs_reviewed")), F.lit("\n- Approval rate: "), t(F.bround(F.col("approval_rate") * 100).cast("int")), F.lit("%\n- Common issues: "), F.array_join(F.slice("common_issues", 1, 3), ", "), F.lit("\n- Avg issues/PR: "), t(F.bround("avg_issues_per_pr", 1)))
    patterns = F.when(F.size("patterns") > 0, F.concat(F.lit(PATTERNS_HEAD + "\n"), F.array_join(F.slice("patterns", 1, 5), "\n")))
    similar = F.lit(None).cast("string")
    if "similar" in context.columns:
        one = F.transform(F.slice("similar", 1, top), lambda c: F.concat(F.lit("- ["), c["severity"], F.lit("] "), F.substring(c["comment"], 1, 100)))
        similar = F.when(F.size("similar") > 0, F.concat(F.lit(SIMILAR_HEAD + "\n"), F.array_join(one, "\n")))
    return context.select("repository_id", "author", F.concat_ws("\n\n", profile, patterns, similar, bullets(AREAS_HEAD, F.col("areas")), bullets(RULES_HEAD, F.col("suppress_rules"))).alias("prompt"))
