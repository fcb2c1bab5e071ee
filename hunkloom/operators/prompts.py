"""Prompts: headers, budgets of diff text, rendered context and message lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.derive import strip

MAX_DIFF, MAX_FILE, MAX_DESCRIPTION = 50_000, 20_000, 2000


def header(prs: DataFrame) -> Column:
    """Header of a PR (repo, pr_number, title, author, head_branch, base_branch, files, additions, deletions, description, labels)."""
    t = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("## Pull Request: "), "repo", F.lit("#"), t("pr_number"), F.lit("\n**Title:** "), "title", F.lit("\n**Author:** "), "author", F.lit("\n**Branch:** "), "head_branch", F.lit(" → "), "base_branch", F.lit("\n**Files Changed:** "), t("files"), F.lit("\n**Lines:** +"), t("additions"), F.lit(" -"), t("deletions"), F.lit("\n"))
    description = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\n**Description:**\n"), F.substring("description", 1, MAX_DESCRIPTION), F.lit("\n"))).otherwise(F.lit(""))
    labels = F.when(F.coalesce(F.size("labels"), F.lit(0)) > 0, F.concat(F.lit("**Labels:** "), F.array_join("labels", ", "), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(text, description, labels)


def section(name: Column, status: Column, additions: Column, deletions: Column, patch: Column) -> Column:
    return F.concat(F.lit("\n### "), name, F.lit(" ("), status, F.lit(", +"), additions.cast("string"), F.lit(" -"), deletions.cast("string"), F.lit(")\n```diff\n"), patch, F.lit("\n```\n"))


def budgeted(files: DataFrame, limit: int = MAX_DIFF) -> DataFrame:
    """Reviewable files of each PR in order, as far as the budget goes: kept, remaining, size."""
    size = F.length(section(*(F.col(c) for c in ("filename", "status", "additions", "deletions", "patch"))))
    order = W.partitionBy("pr_id").orderBy("file_ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = files.select("pr_id", "file_ord", size.alias("size")).withColumn("total", F.sum("size").over(order))
    fits = F.col("total") <= limit
    return rows.groupBy("pr_id").agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("remaining"), F.coalesce(F.max(F.when(fits, F.col("total"))), F.lit(0)).alias("size"))


def diff_text(files: DataFrame, limit: int = MAX_DIFF) -> DataFrame:
    """The budgeted sections as one text a PR; the number of files left out ends it."""
    rows = files.withColumn("text", section(*(F.col(c) for c in ("filename", "status", "additions", "deletions", "patch"))))
    order = W.partitionBy("pr_id").orderBy("file_ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("fits", F.sum(F.length("text")).over(order) <= limit)
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("file_ord", "text")))), lambda x: x["text"])
    more = F.count_if(~F.col("fits"))
    return rows.groupBy("pr_id").agg(kept.alias("kept"), more.alias("more")).select("pr_id", F.array_join(F.concat("kept", F.when(F.col("more") > 0, F.array(F.concat(F.lit("\n... ("), F.col("more").cast("string"), F.lit(" more files truncated due to size) ...")))).otherwise(F.array().cast("array<string>"))), "\n").alias("diff"))


def related_code(results: Column, most: int = 5) -> Column:
    """Rendered search results (file_path, start_line, end_line, symbol_name, content)."""
    def one(r: Column) -> Column:
        lines = F.concat(F.lit(" (lines "), F.coalesce(r["start_line"].cast("string"), F.lit("?")), F.lit("-"), F.coalesce(r["end_line"].cast("string"), F.lit("?")), F.lit(")"))
        symbol = F.when(F.coalesce(r["symbol_name"], F.lit("")) != "", F.concat(F.lit(" ["), r["symbol_name"], F.lit("]"))).otherwise(F.lit(""))
        return F.concat(F.lit("--- "), F.coalesce(r["file_path"], F.lit("unknown")), lines, symbol, F.lit("\n"), r["content"])

    return F.when(F.size(results) > 0, F.array_join(F.transform(F.slice(results, 1, most), one), "\n\n")).otherwise("No related code found in repository.")


def standards(results: Column, most: int = 5) -> Column:
    def one(r: Column) -> Column:
        rule = F.when(F.coalesce(r["rule_id"], F.lit("")) != "", F.concat(F.lit(" ("), r["rule_id"], F.lit(")"))).otherwise(F.lit(""))
        return F.concat(F.lit("["), F.coalesce(r["category"], F.lit("general")), F.lit("]"), rule, F.lit(": "), r["content"])

    return F.when(F.size(results) > 0, F.array_join(F.transform(F.slice(results, 1, most), one), "\n\n")).otherwise("No specific coding standards found.")


# The parts of a message about one file.
FILE_HEAD, FILE_DIFF, FILE_CONTENT, FILE_STANDARDS = "\n## File Under Review: ", "\n### Diff:\n```\n", "\n### Full File Content:\n```\n", "\n## Applicable Coding Standards:\n"
FILE_REQUEST = "\n## Instructions:\nReview ONLY this file. Produce a JSON response with your findings."


def file_message(head: Column, filename: Column, status: Column, additions: Column, deletions: Column, patch: Column, content: Column, rules: Column) -> Column:
    """The user's message about one file of a pull request: its header, the file's diff, its content if there is one, and standards if there are."""
    about = F.concat(F.lit("Status: "), status, F.lit(" | +"), additions.cast("string"), F.lit(" -"), deletions.cast("string"))
    shown = F.when(F.coalesce(content, F.lit("")) != "", F.concat(F.lit(FILE_CONTENT), F.substring(content, 1, MAX_FILE), F.lit("\n```")))
    held = F.when(F.coalesce(rules, F.lit("")) != "", F.concat(F.lit(FILE_STANDARDS), rules))
    return F.concat_ws("\n", head, F.concat(F.lit(FILE_HEAD), filename), about, F.concat(F.lit(FILE_DIFF), F.substring(F.coalesce(patch, F.lit("")), 1, MAX_DIFF), F.lit("\n```")), shown, held, F.lit(FILE_REQUEST))


def messages(turns: DataFrame) -> DataFrame:
    """System texts of a conversation in a row, and its other turns in order; a request where there are none."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = turns.groupBy("conv_id").agg(ordered.alias("m"))
    system = F.transform(F.filter("m", lambda x: x["role"] == "system"), lambda x: F.concat(F.coalesce(x["text"], F.lit("")), F.lit("\n")))
    rest = F.transform(F.filter("m", lambda x: x["role"] != "system"), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    default = F.array(F.struct(F.lit("user").alias("role"), F.lit("Please respond.").alias("content")))
    return rows.select("conv_id", strip(F.array_join(system, "")).alias("system"), F.when(F.size(rest) > 0, rest).otherwise(default).alias("messages"))


def query_texts(files: DataFrame, lines: DataFrame, first: int = 5, length: int = 500) -> DataFrame:
    """Added text of each hunk of a PR's first files, as retrieval queries: the first texts that aren't blank."""
    few = files.select("pr_id", "file_ord").withColumn("n", F.row_number().over(W.partitionBy("pr_id").orderBy("file_ord"))).where(F.col("n") <= first).drop("n")
    added = lines.where("kind = 'added'").join(few, ["pr_id", "file_ord"]).groupBy("pr_id", "file_ord", "hunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n").alias("text")).where(strip(F.col("text")) != "")
    rank = F.row_number().over(W.partitionBy("pr_id").orderBy("file_ord", "hunk_no"))
    return added.withColumn("n", rank).where(F.col("n") <= first).select("pr_id", "n", F.substring("text", 1, length).alias("query_text"))
