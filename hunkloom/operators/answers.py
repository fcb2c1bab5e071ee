"""Answers of language models that are held to a schema, and reviews of large pull requests file by file."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import providers
from . import decision, diff

# What an answer must hold.
REQUIRED = ["summary", "decision", "confidence", "file_reviews"]
REQUIRED_OF_FILE = ["file_path", "summary", "comments"]
REQUIRED_OF_COMMENT = ["file_path", "line_number", "severity", "category", "message"]
DECISIONS = ["approve", "request_changes", "comment"]
SEVERITIES = ["critical", "high", "medium", "low", "info"]
CATEGORIES = ["security", "bug", "performance", "style", "maintainability", "documentation", "testing", "best_practice", "naming", "complexity"]
RETRY = "\n\nThe last answer could not be used: {}. Answer again with one JSON object that fits."


def schema_error(content: str | None) -> str | None:
    """What is wrong with an answer, by the first rule that it breaks; none for one that fits. A fence around it is taken off."""
    text = (content or "").strip()
    lines = text.split("\n")
    if text.startswith("```") and len(lines) > 2:
        text = "\n".join(lines[1:-1])
    try:
        answer = json.loads(text)
    except ValueError:
        return "the answer is not JSON"
    if not isinstance(answer, dict):
        return "the answer is not an object"
    for name in REQUIRED:
        if name not in answer:
            return f"{name} is missing"
    number = answer["confidence"]
    if not isinstance(answer["summary"], str):
        return "summary is not a text"
    if answer["decision"] not in DECISIONS:
        return "decision is none of " + ", ".join(DECISIONS)
    if isinstance(number, bool) or not isinstance(number, int | float) or not 0 <= number <= 1:
        return "confidence is not a number from 0 to 1"
    if not isinstance(answer["file_reviews"], list):
        return "file_reviews is not a list"
    for file in answer["file_reviews"]:
        if not isinstance(file, dict) or any(k not in file for k in REQUIRED_OF_FILE) or not isinstance(file["comments"], list):
            return "a file review lacks " + ", ".join(REQUIRED_OF_FILE)
        for c in file["comments"]:
            if not isinstance(c, dict) or any(k not in c for k in REQUIRED_OF_COMMENT):
                return "a comment lacks " + ", ".join(REQUIRED_OF_COMMENT)
            if c["severity"] not in SEVERITIES:
                return "a severity is none of " + ", ".join(SEVERITIES)
            if c["category"] not in CATEGORIES:
                return "a category is none of " + ", ".join(CATEGORIES)
    return None


def was_truncated(finish_reason: Column) -> Column:
    """Whether an answer was cut short by the limit of its length."""
    return F.coalesce(finish_reason == "length", F.lit(False))


def structured(prompts: DataFrame, prompt: str = "prompt", model: str = "fixed", attempts: int = 2) -> DataFrame:
    """The rows with content, truncated, attempts and error of the model's answers. An answer that breaks the schema is asked for again, with what
    is wrong about it; a model that raises leaves an error and is not asked again. `error` is null for answers that fit."""
    f = providers.provider(providers.MODELS, model)

    @F.pandas_udf("struct<content string, finish_reason string, attempts int, error string>")
    def run(s: pd.Series) -> pd.DataFrame:
        asked = ["" if p is None else p for p in s]
        found: list[list] = [[None, None, 0, None] for _ in asked]
        left = list(range(len(asked)))
        for _ in range(attempts):
            texts = [asked[i] + (RETRY.format(found[i][3]) if found[i][3] else "") for i in left]
            again = []
            for i, (content, reason, error) in zip(left, providers.answers(f, texts), strict=True):
                wrong = error or schema_error(content)
                found[i] = [content, reason, found[i][2] + 1, wrong]
                if wrong and not error:
                    again.append(i)
            left = again
            if not left:
                break
        return pd.DataFrame({c: pd.Series([r[k] for r in found], dtype="int32" if c == "attempts" else object) for k, c in enumerate(("content", "finish_reason", "attempts", "error"))})

    rows = prompts.withColumn("_a", run(F.col(prompt)))
    return rows.select(*prompts.columns, "_a.content", was_truncated(F.col("_a.finish_reason")).alias("truncated"), "_a.attempts", "_a.error")


def merged_reviews(files: DataFrame, answers: DataFrame) -> DataFrame:
    """One review a pull request from the answers about its files (pr_id, file_ord, content, error): failed files are counted and left out.

    files: all files of the pull requests, with `reviewable`. The summary, decision and confidence follow from the comments.
    """
    read = decision.parse_output(answers.where(F.col("error").isNull()).select("pr_id", "file_ord", "content"))
    comments = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "comments"))), lambda x: x["comments"]))
    said = read.groupBy("pr_id").agg(comments.alias("comments"))
    failed = answers.groupBy("pr_id").agg(F.count_if(F.col("error").isNotNull()).alias("failed_files"))
    totals = diff.pr_totals(files).join(files.where("reviewable").groupBy("pr_id").agg(F.count("*").alias("n_files")), "pr_id", "left")
    out = totals.join(failed, "pr_id").join(said, "pr_id", "left")
    out = out.withColumn("comments", F.coalesce("comments", F.array().cast(said.schema["comments"].dataType)))
    n = lambda s: F.size(F.filter("comments", lambda c: c["severity"] == s))
    out = out.withColumns({"total_comments": F.size("comments"), "critical_count": n("critical"), "high_count": n("high")})
    out = out.withColumn("summary", decision.summary(F.coalesce("n_files", F.lit(0)), F.col("total_additions"), F.col("total_deletions"), F.col("total_comments"), F.col("critical_count"), F.col("high_count")))
    out = decision.decide(out.withColumns({"decision": F.lit("comment"), "confidence": F.lit(0.5)}))
    return out.select("pr_id", "summary", "decision", "confidence", "total_comments", "critical_count", "high_count", "failed_files", "comments")


def review_files(files: DataFrame, message: Column, model: str = "fixed", attempts: int = 2) -> DataFrame:
    """Reviews of pull requests, each reviewable file asked about on its own: files with `reviewable`, and the column that holds a file's message."""
    asked = structured(files.where("reviewable").select("pr_id", "file_ord", message.alias("prompt")), "prompt", model, attempts)
    return merged_reviews(files, asked)
