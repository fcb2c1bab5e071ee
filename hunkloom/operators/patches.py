"""Patches from review comments: the lines around a comment, a fix in their place, and the difference as a unified diff."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decision import is_patchable

CONTEXT = 3


def region_diff(path: str, before: list[str], after: list[str], start: int) -> str:
    """Unified diff of a region that begins at line `start` of its file; hunk headers count from there."""
    def ended(x: list[str]) -> list[str]:
        return [line if line.endswith("\n") else line + "\n" for line in x]

    out = []
    for line in difflib.unified_diff(ended(before), ended(after), f"a/{path}", f"b/{path}"):
        if m := re.match(r"@@ -(\d+)(,\d+)? \+(\d+)(,\d+)? @@", line):
            line = f"@@ -{int(m[1]) + start - 1}{m[2] or ''} +{int(m[3]) + start - 1}{m[4] or ''} @@\n"
        out.append(line)
    return "".join(out)


def patches(comments: DataFrame, contents: DataFrame, fixer: Callable[[str, str], str | None] | None = None) -> DataFrame:
    """Patches of comments (pr_id, filename, ordinal, line_number, category, severity, message, suggested_fix) whose file has
    a text in `contents` (pr_id, filename, content). Without a suggested fix, `fixer(original, message)` is asked."""
    wanted = comments.where(is_patchable(F.col("suggested_fix"), F.col("category"), F.col("severity"), F.col("line_number")) & (F.coalesce("line_number", F.lit(0)) != 0))
    rows = wanted.join(contents.where("content <> ''"), ["pr_id", "filename"])

    @F.pandas_udf("struct<original_code:string,fixed_code:string,start_line:int,end_line:int,unified_diff:string>")
    def make(path: pd.Series, content: pd.Series, line: pd.Series, fix: pd.Series, message: pd.Series) -> pd.DataFrame:
        out = []
        for p, c, n, f, m in zip(path, content, line, fix, message, strict=True):
            lines = c.splitlines(keepends=True)
            start, end = max(0, n - 1 - CONTEXT), min(len(lines), n + CONTEXT)
            original = "".join(lines[start:end])
            if n > len(lines) or not (f := f or (fixer(original, m) if fixer else None)):
                out.append((None,) * 5)
                continue
            f = f if f.endswith("\n") else f + "\n"
            out.append((original, f, start + 1, end, region_diff(p, lines[start:end], f.splitlines(keepends=True), start + 1)))
        return pd.DataFrame(out, columns=["original_code", "fixed_code", "start_line", "end_line", "unified_diff"])

    made = rows.withColumn("p", make("filename", "content", "line_number", "suggested_fix", "message"))
    return made.select("pr_id", "filename", "ordinal", "message", "p.*").where("unified_diff IS NOT NULL")


def is_valid(path: Column, fixed: Column, original: Column) -> Column:
    return (F.coalesce(path, F.lit("")) != "") & fixed.rlike(r"\S") & (fixed != original)


def combined(made: DataFrame) -> DataFrame:
    """All non-empty diffs of a PR in order, and how many files they touch."""
    ok = made.where(is_valid(F.col("filename"), F.col("fixed_code"), F.col("original_code")) & (F.col("unified_diff") != ""))
    return ok.groupBy("pr_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "unified_diff"))), lambda x: x["unified_diff"]), "\n").alias("diff"), F.countDistinct("filename").alias("total_files_patched"))


def suggestion(fixed: Column) -> Column:
    return F.concat(F.lit("```suggestion\n"), fixed, F.lit("\n```"))


def n_lines(text: Column) -> Column:
    """Lines of a text whose last line may or may not be ended."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)) - F.when(text.rlike(r"[\n\r\x0b\x0c\x1c-\x1e\x85  ]\z"), 1).otherwise(0))
