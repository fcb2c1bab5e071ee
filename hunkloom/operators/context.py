"""Pull requests put together for a review: metadata, files, contents that are worth reading, and look-ups in the diff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import derive

MAX_FILE_SIZE = 100_000
# Extensions of files whose content isn't fetched.
BINARY_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "ttf", "eot", "pdf"]


def repo_full_name(owner: Column, repo: Column) -> Column:
    return F.concat(owner, F.lit("/"), repo)


def fetchable(status: Column, size: Column, path: Column, max_size: int = MAX_FILE_SIZE) -> Column:
    """Not removed, not larger than the bound (an absent size or 0 passes), and no binary extension."""
    return (F.coalesce(status, F.lit("")) != "removed") & (F.coalesce(size, F.lit(0)) <= max_size) & ~derive.extension(path).isin(BINARY_EXTENSIONS)


def pull_request_context(prs: DataFrame, files: DataFrame, contents: DataFrame, max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """Each row of `prs` (pr_id, ...) with the totals and names of its files (pr_id, file_ord, filename, status, additions, deletions, size)
    and the paths and contents that were fetched (contents: pr_id, filename, content); files without a content are left out there.

    Contents are joined before they are gathered, so what is grouped is one pull request's own files.
    """
    wanted = files.where(fetchable(F.col("status"), F.col("size"), F.col("filename"), max_size)).select("pr_id", "file_ord", "filename")
    got = wanted.join(contents.where("content IS NOT NULL").select("pr_id", "filename", "content"), ["pr_id", "filename"])
    got = got.groupBy("pr_id").agg(F.array_sort(F.collect_list(F.struct("file_ord", "filename", "content"))).alias("file_contents"))
    own = files.groupBy("pr_id").agg(F.sum("additions").cast("long").alias("total_additions"), F.sum("deletions").cast("long").alias("total_deletions"), F.count("*").alias("files_changed"), F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "filename"))), lambda x: x["filename"]).alias("filenames"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total_additions", "total_deletions", "files_changed")}
    out = prs.join(own, "pr_id", "left").withColumns(zero).withColumn("filenames", F.coalesce("filenames", F.array().cast("array<string>")))
    return out.join(got, "pr_id", "left")


def get_file(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The first file of a pull request with a name: wanted (pr_id, filename) with file_ord, status and the rest; null where there is none."""
    rest = [c for c in files.columns if c not in ("pr_id", "filename", "file_ord")]
    first = files.groupBy("pr_id", "filename").agg(F.min(F.struct("file_ord", *rest)).alias("_f")).select("pr_id", "filename", "_f.*")
    return wanted.join(first, ["pr_id", "filename"], "left")


def line_at(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """The diff line at a position: wanted (pr_id, file_ord, pos) with kind, content, old_line and new_line; null where there is none."""
    return wanted.join(lines.select("pr_id", "file_ord", "pos", "kind", "content", "old_line", "new_line"), ["pr_id", "file_ord", "pos"], "left")


def file_languages(files: DataFrame, languages: DataFrame) -> DataFrame:
    """Files whose language is among a pull request's languages (pr_id, language)."""
    return files.withColumn("language", derive.language(F.col("filename"))).join(languages.distinct(), ["pr_id", "language"])


def comment_payload(comment: DataFrame) -> DataFrame:
    """A single comment as the request that posts it: issue comments without a path, line comments with path, position and commit."""
    line = F.to_json(F.struct("body", F.col("head_sha").alias("commit_id"), F.col("filename").alias("path"), "position"))
    return comment.withColumn("payload", F.when(F.col("filename").isNull(), F.to_json(F.struct("body"))).otherwise(line))
