"""Sources and sinks at the engine's edge: landed API responses, file contents, standards, and tables.

Live services are not called. What a client would fetch page by page is read from landed JSON, by
Spark's reader or, page by page, by a Python data source with one partition a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PR_SCHEMA = "title string, body string, number int, user struct<login:string>, base struct<ref:string>, head struct<ref:string,sha:string>, labels array<struct<name:string>>"
FILE_SCHEMA = "filename string, status string, additions int, deletions int, patch string, previous_filename string"
CONTENT_SCHEMA = "path string, encoding string, content string, size bigint"
PAGE = 100
# The default coding standards (id, title, description, category, severity).
DEFAULT_STANDARDS = [
    ("SEC-001", "No hardcoded secrets or credentials", "Never hardcode API keys, passwords, tokens, or other secrets in source code. Use environment variables or secret management services.", "security", "critical"),
    ("SEC-002", "Validate and sanitize all external input", "All data from external sources (user input, API responses, file contents) must be validated before use. Use parameterized queries for database operations.", "security", "critical"),
    ("ERR-001", "Handle errors explicitly", "Never silently swallow exceptions. Log errors with context, handle them appropriately, or propagate them. Avoid bare except clauses.", "best_practice", "high"),
    ("DOC-001", "Document public interfaces", "All public functions, classes, and modules should have docstrings explaining purpose, parameters, return values, and exceptions.", "documentation", "medium"),
    ("PERF-001", "Avoid N+1 queries and unnecessary loops", "Database queries inside loops indicate an N+1 problem. Use batch fetching, joins, or eager loading instead.", "performance", "high"),
    ("MAINT-001", "Keep functions focused and small", "Functions should do one thing. If a function exceeds ~50 lines or has deeply nested logic, consider breaking it into smaller, well-named functions.", "maintainability", "medium"),
    ("TEST-001", "New features should include tests", "New functionality should be accompanied by unit tests covering the happy path and key edge cases. Bug fixes should include a regression test.", "testing", "medium"),
    ("STYLE-001", "Use consistent naming conventions", "Follow the language's naming conventions: snake_case for Python, camelCase for JS/TS. Be descriptive and avoid single-letter names except in small loops.", "style", "low"),
]
# The tables and their columns.
TABLES = {
    "repositories": "id STRING, github_id BIGINT, full_name STRING, owner STRING, name STRING, installation_id BIGINT, default_branch STRING, is_active BOOLEAN, is_indexed BOOLEAN, indexed_commit_sha STRING, coding_standards_doc STRING, review_config STRING, total_reviews INT, created_at TIMESTAMP, updated_at TIMESTAMP",
    "reviews": "id STRING, repository_id STRING, pr_number INT, pr_title STRING, head_sha STRING, author STRING, status STRING, decision STRING, summary STRING, files_reviewed INT, lines_added INT, lines_deleted INT, duration_seconds DOUBLE, llm_tokens_used INT, github_review_id INT, error_message STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "review_comments": "id STRING, review_id STRING, file_path STRING, line_number INT, diff_position INT, severity STRING, category STRING, message STRING, suggested_fix STRING, rule_id STRING, is_resolved BOOLEAN, posted_to_github BOOLEAN, github_comment_id INT, created_at TIMESTAMP, updated_at TIMESTAMP",
}


def pull_requests(spark: SparkSession, path: str) -> DataFrame:
    """Landed pull requests, flattened; a null body is empty."""
    p = spark.read.schema(PR_SCHEMA).json(path)
    return p.select("number", "title", F.coalesce("body", F.lit("")).alias("description"), F.col("user.login").alias("author"), F.col("base.ref").alias("base_branch"), F.col("head.ref").alias("head_branch"), F.col("head.sha").alias("head_sha"), F.transform(F.coalesce("labels", F.array()), lambda x: x["name"]).alias("labels"))


class PagedFiles(DataSource):
    """Landed pages of files of pull requests: `page-1.json`, `page-2.json`, ... of JSON arrays, in `path` or in a folder a pull
    request below it. A listing is a partition, whose pages are read one after the other until one is missing, empty or not full."""

    @classmethod
    def name(cls) -> str:
        return "paged_files"

    def schema(self) -> str:
        return "listing string, page int, " + FILE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Listings(self.options["path"], int(self.options.get("pageSize", str(PAGE))))


class _Listings(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory)
        return [InputPartition(n) for n in (["."] if any(f.base_name == "page-1.json" for f in found) else []) + names]

    def read(self, partition):
        import json

        from pyarrow import fs

        if partition is None:  # there is no listing
            return
        store, top = fs.FileSystem.from_uri(self.path)
        page, full = 0, True
        while full:
            page += 1
            at = f"{top}/{partition.value}/page-{page}.json"
            if store.get_file_info(at).type == fs.FileType.NotFound:
                return
            with store.open_input_stream(at) as f:
                rows = json.loads(f.read())
            for x in rows:
                yield partition.value, page, x.get("filename"), x.get("status"), x.get("additions"), x.get("deletions"), x.get("patch"), x.get("previous_filename")
            full = len(rows) >= self.size


def paged_files(spark: SparkSession, path: str, page_size: int = PAGE) -> DataFrame:
    """Files of landed listings, with their listing and page; each listing ends by itself."""
    spark.dataSource.register(PagedFiles)
    return spark.read.format("paged_files").option("path", path).option("pageSize", page_size).load()


def contents(spark: SparkSession, path: str) -> DataFrame:
    """Landed file contents: base64 ones decoded as UTF-8 with replacement, others without a text."""
    c = spark.read.schema(CONTENT_SCHEMA).json(path)
    raw = F.try_to_binary(F.regexp_replace("content", r"\s", ""), F.lit("base64"))
    return c.select("path", "size", F.when(F.col("encoding") == "base64", F.make_valid_utf8(raw.cast("string"))).alias("content"))


def tree(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder with their sizes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def standards_text(spark: SparkSession, path: str) -> DataFrame:
    """The document as one row; none if there is no such file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "content string")
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("content"))


def default_standards(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(DEFAULT_STANDARDS)]
    return spark.createDataFrame(rows, "ord int, rule_id string, title string, description string, category string, severity string").withColumns({"language": F.lit(None).cast("string"), "examples": F.lit(None).cast("string"), "tags": F.array().cast("array<string>")})


def create_tables(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def drop_tables(spark: SparkSession, database: str) -> None:
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
