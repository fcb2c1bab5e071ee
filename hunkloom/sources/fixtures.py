"""Views over the test tables that stand in for pull requests, reviews and comments, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = """CASE WHEN (i-1) % (CASE WHEN doc_id % 7 = 1 THEN 60 ELSE 12 END) = 0
  THEN CASE WHEN doc_id % 7 = 1 THEN concat('@@ -0,0 +', i, ',60 @@') ELSE concat('@@ -', i, ',12 +', i, ',12 @@') END
  ELSE concat(CASE WHEN doc_id % 7 = 1 THEN '+' WHEN doc_id % 3 = 0 THEN CASE WHEN i % 2 = 0 THEN '+' ELSE '-' END
              ELSE CASE (i*7+doc_id) % 5 WHEN 0 THEN '-' WHEN 2 THEN ' ' WHEN 4 THEN '-' ELSE '+' END END,
              CASE (i*3+doc_id) % 9 WHEN 0 THEN 'except Exception:' WHEN 2 THEN '# if x ' WHEN 4 THEN 'if y is None'
                   WHEN 6 THEN '# TODO later' ELSE x END) END"""
_FILE = """concat('pr', CAST(floor(sqrt(doc_id)) AS INT)) AS pr_id, doc_id AS file_ord,
  CASE doc_id % 8 WHEN 0 THEN concat('src/auth/m', doc_id, '.py') WHEN 1 THEN concat('config/settings', doc_id, '.yml')
    WHEN 2 THEN concat('web/a', doc_id, '.ts') WHEN 3 THEN concat('d', doc_id, '/package-lock.json')
    WHEN 4 THEN concat('img/b', doc_id, '.png') WHEN 5 THEN concat('docker/', doc_id, '/Dockerfile')
    WHEN 6 THEN concat('lib/c', doc_id, '.go') ELSE concat('doc/r', doc_id, '.md') END AS filename,
  CASE doc_id % 9 WHEN 0 THEN 'removed' WHEN 1 THEN 'renamed' WHEN 2 THEN 'added' ELSE 'modified' END AS status,
  CAST(n_chars % 300 AS INT) AS additions, CAST(n_chars % 120 AS INT) AS deletions"""
_REVIEWS = """SELECT o_orderkey AS review_id, c_nationkey AS repository_id, concat('user', o_custkey % 100) AS author,
  CASE o_orderstatus WHEN 'F' THEN 'approve' WHEN 'O' THEN 'request_changes' ELSE 'comment' END AS decision
FROM orders JOIN customer ON o_custkey = c_custkey"""
_COMMENTS = """SELECT l_orderkey AS review_id, l_linenumber AS line_number, concat('src/m', l_suppkey % 5, '.py') AS file_path,
  CASE WHEN l_quantity <= 10 THEN 'info' WHEN l_quantity <= 20 THEN 'low' WHEN l_quantity <= 30 THEN 'medium'
       WHEN l_quantity <= 45 THEN 'high' ELSE 'critical' END AS severity,
  CASE l_partkey % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'bug' WHEN 2 THEN 'style' WHEN 3 THEN 'testing' ELSE 'naming' END AS category,
  CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE concat('R', l_suppkey % 25) END AS rule_id,
  concat('msg', l_partkey % 4) AS message
FROM lineitem"""

#: DuckDB common table expressions of the same views.
PR_FILES_SQL = f"pr_files AS (SELECT {_FILE}, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {_LINE}), chr(10)) AS patch FROM documents)"
REVIEWS_SQL = f"reviews AS ({_REVIEWS})"
COMMENTS_SQL = f"review_comments AS ({_COMMENTS})"
SECRETS_SQL = f"secret_files AS (SELECT {_FILE}, replace(text, 'token = ', 'secret = ') AS content FROM documents)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = "array_join(transform(split(text, '\\n'), (x, j) -> " + _LINE.replace("i-1", "j").replace("(i*", "((j+1)*").replace(" i % 2", " (j+1) % 2").replace(", i, ", ", j+1, ") + "), '\\n')"
    return table(spark, sf_dir, "documents").selectExpr(*_split(_FILE), f"{patch} AS patch")


def secret_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*_split(_FILE), "replace(text, 'token = ', 'secret = ') AS content")


def _split(columns: str) -> list[str]:
    """Top-level items of a select list."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:k])
            start = k + 1
    return [*out, columns[start:]]


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_REVIEWS.replace("orders JOIN customer", "{orders} JOIN {customer}"), orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


def review_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_COMMENTS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector documents: id, repo (by label) and embedding in double precision."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("repo"), F.col("label")).alias("repo"), F.col("embedding").cast("array<double>").alias("embedding"))
