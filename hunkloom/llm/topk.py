"""Exact top-k search by tiled matrix products.

Queries are dealt into blocks and candidates into shards by a hash of their ids; a tile is one
block against one shard. The grid's shape follows from counted rows: a tile holds about
TILE_QUERIES queries and TILE_ROWS candidates, each query is sent to every shard and each
candidate to every block, so no side is broadcast and no task holds more than a tile. A tile is
a matrix product and keeps k candidates a query; per-query lists are merged as a tree, first of
groups of shards, then of groups of groups.

Defined results: components become floor(1024 * x) in double precision; vectors that are null or
hold a null or non-finite component take no part, nor do rows without an id; empty vectors score
0; vectors of different lengths are not compared; equal scores go to the smaller id, rows with
equal ids are separate candidates, never the query's own, and share one list as queries; sums beyond 53 bits are computed
in whole numbers and cut off at the range of a long; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TILE_QUERIES, TILE_ROWS = 1024, 16384
#: Lists merged at once in a step of the tree.
FAN = 16
SCALE = 1024


def quantised(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and whole-number components of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where(F.col(key).isNotNull() & x.isNotNull() & ~bad).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("double")).alias("v"))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as longs."""
    most = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in c], object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest entries, the first of equal ones."""
    n = scores.shape[1]
    if n <= k:
        r, c = np.nonzero(np.ones(scores.shape, bool))
        return r, c
    least = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
    above, level = scores > least, scores == least
    room = k - above.sum(1, keepdims=True)
    crowded = level.sum(1) > room[:, 0]
    if crowded.any():
        level[crowded] &= np.cumsum(level[crowded], axis=1) <= room[crowded]
    return np.nonzero(above | level)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the vectors, and their components in a row."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


_FOUND = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "shard": pa.int32()}


def _tile(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _FOUND.items()})
        order = np.argsort(right.column("id").to_numpy(), kind="stable")
        right = right.take(order)
        ids = [t.column("id").to_numpy() for t in (left, right)]
        sizes, flat = zip(*(_matrix(t.column("v").combine_chunks()) for t in (left, right)), strict=True)
        for dim in np.intersect1d(*sizes):
            rows = [np.flatnonzero(s == dim) for s in sizes]
            q, c = (f[np.repeat(s == dim, s)].reshape(len(r), dim) for f, s, r in zip(flat, sizes, rows, strict=True))
            q_ids, c_ids = ids[0][rows[0]], ids[1][rows[1]]
            for at in range(0, len(q), 256):
                scores = _scores(q[at : at + 256], c)
                own = [np.searchsorted(c_ids, q_ids[at : at + 256], side) for side in ("left", "right")]
                for i in np.flatnonzero(own[0] < own[1]):
                    scores[i, own[0][i] : own[1][i]] = np.iinfo(np.int64).min
                r, col = best(scores, k)
                keep = q_ids[at + r] != c_ids[col]
                out.append((q_ids[at + r][keep], c_ids[col][keep], scores[r, col][keep]))
        parts = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table({"query_id": parts[0], "vec_id": parts[1], "score": parts[2], "shard": np.full(len(parts[0]), right.column("shard")[0].as_py(), np.int32)})

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """For each query (id, v) its k best candidates (id, v): query_id, rank, vec_id, score."""
    blocks = max(1, -(-queries.count() // TILE_QUERIES))
    n = candidates.count()
    shards = max(1, -(-n // TILE_ROWS))
    left = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = candidates.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.select(F.col("id").alias("id"), F.col("v").alias("v"), "block", F.col("shard").alias("shard"))  # of its own, if both sides come from one table
    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(_tile(k), "query_id long, vec_id long, score long, shard int")
    while shards > 1:
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        shards = -(-shards // FAN)
        own = W.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).drop("rank")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(rows.where("id % 100 = 0"), rows, 10)


OP9_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
