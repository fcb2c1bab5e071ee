"""Vector store: upserts and deletes as rewrites, filters before search, exact cosine top-k by tiles.

Queries are dealt into blocks and documents into shards of the same group; a tile is a block against a shard, a matrix product
over Arrow that keeps k documents a query, and the tiles' lists are merged by query. A query is sent to every shard and a
document to every block of its group, so no side is broadcast, no pair of rows is built, and no task holds more than a tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import providers
from . import filters

#: Queries and documents of a tile; its scores are worked out for ROWS queries at once.
TILE_QUERIES, TILE_DOCS, ROWS = 1024, 16384, 64
#: By how much products of matrices may differ from sums from left to right; what is as near to the k-th best is summed again.
SLACK = 1e-9
#: What a search says that has nothing to search for (a fixed text).
NEITHER = "Either query_embedding or query_text must be provided"


def asked(queries: DataFrame, embedder: str = "hashed") -> DataFrame:
    """Queries with their vector in `query`: the one given, else that of `query_text`; an error for rows with neither (an empty one is none)."""
    given = {"query", "query_text"} & set(queries.columns)
    if not given:
        raise ValueError(NEITHER)
    if "query_text" not in given:
        return queries.withColumn("query", F.when(F.size("query") > 0, F.col("query")).otherwise(F.raise_error(F.lit(NEITHER)).cast("array<double>")))
    text = F.nullif(F.col("query_text"), F.lit(""))
    own = F.when(F.size("query") > 0, F.col("query").cast("array<double>")) if "query" in given else F.lit(None).cast("array<double>")
    made = providers.embed(F.when(own.isNull(), text), embedder).cast("array<double>")
    return queries.withColumn("query", F.when(own.isNotNull(), own).when(text.isNotNull(), made).otherwise(F.raise_error(F.lit(NEITHER)).cast("array<double>"))).drop("query_text")


def _usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _matrix(table: pa.Table, name: str, dim: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has that many components, and their vectors."""
    flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.flatnonzero(sizes == dim), flat[np.repeat(sizes == dim, sizes)].reshape(-1, dim)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of paired rows, summed from left to right."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += x * y
    return out


def _tile(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("id")
        found = [[], [], []]
        sizes = [np.diff(t.column(c).combine_chunks().offsets.to_numpy()) for t, c in ((left, "query"), (right, "embedding"))]
        for dim in np.intersect1d(*sizes):
            (q_at, q), (d_at, d) = _matrix(left, "query", dim, sizes[0]), _matrix(right, "embedding", dim, sizes[1])
            norms = [np.sqrt(_dot(x, x)) for x in (q, d)]
            scaled = [x / np.where(n > 0, n, 1)[:, None] for x, n in zip((q, d), norms, strict=True)]
            for low in range(0, len(q), ROWS):
                near = scaled[0][low : low + ROWS] @ scaled[1].T
                least = np.partition(near, len(d) - k, axis=1)[:, len(d) - k] if len(d) > k else np.full(len(near), -2.0)
                row, col = np.nonzero(near >= least[:, None] - SLACK)
                size = norms[0][low + row] * norms[1][col]
                distance = 1 - np.divide(_dot(q[low + row], d[col]), size, out=np.zeros(len(row)), where=size > 0)
                order = np.lexsort((col, distance, row))
                row, col, distance = row[order], col[order], distance[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                for out, values in zip(found, (q_at[low + row[kept]], d_at[col[kept]], distance[kept]), strict=True):
                    out.append(values)
        at = [np.concatenate(f) if f else np.zeros(0, int) for f in found]
        return pa.table({"query_id": left.column("query_id").take(pa.array(at[0], pa.int64())), "id": right.column("id").take(pa.array(at[1], pa.int64())), "distance": pa.array(at[2], pa.float64())})

    return run


def search(queries: DataFrame, docs: DataFrame, k: int, where: Column | dict | None = None, by: str | None = None, where_document: dict | None = None, embedder: str = "hashed") -> DataFrame:
    """The k best documents (id, embedding, ...) of each query (query_id, and query or query_text): query_id, id, the documents' other
    columns, distance, rank and score; ties go to the smaller id. With `by`, only documents that have the query's value there.

    `where` is a condition, or a tree of metadata (see `filters`), `where_document` a tree of the `content`; both are met before the search. A
    vector of zeros is at distance 1 from all; null vectors and those with null or non-finite components take no part; vectors of
    different lengths are not compared; ids of documents are unique.
    """
    docs = docs if where is None else docs.where(filters.metadata(where) if isinstance(where, dict) else where)
    docs = docs if where_document is None else docs.where(filters.document(where_document))
    group = F.col(by) if by else F.lit(0)
    left = asked(queries, embedder).select("query_id", F.col("query").cast("array<double>").alias("query"), group.alias("_group")).where(_usable("query"))
    right = docs.select("id", F.col("embedding").cast("array<double>").alias("embedding"), group.alias("_group")).where(_usable("embedding"))
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    if by:
        grid = left.groupBy("_group").agg(parts(F.count("*"), TILE_QUERIES).alias("_blocks")).join(right.groupBy("_group").agg(parts(F.count("*"), TILE_DOCS).alias("_shards")), "_group")
        left, right = left.join(grid, "_group"), right.join(grid, "_group")
    else:
        grid = {"_blocks": parts(F.lit(left.count()), TILE_QUERIES), "_shards": parts(F.lit(right.count()), TILE_DOCS)}
        left, right = left.withColumns(grid), right.withColumns(grid)
    dealt = lambda df, key, own, other, dealt_by, sent_to: df.withColumns({own: F.pmod(F.xxhash64(key), dealt_by).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(sent_to) - 1))}).drop("_blocks", "_shards")
    left = dealt(left, "query_id", "_block", "_shard", F.col("_blocks"), "_shards")
    right = dealt(right, "id", "_shard", "_block", F.col("_shards"), "_blocks")
    key = ["_group", "_block", "_shard"]
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((left, "query_id"), (right, "id"))}
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_tile(k), f"query_id {types['query_id']}, id {types['id']}, distance double")
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k).withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("distance")))
    others = [c for c in docs.columns if c not in ("id", "embedding", "query_id", "distance", "rank", "score")]
    return found.join(docs.select("id", *others), "id") if others else found


def upsert(current: DataFrame, batch: DataFrame, key: str = "id", order: str = "version") -> DataFrame:
    """Both tables' rows with the latest version of each key."""
    both = current.unionByName(batch)
    return both.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_rank = 1").drop("_rank")


def delete(current: DataFrame, ids: DataFrame | None = None, where: Column | None = None, key: str = "id") -> DataFrame:
    """Without rows that are among the ids and meet the condition, of which either may be absent; neither removes nothing."""
    if ids is None and where is None:
        return current
    if where is None:
        return current.join(ids.select(key), key, "left_anti")
    hit = F.coalesce(where, F.lit(False))
    if ids is None:
        return current.where(~hit)
    return current.where(~hit).unionByName(current.where(hit).join(ids.select(key), key, "left_anti"))


def drop_collection(current: DataFrame, name: str) -> DataFrame:
    return current.where(F.col("collection") != name)


def counts(current: DataFrame, by: str) -> DataFrame:
    return current.groupBy(by).agg(F.count("*").alias("n"))


def retrieve(queries: DataFrame, code: DataFrame, standards: DataFrame, history: DataFrame, repo: Column) -> DataFrame:
    """Ten code chunks of any kind, five standards and five past reviews of the repository."""
    parts = [search(queries, code, 10).withColumn("collection", F.lit("code")), search(queries, standards, 5, repo).withColumn("collection", F.lit("standards")), search(queries, history, 5, repo).withColumn("collection", F.lit("reviews"))]
    columns = ["collection", "query_id", "rank", "id", "score"]
    return parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns))
