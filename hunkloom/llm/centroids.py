"""Centroid clustering by delta Lloyd.

The state of a round is a table of vectors, each with its cluster and its distance to it, and
the exact component sums and counts of all clusters. A round replaces centroids by their means;
those that differ from before have *changed*. A vector whose own centroid has changed is compared with
all centroids, every other one with the changed centroids only: its own one is where it was, and so
are those it lost to. Vectors that go over to another cluster are added up as signed integers
(taken off the old cluster, put to the new one) within each task and then by cluster and component, so
that the sums of the next round follow from those of this one. Centroids and sums are k times the
dimension, the only things that pass through the driver.

Defined results: vectors of another length, null ones and those with a null or non-finite
component take no part; components are floor(scale * x) in double precision, held within the range of a
long; sums, means (floor) and distances are exact, a distance beyond the range of a long is
given as its largest value, but vectors are compared by the exact one; equal distances go to the smaller number; an
empty cluster keeps its centroid; with fewer vectors than k there are as many centroids as vectors; the starting
vectors are those with the smallest hashes of their ids (null as an empty text), equal ones in the order of
their components; repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, remove

SCALE, K, ROUNDS, DIM, SEED = 256, 40, 5, 64, 2
#: Sums below this are exact in the products of doubles that compare vectors with centroids.
EXACT = 2**53
TOP = 2**63 - 1
#: Vectors compared at once; bounds a worker's memory at about this many times k distances.
CHUNK = 4096


def kept(df: DataFrame, key: str, vector: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and whole-number components `v` of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(2**62))), F.lit(-float(2**62)))))
    return df.where(x.isNotNull() & (F.size(x) == dim) & ~bad).select(F.col(key).cast("long").alias("vec_id"), whole.alias("v"))


def start(rows: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The first k vectors in the order of the hashes of their ids."""
    own = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in rows.withColumn("_hash", own).orderBy("_hash", "v").limit(k).collect()]


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v to those of c: longs, or Python integers where longs don't hold them."""
    if not v.size or not c.size:
        return np.zeros((len(v), len(c)), np.int64)
    most = max(abs(int(v.max())), abs(int(v.min())), abs(int(c.max())), abs(int(c.min())))
    if 4 * most * most * v.shape[1] < EXACT:
        v, c = v.astype(np.float64), c.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    v, c = v.astype(object), c.astype(object)
    return np.stack([((v - row) ** 2).sum(1) for row in c], axis=1)


def nearest(v: np.ndarray, centroids: np.ndarray, own: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and distance of each row of v, given its cluster so far (-1: none) and which centroids have changed.

    The distance to an unchanged own centroid is worked out anew from the vector, which is cheaper than carrying it
    exactly; no other unchanged centroid is looked at.
    """
    cluster, least = own.copy(), np.zeros(len(v), object)
    lost = (own < 0) | changed[np.maximum(own, 0)] if len(changed) else own < 0
    at = np.flatnonzero(lost)
    if len(at):
        d = distances(v[at], centroids)
        cluster[at] = d.argmin(1)
        least[at] = d[np.arange(len(at)), cluster[at]]
    at, new = np.flatnonzero(~lost), np.flatnonzero(changed)
    if len(at):
        for name in np.unique(own[at]):
            mine = at[own[at] == name]
            least[mine] = distances(v[mine], centroids[name : name + 1])[:, 0]
        if len(new):
            d = distances(v[at], centroids[new])
            best = d.argmin(1)
            value, number = d[np.arange(len(at)), best], new[best]
            nearer = np.array((value < least[at]) | ((value == least[at]) & (number < own[at])), bool)
            cluster[at[nearer]], least[at[nearer]] = number[nearer], value[nearer]
    return cluster, least


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("v"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def assign(state: DataFrame, centroids: list[list[int]], changed: list[bool]) -> DataFrame:
    """The state (vec_id, v, cluster) after one comparison: with `was`, the cluster before, and distance."""
    middle, new, dim = np.array(centroids, np.int64), np.array(changed), len(centroids[0])
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("was", pa.int32()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                part = batch.slice(low, CHUNK)
                own = part.column(2).to_numpy(zero_copy_only=False).astype(np.int32)
                cluster, least = nearest(_vectors(part, dim), middle, own, new)
                held = pa.array([min(int(d), TOP) for d in least], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(schema.field("v").type), pa.array(own, pa.int32()), pa.array(cluster.astype(np.int32)), held], schema=schema)

    return state.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id long, v array<long>, was int, cluster int, distance long")


def transfers(state: DataFrame, dim: int) -> DataFrame:
    """Signed counts (at -1) and component sums of what clusters won and lost: cluster, at, change."""
    schema = pa.schema([("cluster", pa.int32()), ("at", pa.int32()), ("change", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            v = _vectors(batch, dim)
            for column, sign in ((1, -1), (2, 1)):
                own = batch.column(column).to_numpy(zero_copy_only=False)
                for name in np.unique(own[own >= 0]):
                    rows = v[own == name]
                    parts = [(rows >> 32).sum(0), (rows & 0xFFFFFFFF).sum(0)]  # so that no sum of a batch overflows
                    sums = [(int(high) << 32) + int(low) for high, low in zip(*parts, strict=True)]
                    so_far = total.setdefault(int(name), [0] * (dim + 1))
                    total[int(name)] = [a + sign * b for a, b in zip(so_far, [len(rows), *sums], strict=True)]
        found = [(name, i - 1, str(x)) for name, sums in total.items() for i, x in enumerate(sums) if x]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], schema.field(i).type) for i in range(3)], schema=schema)

    moved = state.where("was <> cluster").select("v", "was", "cluster")
    return moved.mapInArrow(run, "cluster int, at int, change string").groupBy("cluster", "at").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change"))


def lloyd(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """The vectors (vec_id, v) with their cluster and distance after `rounds` rounds and one more assignment, and the centroids.

    Each round's state is written to the shared folder, from which lost tasks start over; the one before is deleted then.
    """
    spark = rows.sparkSession
    centroids = start(rows, k, seed)
    state = rows.withColumn("cluster", F.lit(-1))
    if not centroids:
        return state.withColumn("distance", F.lit(0).cast("long")), []
    dim = len(centroids[0])
    changed, totals, old = [True] * len(centroids), [[0] * (dim + 1) for _ in centroids], None
    for left in range(rounds, -1, -1):
        now, path = assign(state, centroids, changed), new_folder(spark, "vectors")
        now.write.parquet(path)
        state = spark.read.schema(now.schema).parquet(path)
        if old is not None:
            remove(spark, old)
        old = path
        if not left:
            break
        for name, at, change in transfers(state, dim).collect():  # at most k times (dim + 1) rows
            totals[name][at + 1] += int(change)
        means = [[x // t[0] for x in t[1:]] if t[0] else c for c, t in zip(centroids, totals, strict=True)]
        changed = [a != b for a, b in zip(means, centroids, strict=True)]
        centroids = means
        if not any(changed):  # further rounds would change nothing
            break
    return state, centroids


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    state, centroids = lloyd(kept(df, key, vector, dim, scale), k, rounds, seed)
    spark = df.sparkSession
    each = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # at most k rows
    whole = sum(int(r.s) for r in each)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = [(r.cluster, min(int(r.s), TOP), min(whole, TOP), hashes[r.cluster]) for r in each]
    known = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds_sql(rounds: int = ROUNDS) -> str:
    """Rounds written out: c<i> holds number, component index and component of each centroid."""
    near = """a{i} AS MATERIALIZED (SELECT row, arg_min(number, (d, number)) AS number, min(d) AS d FROM (
  SELECT v.row, c.number, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{i} c ON v.pos = c.pos GROUP BY ALL) GROUP BY row)"""
    mean = """c{n} AS MATERIALIZED (SELECT c.number, c.pos, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
  SELECT a.number, v.pos, CASE WHEN sum(v.x) >= 0 THEN sum(v.x) // count(*) ELSE -((-sum(v.x) + count(*) - 1) // count(*)) END::BIGINT AS x
  FROM a{i} a JOIN v ON a.row = v.row GROUP BY ALL) m ON c.number = m.number AND c.pos = m.pos)"""
    steps = [near.format(i=0)]
    for i in range(rounds):
        steps += [mean.format(i=i, n=i + 1), near.format(i=i + 1)]
    return ",\n".join(steps)


OP13_SQL = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT row, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
c0 AS MATERIALIZED (SELECT s.number, v.pos, v.x FROM (SELECT row, row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS number FROM e) s JOIN v ON s.row = v.row WHERE s.number < 40),
{_rounds_sql()}
SELECT e.vec_id, a.number::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.number))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM a{ROUNDS} a JOIN e ON a.row = e.row
JOIN (SELECT number, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY number) h ON a.number = h.number
"""
