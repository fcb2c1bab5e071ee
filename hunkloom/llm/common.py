"""Shared plumbing of the training-data operators.

* `shared_dir` / `cut`: tables written to the folder the cluster names in
  `spark.checkpoint.dir`, used to cut lineage (never a machine-local folder on a cluster).
* `TextBlock`: texts of an Arrow batch as one UTF-8 byte array with offsets, so that
  tokenising and hashing run as numpy passes over bytes and not as Python loops over rows.
* `components`: connected components of an edge table, entirely as DataFrame jobs.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes handled by one round of numpy passes; bounds a worker's memory at about 40 times this.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a fresh one where that is unset and all run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="hunkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/hunkloom-{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems; a stopped session leaves it to the cluster."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Spark's option to delete the shuffle files of a query as it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """`df` written as Parquet in the shared folder and read back, and its folder, which the caller may remove. Its shuffles end with it."""
    spark = df.sparkSession
    path, before = new_folder(spark, what), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, True)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: later stages restart from files."""
    return written(df, what)[0]


#: Bounds of an Arrow batch, in bytes (as Spark estimates them) and rows.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold few texts, so that a worker's memory doesn't follow the partition's."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = int(re.sub(r"\D", "", spark.conf.get(name)))
        if not 0 < now <= most:
            spark.conf.set(name, most)


_HELD: dict[str, object] = {}


def held(key: str, make):
    """What a worker keeps from task to task, such as a model made ready: one thing at a time, so that what an operator before has left is let go."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Keep nothing: for what the driver made ready for itself."""
    _HELD.clear()


def with_fields(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of `df` with more fields, as a new object."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def set_aside(df: DataFrame, own: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its columns of such names renamed, and how to rename them back."""
    names = {c: f"_carried_{i}" for i, c in enumerate(df.columns) if c.lower() in own}
    return df.withColumnsRenamed(names), {new: old for old, new in names.items()}


def held_out(doc_id: str) -> F.Column:
    """True for rows whose labels may not be learned: crc32(doc_id as text) mod 4 is 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


# ---------------------------------------------------------------- texts as bytes

_RNG = np.random.default_rng(20240607)
#: A random 64-bit value for each byte value, and an odd base: the parts of a polynomial hash of words.
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_VALUE = _BYTE_VALUE[_LOWER]
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the public splitmix64 mixer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class TextBlock:
    """Some consecutive texts: `data` (uint8), and for each text its [start, end) in `data`."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int):
        self.data, self.starts, self.ends, self.first = data, starts, ends, first

    def __len__(self) -> int:
        return len(self.starts)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """Index of the text that holds each byte position (empty texts hold none)."""
        return np.searchsorted(self.ends, at, side="right")

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text index of every `[^\\x20\\x09-\\x0D]+`, in order."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, none
        inside = _IN_WORD[self.data]
        full = self.starts < self.ends
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[self.starts[full]] = False
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[self.ends[full] - 1] = False
        s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return s, e, self.doc_of(s)

    def hashes(self, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each byte range, A-Z lower-cased on request."""
        up, down = _powers(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_LOWER_VALUE if lower else _BYTE_VALUE)[self.data] * up[: len(self.data)], out=sums[1:])
        return mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[TextBlock]:
    """The texts of a string column in blocks of about `limit` bytes (one long text is a block); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, len(column), i + 20_000)
        base = offsets[i]
        yield TextBlock(data[base : offsets[j]], offsets[i:j] - base, offsets[i + 1 : j + 1] - base, i)
        i = j


def segment_sum(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum the rows of `values` (sorted by `owner`) into `n` rows; owners without rows get 0."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    if len(owner):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[first]] = np.add.reduceat(values, first, axis=0)
    return out


def batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Column dictionaries as record batches of a schema."""
    for columns in rows:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected edges (a, b) of longs: columns node, root (smallest node reached).

    Alternates the large-star and small-star steps (Kiveris et al., 2014): every node links to
    the smallest of its neighbours (large star), then all small neighbours link to the smallest
    (small star), until nothing changes. A step is two partial aggregations and a join, so a hot
    node is split by AQE; each round's edge table is written to the shared folder, and the one before removed. Edges that
    are stars already take one round.
    """
    spark = edges.sparkSession
    seen = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now, path = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    last = seen(now)
    while True:
        # large star: larger neighbours of u point at the smallest of u's neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours point at the smallest of them
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        old = path
        now, path = written(small, "edges")
        remove(spark, old)
        state = seen(now)
        if last == state:
            break
        last = state
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
