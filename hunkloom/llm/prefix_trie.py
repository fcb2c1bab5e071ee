"""Prefix trie of conversations in preorder-interval encoding.

A node is a distinct sequence of first turns. Sequences are ranked lexicographically, and a node's members are an
interval of ranks; nodes sorted by (first rank, depth) are in preorder, and a node's subtree ends at
the last node of its last member. Positions, leaves and savings are prefix sums over that order
(running sums within sorted partitions, plus the sums of the partitions before), and a subtree's are the
difference between the sums at its end and before its top.

How it is kept distributed: turns get their places from one sort by range, not from a window a
conversation; a prefix is known by 124 bits, sums over its turns of hashes of (place, role, text), so that prefix
sums over chunks of CHUNK turns give all prefixes of a conversation of any length; texts are hashed where they are
read. Conversations with equal turns are one sequence with a weight. Sequences are ranked by blocks of FAN turns, then
by blocks of FAN ranks of blocks, and so on: no row holds more than FAN labels, and a round sorts distinct blocks by range. Ids of equal conversations
are sorted by range and joined to pieces of text before one task hashes the pieces one after the other.

Defined results: rows without a conv_id take no part; null roles and texts are empty, a null turn comes first; turns with equal
numbers are in the order of their roles, then of a hash of their texts; repeated rows are turns of their own; rebuilt conversations without turns are members of the
root; other columns are not read; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

#: A conversation starts with up to HEADS - 1 turns of the first of its group of GROUP.
GROUP, HEADS = 5, 9
#: Binary orders of the turns of a chunk of prefix sums, and of the labels of a block to be ranked.
CHUNK_BITS, FAN_BITS = 10, 5
_PARTS = ["_p1", "_p2", "_p3", "_p4"]
_LOW31 = 0x7FFFFFFF


def by_range(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in files sorted by range, with `_at`: numbers that rise with the keys, the file's in the bits from 33 on."""
    return cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, two hashes of role and text, and the text's bytes."""
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))))
    return rows.select("conv_id", "turn", "role", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "text", "role").alias("b"), F.octet_length("text").cast("long").alias("n_bytes"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, pos from 1, a, b, n_bytes), and all conversations (conv_id)."""
    rows = by_range(turns, "conv_id", "turn", "role", "a").withColumn("_file", F.shiftrightunsigned("_at", 33))
    runs = cut(rows.groupBy("conv_id", "_file").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), "runs")  # a conversation's part of a file
    sizes = runs.groupBy("conv_id").agg(F.sum("_n").alias("_size"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = sizes.select("conv_id", "_size", heads.alias("_heads"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("_base"))
    lengths = sizes.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("_base"), F.col("_size").alias("_base_size"))
    convs = convs.join(lengths, "_base", "left").withColumn("_taken", F.least("_heads", F.coalesce("_base_size", F.lit(0))))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("conv_id").orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_before", before).join(convs, "conv_id").select("conv_id", "_file", "_first", "_before", "_heads", "_taken")
    placed = rows.join(runs, ["conv_id", "_file"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before") + 1)
    own = placed.where(F.col("pos") > F.col("_heads")).withColumn("pos", F.col("pos") - F.col("_heads") + F.col("_taken"))
    first = placed.where((F.col("pos") < HEADS) & (F.col("conv_id") % GROUP == 0)).select(F.col("conv_id").alias("_base"), "pos", "a", "b", "n_bytes")
    shared = first.join(convs.select("_base", "conv_id", "_heads"), "_base").where(F.col("pos") <= F.col("_heads"))
    out = ["conv_id", "pos", "a", "b", "n_bytes"]
    return own.select(out).unionByName(shared.select(out)), convs.select("conv_id")


def _chunk(pos: str) -> Column:
    return F.shiftright(F.col(pos) - 1, CHUNK_BITS)


def _node(depth: Column, sums: list[Column]) -> list[Column]:
    """The two halves of a node's id."""
    return [F.xxhash64(depth, *sums), F.xxhash64(*reversed(sums), depth)]


def root() -> list[Column]:
    zero = F.lit(0).cast("long")
    return _node(zero, [zero] * 4)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, node (i, j), its parent (pi, pj) and n_bytes for each turn."""
    x, y = F.xxhash64("pos", "a", "b"), F.xxhash64("b", "pos", "a")
    parts = [x.bitwiseAND(F.lit(_LOW31)), F.shiftrightunsigned(x, 33), y.bitwiseAND(F.lit(_LOW31)), F.shiftrightunsigned(y, 33)]
    rows = turns.withColumns(dict(zip(_PARTS, parts, strict=True))).withColumn("chunk", _chunk("pos"))
    before = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "chunk").agg(*(F.sum(p).alias(p) for p in _PARTS))
    sums = sums.select("conv_id", "chunk", *(F.sum(p).over(before).alias(f"{p}_before") for p in _PARTS)).where("chunk > 0")
    own = W.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({f"{p}_sum": F.sum(p).over(own) for p in _PARTS}).join(sums, ["conv_id", "chunk"], "left")
    now = [F.col(f"{p}_sum") + F.coalesce(f"{p}_before", F.lit(0)) for p in _PARTS]
    last = [n - F.col(p) for n, p in zip(now, _PARTS, strict=True)]
    ids = [c.alias(n) for c, n in zip(_node(F.col("pos"), now) + _node(F.col("pos") - 1, last), ("i", "j", "pi", "pj"), strict=True)]
    return rows.select("conv_id", "pos", *ids, "n_bytes")


def ranks(rows: DataFrame, longest: int) -> DataFrame:
    """i, j (a sequence's last node) and rank: the lexicographic order of the sequences whose turns (conv_id, pos, i, j) are given."""
    ends = F.element_at("_x", -1)
    blocks = rows.groupBy("conv_id", F.shiftright(F.col("pos") - 1, FAN_BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "i", "j"))).alias("_x"))
    blocks = blocks.select("conv_id", "block", ends["i"].alias("i"), ends["j"].alias("j"), F.transform("_x", lambda x: F.struct(x["i"], x["j"])).alias("labels"))
    while True:
        names = by_range(blocks.groupBy("i", "j").agg(F.first("labels").alias("labels")), "labels").select("i", "j", F.col("_at").alias("rank"))
        longest = -(-longest >> FAN_BITS)
        if longest <= 1:
            return names
        blocks = cut(blocks.select("conv_id", "block", "i", "j").join(names, ["i", "j"]), "blocks")
        blocks = blocks.groupBy("conv_id", F.shiftright("block", FAN_BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("pos"), "rank", "i", "j"))).alias("_x"))
        blocks = blocks.select("conv_id", "block", ends["i"].alias("i"), ends["j"].alias("j"), F.col("_x.rank").alias("labels"))


def _running(names: list[str]):
    """Running sums of the named columns within a partition, the current row included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = dict.fromkeys(names, 0)
        for batch in batches:
            for name in names:
                at = batch.schema.get_field_index(name)
                sums = np.cumsum(batch.column(at).to_numpy()) + so_far[name]
                if len(sums):
                    so_far[name] = int(sums[-1])
                batch = batch.set_column(at, name, pa.array(sums, pa.int64()))
            yield batch

    return run


def preorder(nodes: DataFrame) -> DataFrame:
    """The nodes with place (from 1), leaves_to and saved_to: numbers of nodes, leaves and saved bytes up to and with each."""
    names = ["place", "leaves_to", "saved_to"]
    rows = nodes.withColumns({"place": F.lit(1).cast("long"), "leaves_to": F.col("is_leaf").cast("long"), "saved_to": F.col("saves")})
    ordered = rows.repartitionByRange("lo", "depth").sortWithinPartitions("lo", "depth").withColumn("_file", F.shiftrightunsigned(F.monotonically_increasing_id(), 33))
    summed = cut(ordered.mapInArrow(_running(names), ordered.schema), "preorder")
    sums = summed.groupBy("_file").agg(*(F.max(n).alias(f"_{n}") for n in names))  # a row a partition
    before = W.partitionBy().orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_file", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in names))
    return summed.join(F.broadcast(sums), "_file").withColumns({n: F.col(n) + F.col(f"_{n}") for n in names}).drop("_file", *(f"_{n}" for n in names))


def ends_hashes(ends: DataFrame) -> DataFrame:
    """i, j and the SHA-256 of the comma-joined conv_ids, in ascending order, of the conversations (conv_id, i, j) that end there."""
    pieces = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])
    hashes = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("ends_sha256", pa.string())])

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, conv = (batch.column(k).to_numpy() for k in range(3))
            if len(i):
                starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
                text = [",".join(map(str, x.tolist())) for x in np.split(conv, starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(i[starts]), pa.array(j[starts]), pa.array(conv[starts]), pa.array(text, pa.string())], schema=pieces)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for i, j, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (i, j) != name:
                    if state is not None:
                        done.append((*name, state.hexdigest()))
                    name, state = (i, j), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(hashes)], schema=hashes)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*name, state.hexdigest()), hashes, strict=True)], schema=hashes)

    spread = ends.select("i", "j", "conv_id").repartitionByRange("i", "j", "conv_id").sortWithinPartitions("i", "j", "conv_id")
    joined = spread.mapInArrow(join_ids, "i long, j long, first long, piece string")
    return joined.repartition("i", "j").sortWithinPartitions("i", "j", "first").mapInArrow(digest, "i long, j long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the conversations `convs` (conv_id) with the turns (conv_id, pos, a, b, n_bytes)."""
    spark, top = turns.sparkSession, [c.alias(n) for c, n in zip(root(), ("i", "j"), strict=True)]
    rows = cut(prefixes(turns), "prefixes")
    last = F.max(F.struct("pos", "i", "j")).alias("_end")
    ends = rows.select("conv_id", "pos", "i", "j").unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("pos"), *top)).groupBy("conv_id").agg(last)
    ends = cut(ends.select("conv_id", F.col("_end.pos").alias("size"), "_end.i", "_end.j"), "ends")
    sequences = cut(ends.groupBy("i", "j").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.first("size").alias("size")), "sequences")

    chunks = lambda s: s.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), _chunk("size"))))
    some = sequences.where("size > 0")
    rows = cut(rows.withColumn("chunk", _chunk("pos")).join(chunks(some.select("conv_id", "size")).drop("size"), ["conv_id", "chunk"]), "sequences")
    longest = sequences.agg(F.max("size")).first()[0]
    found = ranks(rows.select("conv_id", "pos", "i", "j"), longest) if longest else spark.createDataFrame([], "i long, j long, rank long")
    ranked = cut(some.join(found, ["i", "j"]).unionByName(sequences.where("size = 0").withColumn("rank", F.lit(-1).cast("long"))), "ranks")

    about = chunks(ranked.where("size > 0").select("conv_id", "weight", "size", "rank"))
    members = rows.join(about, ["conv_id", "chunk"]).select("i", "j", F.col("pos").alias("depth"), "pi", "pj", "n_bytes", "conv_id", "weight", "size", "rank")
    none = F.lit(None).cast("long")
    at_root = ranked.select(*top, F.lit(0).cast("long").alias("depth"), none.alias("pi"), none.alias("pj"), F.lit(0).cast("long").alias("n_bytes"), "conv_id", "weight", "size", "rank")
    ended = F.sum(F.when(F.col("depth") == F.col("size"), F.col("weight")).otherwise(0))
    nodes = members.unionByName(at_root).groupBy("i", "j").agg(F.first("depth").alias("depth"), F.first("pi").alias("pi"), F.first("pj").alias("pj"), F.max("n_bytes").alias("n_bytes"), F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), ended.alias("n_ends"))
    nodes = nodes.withColumns({"is_leaf": F.col("n_ends") == F.col("n_convs"), "saves": (F.col("n_convs") - 1) * F.col("n_bytes")}).drop("n_bytes")
    nodes = cut(preorder(nodes), "nodes")

    stops = nodes.where("n_ends > 0").select(F.col("lo").alias("hi"), F.col("place").alias("end"), F.col("leaves_to").alias("_leaves"), F.col("saved_to").alias("_saved"))  # the last node of each sequence
    children = nodes.where("depth > 0").groupBy(F.col("pi").alias("i"), F.col("pj").alias("j")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("i").alias("pi"), F.col("j").alias("pj"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(children, ["i", "j"], "left").join(ends_hashes(ends), ["i", "j"], "left").join(stops, "hi").join(parents, ["pi", "pj"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    leaves, saved = F.col("_leaves") - F.col("leaves_to") + F.col("is_leaf").cast("long"), F.col("_saved") - F.col("saved_to") + F.col("saves")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), leaves.alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"), F.col("place").alias("preorder"), F.col("end").alias("subtree_end"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie(*rebuilt(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: DuckDB: paths of turns as texts; a subtree is what starts with a path. CRC-32 is worked out bit by bit.
OP11_SQL = """
WITH t AS MATERIALIZED (
  SELECT conv_id, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS d, strlen(coalesce(text, '')) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(*) AS size FROM t GROUP BY ALL),
k AS (SELECT conv_id, size, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))) AS crc FROM s),
c AS MATERIALIZED (SELECT k.conv_id, k.conv_id - k.conv_id % 5 AS base, xor(crc, 4294967295) % 9 AS h, least(xor(crc, 4294967295) % 9, coalesce(b.size, 0)) AS taken
      FROM k LEFT JOIN s b ON b.conv_id = k.conv_id - k.conv_id % 5),
r AS (SELECT c.conv_id, t.pos, d, n FROM c JOIN t ON t.conv_id = c.base WHERE t.pos <= c.h
      UNION ALL SELECT c.conv_id, t.pos - c.h + c.taken, d, n FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.pos > c.h),
m AS (SELECT conv_id, pos AS depth, n, string_agg('/' || d, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, arg_max(path, depth) AS path FROM m GROUP BY ALL) GROUP BY ALL),
u AS MATERIALIZED (SELECT path, left(path, greatest(length(path) - 65, 0)) AS above, any_value(depth) AS depth, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs FROM m GROUP BY path),
w AS MATERIALIZED (SELECT u.*, (SELECT count(*) FROM u x WHERE x.above = u.path AND x.depth > 0) AS n_children FROM u)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((x.n_convs - 1) * x.n)::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM w JOIN w x ON starts_with(x.path, w.path) LEFT JOIN w p ON p.path = w.above AND w.depth > 0 LEFT JOIN e ON e.path = w.path
GROUP BY w.path, w.conv_id, w.depth, p.conv_id, w.n_convs, w.n_children, e.ends_sha256
"""
