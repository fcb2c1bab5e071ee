"""Language-model scores by prediction by partial matching, learned from the whole corpus.

The model is a trie of bytes: a node is a context of 0 to ORDER bytes, its children the symbols (256
bytes and the end of the text) that followed it in the training texts, with their counts. The probability of a
symbol after the longest context is its count less DISCOUNT over the sum of all counts; what is taken off is the
probability of an escape (none, once all symbols have followed). After one, the symbol is sought after the
context without its first byte, where the followers of the longer context are excluded from sum and
discounts; below the empty context the symbols that are left are equally likely. A context that was never seen, or of which nothing is left,
is passed by at no cost. As
the followers of a context are a subset of its shorter one's, what is excluded follows from the two neighbouring levels
alone, so with frozen counts each probability is a number of a trie's edge.

Nothing of the trie is broadcast or bounded by sampling. Each task cuts its rows into blocks of about BLOCK_BYTES of
text; a block is written once with its texts packed, and with its distinct edges and words and their counts in its
training texts, packed by bucket of their keys. Counts are summed by bucket. Levels of the trie are tables of all edges that occur in any
text: sums by edge, windows over a context's followers (257 at most), and a join with the level below. What is known
of a bucket's edges and words goes back to the blocks that asked for them, which then add up their texts' symbols and tokens.

Defined results: null texts are empty and consist of the end alone; with nothing to learn from, all symbols are
equally likely and all tokens cost nothing; texts of any length are scored whole and count whole; rows
without an id are learned from; only the two columns named are read; repeated rows count each and get equal results; an empty table gives no rows. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import _LOWER, TextBlock, bound_batches, cut, text_blocks
from .language_id import _find, _slots

#: Bytes of the longest context, and of a block of texts.
ORDER, BLOCK_BYTES = 5, 16 << 20
#: Bytes of text that are cut into keys at once; a worker's memory beyond its block is some hundred times this.
PART_BYTES = 1 << 18
#: Sorted runs of keys that are merged at once.
MERGED = 8
#: Buckets of keys (a power of two) at least, and bytes of text for one more: what a task sums at once does not grow with the corpus.
BUCKETS, BUCKET_BYTES = 256, 256 << 20
_ZSTD = pa.Codec("zstd", compression_level=1)
#: The byte that stands before a text, the symbol of its end, and the number of symbols.
BEFORE, END, SYMBOLS = 10, 256, 257
#: What a context takes off the count of each follower for what has not followed it.
DISCOUNT = 0.5
#: The key of the end token among words.
END_WORD = np.uint64(0x656E64)
_SYMBOL_BITS = 9


def held_out(key: Column) -> Column:
    """True for rows whose texts are not learned from: crc32(key as text) mod 5 is 1."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def edges(block: TextBlock, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context, symbol) of the bytes of all texts, and of their ends."""
    data = _LOWER[block.data]
    full = block.starts < block.ends
    context, before = np.zeros(len(data), np.uint64), data
    for k in range(order):
        moved = np.empty_like(before)
        moved[1:] = before[:-1]
        moved[block.starts[full]] = BEFORE
        before = moved
        context |= before.astype(np.uint64) << np.uint64(8 * k)
    last = np.full(len(block), sum(BEFORE << (8 * k) for k in range(order)), np.uint64)
    at = block.ends[full] - 1
    last[full] = ((context[at] << np.uint64(8)) | data[at].astype(np.uint64)) & np.uint64((1 << (8 * order)) - 1)
    bits = np.uint64(_SYMBOL_BITS)
    return (context << bits) | data.astype(np.uint64), (last << bits) | np.uint64(END)


def _parts(column: pa.Array, order: int) -> Iterator[tuple]:
    """Parts of about PART_BYTES: their first text, their number of texts, keys of symbols and words, and the texts these are of."""
    for block in text_blocks(column, PART_BYTES):
        n = len(block)
        inside, ends = edges(block, order)
        s, e, owner = block.words()
        texts = np.arange(n)
        symbols, of = np.concatenate([inside, ends]), np.concatenate([np.repeat(texts, block.ends - block.starts), texts])
        words = np.concatenate([block.hashes(s, e) if len(s) else np.zeros(0, np.uint64), np.full(n, END_WORD)])
        yield block.first, n, (symbols, of), (words, np.concatenate([owner, texts]))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of sorted runs of (keys, counts), with their sums."""
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    return _merge([(keys[order], counts[order].astype(np.int64))])


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers (uint64) by planes of their bytes, compressed: the high bytes of small ones cost nothing."""
    return _ZSTD.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(data, 8 * n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view(np.uint64)


def _keys_of(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(packed, n), dtype=np.uint64)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    high = keys >> np.uint64(_SYMBOL_BITS)
    return (high ^ (high >> np.uint64(11)) ^ (high >> np.uint64(22)) ^ (high >> np.uint64(33))) & np.uint64(buckets - 1)


def _bucket_column(key: str, buckets: int) -> Column:
    """The same in the JVM; a context's followers share a bucket."""
    high = F.shiftrightunsigned(F.col(key), _SYMBOL_BITS)
    mixed = high
    for by in (11, 22, 33):
        mixed = mixed.bitwiseXOR(F.shiftrightunsigned(high, by))
    return mixed.bitwiseAND(F.lit(buckets - 1)).cast("int")


_PACKED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
#: Kinds of packed rows: a block's texts, its edges, its words.
TEXTS, EDGES, WORDS = 0, 1, 2


def packed(docs: DataFrame, order: int, block_bytes: int, buckets: int) -> DataFrame:
    """Of docs (doc_id, held_out, text): a row a block with its texts, and one for each bucket of its distinct edges and words."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            if size and size + batch.nbytes > block_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for number, table in enumerate(blocks(b for b in batches if b.num_rows)):
            block = (TaskContext.get().partitionId() << 32) + number
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                out.write_table(table)
            rows = [(block, TEXTS, 0, table.num_rows, sink.getvalue().to_pybytes(), b"")]
            learned, found = ~table.column("held_out").to_numpy(), ([], [])
            for first, n, *kinds in _parts(table.column("text"), order):
                for out, (keys, of) in zip(found, kinds, strict=True):
                    out.append(_counted(keys, learned[first : first + n][of]))
                    if len(out) == MERGED:
                        out[:] = [_merge(out)]
            for kind, parts in zip((EDGES, WORDS), found, strict=True):
                keys, counts = _merge(parts)
                counts = counts.astype(np.uint64)
                bucket = _bucket(keys, buckets)
                at = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[at], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(edge)):
                    own = at[edge[b] : edge[b + 1]]
                    rows.append((block, kind, int(b), len(own), _pack(np.diff(keys[own], prepend=np.uint64(0))), _pack(counts[own])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PACKED)], schema=_PACKED)

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, "block long, kind int, bucket int, n long, keys binary, counts binary")


def summed(asked: DataFrame) -> DataFrame:
    """kind, key, n: the counts of all blocks' edges and words."""

    def run(table: pa.Table) -> pa.Table:
        held = []
        for n, k, c in zip(*(table.column(x) for x in ("n", "keys", "counts")), strict=True):
            held.append((_keys_of(k.as_py(), n.as_py()), _unpack(c.as_py(), n.as_py()).view(np.int64)))
            if len(held) == MERGED:
                held = [_merge(held)]
        keys, counts = _merge(held)
        return pa.table({"kind": np.full(len(keys), table.column("kind")[0].as_py(), np.int32), "key": keys.view(np.int64), "n": counts})

    return asked.groupBy("kind", "bucket").applyInArrow(run, "kind int, key long, n long")


def answered(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of `asked` with what `known` (kind, bucket, key, value) has of their keys: block, kind, n, keys, found."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, values = right.column("key").to_numpy().view(np.uint64), right.column("value").to_numpy()
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        found = [_pack(values[np.searchsorted(keys, _keys_of(k, n))].view(np.uint64)) for n, k in zip(left.column("n").to_pylist(), left.column("keys").to_pylist(), strict=True)]
        return pa.table({"block": left.column("block"), "kind": left.column("kind"), "n": left.column("n"), "keys": left.column("keys"), "found": pa.array(found, pa.binary())})

    return asked.groupBy("kind", "bucket").cogroup(known.groupBy("kind", "bucket")).applyInArrow(run, "block long, kind int, n long, keys binary, found binary")


def trie(grams: DataFrame, order: int) -> DataFrame:
    """key and score (log10 of its probability) of every edge of the longest contexts, from their counts (key, n).

    A level holds key, n, followers' count sum and number (total, kinds) of the edge's context, score, and below: the
    score of the symbol if this context has escaped.
    """
    def counted(n: Column, total: Column, kinds: Column) -> Column:
        return F.log10(F.try_divide(n - F.when(kinds < SYMBOLS, DISCOUNT).otherwise(0.0), total))

    def escaped(kinds: Column, total: Column) -> Column:
        return F.log10(F.try_divide(kinds * DISCOUNT, total))

    level = None
    for k in range(order + 1):
        mask, short = (1 << (8 * k + _SYMBOL_BITS)) - 1, (1 << (8 * (k - 1) + _SYMBOL_BITS)) - 1
        now = grams.withColumn("key", F.col("key").bitwiseAND(F.lit(mask))).groupBy("key").agg(F.sum("n").alias("n")) if k < order else grams
        own = W.partitionBy(F.shiftright("key", _SYMBOL_BITS))
        seen = F.col("n") > 0
        total, kinds = F.sum("n").over(own), F.sum(seen.cast("long")).over(own)
        if level is None:
            now = now.withColumns({"total": total, "kinds": kinds})
            now = now.withColumns({"below": -F.log10(F.lit(float(SYMBOLS)) - F.col("kinds")), "shorter": F.lit(-float(np.log10(SYMBOLS)))})
        else:
            under = level.select(F.col("key").alias("_key"), *(F.col(c).alias(f"_{c}") for c in ("n", "total", "kinds", "below", "score")))
            now = now.join(under, F.col("key").bitwiseAND(F.lit(short)) == F.col("_key"))
            now = now.withColumns({"total": total, "kinds": kinds, "taken": F.sum(F.when(seen, F.col("_n")).otherwise(0)).over(own)})
            rest, others = F.col("_total") - F.col("taken"), F.col("_kinds") - F.col("kinds")  # of the shorter context, without what this one has
            below = F.when(rest == 0, F.col("_below")).when(F.col("_n") > 0, counted(F.col("_n"), rest, F.col("_kinds"))).otherwise(escaped(others, rest) + F.col("_below"))
            now = now.withColumns({"below": below, "shorter": F.col("_score")})
        score = F.when(F.col("total") == 0, F.col("shorter")).when(seen, counted(F.col("n"), F.col("total"), F.col("kinds"))).otherwise(escaped(F.col("kinds"), F.col("total")) + F.col("below"))
        level = now.withColumn("score", score).select("key", "n", "total", "kinds", "below", "score")
    return level.select("key", "score")


def _score(order: int, tokens_learned: int, words_learned: int):
    smooth = tokens_learned + 0.5 * (words_learned + 1)

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        docs = pa.ipc.open_stream(texts.column("keys")[0].as_buffer()).read_all()
        rows = list(zip(*(known.column(c).to_pylist() for c in ("kind", "n", "keys", "found")), strict=True))
        tables = []
        for kind in (EDGES, WORDS):
            own = [(_keys_of(k, n), _unpack(f, n).view(np.float64)) for of, n, k, f in rows if of == kind]
            keys, values = (np.concatenate([x[i] for x in own]) for i in (0, 1))
            tables.append((_slots(keys), np.log10((values + 0.5) / smooth) if kind == WORDS else values, values > 0))
        score, base, tokens, met = (np.zeros(docs.num_rows, t) for t in (float, float, np.int64, np.int64))
        for first, n, *kinds in _parts(docs.column("text"), order):
            rows = slice(first, first + n)
            for (levels, value, have), (asked_for, of), out in zip(tables, kinds, (score, base), strict=True):
                at = _find(levels, asked_for)
                out[rows] = np.bincount(of, value[at], n)
                if out is base:
                    tokens[rows], met[rows] = np.bincount(of, minlength=n), np.bincount(of, have[at], n)
        columns = {"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": tokens, "n_known": met, "train_tokens": np.full(len(tokens), tokens_learned, np.int64), "base_score": base, "score": score}
        return pa.table(columns)

    return run


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", order: int = ORDER, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """doc_id (`key`), held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigrams of words) and score (the trie's) of each row."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), held_out(F.col(key)).alias("held_out"))
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
        buckets = max(BUCKETS, 1 << (size // BUCKET_BYTES).bit_length())
    blocks = cut(packed(rows, order, block_bytes, buckets), "blocks")
    asked = blocks.where(F.col("kind") != TEXTS)
    counts = cut(summed(asked), "counts")
    words = counts.where(F.col("kind") == WORDS)
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    words = words.select("kind", "key", F.col("n").cast("double").alias("value"))
    grams = trie(counts.where(F.col("kind") == EDGES).select("key", "n"), order).select(F.lit(EDGES).alias("kind"), "key", F.col("score").cast("float").cast("double").alias("value"))
    known = grams.unionByName(words).withColumn("bucket", _bucket_column("key", buckets))
    answers = answered(asked.select("block", "kind", "bucket", "n", "keys"), known)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    texts = blocks.where(F.col("kind") == TEXTS).select("block", "keys")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, n, v), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
