"""Language identification by prediction by partial matching.

For each language a variable-order model of bytes is learned from a bounded sample: counts of the
bytes after every context of ORDER down to 0 bytes, with escape probability d / (n + d) (d distinct
followers of a context seen n times), below which all 256 bytes cost the same. The statistics are
frozen, so the exact code length of a byte after a known context is a table entry, and that of an
unknown one is its context's escape and the code length after the next shorter context. Tables are
of the contexts and bytes that occur in the sample, in levels of hashed slots that hold their keys. A text's
language is the one whose model codes the whole text in the fewest bits; the score is that model's posterior.

Defined results: null texts and texts without a letter are `und` with score 0; equal code
lengths go to the language that is first by code point; rows without a language, or held out by
their doc_id, are not learned from; with nothing to learn from every text is `und`. Texts of any length are coded whole. Other
columns of the input are carried along, those named as an output are replaced, repeated rows get equal results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, held, held_out, let_go, segment_sum, set_aside, text_blocks

#: Bytes of the longest context.
ORDER = 4
#: Bounds of the training sample: documents a language, and characters of a document to be eligible.
MAX_DOCS, MAX_CHARS = 600, 200_000
#: Texts of at least so many bytes, and so many of them a language, tell the range of its code lengths; that quantile of
#: theirs, times the factor, is a bits-per-byte rate that a text may exceed by the slack (in bits, so short texts stay).
RANGE_BYTES, RANGE_TEXTS, RANGE_QUANTILE, RANGE_FACTOR, SLACK_BITS = 200, 50, 0.99, 2.0, 400
_FREE = np.uint64(2**64 - 1)
_BYTE = np.uint64(8)


def sample(docs: DataFrame, text: str, lang: str, key: str, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> list[tuple[str, str]]:
    """About `max_docs` (text, language) pairs a language, one an id, chosen by a hash of the key."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key) & (F.length(text) <= max_chars))
    counts = rows.groupBy(lang).agg(F.approx_count_distinct(key)).collect()
    share = F.lit(0)
    for name, n in counts:
        share = F.when(F.col(lang) == name, F.lit(int(min(1.0, max_docs / n) * 2**30))).otherwise(share)
    rows = rows.where(F.pmod(F.xxhash64(key), F.lit(2**30)) < share)
    return [(r.text, r.lang) for r in rows.groupBy(F.col(key)).agg(F.min(F.struct(F.col(text).alias("text"), F.col(lang).alias("lang"))).alias("_row")).select("_row.*").collect()]


def _mask(bytes_: int) -> np.uint64:
    return np.uint64((1 << (8 * bytes_)) - 1)


def _keys(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """At each position its byte, below the ORDER bytes before it; a text is preceded by blanks."""
    key = data.astype(np.uint64)
    before = data
    for k in range(1, ORDER + 1):
        moved = np.empty_like(before)
        moved[1:] = before[:-1]
        moved[starts] = 32
        before = moved
        key |= before.astype(np.uint64) << np.uint64(8 * k)
    return key


def _slots(keys: np.ndarray, seed: int = 11) -> list[tuple]:
    """Levels of (multiplier, shift, key by slot, row by slot); a key that finds its slot taken goes to the next level."""
    rng, left, levels = np.random.default_rng(seed), np.arange(len(keys)), []
    while len(left):
        bits = max(4, (2 * len(left) - 1).bit_length())
        by, down = np.uint64(rng.integers(1, 1 << 63)) * np.uint64(2) + np.uint64(1), np.uint64(64 - bits)
        slot, first = np.unique((keys[left] * by) >> down, return_index=True)
        held, row = np.full(1 << bits, _FREE), np.zeros(1 << bits, np.int32)
        held[slot], row[slot] = keys[left[first]], left[first]
        levels.append((by, down, held, row))
        left = np.delete(left, first)
    return levels


def _find(levels: list[tuple], keys: np.ndarray) -> np.ndarray:
    """The row of each key, -1 for those without one."""
    out, left = np.full(len(keys), -1, np.int32), None
    for by, down, held, row in levels:
        own = keys if left is None else keys[left]
        slot = ((own * by) >> down).astype(np.int64)
        hit = held[slot] == own
        if left is None:
            out[hit] = row[slot[hit]]
            left = np.flatnonzero(~hit)
        else:
            out[left[hit]] = row[slot[hit]]
            left = left[~hit]
        if not len(left):
            break
    return out


def train(pairs: list[tuple[str, str]]) -> dict | None:
    """Code-length tables from (text, language) pairs; None without pairs."""
    pairs = [(t.encode(), name) for t, name in pairs if t]
    if not pairs:
        return None
    langs = sorted({name for _, name in pairs})
    whole = []
    for name in langs:
        texts = [np.frombuffer(t, np.uint8) for t, own in pairs if own == name]
        whole.append(np.unique(_keys(np.concatenate(texts), np.cumsum([0, *map(len, texts)])[:-1]), return_counts=True))
    orders, shorter, below = [], np.zeros(1, np.uint64), np.full((1, len(langs)), 8.0)  # under order 0, eight bits
    for order in range(ORDER + 1):
        grams = []
        for keys, counts in whole:
            own, back = np.unique(keys & _mask(order + 1), return_inverse=True)
            grams.append((own, np.bincount(back, counts)))
        seen = np.unique(np.concatenate([g for g, _ in grams]))
        contexts = np.unique(seen >> _BYTE)
        lower = below[np.searchsorted(shorter, seen & _mask(order))]  # a gram's shorter one is there as well
        rows, escapes = np.empty((len(seen), len(langs))), np.empty((len(contexts), len(langs)))
        for k, (own, counts) in enumerate(grams):
            at = np.searchsorted(contexts, own >> _BYTE)
            total, kinds = np.bincount(at, counts, len(contexts)), np.bincount(at, minlength=len(contexts))
            escapes[:, k] = np.where(total > 0, np.log2(np.maximum(total + kinds, 1)) - np.log2(np.maximum(kinds, 1)), 0)
            rows[:, k] = escapes[np.searchsorted(contexts, seen >> _BYTE), k] + lower[:, k]
            rows[np.searchsorted(seen, own), k] = np.log2((total + kinds)[at]) - np.log2(counts)
        shorter, below = seen, rows
        orders.append({"seen": seen, "rows": rows.astype(np.float32), "contexts": contexts, "escapes": escapes.astype(np.float32)})
    return {"id": uuid.uuid4().hex, "langs": langs, "orders": orders}


def code_lengths(model: dict, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each whole text under each language's model, and the texts' bytes."""
    slots = held(model["id"], lambda: [(_slots(o["seen"]), _slots(o["contexts"])) for o in model["orders"]])
    langs = range(len(model["langs"]))
    bits, sizes = np.zeros((len(column), len(langs))), np.zeros(len(column), np.int64)
    for block in text_blocks(column):
        n = len(block)
        sizes[block.first : block.first + n] = block.ends - block.starts
        keys = _keys(block.data, block.starts[block.starts < block.ends])
        own, at = bits[block.first : block.first + n], np.arange(len(keys))
        for order in range(ORDER, -1, -1):  # positions whose byte is unknown after this context go on to the next
            if not len(at):
                break
            tables, (grams, contexts) = model["orders"][order], slots[order]
            row = _find(grams, keys & _mask(order + 1) if order < ORDER else keys)
            known = row >= 0
            doc, row, left = block.doc_of(at[known]), row[known], np.flatnonzero(~known)
            at, keys = at[left], keys[left]
            context = _find(contexts, (keys >> _BYTE) & _mask(order))
            leaves = context >= 0
            out, context = block.doc_of(at[leaves]), context[leaves]
            for k in langs:
                own[:, k] += segment_sum(tables["rows"][row, k].astype(np.float64), doc, n) + segment_sum(tables["escapes"][context, k].astype(np.float64), out, n)
        own += 8.0 * np.bincount(block.doc_of(at), minlength=n)[:, None] if len(at) else 0
    return bits, sizes


def rates(pairs: list[tuple[str, str]]) -> dict[str, float]:
    """For each language with enough texts the bits a byte up to which a text counts as of it: learned from one half, measured on the other."""
    pairs = sorted(pairs, key=lambda p: p[1])  # so that the halves share each language
    model, tests = train(pairs[::2]), [(t, name) for t, name in pairs[1::2] if t and len(t.encode()) >= RANGE_BYTES]
    if model is None or not tests:
        return {}
    bits, sizes = code_lengths(model, pa.array([t for t, _ in tests]))
    let_go()
    rate = bits.min(1) / sizes
    names = np.array([name for _, name in tests], dtype=object)
    return {name: float(np.quantile(rate[names == name], RANGE_QUANTILE) * RANGE_FACTOR) for name in model["langs"] if (names == name).sum() >= RANGE_TEXTS}


def in_range(found: DataFrame, model: dict | None, text: str = "text") -> Column:
    """Whether a row of `identify` is coded about as well as the texts its language was learned from; true where that range isn't known."""
    ok = F.lit(True)
    size = F.octet_length(F.col(text))
    for name, rate in (model or {}).get("rates", {}).items():
        ok = F.when(F.col("lang_pred") == name, F.col("bits_per_byte") * size <= rate * size + SLACK_BITS).otherwise(ok)
    return F.coalesce(ok, F.lit(True))


def identify(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """The rows with lang_pred, score and bits_per_byte (of the best model). Only texts go to Python and only results come back."""
    new = ("lang_pred", "score", "bits_per_byte")
    docs, back = set_aside(docs.drop(*(c for c in new if c != text)), {"_found", "_letters"} - {text})
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "bits_per_byte": F.lit(0.0)}).withColumnsRenamed(back)
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred string, score double, bits_per_byte double>")
    def found(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array(shared.value["langs"], dtype=object)
        for column in columns:
            bits, sizes = code_lengths(shared.value, column)
            best, least = (bits.argmin(1), bits.min(1)) if len(bits) else (np.zeros(0, np.int64), np.zeros(0))
            posterior = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(posterior, pa.float64()), pa.array(least / np.maximum(sizes, 1), pa.float64())], names=list(new))

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.withColumns({"_found": found(F.col(text).cast("string")), "_letters": letters})
    out = {"lang_pred": F.when(F.col("_letters"), F.col("_found.lang_pred")).otherwise("und"), "score": F.when(F.col("_letters"), F.col("_found.score")).otherwise(0.0), "bits_per_byte": F.col("_found.bits_per_byte")}
    return rows.withColumns(out).drop("_found", "_letters").withColumnsRenamed(back)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", ranges: bool = False) -> dict | None:
    """Learn from the rows of `docs` that have a language and are not held out; with `ranges` also the range of their code lengths."""
    pairs = sample(docs, text, lang, key)
    model = train(pairs)
    return model and model | {"rates": rates(pairs) if ranges else {}}


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte")
