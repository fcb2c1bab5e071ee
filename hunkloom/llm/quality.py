"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Features are indicators of word unigrams and bigrams (A-Z lower-cased) and of one to three
consecutive word shapes (letters, digits and runs of signs, or "as the word before"), hashed
into 2**18 buckets. Each is scaled by its class log-count ratio, rows are brought to length 1,
and a linear hinge-loss model is fitted by dual coordinate descent on a bounded sample of labels.

Defined results: null and empty texts have no features and get the score of the bias; a sample
without both classes gives every text the score 0.5; repeated rows get equal scores; columns of
the input are carried along, those named score or predicted are replaced. Several labels of a
document count as their largest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify
from .common import TextBlock, held_out, mix64, segment_sum, text_blocks

BITS = 18
#: Bound of the training sample, in labelled documents.
MAX_TRAIN = 5000
THRESHOLD = 0.7
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def _shapes(block: TextBlock, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: its classes of bytes, runs as one."""
    kinds = _SHAPE[block.data]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[s] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return TextBlock(kinds[keep], np.zeros(0, np.int64), np.zeros(0, np.int64), 0).hashes(at[s], at[e], lower=False)


def features(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, bucket) pairs of a block, sorted."""
    s, e, doc = block.words()
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word, shape = block.hashes(s, e), _shapes(block, s, e)
    shape[1:][(word[1:] == word[:-1]) & (doc[1:] == doc[:-1])] = 7
    found = []
    for kind, (h, most) in enumerate(((word, 2), (shape, 3))):
        gram = h
        for n in range(1, most + 1):
            if n > 1:
                gram = mix64(gram[:-1] * np.uint64(0x2545F4914F6CDD1D) + h[n - 1 :])
            same = doc[n - 1 :] == doc[: len(doc) - n + 1]
            bucket = mix64(gram + np.uint64(97 * kind + n)) >> np.uint64(64 - BITS)
            found.append(((doc[n - 1 :].astype(np.int64) << BITS) | bucket.astype(np.int64))[same])
    pairs = np.sort(np.concatenate(found))
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def train(rows: list[tuple[str, int]], c: float = 1.0, rounds: int = 8, alpha: float = 1.0, seed: int = 7) -> dict:
    """Weights over buckets (already times the log-count ratio), the ratios, bias, cut and scale."""
    y = np.array([r[1] for r in rows], np.int64)
    none = {"w": np.zeros(1 << BITS, np.float32), "r2": np.zeros(1 << BITS, np.float32), "bias": 0.0, "cut": 0.0, "scale": 0.0}
    if len(set(y.tolist())) < 2:
        return none
    xs = []
    for block in text_blocks(pa.array([r[0] for r in rows], pa.string())):
        doc, bucket = features(block)
        xs += np.split(bucket, np.searchsorted(doc, np.arange(1, len(block))))
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held[:] = False
    fit = np.flatnonzero(~held)
    counts = [np.bincount(np.concatenate([xs[i] for i in fit if y[i] == k]), minlength=1 << BITS) + alpha for k in (0, 1)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[(counts[0] + counts[1]) == 2 * alpha] = 0
    values = [ratio[x] for x in xs]
    norms = [np.sqrt((v * v).sum()) or 1.0 for v in values]
    values = [v / n for v, n in zip(values, norms, strict=True)]
    # dual coordinate descent: min over 0 <= a_i <= c_i of the hinge loss's dual, bias as a constant feature
    sign = np.where(y == 1, 1.0, -1.0)
    limit = np.where(y == 1, c * len(fit) / (2 * max(1, (y[fit] == 1).sum())), c * len(fit) / (2 * max(1, (y[fit] == 0).sum())))
    w, bias, a, rng = np.zeros(1 << BITS), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(fit):
            x, v = xs[i], values[i]
            g = sign[i] * (w[x] @ v + bias) - 1
            new = min(max(a[i] - g / ((v @ v) + 1.0), 0.0), limit[i])
            if new != a[i]:
                step = (new - a[i]) * sign[i]
                w[x] += step * v
                bias += step
                a[i] = new
    margin = np.array([w[x] @ v + bias for x, v in zip(xs, values, strict=True)])
    test = held if held.any() else ~held
    cut = classify.best_threshold(margin[test], y[test])
    return {"w": (w * ratio).astype(np.float32), "r2": (ratio * ratio).astype(np.float32), "bias": bias, "cut": cut, "scale": classify.fit_scale(margin[test], y[test], cut)}


def score(model: dict, column: pa.Array) -> np.ndarray:
    """A score in (0, 1) for each whole text; THRESHOLD is where the model cuts."""
    margin = np.full(len(column), model["bias"])
    for block in text_blocks(column):
        doc, bucket = features(block)
        n = len(block)
        dot, size = (segment_sum(model[k][bucket].astype(np.float64), doc, n) for k in ("w", "r2"))
        margin[block.first : block.first + n] += dot / np.sqrt(np.where(size > 0, size, 1.0))
    if not model["scale"]:
        return np.full(len(column), 0.5)
    return classify.squash(margin, model["cut"], model["scale"], THRESHOLD)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = classify.labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", "doc_id", MAX_TRAIN, ["text"])
    return classify.score_rows(docs, train(rows), score, "text", THRESHOLD).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
