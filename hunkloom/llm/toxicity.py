"""Toxicity: a convolutional text classifier trained in numpy.

Words (A-Z lower-cased) are hashed into 2**17 buckets, and so are their first PREFIX bytes. Buckets
found in at least MIN_DOCS documents of the sample get an embedding: a word has the sum of its own
and its prefix's. Filters of width 1, 2 and 3 run over the embeddings of a whole text and
its padding; each filter's largest value goes through a rectifier into a logistic output whose
weights are kept at 0 or more, so that words only add to a text's toxicity. Max pooling passes a gradient to one position a filter and
text only, so a training step touches few words. After training, embeddings and filters are
multiplied out into one table of bucket by (width, offset, filter): scoring is gathers and sums.

Thresholds are calibrated by language: the language is guessed from the text itself, by hashed
words and frozen counts of the training sample, and each language's cut is brought to the same
score. The columns lang, source, doc_id and labels are never read when scoring.

Defined results: null and empty texts are scored as a text of padding; a sample without both
classes gives 0.0 everywhere; repeated rows get equal scores; columns of the input are carried
along, those named score or predicted are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify
from .common import TextBlock, held_out, segment_sum, text_blocks

BITS, DIM, FILTERS, WIDTHS = 17, 12, 8, (1, 2, 3)
#: Documents of the sample that must hold a bucket's words for it to be learned.
MIN_DOCS = 6
#: Documents at the prior share that smooth a bucket's toxic share.
SMOOTH = 5
PREFIX = 4
#: Bound of the training sample, in labelled documents.
MAX_TRAIN = 6000
THRESHOLD = 0.3
PAD = 1 << BITS
#: Words are stripped of these signs at either end before hashing.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and of their prefixes, three paddings after each text; first position and windows of each text."""
    s, e, doc = block.words()
    n = np.bincount(doc, minlength=len(block))
    first = np.r_[0, np.cumsum(n + 3)[:-1]] if len(block) else np.zeros(0, np.int64)
    word = np.full(len(s) + 3 * len(block), PAD, np.int32)
    prefix = word.copy()
    if len(s):
        for _ in range(3):  # up to three signs at either end
            s = np.where((s < e - 1) & ~_LETTER[block.data[s]], s + 1, s)
            e = np.where((s < e - 1) & ~_LETTER[block.data[e - 1]], e - 1, e)
        at = np.arange(len(s)) + 3 * doc
        word[at] = (block.hashes(s, e) >> np.uint64(64 - BITS)).astype(np.int32)
        prefix[at] = ((block.hashes(s, np.minimum(e, s + PREFIX)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)
    return word, prefix, first, n + 1


def _pool(values: np.ndarray, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The largest row entry of each text's windows."""
    ends = np.minimum(first + windows, len(values))
    cuts = np.stack([first, ends], 1).reshape(-1)
    if cuts[-1] == len(values):
        cuts = cuts[:-1]
    return np.maximum.reduceat(values, cuts, axis=0)[::2]


def _tables(p: dict) -> list[np.ndarray]:
    """For each width a (buckets, width, filters) table of embedding times filter."""
    return [np.einsum("bd,wdf->bwf", p["emb"], p[f"w{w}"]) for w in WIDTHS]


def train(rows: list[tuple[str, str | None, int]], rounds: int = 4, step: int = 64, rate: float = 0.01, seed: int = 5) -> dict | None:
    """Fit on (text, language, label) rows; None without both classes."""
    y = np.array([r[2] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    words, prefixes, lens = [], [], []
    for block in text_blocks(pa.array([r[0] for r in rows], pa.string())):
        word, prefix, first, windows = tokens(block)
        words += np.split(word, first[1:])
        prefixes += np.split(prefix, first[1:])
        lens += windows.tolist()
    index, size = np.zeros((2, PAD + 1), np.int32), 1  # rows of the embedding of words and prefixes; 0 is for all others
    for k, own in enumerate((words, prefixes)):
        docs_of = np.zeros(PAD + 1, np.int64)
        for t in own:
            docs_of[np.unique(t)] += 1
        docs_of[PAD] = 0
        learned = np.flatnonzero(docs_of >= MIN_DOCS)
        index[k, learned] = np.arange(size, size + len(learned))
        size += len(learned)
    toks = [np.stack([index[0][w], index[1][x]]) for w, x in zip(words, prefixes, strict=True)]
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held[:] = False
    fit = np.flatnonzero(~held)
    seen, toxic = (np.bincount(np.concatenate([np.unique(toks[i]) for i in of]), minlength=size) for of in (fit, fit[y[fit] == 1]))
    prior = y[fit].mean()
    odds = np.log((toxic + SMOOTH * prior) / (seen + SMOOTH) / prior)
    p = {"emb": rng.normal(0, 0.05, (size, DIM)), "out": np.abs(rng.normal(0, 0.3, (len(WIDTHS) * FILTERS))), "bias": np.zeros(1)}
    p |= {f"w{w}": rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)) for w in WIDTHS}
    p |= {f"b{w}": np.zeros(FILTERS) for w in WIDTHS}
    p["emb"][:, 0] = odds  # the first dimension starts as the smoothed log ratio of a bucket's toxic share to the prior
    for w in WIDTHS:
        p[f"w{w}"][0, 0] += 0.5
    p["emb"][0] = 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    weight = np.where(y == 1, len(fit) / (2 * max(1.0, y[fit].sum())), len(fit) / (2 * max(1.0, (1 - y[fit]).sum())))
    t = 0
    for _ in range(rounds):
        order = rng.permutation(fit)
        for at in range(0, len(order), step):
            ids = order[at : at + step]
            flat = np.concatenate([toks[i] for i in ids], axis=1)
            span = np.array([toks[i].shape[1] for i in ids])
            first, windows = np.r_[0, np.cumsum(span)[:-1]], np.array([lens[i] for i in ids])
            owner = np.repeat(np.arange(len(ids)), span)
            grads = {k: np.zeros_like(v) for k, v in p.items() if k != "emb"}
            e = p["emb"][flat[0]] + p["emb"][flat[1]]
            pooled, where = [], []
            inside = np.arange(flat.shape[1]) - first[owner] < windows[owner]
            for w in WIDTHS:
                conv = e @ p[f"w{w}"][0]
                for k in range(1, w):
                    conv[:-k] += (e @ p[f"w{w}"][k])[k:]
                conv[~inside] = -np.inf
                top = _pool(conv, first, windows)
                hit = conv == top[owner]
                spot = np.zeros(top.shape, np.int64)
                r, c = np.nonzero(hit)
                spot[owner[r[::-1]], c[::-1]] = r[::-1]  # the first of equal positions
                pooled.append(top + p[f"b{w}"])
                where.append(spot)
            z = np.concatenate(pooled, 1)
            h = np.maximum(z, 0)
            out = h @ p["out"] + p["bias"][0]
            d = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[ids]) * weight[ids] / len(ids)
            grads["out"], grads["bias"][0] = h.T @ d, d.sum()
            dz = np.outer(d, p["out"]) * (z > 0)
            demb = np.zeros((flat.shape[1] + 2, DIM))
            for j, w in enumerate(WIDTHS):
                g, spot = dz[:, j * FILTERS : (j + 1) * FILTERS], where[j]
                grads[f"b{w}"] = g.sum(0)
                for k in range(w):
                    x = e[np.minimum(spot + k, flat.shape[1] - 1)]
                    grads[f"w{w}"][k] = np.einsum("nf,nfd->df", g, x)
                    np.add.at(demb, spot + k, g[:, :, None] * p[f"w{w}"][k].T[None])
            used, back = np.unique(flat, return_inverse=True)
            back = back.reshape(flat.shape)
            grow = np.zeros((len(used), DIM))
            for own in back:
                np.add.at(grow, own, demb[: flat.shape[1]])
            t += 1
            lr = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, g in [*grads.items(), ("emb", grow)]:
                rowsel = used if k == "emb" else slice(None)
                m, v = moments[k]
                m[rowsel] = 0.9 * m[rowsel] + 0.1 * g
                v[rowsel] = 0.999 * v[rowsel] + 0.001 * g * g
                p[k][rowsel] -= lr * m[rowsel] / (np.sqrt(v[rowsel]) + 1e-8)
            p["emb"][0] = 0
            np.maximum(p["out"], 0, out=p["out"])
    langs = sorted({r[1] for r in rows if r[1] is not None})
    counts = np.full((size, max(1, len(langs))), 0.1)
    for i, r in enumerate(rows):
        if r[1] is not None:
            counts[:, langs.index(r[1])] += np.bincount(toks[i].ravel(), minlength=size)
    counts[0] = 1
    model = {"index": index, "tables": [x.astype(np.float32) for x in _tables(p)], "bias": [p[f"b{w}"] for w in WIDTHS], "out": p["out"], "out_bias": float(p["bias"][0]), "words": np.log(counts / counts.sum(0)).astype(np.float32), "cuts": np.zeros(max(1, len(langs))), "scale": 1.0}
    test = np.flatnonzero(held if held.any() else ~held)
    margin, guess = margins(model, pa.array([rows[i][0] for i in test], pa.string()))
    whole = classify.best_threshold(margin, y[test])
    for k in range(len(model["cuts"])):
        own = guess == k
        enough = min(y[test][own].sum(), (1 - y[test][own]).sum()) >= 10 if own.any() else False
        model["cuts"][k] = classify.best_threshold(margin[own], y[test][own]) if enough else whole
    model["scale"] = classify.fit_scale(margin - model["cuts"][guess], y[test], 0.0)
    return model


def margins(model: dict, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The network's output for each whole text, and the index of its guessed language."""
    out, guess = np.zeros(len(column)), np.zeros(len(column), np.int64)
    for block in text_blocks(column):
        word, prefix, first, windows = tokens(block)
        own = model["index"][0][word], model["index"][1][prefix]
        n = len(word)
        z = []
        for table, bias in zip(model["tables"], model["bias"], strict=True):
            conv = table[own[0], 0] + table[own[1], 0]
            for k in range(1, table.shape[1]):
                conv[:-k] += table[own[0][k:], k] + table[own[1][k:], k]
            z.append(_pool(conv, first, windows) + bias)
        rows = slice(block.first, block.first + len(block))
        out[rows] = np.maximum(np.concatenate(z, 1), 0) @ model["out"] + model["out_bias"]
        if model["words"].shape[1] > 1:
            sizes = np.diff(np.r_[first, n])
            guess[rows] = segment_sum((model["words"][own[0]] + model["words"][own[1]]).astype(np.float64), np.repeat(np.arange(len(block)), sizes), len(block)).argmax(1)
    return out, guess


def score(model: dict | None, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(column))
    margin, guess = margins(model, column)
    return classify.squash(margin, model["cuts"][guess], model["scale"], THRESHOLD)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = classify.labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", "doc_id", MAX_TRAIN, ["text", "lang"])
    return classify.score_rows(docs.select("doc_id", "text"), train(rows), score, "text", THRESHOLD).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
