"""What the two text classifiers share: the labelled sample, calibration, and scoring over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, max_rows: int, columns: list[str]) -> list:
    """At most `max_rows` labelled rows that are not held out, one an id, by a hash of the key: columns + label.

    The ids have the bound `max_rows`, so they are the side that is broadcast; rows repeating an id are one before they reach the driver.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    ids = rows.groupBy(key).agg(F.max(F.col(label).cast("int")).alias("_label")).orderBy(F.xxhash64(key), key).limit(max_rows)
    found = docs.select(key, *columns).join(F.broadcast(ids), key).groupBy(key).agg(F.min(F.struct(*columns, "_label")).alias("_row")).select(key, "_row.*").collect()
    return [tuple(r)[1:] for r in sorted(found, key=lambda r: r[0])]


def best_threshold(margin: np.ndarray, label: np.ndarray) -> float:
    """The cut of largest balanced accuracy, in the middle of the gap it falls into."""
    if not len(label) or label.min() == label.max():
        return 0.0
    order = np.argsort(margin, kind="stable")
    m, y = margin[order], label[order]
    below = np.r_[0, np.cumsum(y)], np.r_[0, np.cumsum(1 - y)]
    gain = below[1] / max(1, (1 - y).sum()) - below[0] / max(1, y.sum())
    gain[1:-1][m[1:] == m[:-1]] = -1
    k = int(gain.argmax())
    return float((m[max(k - 1, 0)] + m[min(k, len(m) - 1)]) / 2)


def fit_scale(margin: np.ndarray, label: np.ndarray, cut: float) -> float:
    """Slope of a logistic curve through the cut, by Newton steps."""
    x, a = margin - cut, 1.0 / max(1e-6, float(np.std(margin)) if len(margin) else 1.0)
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(a * x, -30, 30)))
        step = ((label - p) * x).sum() / max(1e-9, (p * (1 - p) * x * x).sum() + 1e-3)
        a = float(np.clip(a + step, 1e-3, 50.0))
    return a


def squash(margin: np.ndarray, cut: np.ndarray | float, scale: float, at: float) -> np.ndarray:
    """Scores in (0, 1), increasing in the margin, that are `at` where the margin is `cut`."""
    return 1 / (1 + np.exp(-np.clip(scale * (margin - cut) + np.log(at / (1 - at)), -40, 40)))


def score_rows(docs: DataFrame, model: dict, score: Callable[[dict, pa.Array], np.ndarray], text: str, threshold: float) -> DataFrame:
    """The rows with score and predicted; the model is broadcast, its size is fixed. Only texts go to Python and only scores come back."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(score(shared.value, column), pa.float64())

    rows = docs.drop("score", "predicted") if text not in ("score", "predicted") else docs
    rows = rows.withColumn("score", scored(F.col(text).cast("string")))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
