"""Retries of failed deliveries with backoff, dead letters, and one batch into several sinks.

Outcomes (delivery_id, ok, error, at) come in as a stream. A failure is tried again after RETRY_SECONDS, twice that, four times
that; the one after MAX_RETRIES retries makes the delivery a dead letter. What has failed is state of the delivery, what is due is a timer of event time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window as W

# How often and after how many seconds a review is tried again.
MAX_RETRIES, RETRY_SECONDS = 3, 30
OUTCOMES = "delivery_id string, ok boolean, error string, at timestamp"
ACTIONS = "delivery_id string, action string, attempt int, due timestamp, error string"
#: How long outcomes of a delivery that is over are still known as such.
KEEP_MS = 24 * 3600 * 1000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Retries(StatefulProcessor):
    """State of a delivery: failures so far, the last error, when the retry is due (ms; 0: none), and whether it is over."""

    def __init__(self, retries: int, seconds: int):
        self.retries, self.seconds = retries, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("delivery", "failed int, error string, due long, over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("at", kind="stable")
        failed, error, due, over = self.state.get() if self.state.exists() else (0, None, 0, False)
        out = []
        for ok, said, at in zip(found.ok, found.error, found["at"], strict=True):
            if over:
                continue
            now = int(at.timestamp() * 1000)
            if due:
                self.handle.deleteTimer(due)
                out.append(("retry", failed, due, error))  # its outcome is here before its timer was
                due = 0
            if ok:
                over = True
                out.append(("done", failed, None, None))
            elif failed >= self.retries:
                over = True
                out.append(("dead", failed, None, said))
            else:
                due, failed, error = now + 1000 * self.seconds * 2**failed, failed + 1, said
                self.handle.registerTimer(due)
            if over:
                self.handle.registerTimer(now + KEEP_MS)
        self.state.update((failed, error, due, over))
        yield _rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failed, error, due, over = self.state.get() if self.state.exists() else (0, None, 0, False)
        if over:
            self.state.clear()
        elif due and expiredTimerInfo.getExpiryTimeInMs() == due:
            self.state.update((failed, error, 0, False))
            yield _rows(key, [("retry", failed, due, error)])

    def close(self) -> None:
        pass


def _rows(key, found: list[tuple]) -> pd.DataFrame:
    due = [None if d is None else pd.Timestamp(d, unit="ms") for _, _, d, _ in found]
    return pd.DataFrame({"delivery_id": pd.Series([key[0]] * len(found), dtype=object), "action": pd.Series([f[0] for f in found], dtype=object), "attempt": pd.Series([f[1] for f in found], dtype="int32"), "due": pd.Series(due, dtype="datetime64[ns]"), "error": pd.Series([f[3] for f in found], dtype=object)})


def retries(outcomes: DataFrame, max_retries: int = MAX_RETRIES, seconds: int = RETRY_SECONDS, watermark: str = "0 seconds") -> DataFrame:
    """What follows from a stream of outcomes: a retry once it is due, the delivery's end as done or as a dead letter; outcomes after that
    are passed by. For a table of outcomes the same rows, with all retries. Needs the RocksDB state store (STATE_STORE)."""
    if outcomes.isStreaming:
        dated = outcomes.select("delivery_id", "ok", "error", "at").withWatermark("at", watermark)
        return dated.groupBy("delivery_id").transformWithStateInPandas(_Retries(max_retries, seconds), outputStructType=ACTIONS, outputMode="Append", timeMode="EventTime")
    each = W.partitionBy("delivery_id").orderBy("at", "ok", "error").rowsBetween(W.unboundedPreceding, -1)
    rows = outcomes.withColumns({"failed": F.count("at").over(each).cast("int"), "ended": F.coalesce(F.bool_or("ok").over(each), F.lit(False))})
    rows = rows.where(~F.col("ended") & (F.col("failed") <= max_retries))
    action = F.when(F.col("ok"), "done").when(F.col("failed") == max_retries, "dead").otherwise("retry")
    due = F.when(action == "retry", F.timestamp_millis(F.unix_millis("at") + F.lit(1000 * seconds) * F.pow(F.lit(2), "failed").cast("long")))
    attempt = F.when(action == "retry", F.col("failed") + 1).otherwise(F.col("failed"))
    return rows.select("delivery_id", action.alias("action"), attempt.cast("int").alias("attempt"), due.alias("due"), F.when(~F.col("ok"), F.col("error")).alias("error"))


def write(rows: DataFrame, sinks: dict[str, str], checkpoint: str, by: str = "action", between: Callable[[int, str], None] | None = None):
    """Each batch into one Parquet folder a value of `by` (`sinks`: value to path); values without a sink are left out.

    A batch has a folder of its number in each sink and overwrites it when it is run again, so a stop between two sinks leaves nothing
    missing and nothing twice. The batch is worked out once for all sinks. `between` is called after each.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for value, path in sinks.items():
                batch.where(F.col(by) == value).drop(by).write.mode("overwrite").parquet(f"{path}/batch={number}")
                if between is not None:
                    between(number, value)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark, path: str) -> DataFrame:
    """All batches of a sink."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")
