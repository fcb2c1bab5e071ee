"""Retries, dead letters and routed sinks: goldens, restarts, and the table form against the stream."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from hunkloom.streaming import delivery, webhooks

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", delivery.STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(folder, number, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"delivery_id": d, "ok": ok, "error": e, "at": (T0 + dt.timedelta(seconds=s)).isoformat() + "Z"}) for d, ok, e, s in rows]
    (folder / f"{number:03}.json").write_text("\n".join(lines))
    os.utime(folder / f"{number:03}.json", (1.7e9 + number, 1.7e9 + number))  # the order in which files are read


def run(spark, tmp_path, **options):
    outcomes = spark.readStream.schema(delivery.OUTCOMES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    sinks = {a: str(tmp_path / a) for a in ("retry", "dead", "done")}
    delivery.write(delivery.retries(outcomes), sinks, str(tmp_path / "cp"), **options).awaitTermination(180)


def found(spark, tmp_path, action):
    rows = delivery.read(spark, str(tmp_path / action)).orderBy("delivery_id", "attempt").collect()
    return [(r.delivery_id, r.attempt, None if r.due is None else int((r.due - T0).total_seconds()), r.error) for r in rows]


FIRST = [("a", False, "e1", 0), ("b", True, None, 1), ("c", False, "x", 2)]
LATER = [[("a", False, "e2", 35), ("c", True, None, 40)], [("a", False, "e3", 100), ("b", False, "late", 101)], [("a", False, "e4", 300), ("a", True, None, 301)], [("d", False, "y", 5000)], [("e", True, None, 9000)], [("f", True, None, 9500)]]
RETRIES = [("a", 1, 30, "e1"), ("a", 2, 95, "e2"), ("a", 3, 220, "e3"), ("c", 1, 32, "x"), ("d", 1, 5030, "y")]


def test_failing_deliveries(spark, tmp_path):
    for k, rows in enumerate([FIRST, *LATER]):
        put(tmp_path / "in", k, rows)
    run(spark, tmp_path)
    assert found(spark, tmp_path, "retry") == RETRIES
    assert found(spark, tmp_path, "dead") == [("a", 3, None, "e4")]
    assert found(spark, tmp_path, "done") == [("b", 0, None, None), ("c", 1, None, None), ("e", 0, None, None), ("f", 0, None, None)]
    table = delivery.retries(spark.read.schema(delivery.OUTCOMES).json(str(tmp_path / "in")))
    for action in ("retry", "dead", "done"):
        same = sorted((r.delivery_id, r.attempt, r.error) for r in table.where(F.col("action") == action).collect())
        assert same == sorted((d, n, e) for d, n, _, e in found(spark, tmp_path, action))


def test_failures_are_remembered_across_a_restart(spark, tmp_path):
    put(tmp_path / "in", 0, FIRST)
    run(spark, tmp_path)
    for k, rows in enumerate(LATER, 1):
        put(tmp_path / "in", k, rows)
        run(spark, tmp_path) if k in (2, 4) else None  # a new query from the checkpoint
    run(spark, tmp_path)
    assert found(spark, tmp_path, "retry") == RETRIES and found(spark, tmp_path, "dead") == [("a", 3, None, "e4")]


def test_a_stop_between_sinks_leaves_nothing_twice(spark, tmp_path):
    for k, rows in enumerate([FIRST, *LATER]):
        put(tmp_path / "in", k, rows)
    stopped = []

    def stop_once(number, value):
        if number == 3 and value == "retry" and not stopped:
            stopped.append(number)
            raise RuntimeError("stopped between two sinks")

    with pytest.raises(Exception, match="stopped between two sinks"):
        run(spark, tmp_path, between=stop_once)
    assert stopped
    run(spark, tmp_path, between=stop_once)
    assert found(spark, tmp_path, "retry") == RETRIES and found(spark, tmp_path, "dead") == [("a", 3, None, "e4")]
    assert [r[0] for r in found(spark, tmp_path, "done")] == ["b", "c", "e", "f"]


def test_events_into_a_sink_each(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = [{"delivery_id": f"d{i % 4}", "event": e, "payload": json.dumps({"action": a, "pull_request": {"number": i}}), "received_at": "2024-01-01T00:00:00Z", "signature": ""} for i, (e, a) in enumerate([("pull_request", "opened"), ("ping", None), ("pull_request_review", "submitted"), ("push", None), ("pull_request", "opened")])]
    (tmp_path / "in/e.json").write_text("\n".join(map(json.dumps, events)))
    stream = webhooks.once(webhooks.routed(webhooks.source(spark, str(tmp_path / "in")), "", allow_empty_secret=True))
    sinks = {r: str(tmp_path / r) for r in ("review", "pong", "acknowledged")}
    delivery.write(stream, sinks, str(tmp_path / "cp"), by="route").awaitTermination(120)
    assert {r: [x.delivery_id for x in delivery.read(spark, p).collect()] for r, p in sinks.items()} == {"review": ["d0"], "pong": ["d1"], "acknowledged": ["d2"]}


def test_human_reviews_beside_stored_ones(spark):
    payload = lambda state, n: json.dumps({"action": "submitted", "review": {"state": state, "user": {"login": "u"}}, "pull_request": {"number": n}, "repository": {"full_name": "o/r"}})
    events = spark.createDataFrame([("d1", "pull_request_review", payload("APPROVED", 1)), ("d2", "pull_request_review", payload("changes_requested", 2)), ("d3", "pull_request_review", payload("commented", 9)), ("d4", "ping", "{}"), ("d5", "pull_request_review", "bad")], "delivery_id string, event string, payload string")
    reviews = spark.createDataFrame([("o/r", 1, "r1", "comment", 1), ("o/r", 1, "r2", "approve", 2), ("o/r", 2, "r3", "approve", 1)], "repo string, pr_number int, review_id string, decision string, created_at int")
    got = {r.delivery_id: (r.review_id, r.reviewer, r.agrees) for r in webhooks.human_reviews(events, reviews).collect()}
    assert got == {"d1": ("r2", "u", True), "d2": ("r3", "u", False), "d3": (None, "u", None), "d5": (None, None, None)}
