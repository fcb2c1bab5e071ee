"""Queries over retries of deliveries and reviews by people, with DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from ..streaming import delivery, webhooks

Q, O = {}, {}


def query(name: str, sql: str):
    def add(f):
        Q[name], O[name] = f, sql
        return f

    return add


@query("m04_retries", f"""WITH e AS (SELECT concat('d', user_id) AS delivery_id, event_id % 3 = 0 AS ok, event_type AS error, ts AS t FROM events),
w AS (SELECT *, count(*) OVER b AS failed, coalesce(bool_or(ok) OVER b, false) AS ended FROM e WINDOW b AS (PARTITION BY delivery_id ORDER BY t, ok, error ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, CASE WHEN ok THEN 'done' WHEN failed = {delivery.MAX_RETRIES} THEN 'dead' ELSE 'retry' END AS action FROM w WHERE NOT ended AND failed <= {delivery.MAX_RETRIES})
SELECT delivery_id, action, (failed + CASE WHEN action = 'retry' THEN 1 ELSE 0 END)::INT AS attempt, CASE WHEN action = 'retry' THEN epoch_us(t) // 1000 + ({1000 * delivery.RETRY_SECONDS} * 2 ** failed)::BIGINT END AS due_ms, CASE WHEN NOT ok THEN error END AS error FROM a""")
def _(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select(F.concat(F.lit("d"), "user_id").alias("delivery_id"), (F.col("event_id") % 3 == 0).alias("ok"), F.col("event_type").alias("error"), F.col("ts").cast("timestamp").alias("at"))
    return delivery.retries(e).select("delivery_id", "action", "attempt", F.unix_millis("due").alias("due_ms"), "error")


_STATE = "CASE event_id % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'changes_requested' ELSE 'commented' END"


@query("m07_human_reviews", f"""WITH {fx.REVIEWS_SQL}, ev AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'pull_request_review' ELSE event_type END AS event, user_id, lower({_STATE}) AS state, event_id % 50 AS pr_number FROM events),
last AS (SELECT repository_id, review_id % 50 AS pr_number, arg_max((review_id, decision), review_id) AS r FROM reviews GROUP BY ALL)
SELECT event_id::VARCHAR AS delivery_id, concat('r', user_id % 25) AS repo, ev.pr_number::INT AS pr_number, concat('user', user_id) AS reviewer, state, r[1] AS review_id, r[2] AS decision,
  CASE state WHEN 'approved' THEN 'approve' WHEN 'changes_requested' THEN 'request_changes' ELSE 'comment' END = r[2] AS agrees
FROM ev LEFT JOIN last l ON l.repository_id = user_id % 25 AND l.pr_number = ev.pr_number WHERE event = 'pull_request_review'""")
def _(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    payload = F.to_json(F.struct(F.lit("submitted").alias("action"), F.struct(F.expr(_STATE).alias("state"), F.struct(F.concat(F.lit("user"), "user_id").alias("login")).alias("user")).alias("review"), F.struct((F.col("event_id") % 50).alias("number")).alias("pull_request"), F.struct(F.concat(F.lit("r"), F.col("user_id") % 25).alias("full_name")).alias("repository")))
    events = e.select(F.col("event_id").cast("string").alias("delivery_id"), F.when(F.col("event_type") == "click", "pull_request_review").otherwise(F.col("event_type")).alias("event"), payload.alias("payload"))
    stored = fx.reviews(spark, sf_dir).select(F.concat(F.lit("r"), "repository_id").alias("repo"), (F.col("review_id") % 50).cast("int").alias("pr_number"), "review_id", "decision", F.col("review_id").alias("created_at"))
    return webhooks.human_reviews(events, stored)
