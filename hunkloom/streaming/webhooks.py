"""Webhook events as a stream: verify, route, deduplicate by delivery id, write once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.providers import signature_ok

SCHEMA = "delivery_id string, event string, signature string, payload string, received_at timestamp"
PULL = "action string, number int, pull_request struct<number:int>, repository struct<full_name:string>, installation struct<id:bigint>"
# Actions of a pull request that lead to a review.
ACTIONS = ["opened", "synchronize", "reopened"]


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON events from a folder."""
    return spark.readStream.schema(SCHEMA).json(path)


def route(event: Column, action: Column) -> Column:
    return F.when(event == "ping", "pong").when((event == "pull_request") & action.isin(ACTIONS), "review").when(event == "pull_request_review", "acknowledged").otherwise("ignored")


def routed(events: DataFrame, secret: str, allow_empty_secret: bool = False) -> DataFrame:
    """Events whose signature holds, with their route and what a review needs to know."""
    ok = events.where(signature_ok(F.col("payload"), F.col("signature"), secret, allow_empty_secret))
    p = ok.withColumn("p", F.from_json("payload", PULL))
    return p.select("delivery_id", "event", "received_at", F.col("p.action").alias("action"), F.coalesce("p.pull_request.number", "p.number").alias("pr_number"), F.col("p.repository.full_name").alias("repo"), F.col("p.installation.id").alias("installation_id"), route(F.col("event"), F.col("p.action")).alias("route"))


def once(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each delivery once; its id is remembered for the watermark's time."""
    if not events.isStreaming:
        return events.dropDuplicates(["delivery_id"])
    return events.withWatermark("received_at", watermark).dropDuplicatesWithinWatermark(["delivery_id"])


def write(events: DataFrame, path: str, checkpoint: str):
    """One Parquet folder per route; a batch that is run again overwrites what it wrote before."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("route").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def requests(lines: DataFrame) -> DataFrame:
    """JSON-RPC messages, one a line; a line that can't be read has the parse error's code."""
    m = lines.select("value", F.from_json("value", "jsonrpc string, id string, method string, params string").alias("m"))
    ok = F.try_parse_json("value").isNotNull()
    known = F.col("m.method").isin("initialize", "tools/list", "tools/call", "resources/list", "resources/read", "ping")
    return m.select("m.id", "m.method", "m.params", F.when(~ok, F.lit(-32700)).when(~known, F.lit(-32601)).alias("error_code"))


REVIEW = "action string, review struct<state:string, user:struct<login:string>>, pull_request struct<number:int>, repository struct<full_name:string>"


def human_reviews(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews by people (events of the route `acknowledged`, with their payload) beside the latest stored review of the pull request.

    reviews: repo, pr_number, review_id, decision, created_at. `agrees` says whether both ask for the same; it is null without a stored review.
    """
    p = events.where(F.col("event") == "pull_request_review").select("delivery_id", F.from_json("payload", REVIEW).alias("p"))
    said = p.select("delivery_id", F.col("p.repository.full_name").alias("repo"), F.col("p.pull_request.number").alias("pr_number"), F.col("p.review.user.login").alias("reviewer"), F.lower("p.review.state").alias("state"))
    last = reviews.groupBy("repo", "pr_number").agg(F.max_by(F.struct("review_id", "decision"), F.struct("created_at", "review_id")).alias("r")).select("repo", "pr_number", "r.*")
    same = F.when(F.col("state") == "approved", "approve").when(F.col("state") == "changes_requested", "request_changes").otherwise("comment") == F.col("decision")
    return said.join(last, ["repo", "pr_number"], "left").withColumn("agrees", same)
