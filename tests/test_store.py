"""The document store, answers held to a schema, reviews file by file, and listings that end by themselves."""

import json

import pytest
from pyspark.sql import functions as F

from hunkloom.functions import providers
from hunkloom.operators import answers, history, prompts, store
from hunkloom.sources import landed

BATCH = "collection string, id string, content string, metadata map<string,string>"


def never(texts):
    raise AssertionError("nothing should be embedded")


def only_new(texts):
    assert all(t.startswith("new") for t in texts), texts
    return providers.hashed(texts)


@pytest.fixture(autouse=True)
def registered():
    providers.EMBEDDERS |= {"never": never, "only_new": only_new}
    yield
    providers.EMBEDDERS.pop("never"), providers.EMBEDDERS.pop("only_new")


def test_a_second_run_embeds_nothing(spark):
    batch = spark.createDataFrame([("c", "1", "one", {"a": "1"}), ("c", "2", "two", {"a": "1"}), ("d", "1", "one", {})], BATCH)
    first = store.upserted(spark.createDataFrame([], store.SCHEMA), batch)
    stored = spark.createDataFrame(first.collect(), store.SCHEMA)
    again = store.upserted(stored, batch, "never")
    assert sorted(r.asDict()["digest"] for r in again.collect()) == sorted(r.digest for r in stored.collect()) and again.where(F.size("embedding") == 64).count() == 3
    changed = spark.createDataFrame([("c", "1", "one", {"a": "2"}), ("c", "2", "new two", {}), ("c", "3", "new three", {}), ("c", "3", "new", {})], BATCH)
    got = {(r.collection, r.id): (r.content, r.metadata) for r in store.upserted(stored, changed, "only_new").collect()}
    assert got == {("c", "1"): ("one", {"a": "2"}), ("c", "2"): ("new two", {}), ("c", "3"): ("new three", {}), ("d", "1"): ("one", {})}


def test_standards_and_similar_comments(spark):
    empty = spark.createDataFrame([], store.SCHEMA)
    docs = spark.createDataFrame([(1, "## SEC-1: No secrets\n<!-- tags: a, b -->\nnever\n## Other\ntext", "o/r")], "doc_id int, content string, repo string")
    rules = {r.metadata["rule_id"]: r for r in store.load_standards(empty, docs, F.col("repo")).collect()}
    assert set(rules) == {"SEC-1", "RULE-002"} and rules["SEC-1"].metadata["repo"] == "o/r" and rules["SEC-1"].content == "[SEC-1] No secrets\n\nnever"
    comments = spark.createDataFrame([("v1", 0, "high", "bug", "a.py", "index out of range", 7, "u"), ("v1", 1, "low", "style", "b.py", "long line", 7, "u")], "review_id string, ordinal int, severity string, category string, file_path string, message string, pr_number int, author string")
    stored = store.upserted(empty, store.comment_documents(comments, F.lit("o/r")))
    calls = spark.createDataFrame([("q", "o/r", "long line in b.py"), ("other", "x/y", "long line")], "query_id string, repo string, query_text string")
    got = store.similar_comments(calls, stored, 1).collect()
    assert [(r.query_id, r.comment, r.severity, r.file_path) for r in got] == [("q", "[low] [style] b.py: long line", "low", "b.py")]
    context = spark.createDataFrame([(1, "u", 0.5, 2, ["bug"], 1.25, [], [], [])], "repository_id int, author string, approval_rate double, total_prs_reviewed int, common_issues array<string>, avg_issues_per_pr double, areas array<string>, patterns array<string>, suppress_rules array<string>")
    text = history.prompt_context(history.with_similar(context, got and spark.createDataFrame(got).withColumn("repository_id", F.lit(1)), ["repository_id"])).first().prompt
    assert text == "## Author History (u):\n- PRs reviewed: 2\n- Approval rate: 50%\n- Common issues: bug\n- Avg issues/PR: 1.2\n\n## Similar Past Comments (avoid repeating unless still relevant):\n- [low] [low] [style] b.py: long line"


COMMENT = {"file_path": "a", "line_number": None, "severity": "low", "category": "bug", "message": "m"}
FITS = {"summary": "s", "decision": "comment", "confidence": 1, "file_reviews": [{"file_path": "a", "summary": "s", "comments": [COMMENT]}]}


def test_schema():
    ok = json.dumps(FITS)
    assert answers.schema_error(ok) is None and answers.schema_error(f"```json\n{ok}\n```") is None
    wrong = lambda **k: answers.schema_error(json.dumps({x: v for x, v in (FITS | k).items() if v != "gone"}))
    comment = lambda **k: wrong(file_reviews=[{"file_path": "a", "summary": "s", "comments": [{x: v for x, v in (COMMENT | k).items() if v != "gone"}]}])
    assert [wrong(summary="gone"), wrong(summary=1), wrong(decision="maybe")[:16], wrong(confidence=2)[:10], wrong(confidence=True)[:10], wrong(confidence="1")[:10], wrong(file_reviews={})[:12]] == ["summary is missing", "summary is not a text", "decision is none", "confidence", "confidence", "confidence", "file_reviews"]
    assert wrong(file_reviews=[{"file_path": "a"}]).startswith("a file review lacks") and wrong(file_reviews=[1]).startswith("a file review lacks")
    assert comment(message="gone").startswith("a comment lacks") and comment(severity="bad").startswith("a severity") and comment(category=None).startswith("a category")
    assert [answers.schema_error(x) for x in (None, "", "[]", "{", "null")] == ["the answer is not JSON", "the answer is not JSON", "the answer is not an object", "the answer is not JSON", "the answer is not an object"]


def scripted(asked):
    out = []
    for p in asked:
        if p.startswith("raise"):
            raise TimeoutError("late")
        out.append({"content": json.dumps(FITS), "finish_reason": "length"} if p.startswith("cut") else json.dumps(FITS) if p.startswith("good") or "summary is missing" in p else "{}")
    return out


def test_answers_are_asked_for_again(spark):
    providers.MODELS["scripted-test"] = scripted
    try:
        rows = spark.createDataFrame([("good",), ("cut",), ("bad",), ("raise",)], "prompt string")
        got = {r.prompt: (r.attempts, r.error, r.truncated, r.content is None) for r in answers.structured(rows, model="scripted-test").collect()}
        assert got == {"good": (1, None, False, False), "cut": (1, None, True, False), "bad": (2, None, False, False), "raise": (1, "TimeoutError: late", False, True)}
        once = {r.prompt: r.error for r in answers.structured(rows, model="scripted-test", attempts=1).collect()}
        assert once["bad"] == "summary is missing"
        files = spark.createDataFrame([("p", 1, "good", 3, 1, True), ("p", 2, "raise", 4, 1, True), ("p", 3, "x", 5, 1, False), ("q", 4, "raise", 1, 1, True)], "pr_id string, file_ord int, message string, additions int, deletions int, reviewable boolean")
        found = {r.pr_id: r for r in answers.review_files(files, F.col("message"), "scripted-test").collect()}
        assert (found["p"].summary, found["p"].decision, found["p"].failed_files, found["p"].total_comments) == ("Reviewed 2 files. Found 1 issue(s): 0 critical, 0 high, 1 medium/low.", "comment", 1, 1)
        assert (found["q"].summary, found["q"].decision, found["q"].confidence, found["q"].failed_files) == ("Reviewed 1 files with +1/-1 changes. No issues found.", "approve", 0.8, 1)
    finally:
        providers.MODELS.pop("scripted-test")


def test_file_message(spark):
    one = spark.range(1).select(prompts.file_message(F.lit("H"), F.lit("a.py"), F.lit("added"), F.lit(1), F.lit(2), F.lit("p" * 60_000), F.lit("c" * 30_000), F.lit(None)).alias("m")).first().m
    assert one == "H\n\n## File Under Review: a.py\nStatus: added | +1 -2\n\n### Diff:\n```\n" + "p" * 50_000 + "\n```\n\n### Full File Content:\n```\n" + "c" * 20_000 + "\n```\n\n## Instructions:\nReview ONLY this file. Produce a JSON response with your findings."


def test_listings_end_by_themselves(spark, tmp_path):
    def page(listing, k, n):
        (tmp_path / listing).mkdir(exist_ok=True)
        (tmp_path / listing / f"page-{k}.json").write_text(json.dumps([{"filename": f"{listing}-{k}-{i}"} for i in range(n)]))

    for listing, sizes in {"full": [3, 3, 1], "short": [2, 3], "empty": [3, 0, 3], "gap": [3], "none": [0]}.items():
        for k, n in enumerate(sizes, 1):
            page(listing, k, n)
    page("gap", 3, 3)
    got = landed.paged_files(spark, f"file://{tmp_path}", 3)
    assert {r.listing: (r.n, r.last) for r in got.groupBy("listing").agg(F.count("*").alias("n"), F.max("page").alias("last")).collect()} == {"full": (7, 3), "short": (2, 1), "empty": (3, 1), "gap": (3, 1)}
    assert got.rdd.getNumPartitions() == 5 and landed.paged_files(spark, f"file://{tmp_path}/nowhere").count() == 0
