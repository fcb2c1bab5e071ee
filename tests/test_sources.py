"""Landed responses, tables, standards, and the small text functions around patches."""

import json

from pyspark.sql import functions as F

from hunkloom.operators import diff, patches
from hunkloom.sources import landed


def test_pull_requests(spark, tmp_path):
    pull = {"title": "t", "body": None, "number": 7, "user": {"login": "u"}, "base": {"ref": "main"}, "head": {"ref": "h", "sha": "abc"}, "labels": [{"name": "x"}, {"name": "y"}]}
    (tmp_path / "p.json").write_text(json.dumps(pull) + "\n" + json.dumps({"title": "no", "number": 8, "body": "b"}))
    got = {r.number: r.asDict() for r in landed.pull_requests(spark, str(tmp_path / "p.json")).collect()}
    assert got[7] == {"number": 7, "title": "t", "description": "", "author": "u", "base_branch": "main", "head_branch": "h", "head_sha": "abc", "labels": ["x", "y"]}
    assert got[8]["description"] == "b" and got[8]["labels"] == [] and got[8]["author"] is None


def test_standards_text_and_invalid_utf8(spark, tmp_path):
    (tmp_path / "s.md").write_text("## A-1: T\nbody\n")
    assert [r.content for r in landed.standards_text(spark, str(tmp_path / "s.md")).collect()] == ["## A-1: T\nbody\n"]
    assert landed.standards_text(spark, str(tmp_path / "none.md")).count() == 0
    (tmp_path / "c.json").write_text(json.dumps({"path": "a", "encoding": "base64", "content": "/w==", "size": 1}))
    assert landed.contents(spark, str(tmp_path / "c.json")).first().content == "�"


def test_tables_up_and_down(spark):
    landed.create_tables(spark, "hunkloom_test")
    landed.create_tables(spark, "hunkloom_test")
    try:
        assert {r.tableName for r in spark.sql("SHOW TABLES IN hunkloom_test").collect()} == set(landed.TABLES)
        assert spark.table("hunkloom_test.reviews").columns[:3] == ["id", "repository_id", "pr_number"]
    finally:
        landed.drop_tables(spark, "hunkloom_test")
        assert spark.sql("SHOW TABLES IN hunkloom_test").count() == 0
        spark.sql("DROP DATABASE hunkloom_test")


def test_suggestions_and_line_counts(spark):
    rows = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",), ("a\r\nb\n",)], "t string")
    assert [r.n for r in rows.select(patches.n_lines(F.col("t")).alias("n")).collect()] == ["".count("x"), 1, 1, 2, 2]
    assert rows.select(patches.suggestion(F.lit("x")).alias("s")).first().s == "```suggestion\nx\n```"
    text = "diff --git a b\n@@ -1 +1 @@\n+a\ndiff --git c d\n@@ -2 +2 @@\n-b\n"
    parts = spark.range(1).select(diff.split_files(F.lit(text)).alias("s")).first().s
    assert [p.strip().splitlines()[0] for p in parts] == ["diff --git a b", "diff --git c d"]
