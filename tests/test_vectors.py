"""Vector search by tiles and filters of the store."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hunkloom.functions import providers
from hunkloom.operators import filters, vectors


def brute(queries, docs, k):
    out = []
    for q, a in queries:
        rows = []
        for i, b in docs:
            if len(a) == len(b):
                dot, size = sum(x * y for x, y in zip(a, b, strict=True)), np.sqrt(sum(x * x for x in a)) * np.sqrt(sum(x * x for x in b))
                rows.append((1 - (dot / size if size > 0 else 0.0), i))
        out += [(q, i, n + 1) for n, (_, i) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def test_tiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE_QUERIES", 7)
    monkeypatch.setattr(vectors, "TILE_DOCS", 50)
    rnd = random.Random(1)
    docs = [(i, [float(rnd.randint(-2, 2)) for _ in range(4)]) for i in range(400)] + [(1000, [0.0] * 4), (1001, [1.0, 2.0]), (1002, [])]  # many ties
    queries = [(f"q{i}", docs[i * 13][1]) for i in range(20)] + [("zero", [0.0] * 4), ("short", [1.0, 0.0])]
    d, q = spark.createDataFrame(docs, "id long, embedding array<double>"), spark.createDataFrame(queries, "query_id string, query array<double>")
    got = vectors.search(q, d, 6)
    assert sorted((r.query_id, r.id, r.rank) for r in got.collect()) == brute(queries, docs, 6)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_groups_and_other_columns(spark):
    docs = spark.createDataFrame([(i, f"r{i % 3}", [float(i % 5 - 2), 1.0], f"text {i}") for i in range(60)], "id int, repo string, embedding array<double>, content string")
    queries = spark.createDataFrame([("a", "r1", [1.0, 1.0]), ("b", "none", [1.0, 1.0]), ("c", None, [1.0, 1.0])], "query_id string, repo string, query array<double>")
    got = vectors.search(queries, docs, 3, by="repo").orderBy("rank").collect()
    assert [(r.query_id, r.id, r.repo, r.content) for r in got] == [("a", i, "r1", f"text {i}") for i in (13, 28, 43)]


def test_bad_vectors_take_no_part(spark):
    docs = spark.createDataFrame([(1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.0, 0.0]), (6, [-1.0, 0.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")
    got = vectors.search(q, docs, 10).orderBy("rank").collect()
    assert [(r.id, r.distance, r.score) for r in got] == [(5, 1.0, 0.0), (6, 2.0, 0.0)]
    assert vectors.search(q, docs.limit(0), 3).count() == 0 and vectors.search(q.limit(0), docs, 3).count() == 0


def test_text_or_vector_or_neither(spark):
    texts = ["def parse(line): return line", "SELECT * FROM t", "class Node: pass"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, content string").withColumn("embedding", providers.embed(F.col("content")))
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, query_text string")
    assert [r.id for r in vectors.search(asked, docs, 1).orderBy("query_id").collect()] == [0, 1, 2]
    both = spark.createDataFrame([(0, None, texts[1]), (1, docs.first().embedding, texts[1]), (2, [], texts[2])], "query_id int, query array<float>, query_text string")
    assert [r.id for r in vectors.search(both, docs, 1).orderBy("query_id").collect()] == [1, 0, 2]
    with pytest.raises(ValueError, match="Either query_embedding or query_text"):
        vectors.search(asked.select("query_id"), docs, 1)
    for row in [(0, None, None), (0, [], "")]:
        with pytest.raises(Exception, match="Either query_embedding or query_text"):
            vectors.search(spark.createDataFrame([row], "query_id int, query array<float>, query_text string"), docs, 1).collect()


def test_ten_thousand_queries(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(3000, 8)).tolist())], "id int, embedding array<double>")
    queries = spark.range(10_000).select(F.col("id").alias("query_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sin(F.col("id") * k)).alias("query"))
    got = vectors.search(queries, docs, 2)
    assert got.count() == 20_000 and got.where("rank = 1").count() == 10_000


META = "id int, repo string, n int, content string"


def test_filters(spark):
    rows = [(1, "a", 1, "has token"), (2, "a", 5, "no"), (3, "b", 5, "token test"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, META)
    ids = lambda c: sorted(r.id for r in docs.where(c).collect())
    for where, want in [
        (None, [1, 2, 3, 4]), ({}, [1, 2, 3, 4]), ({"repo": "a"}, [1, 2]), ({"repo": {"$ne": "a"}}, [3, 4]), ({"n": {"$gt": 1}}, [2, 3]), ({"n": {"$gte": 1, "$lt": 5}}, [1]), ({"n": {"$lte": 1}}, [1]), ({"repo": {"$in": ["b", "c"]}}, [3]), ({"repo": {"$nin": ["b"]}}, [1, 2, 4]),
        ({"$and": [{"repo": "a"}, {"n": 5}]}, [2]), ({"$or": [{"repo": "b"}, {"$and": [{"n": 1}, {"repo": "a"}]}]}, [1, 3]), ({"repo": "a", "n": 5}, [2]),
    ]:
        assert ids(filters.metadata(where)) == want, where
    for where, want in [({"$contains": "token"}, [1, 3]), ({"$not_contains": "token"}, [2, 4]), ({"$regex": "^n"}, [2]), ({"$not_regex": "o"}, [4]), ({"$and": [{"$contains": "token"}, {"$not_contains": "test"}]}, [1]), ({"$or": [{"$contains": "test"}, {"$contains": "no"}]}, [2, 3])]:
        assert ids(filters.document(where)) == want, where
    held = docs.withColumn("metadata", F.create_map(F.lit("repo"), F.col("repo")))
    assert held.where(filters.metadata({"repo": "b"}, lambda n: F.col("metadata")[n])).count() == 1
    for bad in ({"$not": []}, {"n": {"$near": 1}}, {"$and": []}, {"$or": {}}):
        with pytest.raises(ValueError):
            filters.metadata(bad)
    with pytest.raises(ValueError):
        filters.document({"$like": "x"})


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a", [1.0], "token"), (2, "b", [1.0], "token")], "id int, repo string, embedding array<double>, content string").write.parquet(str(tmp_path / "d"))
    docs, q = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame([(1, [1.0])], "query_id int, query array<double>")
    got = vectors.search(q, docs, 5, {"repo": "a"}, where_document={"$contains": "oke"})
    assert [r.id for r in got.collect()] == [1]
    plan = vectors.search(q, docs.select("id", "embedding", "repo", "content"), 5, {"repo": "a", "id": {"$ne": 7}}, where_document={"$contains": "oke"})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(repo,a)" in plan and "StringC" in plan and "Or(IsNull(id),Not(EqualTo(id,7)))" in plan
