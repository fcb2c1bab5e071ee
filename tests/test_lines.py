"""Diff lines inside a patch's row, and joins of lines with intervals."""

import random
import re

from hunkloom.operators import chunking, diff

FILES = "pr_id string, file_ord long, filename string, status string, additions int, deletions int, patch string"
HEADER = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def walk(patch):
    """Lines of a patch one after the other."""
    out, hunk, pos, last = [], 0, 0, None
    for raw in patch.split("\n"):
        if m := HEADER.match(raw):
            hunk, pos, last = hunk + 1, pos + 1, None
            start = [int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)]
            old, new = start[0], start[2]
            out.append((hunk, pos, "hunk_header", None, None, raw, *start, False))
        elif hunk:
            pos += 1
            if raw[:1] == "+":
                out.append((hunk, pos, "added", None, new, raw[1:], *start, last == "-"))
                new, last = new + 1, "+"
            elif raw[:1] == "-":
                out.append((hunk, pos, "removed", old, None, raw[1:], *start, last == "+"))
                old, last = old + 1, "-"
            elif raw[:1] in (" ", ""):
                out.append((hunk, pos, "context", old, new, raw[1:], *start, False))
                old, new = old + 1, new + 1
    return out


def test_lines_equal_a_walk(spark):
    rnd = random.Random(4)
    pieces = ["@@ -3,2 +4,9 @@ f", "@@ -10 +20 @@", "+a", "-b", " c", "", "\\ No newline", "?", "@@ bad", "+é☃", "-\t", "--- x", "+++ y", "@@ -1,1 +1,1 @@"]
    patches = ["\n".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 40))) for _ in range(300)] + ["", "x", "@@ -1 +1 @@", "\n", "+a\n-b"]
    files = spark.createDataFrame([(f"p{i % 7}", i, f"f{i}", "modified", 0, 0, p) for i, p in enumerate(patches)] + [("n", 9999, "none", None, None, None, None)], FILES)
    got = diff.parse_patches(files)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = {i: [] for i in range(len(patches))}
    for r in got.orderBy("file_ord", "pos").collect():
        assert r.pr_id == f"p{r.file_ord % 7}" and r.filename == f"f{r.file_ord}"
        found[r.file_ord].append((r.hunk_no, r.pos, r.kind, r.old_line, r.new_line, r.content, r.old_start, r.old_count, r.new_start, r.new_count, r.turn))
    for i, p in enumerate(patches):
        assert found[i] == walk(p), p


def test_large_numbers_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(diff, "BLOCK_BYTES", 50)
    files = spark.createDataFrame([("p", i, "f", "added", 0, 0, f"@@ -{n} +{i},{n} @@\n+a\n c") for i, n in enumerate(["7", "99999999999", "9" * 40])], FILES)
    got = diff.parse_patches(files).where("kind = 'context'").orderBy("file_ord").collect()
    assert [(r.old_line, r.new_line, r.old_start, r.new_count) for r in got] == [(7, 1, 7, 7), (None, 2, None, 1), (None, 3, None, 1)]


def test_intervals_equal_brute_force(spark):
    rnd = random.Random(8)
    ints = [(rnd.choice("ab"), s, s + rnd.choice([0, 3, 15, 16, 40, 300, 5000]), i) for i, s in enumerate(rnd.randint(1, 6000) for _ in range(150))] + [("a", 9, 3, 999)]
    points = sorted({(rnd.choice("abc"), rnd.randint(0, 7000)) for _ in range(400)})
    ranges = [(rnd.choice("ab"), i, f, f + rnd.choice([0, 10, 700, 9000])) for i, f in enumerate(rnd.randint(1, 6000) for _ in range(60))] + [("a", 999, 5, 1)]
    intervals = spark.createDataFrame(ints, "k string, start_line int, end_line int, ord int")
    got = {(r.k, r.line): (r.start_line, r.end_line, r.ord) for r in chunking.innermost(spark.createDataFrame(points, "k string, line int"), intervals, "k").collect()}
    want = {}
    for k, x in points:
        held = [(e - s, o, s, e) for kk, s, e, o in ints if kk == k and s <= x <= e]
        if held:
            want[k, x] = (min(held)[2], min(held)[3], min(held)[1])
    assert got == want
    over = chunking.overlapping(spark.createDataFrame(ranges, "k string, r int, from_line int, to_line int"), intervals, "k").select("r", "ord").collect()
    assert sorted(map(tuple, over)) == sorted((r, o) for k, r, f, t in ranges for kk, s, e, o in ints if k == kk and s <= t and e >= f and s <= e and f <= t)


def test_what_meets_grows_with_the_lines(spark):
    n = 100_000
    points = spark.range(1, n + 1).selectExpr("'f' AS k", "CAST(id AS INT) AS line")
    intervals = spark.range(0, n, 45).selectExpr("'f' AS k", "CAST(id + 1 AS INT) AS start_line", "CAST(id + 50 AS INT) AS end_line", "CAST(id AS INT) AS ord")
    level = intervals.withColumn("_b", chunking.F.explode(chunking.F.sequence(chunking.F.expr("start_line div 256"), chunking.F.expr("end_line div 256"))))
    met = points.withColumn("_b", chunking.F.expr("line div 256")).join(level, ["k", "_b"]).count()  # what the join compares at the level of these intervals
    assert met < 10 * n and chunking.innermost(points, intervals, "k").count() == n
