"""Operators against brute force, round trips and libraries, and their defined results for odd rows."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hunkloom.llm import classify, common, jaccard, language_id, line_dedup, mixing, ogg, pieces, quality, topk, toxicity, warc

WORD = "[^\\x20\\x09-\\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
LONG = "lorem ipsum " * 20_000
ODD = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (3, "   \n\t", "en", "a", 5, "x"), (4, LONG, "en", None, 1, "x"), (5, "same text here", "en", "a", 1, "x"), (5, "same text here", "en", "a", 1, "x"), (None, "no id", "en", "b", 1, "x"), (7, "é ☃ \x00 ▁ 12", "fr", "", 1, "x")]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- mixing


def test_mix_targets_and_counts(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randint(0, 30), "en", rnd.choice(["a", "b", "b", "b", None]), 0, "") for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert len(got) == 600
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.copies <= 3
        by[r.source].append(r)
    total = sum(r.size for r in got)
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert v[0].target <= 3 * v[0].source_size + 1e-9
        assert abs(sum(r.copies * r.size for r in v) - v[0].target) <= 0.05 * v[0].target + 60
    small = {s: (v[0].source_size, v[0].target) for s, v in by.items()}
    free = [s for s, (size, t) in small.items() if t < 3 * size - 1e-6]
    assert len({round(small[s][1] / {"a": 1, "b": 2, None: 3}[s], 6) for s in free}) == 1  # shares by weight, nulls last


def test_mix_odd_rows(spark):
    got = mixing.mix(odd(spark)).collect()
    assert len(got) == len(ODD) and mixing.mix(none(spark)).count() == 0
    assert mixing.mix(odd(spark).withColumn("size", F.lit("clash"))).where("doc_id = 1").first()["size"] == 0
    clash = mixing.mix(odd(spark).withColumns({c: F.lit(c) for c in mixing._OWN})).collect()
    assert all(r[c] == c for r in clash for c in mixing._OWN) and sorted(r.copies for r in clash) == sorted(r.copies for r in got)
    emitted = mixing.emit(mixing.mix(odd(spark)), ["doc_id"]).count()
    assert emitted == sum(r.copies for r in got)


def test_forest_is_the_components_of_near_maps():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, 12).astype(np.uint64)
    maps = np.array([base[i % 12] ^ np.uint64(sum(1 << int(b) for b in set(rnd.integers(0, 64, i % 5).tolist()))) for i in range(150)], np.uint64)
    got = sorted(sorted(p.tolist()) for p in jaccard.forest(maps))
    near = np.bitwise_count(maps[:, None] ^ maps[None]) <= 3
    label = np.arange(len(maps))
    for _ in range(150):
        label = np.array([label[near[i]].min() for i in range(len(maps))])
    assert got == sorted(sorted(np.flatnonzero(label == x).tolist()) for x in set(label.tolist()))


@pytest.mark.parametrize("percent, low, high, n", [(80, 30, 120, 1000), (80, 300, 600, 250), (90, 30, 120, 1000), (80, 5, 20, 1000)])
def test_index_lists_of_unrelated_sets_do_not_grow(percent, low, high, n):
    for times in (1, 16):
        rnd, found = np.random.default_rng(4), []
        for start in range(0, n * times, n):
            sizes = rnd.integers(low, high + 1, n)
            bounds = np.r_[0, np.cumsum(sizes)]
            token = np.concatenate([np.sort(rnd.integers(0, 1 << 52, k)).astype(np.uint64) for k in sizes])
            found += [(k, o + start, m) for k, o, m in jaccard.entries(bounds, token, sizes, np.ones(n, bool), percent)]
        keys, ids, maps = (np.concatenate(x) for x in zip(*found, strict=True))
        assert np.unique(keys, return_counts=True)[1].max() <= 3
        assert len(jaccard.list_edges(keys, ids.astype(np.int64), maps)[0]) <= 3


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_list(percent):
    rnd, missed = random.Random(percent), []
    for _ in range(400):
        a = {rnd.getrandbits(52) for _ in range(rnd.choice([1, 2, 4, 5, 7, 11, 30, 90, 400]))}
        b = set(a)
        while True:  # as far apart as the link allows
            c = set(b)
            c.add(rnd.getrandbits(52)) if rnd.random() < 0.5 else c.discard(rnd.choice(sorted(c)))
            if not c or 100 * len(a & c) < percent * len(a | c):
                break
            b = c
        if a == b:
            continue
        sets = [np.array(sorted(x), np.uint64) for x in (a, b)]
        sizes = np.array([len(x) for x in sets])
        found = list(jaccard.entries(np.r_[0, np.cumsum(sizes)], np.concatenate(sets), sizes, np.ones(2, bool), percent))
        keys, ids, maps = (np.concatenate([f[i] for f in found]) for i in range(3))
        missed += [] if len(jaccard.list_edges(keys, ids.astype(np.int64), maps)[0]) else [(sizes, len(a & b))]
    assert not missed


# ---------------------------------------------------------------- line dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_within_is_edit_distance(spark, k):
    rnd = random.Random(k)
    pairs = []
    for _ in range(600):
        a = [rnd.choice("abé") for _ in range(rnd.randint(0, 14))]
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "é"])
        pairs.append(tuple("".join(x) for x in sorted((a, b), key=len)))
    df = spark.createDataFrame(pairs, "a string, b string")
    df = df.selectExpr("*", *(f"transform(split({c}, ''), x -> xxhash64(x)) AS {c}_words" for c in "ab"))
    characters, by_word = line_dedup.Characters(3, 8), line_dedup.Words(3, 8)
    got = df.select("a", "b", F.expr(line_dedup.within(characters, "a", "b", k)).alias("w"), F.expr(line_dedup.within(by_word, "a_words", "b_words", k)).alias("v")).collect()
    assert all(r.w == (edits(r.a, r.b) <= k) for r in got)
    assert all(r.v == r.w for r in got if r.a and r.b)


def line_classes(docs, max_edits, edit_chars, max_words=0, edit_words=10):
    """For each line that is not blank the first (doc, line) of its class, by comparing all pairs."""
    first = {}
    for i, t in docs:
        for j, x in enumerate((t or "").split("\n") if t is not None else []):
            if x.strip():
                first.setdefault(x, (i, j))
    names = sorted(first, key=first.get)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, a in enumerate(names):
        for b in names[p + 1 :]:
            k, n = min(max_edits, min(len(a), len(b)) // edit_chars), abs(len(a) - len(b))
            near = k and n <= k and edits(a, b) <= k
            if max_words and not near:
                x, y = a.split(" "), b.split(" ")
                k = min(max_words, min(len(x), len(y)) // edit_words)
                near = k and abs(len(x) - len(y)) <= k and edits(x, y) <= k
            if near:
                u, v = sorted((find(a), find(b)), key=first.get)
                root[v] = u
    return {x: (first[x], first[find(x)]) for x in names}


def check_lines(spark, docs, **options):
    got = {r.doc_id: r for r in line_dedup.with_kept(line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), **options)).collect()}
    want, dropped = line_classes(docs, **{"max_edits": 1, "edit_chars": 10} | options), 0
    for i, t in docs:
        lines = t.split("\n")
        kept = [j for j, x in enumerate(lines) if not x.strip() or want[x] == ((i, j), (i, j))]
        near = [(j, *want[x][1]) for j, x in enumerate(lines) if x.strip() and want[x][0] == (i, j) != want[x][1]]
        assert got[i].kept_lines == kept and got[i].kept_text == "\n".join(lines[j] for j in kept) and got[i].n_lines == len(lines)
        assert list(zip(got[i].near_lines, got[i].near_ids, got[i].near_to, strict=True)) == near
        dropped += len(near)
    return dropped


@pytest.mark.parametrize("k, most", [(1, 4), (2, 8)])
def test_line_dedup_against_brute_force(spark, monkeypatch, k, most):
    monkeypatch.setattr(line_dedup, "MAX_LIST", most)
    rnd = random.Random(10 + k)
    base = ["".join(rnd.choice("abcdefghé ") for _ in range(rnd.randint(0, 45))) for _ in range(30)] + ["x" * n for n in (9, 10, 11, 19, 20, 21, 33)]
    docs = []
    for i in range(50):
        lines = []
        for _ in range(rnd.randint(1, 7)):
            x = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                at = rnd.randrange(len(x) + 1)
                x[at : at + rnd.randint(0, 1)] = rnd.choice(["", "q", "z"])
            lines.append("".join(x))
        docs.append((i, "\n".join(lines)))
    assert check_lines(spark, docs, max_edits=k, edit_chars=5 if k > 1 else 8)


def test_line_dedup_words_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_LIST", 4)
    rnd = random.Random(5)
    base = [[rnd.choice(["ab", "cde", "f", "ghijk", "lm", "nopq", "rst"]) + rnd.choice("xyz") for _ in range(n)] for n in (7, 10, 11, 19, 20, 21, 22, 29, 30, 32, 33, 39, 40, 60, 110) for _ in range(2)]
    docs = []
    for i in range(130):
        x = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(x) + 1)
            x[at : at + rnd.randint(0, 1)] = rnd.choice([[], ["new"], ["ändern"]])
        docs.append((i, " ".join(x)))
    docs.append((999, "lorem ipsum " * 5000))
    assert check_lines(spark, docs, max_words=2)


def test_line_dedup_large_groups_make_few_rows(spark):
    rnd = random.Random(6)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(80))
    near = [line[:40] + f"{i:03d}" + line[40:] for i in range(0, 240, 2)]  # one class: numbers in a line
    far = [line[:30] + "".join(rnd.choice("abcdefgh ") for _ in range(60)) for _ in range(120)]  # a common beginning only
    docs = spark.createDataFrame([(i, a + "\n" + b) for i, (a, b) in enumerate(zip(near, far, strict=True))], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert all(r.near_lines == ([0] if i else []) and r.kept_lines == ([1] if i else [0, 1]) for i, r in got.items())


def test_neighbours_connect_what_is_within_one_edit(spark):
    rnd, texts = random.Random(11), set()
    for n in (9, 10, 11, 31, 32, 33, 63, 64, 65, 200):
        base = "".join(rnd.choice("abé ") for _ in range(n))
        for _ in range(30):
            x, at = base, rnd.randrange(n)
            for _ in range(rnd.randint(0, 2)):
                x = x[:at] + rnd.choice(["", "z", "y", x[at : at + 1] + "z"]) + x[at + 1 :]
                at = rnd.choice([at, rnd.randrange(n), 0, len(x) - 1])
            texts.add(x)
    texts = sorted(t for t in texts if t.strip())
    unit = line_dedup.Characters(1, 10)
    rows = spark.createDataFrame(list(enumerate(texts)), "h long, seq string")
    links = [(r.a, r.b) for r in line_dedup.neighbours(unit, rows).collect()]
    near = lambda a, b: abs(len(a) - len(b)) <= 1 and min(len(a), len(b)) >= 10 and edits(a, b) <= 1
    assert links and all(near(texts[a], texts[b]) for a, b in links)

    def roots(pairs):
        root = list(range(len(texts)))
        for _ in range(len(texts)):
            before = list(root)
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
            if root == before:
                return root

    assert roots(links) == roots([(a, b) for a in range(len(texts)) for b in range(a) if near(texts[a], texts[b])])


def test_long_lists_make_a_few_keys_a_line(spark, monkeypatch):
    rnd, made = random.Random(12), []
    base = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(70)]
    lines = [" ".join([*base[:i], w, *base[i + 1 :]]) for i in (rnd.randrange(70) for _ in range(300)) for w in ["".join(rnd.choice("xyz") for _ in range(5))]]
    lines = sorted({*lines, lines[0][:200] + "Q" + lines[0][200:], lines[0][:-1] + "Q"})
    whole = line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df, what: (made.append(whole(df, what)) if what == "neighbours" else None) or (made[-1] if what == "neighbours" else whole(df, what)))
    rows = spark.createDataFrame(list(enumerate(lines)), "h long, seq string")
    links = {tuple(sorted((r.a, r.b))) for r in line_dedup.neighbours(line_dedup.Characters(1, 10), rows).collect()}
    found = [x for x in links if any("Q" in lines[i] for i in x)]
    assert len({i for x in found for i in x if "Q" in lines[i]}) == 2 and all(edits(lines[a], lines[b]) <= 1 for a, b in found)
    assert sum(x.count() for x in made) < 60 * len(lines)


def test_line_dedup_units_and_rounds_share_jobs(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_LIST", 4)
    rnd, made, whole = random.Random(13), [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df, what: made.append((what, df._jdf.queryExecution().analyzed().toString().count("Join "))) or whole(df, what))
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(12)]
    near = [" ".join([*words[:6], "".join(rnd.choice("xyz") for _ in range(5)), *words[7:]]) for _ in range(20)]  # a changed word
    line = "".join(rnd.choice("ijklmnop") for _ in range(60))
    near += [line[:30] + f"{i}" + line[31:] for i in "0123456789QRSTUVWX"]  # a changed character
    assert check_lines(spark, list(enumerate(near)), max_words=1) >= 30
    names = [what for what, _ in made]
    assert names.count("neighbours") > 1 and names.count("texts") == names.count("members") == 1 and names.count("pairs") == names.count("links") == 2
    assert max(joins for what, joins in made if what == "pairs") <= 4  # however many rounds there were


def test_line_dedup_odd_rows(spark):
    got = {r.doc_id: r for r in line_dedup.with_kept(line_dedup.dedup_lines(odd(spark).withColumn("n_kept", F.lit("clash")).withColumn("h", F.lit(1)))).collect()}
    assert got[1].n_lines == 0 and got[1].kept_text is None and got[1].h == 1
    assert got[2].n_lines == 1 and got[2].kept_lines == [0] and got[3].kept_text == "   \n\t"
    assert got[5].kept_text == "same text here" and got[None].kept_text == "no id" and got[4].kept_text == LONG
    assert line_dedup.dedup_lines(none(spark)).count() == 0
    line = "a line that many rows hold, over and over again"
    rows = [(7, f"{line}\n{line}!\nIt.")] * 1000 + [(8, f"It.\nno\n{line}?")]
    same = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id", "kept_lines", "near_lines", "near_ids", "near_to").count().collect()
    assert sorted(map(tuple, same)) == [(7, [0, 2], [1], [7], [0], 1000), (8, [1], [2], [7], [0], 1)]
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(none(spark), max_edits=0)


# ---------------------------------------------------------------- Jaccard join


def brute_classes(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent", "most"), [(3, 90, 10**6), (5, 80, 300), (2, 60, 150)])
def test_jaccard_against_brute_force(spark, monkeypatch, n, percent, most):
    monkeypatch.setattr(jaccard, "MAX_TOKENS", most)  # small parts, so that pairs of parts are walked as well
    rnd = random.Random(n)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, base = [], [[rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 5, 30, 80, 200]))] for _ in range(25)]
    for i in range(150):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary).upper()
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "  ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), n=n, percent=percent).collect()}
    assert got == brute_classes(rows, n, percent)


@pytest.mark.parametrize("percent", [jaccard.RUNS[0], 80, jaccard.RUNS[-1]])
def test_linked_sets_share_a_run(percent):
    rnd, made = np.random.default_rng(percent), 0
    for _ in range(3000):
        n = int(rnd.integers(1, 120))
        both = rnd.integers(0, 1 << 52, n, dtype=np.uint64)
        spare_ = int(n * (100 - percent) / percent)  # as many differences as a link allows, dealt at random
        x = int(rnd.integers(0, spare_ + 1))
        more = rnd.integers(0, 1 << 52, spare_, dtype=np.uint64)
        if rnd.random() < 0.3:  # all at the beginning, where runs are cut
            more >>= np.uint64(7)
        sets = [np.unique(np.r_[both, more[:x]]), np.unique(np.r_[both, more[x:]])]
        if not spare_ or 100 * len(both) < percent * (len(both) + spare_):
            continue
        sizes = np.array([len(a) for a in sets])
        key, owner = jaccard.runs(np.r_[0, np.cumsum(sizes)], np.concatenate(sets), sizes, np.ones(2, bool), percent)
        assert jaccard.with_kin(key, owner, percent).tolist() == [0, 1]
        made += 1
    assert made > 2000


def test_unrelated_sets_have_no_index(spark, monkeypatch):
    rnd, seen = random.Random(8), []
    rows = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(100))) for i in range(60)]
    rows += [(100 + i, t + " end") for i, t in rows[:5]] + [(200, rows[0][1])]
    whole = jaccard._clusters
    monkeypatch.setattr(jaccard, "_clusters", lambda docs, *a: seen.append(sorted(r.id for r in docs.select("id").collect())) or whole(docs, *a))
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert seen == [[*range(5), *range(100, 105)]]
    assert got == {i: 0 if i == 200 else i - 100 if i >= 100 else i for i, _ in rows}


def test_shuffles_end_with_what_they_were_for(spark):
    before, kept = spark.conf.get(common.CLEANUP), []
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    at = files()
    for _ in range(3):
        kept.append(spark.range(1000).select((F.col("id") % 7).alias("k")).groupBy("k").count())
        assert common.cut(kept[-1], "test").count() == 7
    for _ in range(40):
        if files() <= at + 8:  # of the counts
            break
        time.sleep(0.25)
    assert files() <= at + 8 and spark.conf.get(common.CLEANUP) == before


def test_jaccard_odd_rows(spark):
    got = jaccard.classes(odd(spark)).collect()
    assert len(got) == len(ODD) and jaccard.classes(none(spark)).count() == 0
    assert [r.component_id for r in got if r.doc_id == 5] == [5, 5]
    assert {r.doc_id: r.component_id for r in got}[None] is None


def test_components(spark):
    rnd = random.Random(0)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# ---------------------------------------------------------------- WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://www.B.org:80/x?q#top", "same"), (2, "https://b.org/y", "same"), (3, None, None), (4, "b.org", ""), (9, "http://a.b.org/\r\n", "é" * 70_000 + "\r\n\r\nWARC/1.1"), (9, "http://a.b.org/\r\n", "other"), (None, "http://n.org/", "nobody")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    folder = common.new_folder(spark, "test")
    files = warc.build_index(warc.write_archives(pages, folder), folder)
    keys = pages.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    got = warc.lookup(keys, folder, files).collect()
    assert len(got) == len(rows)
    assert Counter((r.page_id, r.payload_digest, r.payload_bytes) for r in got) == Counter((i, warc.digest((h or "").encode()), len((h or "").encode())) for i, _, h in rows)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[1].refers_to, by[1].payload) == ("revisit", 2, None) and by[2].record_type == "response" and bytes(by[2].payload) == b"same"
    assert by[3].refers_to == 4 and by[4].record_type == "response" and by[None].record_type == "response"
    assert warc.lookup(keys.limit(0), folder, files).count() == 0
    missing = spark.createDataFrame([("org,zzz)/ 00000000000000000001",)], "key string")
    assert warc.lookup(missing, folder, files).count() == 0
    assert pages.select(warc.url_key(F.col("url")).alias("k")).first().k == "org,b,www)/x?q"


def test_warc_blocks_and_damage(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.org/{i}", f"p{i}") for i in range(40)], "page_id long, url string, html string")
    folder = common.new_folder(spark, "test")
    files = warc.build_index(warc.write_archives(pages, folder), folder)
    got = warc.lookup(pages.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key")), folder, files).collect()
    assert sorted(r.page_id for r in got) == list(range(40))
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(warc.record(1, "u", b"abc", None, False).replace(b"abc", b"abd"))
    assert warc.write_archives(pages.limit(0), folder).count() == 0


# ---------------------------------------------------------------- classifiers


def test_quality_learns_and_odd_rows(spark):
    rnd = random.Random(1)
    good = lambda: " ".join("".join(rnd.choice("abcdef") for _ in range(5)) for _ in range(40))
    rows = [(good(), 1) if i % 2 else (" ".join(["spam!!"] * 3) + " " + good().upper(), 0) for i in range(200)]
    model = quality.train(rows)
    s = quality.score(model, pa.array([r[0] for r in rows]))
    assert ((s >= quality.THRESHOLD) == np.array([r[1] for r in rows], bool)).mean() > 0.95
    got = classify.score_rows(odd(spark), model, quality.score, "text", quality.THRESHOLD).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert got[0].score == got[1].score and classify.score_rows(none(spark), model, quality.score, "text", 0.7).count() == 0
    assert quality.score(quality.train([("a", 1)]), pa.array(["b"]))[0] == 0.5 and quality.score(quality.train([]), pa.array(["b"]))[0] == 0.5


def test_toxicity_learns_and_odd_rows(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(2))
    rows = [(" ".join([*(word() for _ in range(30)), *(["Vile,"] if i % 3 == 0 else []), *(word() for _ in range(10))]), "en" if i % 2 else "de", int(i % 3 == 0)) for i in range(400)]
    model = toxicity.train(rows)
    s = toxicity.score(model, pa.array([r[0] for r in rows]))
    assert ((s >= toxicity.THRESHOLD) == np.array([r[2] for r in rows], bool)).mean() > 0.95
    got = classify.score_rows(odd(spark), model, toxicity.score, "text", toxicity.THRESHOLD).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and got[0].predicted == got[1].predicted == 0
    assert toxicity.score(toxicity.train(rows[:1]), pa.array(["b", None])).tolist() == [0, 0]


def test_labelled_sample_leaves_held_out_rows(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    got = classify.labelled_sample(docs, labels, "toxic", "doc_id", 1000, ["text"])
    assert {t for t, _ in got} == {f"t{i}" for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(classify.labelled_sample(docs, labels, "toxic", "doc_id", 10, ["text"])) == 10


def brute_bits(pairs, text, lang):
    top = language_id.ORDER
    counts = defaultdict(Counter)
    for t, own in pairs:
        if own == lang and t:
            s = b" " * top + t.encode()
            for i in range(top, len(s)):
                for o in range(top + 1):
                    counts[s[i - o : i]][s[i]] += 1
    s, bits = b" " * top + text.encode(), 0.0
    for i in range(top, len(s)):
        for o in range(top, -1, -1):
            c = counts.get(s[i - o : i])
            if c:
                n, d = sum(c.values()), len(c)
                if s[i] in c:
                    bits -= log2(c[s[i]] / (n + d))
                    break
                bits -= log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_language_id_code_lengths_and_odd_rows(spark):
    pairs = [("the cat sat on the mat and the hat", "en"), ("le chat est là, où est-il été", "fr"), ("der Hund läuft über die Straße", "de"), ("Погода была тёплой, дети гуляли у реки", "ru"), ("Времето беше топло и децата играеха", "bg"), ("今日は天気がいいから散歩しましょう", "ja"), ("今天天气很好我们去散步吧", "zh"), ("", "en")] * 2
    model = language_id.train(pairs)
    tests = ["the dog", "où", "ß☃Q 9", "", "Straße und Hund " * 5, "дети и децата у реки", "天気は散歩", "今天去散步吧"]
    bits, sizes = language_id.code_lengths(model, pa.array(tests))
    for i, t in enumerate(tests):
        assert sizes[i] == len(t.encode())
        for k, lang in enumerate(model["langs"]):
            assert bits[i, k] == pytest.approx(brute_bits(pairs, t, lang), abs=1e-3)
    assert [model["langs"][k] for k in bits[5:].argmin(1)] == ["ru", "ja", "zh"]
    got = {r.doc_id: r for r in language_id.identify(odd(spark).withColumn("lang_pred", F.lit("clash")), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0 and got[4].lang_pred in model["langs"]
    assert language_id.identify(none(spark), model).count() == 0 and language_id.train([]) is None
    assert {r.lang_pred for r in language_id.identify(odd(spark), language_id.fit(none(spark))).collect()} == {"und"}


def test_hashed_slots_find_all_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 20_000)).astype(np.uint64)
    levels = language_id._slots(keys)
    assert (language_id._find(levels, keys) == np.arange(len(keys))).all()
    assert (language_id._find(levels, keys + np.uint64(1 << 41)) == -1).all()


# ---------------------------------------------------------------- classifiers, naively


def little_texts(n):
    rnd = random.Random(12)
    words = "the a cat dog sees likes house tree über green".split()
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        t = [rnd.choice(words) for _ in range(rnd.randint(1, 30))]
        if bad:
            at = rnd.randrange(len(t) + 1)
            t[at:at] = ["you", rnd.choice(["fool", "idiots!"])]
        rows.append((" ".join(t), "en" if i % 2 else "de", int(bad)))
    return rows


def test_toxicity_margins_against_a_naive_convolution():
    rows = little_texts(400)
    model = toxicity.train(rows, rounds=2)
    texts = [t for t, _, _ in rows[:40]] + ["", None, "you fool", "word " * 500]
    got, _ = toxicity.margins(model, pa.array(texts))
    for t, margin in zip(texts, got, strict=True):
        block = next(common.text_blocks(pa.array([t], pa.string())))
        word, prefix, _, windows = toxicity.tokens(block)
        own = [(int(model["index"][0][w]), int(model["index"][1][x])) for w, x in zip(word, prefix, strict=True)]
        assert windows[0] == len((t or "").split()) + 1
        pooled = []
        for table, bias in zip(model["tables"], model["bias"], strict=True):
            for f in range(toxicity.FILTERS):
                values = [sum(float(table[i, k, f]) for k in range(table.shape[1]) if at + k < len(own) for i in own[at + k]) for at in range(int(windows[0]))]
                pooled.append(max(0.0, max(values) + float(bias[f])))
        assert margin == pytest.approx(sum(p * w for p, w in zip(pooled, model["out"], strict=True)) + model["out_bias"], abs=1e-3)


def test_quality_scores_and_dual_solution_naively():
    rows = [(t, y) for t, _, y in little_texts(240)]
    model = quality.train(rows, rounds=40)
    texts = [t for t, _ in rows[:40]] + ["", None, "you fool " * 30]
    got = quality.score(model, pa.array(texts))
    margins = []
    for t in texts:
        _, bucket = quality.features(next(common.text_blocks(pa.array([t], pa.string()))))
        size = sum(float(model["r2"][b]) for b in bucket.tolist())
        margins.append(model["bias"] + sum(float(model["w"][b]) for b in bucket.tolist()) / (size**0.5 or 1.0))
    want = classify.squash(np.array(margins), model["cut"], model["scale"], quality.THRESHOLD)
    assert np.allclose(got, want, atol=1e-4) and ((0 <= got) & (got <= 1)).all()
    labels = np.array([y for _, y in rows])
    assert ((quality.score(model, pa.array([t for t, _ in rows])) >= quality.THRESHOLD) == (labels == 1)).mean() > 0.97


# ---------------------------------------------------------------- SentencePiece


def test_pieces_against_the_library(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("piece_bpe_32k.model")
    codec = pieces.Codec(path)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab e\n\t  ▁éß梦\x00ñThe☃ '.,ing") for _ in range(rnd.choice([0, 3, 10, 30, 200]))) for _ in range(500)] + ["the" * 100, "x" * 300, " " * 100, "\n" * 5, None, "▁", "a" * 5000 + "\n"]
    for t, (ids, n, shown) in zip(texts, codec.encode(pa.array(texts)), strict=True):
        own = codec.library.encode(t or "")
        assert (ids.decode(), n, shown) == (",".join(map(str, own)), len(own), codec.library.decode(own))
    codec.forget(np.zeros(0, np.int64))
    assert not len(codec.keys) or codec.again.sum() == 0
    got = pieces.encode_texts(odd(spark).withColumn("ids", F.lit("clash")), path).collect()
    assert len(got) == len(ODD) and all(r.ids == codec.library.encode(t[1] or "") for r, t in zip(got, ODD, strict=True))
    assert pieces.encode_texts(none(spark), path).count() == 0


def test_workers_let_go_between_tasks(monkeypatch):
    codec = pieces.Codec(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    texts = pa.array([" ".join(f"word{i}" for i in range(300)), "word7 word8 word7 " * 3])
    want = list(codec.encode(texts))
    assert list(codec.encode(texts)) == want and len(codec.keys) > 250
    monkeypatch.setattr(pieces, "REST_UNITS", 50)
    codec.rest()
    assert len(codec.keys) == 50 and len(codec.pool) == codec.length.sum() and list(codec.encode(texts)) == want
    one = common.held("one", list)
    assert common.held("one", list) is one and common.held("two", list) is not one and common.held("one", list) is not one


def test_pieces_with_a_small_memory(monkeypatch):
    codec = pieces.Codec(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    monkeypatch.setattr(pieces, "MAX_UNITS", 30)
    rnd = random.Random(8)
    names = [f"{rnd.choice('abcdefgh')}{i}x" for i in range(60)]
    texts = [" ".join(names[i : i + 40]) for i in (0, 20, 5, 0, 20)] + [" ".join(rnd.choice(names) for _ in range(300)), " ".join(f"w{i}" for i in range(500))]
    for t in texts:
        ((ids, n, shown),) = codec.encode(pa.array([t]))
        own = codec.library.encode(t)
        assert (ids.decode(), n, shown) == (",".join(map(str, own)), len(own), t)
    assert len(codec.keys) <= 30 + 500


def test_pieces_decode_the_ids():
    codec = pieces.Codec(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    texts = pa.array(["alphabet", "über"])
    list(codec.encode(texts))
    for name in ("at", "length", "count", "shown_at", "shown_length"):  # as if the units' hashes were each other's
        if hasattr(codec, name):
            setattr(codec, name, getattr(codec, name)[::-1])
    got = list(codec.encode(texts))
    assert [shown for _, _, shown in got] == [codec.library.decode([int(i) for i in ids.split(b",")]) for ids, _, _ in got] == ["über", "alphabet"]


# ---------------------------------------------------------------- Ogg


def slow_crc(data):
    r = 0
    for x in data:
        r ^= x << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if r & 0x80000000 else (r << 1) & 0xFFFFFFFF
    return r


def test_ogg_pages_packets_and_damage():
    assert ogg.checksum(b"hello pages" * 9) == slow_crc(b"hello pages" * 9)
    packets = [b"a" * n for n in (0, 254, 255, 256, 70_000, 3, 255 * 255)]
    media = b"".join([ogg.page(ogg.FIRST, 0, 9, 0, b"\x01", b"h"), *ogg.pages_of(9, 1, packets, list(range(1, 8)), True)])
    found = ogg.read(media)[9]
    assert found["packets"][1:] == packets and found["granules"][-1] == (8, 7)
    for at in (0, 5, 22, 60, len(media) - 1):
        with pytest.raises(ValueError):
            ogg.read(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(ValueError):
        ogg.read(media[:-10])


def test_ogg_round_trip(spark):
    for n in (0, 1, 575, 576, 577, 576 * 85, 576 * 85 + 1, 576 * 200):
        payload, size = ogg.padded("x" * n)
        back, again, times = ogg.payload_of(ogg.write(payload, size))
        assert (back, again) == (payload, n) and times[-1] == len(payload) / ogg.RATE and len(payload) % 576 == 0
    got = ogg.store(odd(spark).withColumn("media", F.lit("clash"))).collect()
    assert len(got) == len(ODD) and got[0].payload_bytes == 576 and got[0].media == got[1].media and got[4].media == got[5].media
    assert ogg.store(none(spark)).count() == 0


# ---------------------------------------------------------------- top-k


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_ROWS", 40)
    monkeypatch.setattr(topk, "TILE_QUERIES", 2)
    rnd = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rnd.integers(-2, 3, 6) / 7]) for i in range(0, 330, 3)]
    rows += [(600, None), (601, [1.0, None]), (602, [float("nan")] * 6), (603, [float("inf")] * 6), (700, [0.5, 0.5]), (None, [1.0] * 6), (800, []), (801, [])]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")), "vec_id", "embedding")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df.where("id % 100 = 0"), df, 10).collect()}
    whole = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v)}
    want = {}
    for q in [i for i in whole if i % 100 == 0]:
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:10]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want
    assert topk.search(df.limit(0), df.limit(0), 10).count() == 0


def test_topk_large_components_are_exact():
    q, c = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**20, 2.0]])
    assert topk._scores(q, c).tolist() == [[2**60 + 3, 2**60 + 6]]
