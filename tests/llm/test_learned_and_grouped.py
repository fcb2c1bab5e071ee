"""Prefix trie, language-model scores and centroid clustering against brute force, and their defined results for odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import floor, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from hunkloom.llm import centroids, lm_scoring, prefix_trie

# ---------------------------------------------------------------- prefix trie


def brute_trie(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    children = Counter(p[:-1] for p in nodes if p)
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in members if len(made[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, rank string, _at string"


def tried(spark, rows):
    found = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS))))
    got = found.collect()
    places = sorted(r.preorder for r in got)
    assert places == list(range(1, len(got) + 1))
    for r in got:  # intervals are nested or apart, and hold what is counted
        inside = [x for x in got if r.preorder <= x.preorder <= r.subtree_end]
        assert sum(x.n_children == 0 for x in inside) == r.n_leaves
    return sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str)


def test_trie_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "bot"]), rnd.choice(["a", "b", "é☃", ""])) for c in range(60) for t in range(rnd.randint(1, 12))]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(3)]  # copies
    rows += [(200, t, "user", "long" if t < 70 else str(t)) for t in range(90)] + [(201, t, "user", "long") for t in range(80)]  # several blocks of ranks
    assert tried(spark, rows) == brute_trie(rows)


def test_trie_of_long_conversations_crosses_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    monkeypatch.setattr(prefix_trie, "FAN_BITS", 1)
    rnd = random.Random(6)
    rows = [(c, t, "u", rnd.choice("ab")) for c in range(25) for t in range(rnd.randint(1, 20))]
    assert tried(spark, rows) == brute_trie(rows)


def test_trie_odd_rows(spark):
    rows = [(None, 1, "u", "no id"), (1, None, None, None), (1, 2, "u", "x" * 100_000), (1, 2, "u", "x" * 100_000), (7, 1, "u", "t"), (-3, 1, "u", "t"), (12, 3, "", "")]
    assert tried(spark, rows) == brute_trie(rows)
    assert tried(spark, []) == []


# ---------------------------------------------------------------- language-model scores


def brute_scores(docs, order):
    low = [(i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))) for i, t in docs]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in low]
    split = lambda t: [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w] + [None]
    words, follow = Counter(), defaultdict(Counter)

    def steps(t):
        data = [10] * order + list(t.encode()) + [256]
        return [(tuple(data[i - order : i]), data[i]) for i in range(order, len(data))]

    for (_, t), h in zip(low, held, strict=True):
        if not h:
            words.update(split(t))
            for context, symbol in steps(t):
                for k in range(order + 1):
                    follow[context[k:]][symbol] += 1
    n, v = sum(words.values()), len(words)

    def chance(context, symbol):
        p, gone = 1.0, set()
        while True:
            left = {s: c for s, c in follow.get(context, {}).items() if s not in gone}
            whole = sum(left.values())
            take = 0.0 if len(follow.get(context, {})) == 257 else lm_scoring.DISCOUNT
            if whole:
                if symbol in left:
                    return p * (left[symbol] - take) / whole
                p *= take * len(left) / whole
                gone |= set(left)
            if not context:
                return p / (257 - len(gone))
            context = context[1:]

    out = []
    for (i, t), h in zip(low, held, strict=True):
        tokens = split(t)
        base = sum(log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out.append((i, h, len(tokens), sum(w in words for w in tokens), n, base, sum(log10(chance(*s)) for s in steps(t))))
    return out, chance


def scored(spark, docs, **options):
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    return lm_scoring.score(rows, **options).collect()


@pytest.mark.parametrize("order", [0, 2, 5])
def test_scores_equal_brute_force(spark, order):
    rnd = random.Random(order)
    docs = [(i, " ".join(rnd.choice(["The", "cat", "sat", "on", "maté", "x\n", "\t zz"]) for _ in range(rnd.randint(0, 30)))) for i in range(80)] + [(200, None), (201, ""), (None, "no id"), (203, "é☃ \x00 never SEEN")]
    want, chance = brute_scores(docs, order)
    got = {r.doc_id: r for r in scored(spark, docs, order=order, block_bytes=500, buckets=4)}
    assert len(got) == len(docs)
    for i, held, n, known, total, base, score in want:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9) and r.score == pytest.approx(score, rel=1e-5)
    for context in [(), (97,), (200, 201), tuple(b"cat")]:  # a distribution over all symbols
        assert sum(chance(context[-order:] if order else (), s) for s in range(257)) == pytest.approx(1.0)


def test_scores_odd_rows(spark):
    long = "Lorem ipsum dolor " * 20_000
    docs = [(1, long), (1, long), (5, "a b")]
    got = scored(spark, docs)
    assert len(got) == 3 and len({r.score for r in got if r.doc_id == 1}) == 1 and all(r.score < 0 for r in got)
    assert scored(spark, []) == []
    held = [(i, "only held out") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    for r in scored(spark, held):  # nothing to learn from
        assert r.train_tokens == 0 and r.base_score == 0 and r.score == pytest.approx(-14 * log10(257), rel=1e-5)


# ---------------------------------------------------------------- centroid clustering


def brute_lloyd(rows, k, rounds, dim, scale=256, seed=2):
    kept = [(i, [floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        middle = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if groups[n] else c for n, c in enumerate(middle)]
    found = [(i, *near(v)) for i, v in kept]
    each, top = Counter(), 2**63 - 1
    for _, d, n in found:
        each[n] += min(d, top)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, n, min(d, top), min(each[n], top), min(sum(each.values()), top), sha[n]) for i, d, n in found), key=str)


def clustered(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    return sorted((tuple(r) for r in centroids.cluster(frame, **options).collect()), key=str)


def test_clusters_equal_brute_force(spark):
    rnd = random.Random(7)
    rows = [(i, [rnd.gauss(i % 3, 0.4) for _ in range(4)]) for i in range(300)] + [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(100)]
    assert clustered(spark, rows, k=9, rounds=4, dim=4) == brute_lloyd(rows, 9, 4, 4)


def test_clusters_odd_rows(spark):
    odd = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [0.0, 0.0]), (9, [-1e9, 3.3]), (10, [1e12, -1e12])]
    got = clustered(spark, odd, k=3, rounds=5, dim=2)
    assert got == brute_lloyd(odd, 3, 5, 2) and len(got) == 5
    assert len(clustered(spark, odd, k=40, rounds=2, dim=2)) == 5  # fewer vectors than centroids
    assert clustered(spark, [(1, None)], k=3, rounds=2, dim=2) == []


def test_only_changed_centroids_are_compared():
    v = np.array([[0, 0], [10, 0], [20, 0], [30, 0]])
    middle = np.array([[1, 0], [11, 0], [29, 0]])
    calls = []
    real = centroids.distances
    try:
        centroids.distances = lambda a, c: calls.append((len(a), len(c))) or real(a, c)
        cluster, least = centroids.nearest(v, middle, np.array([0, 1, 1, 2]), np.array([False, False, True]))
    finally:
        centroids.distances = real
    assert cluster.tolist() == [0, 1, 1, 2] or cluster.tolist() == [0, 1, 2, 2]
    assert (1, 3) in calls and (3, 1) in calls and not any(n > 1 and c > 1 for n, c in calls)  # the one whose owner moved: all; the others: the one that changed
    assert [int(x) for x in least] == [int(min(((p - c) ** 2).sum() for c in middle)) for p in v]


def test_transfers_are_signed(spark):
    state = spark.createDataFrame([([1, 2], 0, 1), ([5, 5], 1, 1), ([7, 1], -1, 0)], "v array<long>, was int, cluster int").withColumn("vec_id", F.lit(0))
    got = {(r.cluster, r.at): int(r.change) for r in centroids.transfers(state, 2).collect()}
    assert got == {(0, -1): 0, (0, 0): 6, (0, 1): -1, (1, -1): 1, (1, 0): 1, (1, 1): 2}
