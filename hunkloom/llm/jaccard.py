"""N-gram Jaccard join with set-relation skipping.

A document is the set of its word shingles (52-bit hashes). Two sets are linked when
100 * intersection >= percent * union; classes are the connected components of the links.

0. Runs, where an index entry for almost each element would be needed (RUNS). Linked sets x and y that differ in D elements,
   a of them in x, share D + 2 or more; the first D + 2 of these in the order of the hashes have D others between them at most, so two are next to
   each other in both sets, within the first 2a + (D - a) + 2 elements of x, which is within the first 2 (1 - percent) of them and two more.
   Sets without such a run in common with another one of a size that can be linked are linked with nothing and skip the rest.
1. Index level. A set's elements, in the global order of their hashes, are cut into blocks by
   position. Sets of linkable sizes differ in at most d elements, so with d + 1 + t blocks, going round the ring
   of blocks, t + 1 of them at least are equal and followed by three blocks that differ in three
   elements at most (cycle lemma). Index lists are keyed by (size level, block number, block content) and carry
   a 64-bit parity map of the next three blocks: all other list entries are skipped unread. Empty
   blocks, which unrelated sets share by chance, have no list if the set has t of them at most: not all of
   the t + 1 can be empty then, and a linked set, which has the same ones empty, does not miss them either. Blocks of one
   element are keyed by a quarter of the map as well (four entries; of maps that differ in three bits one quarter is equal). A list
   is reduced to a spanning forest of its entries that pass, never to pairs.
2. Answer level. Within a cluster (a component of what passed), the intersection sizes of one
   set with all others are counted once; those of a similar set are derived from them by the
   lists of the few elements in which the two differ. A walk over links visits each set once and
   stops when no set is left, so a group of n near copies costs about n steps. Clusters over
   MAX_TOKENS elements are dealt into parts, walked part by part and then by pairs of parts.

Equal sets are one set from the start (by a hash of all elements), so copies add nothing.

Defined results: null or wordless texts have the empty set and are linked with nothing; fewer
words than `n` make one shingle; rows with a null id take part, a class without any id has a null
component_id; rows repeating an id keep a row each; extra columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import inf, lgamma, log, log1p, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TextBlock, bound_batches, components, cut, held, mix64, text_blocks

TOKEN_BITS, BLOCK_DOCS, BLOCK_BYTES = 52, 4096, 1 << 20
#: Ratio of a size level's ends.
LEVEL_RATIO = 1.75
#: Elements of sets that a task holds at once.
MAX_TOKENS = 1_500_000
#: Percentages for which runs are looked for first: below, linked sets may have none; above, the index has no more entries than runs.
RUNS = range(75, 86)
#: Bits of a run's key that are its set's size, as 64ths of a power of two.
SIZE_BITS = 12
_M1, _M2, _M3 = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def shingles(block: TextBlock, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (text index, token), sorted by both."""
    s, e, doc = block.words()
    h = block.hashes(s, e)
    count = np.bincount(doc, minlength=len(block))
    first = np.cumsum(count) - count
    gram = h.copy()
    for k in range(1, n):  # the hash of a word and up to n - 1 words after it, as far as the text goes
        more = np.flatnonzero(doc[k:] == doc[:-k]) if k < len(doc) else np.zeros(0, np.int64)
        gram[more] = mix64(gram[more] * _M1 + h[more + k])
    full = np.arange(len(doc)) - first[doc] <= np.maximum(count[doc] - n, 0)
    keys = np.sort((doc[full].astype(np.uint64) << np.uint64(TOKEN_BITS)) | (gram[full] >> np.uint64(64 - TOKEN_BITS)))
    keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    return (keys >> np.uint64(TOKEN_BITS)).astype(np.int64), keys & np.uint64((1 << TOKEN_BITS) - 1)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def sets_of(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: first row, bounds of each text's tokens, tokens, set sizes, set hashes."""
    for whole in text_blocks(column, BLOCK_BYTES):
        for at in range(0, len(whole), BLOCK_DOCS):
            a, b = at, min(at + BLOCK_DOCS, len(whole))
            lo, hi = whole.starts[a], whole.ends[b - 1]
            block = TextBlock(whole.data[lo:hi], whole.starts[a:b] - lo, whole.ends[a:b] - lo, whole.first + a)
            doc, token = shingles(block, n)
            bounds = np.searchsorted(doc, np.arange(len(block) + 1))
            yield block.first, bounds, token, np.diff(bounds), mix64(_sums(mix64(token + _M2), bounds) + np.diff(bounds).astype(np.uint64))


def _levels(sizes: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(members, level id, blocks) of the level each size is in and of the levels across the ends of levels."""
    ends, end = [1], 1
    while end <= sizes.max(initial=1) * 2:
        end = int(end * LEVEL_RATIO) + 1
        ends.append(end)
    ends = np.array(ends)
    most = lambda s: s * (100 - percent) // (100 + percent) + 1  # noqa: E731  blocks for pairs of that total size
    level = np.searchsorted(ends, sizes, side="right") - 1
    inside = np.flatnonzero(sizes > 0)
    out = [(inside, 2 * level[inside], most(2 * (ends[level[inside] + 1] - 1)))]
    for up in (0, 1):  # sets just below, and just above, a level's end
        end = ends[level + 1 - up]
        near = (sizes > 0) & ((sizes * 100 >= percent * end) if not up else ((level > 0) & (sizes * percent <= 100 * (end - 1))))
        near = np.flatnonzero(near)
        out.append((near, 2 * (level[near] - up) + 1, most((end[near] - 1) + (end[near] - 1) * 100 // percent)))
    return out


@lru_cache(maxsize=None)
def spare(blocks: int, percent: int) -> int:
    """Blocks to add to those of a level, so that hardly any of its sets has more empty ones (fewer than one of 500 of its smallest sets)."""
    least = max(1.0, (blocks - 1) * (100 + percent) / (100 - percent) / 2 / LEVEL_RATIO)
    for t in range(2 * blocks + 64):
        m = blocks + t
        bound = lgamma(m + 1) - lgamma(t + 2) - lgamma(m - t) + least * (log1p(-(t + 1) / m) if t + 1 < m else -inf)
        if bound < log(0.002):
            return t
    return 0


def entries(bounds: np.ndarray, token: np.ndarray, sizes: np.ndarray, keep: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index entries (key, set index, parity map of the next three blocks) of the sets in `keep`."""
    content, bit = mix64(token + _M3), np.uint64(1) << (mix64(token * _M1) >> np.uint64(58))
    for members, level, blocks in _levels(np.where(keep, sizes, 0), percent):
        if not len(members):
            continue
        n = sizes[members]
        of, at = np.unique(blocks, return_inverse=True)
        extra = np.array([spare(int(x), percent) for x in of])[at]
        blocks = blocks + extra
        pick = np.repeat(bounds[members] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        base = np.cumsum(blocks) - blocks
        flat = np.repeat(base, n) + ((token[pick] * np.repeat(blocks, n).astype(np.uint64)) >> np.uint64(TOKEN_BITS)).astype(np.int64)
        edge = np.searchsorted(flat, np.arange(blocks.sum() + 1))
        owner = np.repeat(np.arange(len(members)), blocks)
        number = np.arange(len(owner)) - base[owner]
        key = mix64(_sums(content[pick], edge) + mix64(level[owner].astype(np.uint64) * _M1 + number.astype(np.uint64) * _M2 + np.uint64(1)))
        parity = np.zeros(len(pick) + 1, np.uint64)
        np.bitwise_xor.accumulate(bit[pick], out=parity[1:])
        parity = parity[edge[1:]] ^ parity[edge[:-1]]
        ahead = np.zeros(len(owner), np.uint64)
        for k in (1, 2, 3):
            more = np.flatnonzero(blocks[owner] > k)
            ahead[more] ^= parity[base[owner[more]] + (number[more] + k) % blocks[owner[more]]]
        held = np.diff(edge)
        empty = np.add.reduceat((held == 0).astype(np.int64), base)
        thin = held < 2
        yield key[~thin], members[owner[~thin]], ahead[~thin]
        thin &= (held > 0) | (empty > extra)[owner]
        for k in range(4):  # a block of one element says little: its list is split by the maps, of which one quarter is equal
            quarter = (ahead[thin] >> np.uint64(16 * k)) & np.uint64(0xFFFF)
            yield mix64(key[thin] + (quarter * np.uint64(4) + np.uint64(k + 1)) * _M3), members[owner[thin]], ahead[thin]


def runs(bounds: np.ndarray, token: np.ndarray, sizes: np.ndarray, keep: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, set index) of the pairs of neighbours among the first elements of the sets in `keep`."""
    n = np.where(keep, np.minimum(sizes, 2 * sizes * (100 - percent) // 100 + 2), 0)
    n = np.maximum(n - 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    at = bounds[owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    size = np.minimum(64 * np.log2(np.maximum(sizes, 1)), (1 << SIZE_BITS) - 1).astype(np.int64)
    key = mix64(token[at] * _M1 + token[at + 1]).view(np.int64)
    return key >> SIZE_BITS << SIZE_BITS | size[owner], owner


def with_kin(key: np.ndarray, ids: np.ndarray, percent: int) -> np.ndarray:
    """Of the runs in arrays, the ids of sets that share one with another set of a size that can be linked."""
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]
    key, ids = key[fresh], ids[fresh]
    near = (key[1:] >> SIZE_BITS == key[:-1] >> SIZE_BITS) & (key[1:] - key[:-1] <= int(64 * log2(100 / percent)) + 1)
    return np.unique(ids[np.r_[near, False] | np.r_[False, near]])


def _whole_lists(it, columns: tuple[str, ...], shift: int = 0) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first one, in pieces that hold whole lists; `shift`: its bits that don't tell lists apart."""
    held: list[list[np.ndarray]] = []  # parts of the list that may go on
    for batch in it:
        now = [batch.column(c).to_numpy() for c in columns]
        if not len(now[0]):
            continue
        if held and now[0][-1] >> shift == held[0][0][0] >> shift:
            held.append(now)
            continue
        now = [np.concatenate(x) for x in zip(*held, now, strict=True)]
        cutoff = np.searchsorted(now[0] >> shift, now[0][-1] >> shift)
        held = [[x[cutoff:] for x in now]]
        if cutoff:
            yield [x[:cutoff] for x in now]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def forest(maps: np.ndarray) -> list[np.ndarray]:
    """Components of entries whose parity maps differ in at most three bits, as index arrays.

    Of two such maps one quarter is equal, so entries are compared under equal quarters only.
    """
    root = np.arange(len(maps))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return int(x)

    for k in range(4):
        quarter = (maps >> np.uint64(16 * k)) & np.uint64(0xFFFF)
        order = np.argsort(quarter, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(quarter[order]) != 0])
        for a, b in zip(starts.tolist(), np.r_[starts[1:], len(maps)].tolist(), strict=True):
            left = order[a:b]
            while len(left) > 1:  # what is near the first one, then near that, until nothing is added
                wave, left = left[:1], left[1:]
                while len(wave) and len(left):
                    near = np.zeros(len(left), bool)
                    for x in wave[:64]:
                        hit = np.bitwise_count(maps[left] ^ maps[x]) <= 3
                        for y in left[hit & ~near].tolist():
                            root[find(y)] = find(int(x))
                        near |= hit
                    wave, left = np.r_[wave[64:], left[near]], left[~near]
    roots = np.array([find(x) for x in range(len(maps))])
    order = np.argsort(roots, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(roots[order])) + 1)


def list_edges(keys: np.ndarray, ids: np.ndarray, maps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the index lists in arrays sorted by key."""
    order = np.lexsort((ids, keys))
    keys, ids, maps = keys[order], ids[order], maps[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]
    keys, ids, maps = keys[fresh], ids[fresh], maps[fresh]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, len(keys)])
    two = start[size == 2]
    two = two[np.bitwise_count(maps[two] ^ maps[two + 1]) <= 3]
    a, b = [ids[two]], [ids[two + 1]]
    for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        for part in forest(maps[s : s + n]):
            if len(part) > 1:
                a.append(np.full(len(part) - 1, ids[s + part.min()]))
                b.append(ids[s + part[part != part.min()]])
    edges = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
    return edges[:, 0], edges[:, 1]


def walk(tokens: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets that connect all sets connected by links or by equal labels.

    The counts of a walk's first set are computed once; those of a later set follow from them.
    """
    sizes = np.array([len(t) for t in tokens])
    flat = np.concatenate(tokens)
    names, element = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(tokens)), sizes)
    lists = owner[np.argsort(element, kind="stable")]
    ends = np.cumsum(np.bincount(element, minlength=len(names)))
    own = np.split(element, np.cumsum(sizes)[:-1])
    weight = np.add.reduceat(np.diff(np.r_[0, ends])[element], np.cumsum(sizes) - sizes) / sizes  # how common a set's elements are here
    _, label = np.unique(labels, return_inverse=True)
    family = np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label))[:-1])

    def counted(elements: np.ndarray) -> np.ndarray:
        """In how many of the elements each set is."""
        if not len(elements):
            return np.zeros(len(tokens), np.int64)
        n = ends[elements] - np.where(elements > 0, ends[elements - 1], 0)
        spots = np.repeat(ends[elements] - np.cumsum(n), n) + np.arange(n.sum())
        return np.bincount(lists[spots], minlength=len(tokens))

    links, open_ = [], np.ones(len(tokens), bool)
    for seed in np.argsort(-weight, kind="stable").tolist():
        if not open_[seed]:
            continue
        common = counted(own[seed])
        wave = family[label[seed]].tolist()
        open_[wave] = False
        while wave and open_.any():
            x = wave.pop()
            shared = common if x == seed else common + counted(np.setdiff1d(own[x], own[seed], assume_unique=True)) - counted(np.setdiff1d(own[seed], own[x], assume_unique=True))
            for y in np.flatnonzero(open_ & (shared * 100 >= percent * (sizes + sizes[x] - shared))).tolist():
                if open_[y]:
                    links.append((x, y))
                    kin = family[label[y]]
                    open_[kin] = False
                    wave += kin.tolist()
        if not open_.any():
            break
    return links


def _walk_groups(percent: int, n: int, by: list[str]):
    """Walk each group of rows (group columns, set, label, text), sorted by group; links as (a, b)."""

    def solve(rows: list[tuple]) -> tuple[list[int], list[int]]:
        kept = {}
        for _, fp, label, tokens in rows:
            kept.setdefault(fp, (label, tokens))
        fps = list(kept)
        links = walk([kept[f][1] for f in fps], np.array([kept[f][0] for f in fps]), percent) if len(fps) > 1 else []
        return [fps[x] for x, _ in links], [fps[y] for _, y in links]

    def run(it):
        held: list[tuple] = []
        for batch in it:
            group = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            fps, label = batch.column("fp").to_pylist(), batch.column("label").to_pylist()
            out: tuple[list, list] = ([], [])
            for first, bounds, token, _, found in sets_of(batch.column("text"), n):
                for k, fp in enumerate(found.view(np.int64).tolist()):
                    i = first + k
                    if held and held[-1][0] != group[i]:
                        for o, x in zip(out, solve(held), strict=True):
                            o += x
                        held = []
                    if fp == fps[i]:  # else another text with the id of the one that is meant
                        held.append((group[i], fp, label[i], token[bounds[k] : bounds[k + 1]].copy()))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in solve(held)], names=["a", "b"])

    return run


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """For each row: the key, n_shingles, set_id (equal for equal sets) and component_id."""
    bound_batches(docs.sparkSession)
    return _classes(docs, key, text, n, percent)


def _with_kin(docs: DataFrame, first: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of docs (id, text) that sets `first` (fp, id) with a run in common with another one are of."""

    def cut_runs(it):
        seen: set[int] = set()
        for batch in it:
            for _, bounds, token, sizes, found in sets_of(batch.column("text"), n):
                keep = np.zeros(len(sizes), bool)
                for k, fp in enumerate(found.tolist()):
                    keep[k] = fp not in seen
                    seen.add(fp)
                key, owner = runs(bounds, token, sizes, keep, percent)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(found[owner].view(np.int64))], names=["run", "fp"])

    def kin(it):
        for key, ids in _whole_lists(it, ("run", "fp"), SIZE_BITS):
            yield pa.RecordBatch.from_arrays([pa.array(with_kin(key, ids, percent))], names=["fp"])

    found = docs.select("text").mapInArrow(cut_runs, "run long, fp long").repartition(F.shiftright("run", SIZE_BITS)).sortWithinPartitions("run")
    found = cut(found.mapInArrow(kin, "fp long").distinct(), "kin")
    ids = cut(first.join(found, "fp").select(F.col("id").alias("own")).distinct(), "kin-ids")
    return cut(docs.join(ids, docs["id"].eqNullSafe(ids["own"]), "left_semi"), "kin-texts")


def _clusters(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Components of what passes the index: node (a set), root. The index's shuffle ends with this function."""

    def index(it):
        seen: set[int] = set()
        for batch in it:
            for _, bounds, token, sizes, found in sets_of(batch.column("text"), n):
                keep = np.zeros(len(sizes), bool)
                for k, fp in enumerate(found.tolist()):
                    keep[k] = fp not in seen
                    seen.add(fp)
                for lists, owner, maps in entries(bounds, token, sizes, keep, percent):
                    yield pa.RecordBatch.from_arrays([pa.array(lists.view(np.int64)), pa.array(found[owner].view(np.int64)), pa.array(maps.view(np.int64))], names=["list", "fp", "map"])

    def reduce(it):
        for keys, ids, maps in _whole_lists(it, ("list", "fp", "map")):
            a, b = list_edges(keys, ids, maps.view(np.uint64))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    lists = docs.select("text").mapInArrow(index, "list long, fp long, map long")
    pairs = lists.repartition("list").sortWithinPartitions("list").mapInArrow(reduce, "a long, b long")
    return cut(components(pairs, "a", "b"), "clusters")


def _classes(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def measure(it):
        held("sets", dict)  # nothing, in place of what an operator before has left
        for batch in it:
            sizes, hashes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for first, _, _, size, found in sets_of(batch.column("text"), n):
                sizes[first : first + len(size)], hashes[first : first + len(size)] = size, found
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(hashes.view(np.int64))], names=["id", "size", "fp"])

    id_type = docs.schema["id"].dataType.simpleString()
    measured = cut(docs.mapInArrow(measure, f"id {id_type}, size long, fp long"), "sets")
    first = measured.where("size > 0").groupBy("fp").agg(F.min("id").alias("id"), F.first("size").alias("size"))
    if percent in RUNS:
        docs = _with_kin(docs, first, n, percent)
    cluster = _clusters(docs, n, percent)

    members = first.join(cluster.withColumnRenamed("node", "fp"), "fp")
    parts = members.groupBy("root").agg(F.ceil(F.sum("size") / MAX_TOKENS).cast("int").alias("parts"))
    members = members.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    texts = docs.select(F.col("id").alias("own"), "text")
    members = cut(members.join(texts, members["id"].eqNullSafe(F.col("own"))).select("root", "part", "parts", "fp", "text"), "members")
    near = members.withColumn("label", F.col("fp")).select("root", "part", "fp", "label", "text").repartition("root", "part").sortWithinPartitions("root", "part")
    links = cut(near.mapInArrow(_walk_groups(percent, n, ["root", "part"]), "a long, b long"), "links")

    large = members.where("parts > 1")
    if not large.isEmpty():
        done = components(links, "a", "b").withColumnRenamed("node", "fp").withColumnRenamed("root", "label")
        large = large.join(done, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        several = large.groupBy("root").agg(F.countDistinct("label").alias("k")).where("k > 1").select("root")
        tiles = large.join(several, "root").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> part")
        tiles = tiles.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp", "label", "text").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
        links = links.unionByName(tiles.mapInArrow(_walk_groups(percent, n, ["root", "i", "j"]), "a long, b long"))

    joined = components(links, "a", "b").withColumnRenamed("node", "fp")
    ids = first.select("fp", "id").join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    ids = ids.join(least, "root").select("fp", "component_id")
    full, empty = measured.where("size > 0"), measured.where("size = 0")
    out = full.join(ids, "fp").select(F.col("id").alias(key), F.col("size").alias("n_shingles"), F.col("fp").alias("set_id"), "component_id")
    return out.unionByName(empty.select(F.col("id").alias(key), F.col("size").alias("n_shingles"), F.col("fp").alias("set_id"), F.col("id").alias("component_id")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs, n=3, percent=90).select("doc_id", "n_shingles", "component_id")
