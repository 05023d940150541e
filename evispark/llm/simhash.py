"""SimHash near-duplicates: fingerprints of word shingles, linked by BK-trees.

A BK-tree keeps under each node the fingerprints of its subtree by their integer Hamming distance to
the node; a search for radius r at distance d from a node follows only the edges d-r..d+r.

One tree over all fingerprints would be no use: random 64-bit fingerprints are nearly all 32 bits
apart, so a search follows most edges, and a broadcast tree would grow with the corpus. The trees are
therefore sharded by pigeonhole: the bits are cut into b blocks, and two fingerprints at most r
apart agree on some b - r of them. Each fingerprint goes to the shards named by its values of every
choice of b - r blocks; b rises with the count of fingerprints so that shards stay small. The shard
trees reach the tasks by a shuffle, not by a broadcast from the driver, since nothing bounds them.
Shards of over ``SHARD`` fingerprints are cut further and their parts meet pairwise in tasks.

Near copies by similarity need more than 64 bits: texts of shingle similarity 0.8 differ in 10 of 64
bits on average, give or take 3, so a radius that holds them holds others too. ``words`` asks for
fingerprints of that many 64-bit words, whose distance says more. Their radius is too wide for shards
by pigeonhole, so they are dealt into parts of ``PART`` and every two parts meet in one task. There
two fingerprints at most r apart agree on some 16-bit block but for floor(r / blocks) bits or fewer
(``allowances``), so each looks up, block by block, all values that near its own: no pair within the
radius is left out. The work grows with the square of the fingerprints, at some hundredth of comparing
all of them; a task holds two parts. Fingerprints that share one of ``keys_for`` many keys of some of
their bytes are linked first, so that a large group of near copies is one component by then and its
pairs are passed over.

Equal fingerprints are one node (partial aggregation first), and a shard returns a spanning forest of
its links, at most one edge a node: groups of any size stay linear.

Defined results: texts without words (null, empty, blank) have fingerprint zero and link like any
other; fewer than the shingle's words are one shingle; rows that repeat link at distance 0; null
doc_ids never name a component unless all its ids are null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunk_pairs, components, prepare, release, rows_that_stay, written

SHINGLE = 4
SEED = 42
RADIUS = 4
SHARD = 2048
#: Wide fingerprints: most of a part, most pairs compared at once, parts so small that all pairs are compared.
PART, PAIRS, FEW = 1 << 16, 1 << 20, 2048
#: Wide fingerprints: the similarity that keys are made for, and the chance that they find such a pair.
ALIKE = 0.8
FOUND = 0.9

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256)[None, :]


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Another hash of each shingle, made of its XXH64 value (SplitMix64's steps)."""
    z = h + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, shingle: int = SHINGLE, n_words: int = 1) -> int:
    """Bit k is set if it is in over half of the shingles' XXH64 values; bits from 64 on are those of
    further hashes, 64 bits a word."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        joined: Iterator[bytes] = iter([b" ".join(words)])
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in joined], "<u8")
    found = b""
    for word in range(n_words):
        bits = _mixed(h, word) if word else h
        lanes = np.bincount((bits.view("u1").reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
        found += np.packbits(2 * (lanes @ _BITS).ravel() > len(h), bitorder="little").tobytes()
    return int.from_bytes(found, "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, words: int = 1, *more: Column) -> DataFrame:
    """doc_id, fp and ``more`` of every row. fp is the 64 bits as a signed long, or a struct of
    ``words`` such longs if there are several."""
    prepare(docs.sparkSession)

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for batch in batches:
            yield pa.array([fingerprint(t, shingle, words).to_bytes(8 * words, "big") for t in batch.to_pylist()], pa.binary())
        release()

    @F.arrow_udf("long")
    def of_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for batch in batches:
            got = np.fromiter((fingerprint(t, shingle) for t in batch.to_pylist()), np.uint64, len(batch))
            yield pa.array(got.view(np.int64), pa.int64())
        release()

    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")
    if words == 1:
        return docs.select(doc_id, of_one(text).alias("fp"), *more)
    whole = docs.select(doc_id, of(text).alias("fp"), *more)
    return whole.withColumn("fp", F.struct(*(_long("fp", 8 * (words - 1 - w)).alias(f"w{w}") for w in range(words))))


def _long(name: str, at: int) -> Column:
    """Bytes ``at`` to ``at + 8`` of a binary column as a signed long."""
    halves = [F.conv(F.hex(F.substring(name, at + 1 + 4 * k, 4)), 16, 10).cast("long") for k in (0, 1)]
    return F.shiftleft(halves[0], 32).bitwiseOR(halves[1])


def _words(points: DataFrame) -> list[Column]:
    """The longs of ``fp``, lowest bits first."""
    kind = points.schema["fp"].dataType
    return [F.col(f"fp.{f}") for f in kind.names] if isinstance(kind, StructType) else [F.col("fp")]


def _far(fps: np.ndarray, fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ fp).sum(1, dtype=np.int64)


class Tree:
    """A BK-tree over distinct fingerprints, built by splitting on the distance to each node.

    Splitting the rest of a node's points by distance and making the first of each share its child
    gives the tree that inserting them in order would give.
    """

    __slots__ = ("at", "edges")

    def __init__(self, fps: np.ndarray, at: np.ndarray):
        self.at, self.edges = int(at[0]), {}
        rest = at[1:]
        if len(rest):
            far = _far(fps[rest], fps[self.at])
            order = np.argsort(far, kind="stable")
            far, rest = far[order], rest[order]
            cuts = np.nonzero(np.diff(far))[0] + 1
            for d, share in zip(far[np.concatenate([[0], cuts])].tolist(), np.split(rest, cuts)):
                self.edges[d] = Tree(fps, share)

    def search(self, fps: np.ndarray, queries: np.ndarray, at: np.ndarray, radius: int, join) -> None:
        """Call ``join(query numbers, point)`` for all points with queries within ``radius``; ``at``
        numbers ``queries``."""
        stack = [(self, at)]
        while stack:
            node, ask = stack.pop()
            far = _far(queries[ask], fps[node.at])
            near = ask[far <= radius]
            if len(near):
                join(near, node.at)
            for edge, child in node.edges.items():
                follow = ask[(far >= edge - radius) & (far <= edge + radius)]
                if len(follow):
                    stack.append((child, follow))


def forest(fps: np.ndarray, part: np.ndarray, lo: int, hi: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (member, root) of the links between part ``lo`` and part ``hi`` of ``fps`` (rows of words)."""
    fps = np.ascontiguousarray(fps).view(np.uint64)
    mine, theirs = np.nonzero(part == lo)[0], np.nonzero(part == hi)[0]
    if not len(mine) or not len(theirs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = np.arange(len(fps))  # the least row of each row's component; links aren't kept

    def join(near: np.ndarray, at: int) -> None:
        seen = root[near]
        if (seen != root[at]).any():
            labels = np.unique(np.append(seen, root[at]))
            root[np.isin(root, labels)] = labels[0]

    Tree(fps, mine).search(fps, fps, theirs, radius, join)
    member = np.nonzero(root != np.arange(len(fps)))[0]
    return member, root[member]


def allowances(radius: int, blocks: int) -> list[int]:
    """Bits in which each of ``blocks`` may differ so that two fingerprints at most ``radius`` apart stay within
    it in some block: were all beyond, they would differ in ``radius`` + 1 bits at least."""
    least, more = divmod(radius + 1, blocks)
    return [least - (i >= more) for i in range(blocks)]


class Joined:
    """Components of rows 0..n-1 as links come in: ``root`` is the least row of each row's component."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            one, other = self.root[a], self.root[b]
            apart = one != other
            a, b, one, other = a[apart], b[apart], one[apart], other[apart]
            np.minimum.at(self.root, np.maximum(one, other), np.minimum(one, other))
            while len(a) and (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def wide_forest(fps: np.ndarray, part: np.ndarray, lo: int, hi: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``forest`` of wide fingerprints: all links between the two parts, and some inside them, none beyond ``radius``."""
    fps = np.ascontiguousarray(fps).view(np.uint64)
    mine, theirs = np.nonzero(part == lo)[0], np.nonzero(part == hi)[0]
    joined = Joined(len(fps))

    if min(len(mine), len(theirs)) <= FEW:
        if len(mine) > len(theirs):
            mine, theirs = theirs, mine
        for at in mine:
            near = theirs[_far(fps[theirs], fps[at]) <= radius]
            joined.link(near, np.full(len(near), at))
    else:
        whole = fps.view("u1").reshape(len(fps), -1).astype(np.int64)
        for run in keys_for(len(fps), fps.shape[1]):  # most of a large group; the rest follows
            key = sum(whole[:, at] << (8 * k) for k, at in enumerate(run))
            order = np.argsort(key, kind="stable")
            a, b = order[:-1], order[1:]
            near = (key[a] == key[b]) & (np.bitwise_count(fps[a] ^ fps[b]).sum(1, dtype=np.int64) <= radius)
            joined.link(a[near], b[near])
        for block, most in enumerate(allowances(radius, 4 * fps.shape[1])):
            _meet(fps, block, mine, theirs, most, radius, joined)
    member = np.nonzero(joined.root != np.arange(len(fps)))[0]
    return member, joined.root[member]


def _meet(fps: np.ndarray, block: int, mine: np.ndarray, theirs: np.ndarray, most: int, radius: int, joined: Joined) -> None:
    """Link every two rows of ``mine`` and ``theirs`` at most ``radius`` apart whose 16-bit block differs in
    ``most`` bits or fewer."""
    values, root, n = fps.view("u2")[:, block].astype(np.int64), joined.root, len(fps)
    mine, theirs = mine[np.lexsort((root[mine], values[mine]))], theirs[np.argsort(values[theirs], kind="stable")]
    begin = np.searchsorted(values[mine], np.arange((1 << 16) + 1))
    held, asked = np.diff(begin), values[theirs]
    known = values[mine] * n + root[mine] if held.max() > 16 else None  # runs of one value and component
    order = sorted(range(fps.shape[1]), key=lambda w: w == block // 4)  # the block's own word tells least
    left, right = [[np.ascontiguousarray(fps[rows, w]) for w in order] for rows in (mine, theirs)]

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        far = np.zeros(len(a), np.int16)
        for x, y in zip(left, right):
            far += np.bitwise_count(x[a] ^ y[b])
            keep = np.nonzero(far <= radius)[0]
            if len(keep) < len(a) // 2:
                a, b, far = a[keep], b[keep], far[keep]
        near = far <= radius
        joined.link(mine[a[near]], theirs[b[near]])

    for flips in (f for bits in range(most + 1) for f in combinations(range(16), bits)):
        value = asked ^ sum(1 << f for f in flips)
        count = held[value]
        at = np.nonzero(count)[0]
        value, count = value[at], count[at]
        start = begin[value]
        if known is not None and (many := count > 16).any():  # leave out those of the own component
            run = value[many] * n + root[theirs[at[many]]]
            a, b = np.searchsorted(known, run), np.searchsorted(known, run, "right")
            count = np.concatenate([count[~many], a - start[many], start[many] + count[many] - b])
            start, at = np.concatenate([start[~many], start[many], b]), np.concatenate([at[~many], at[many], at[many]])
            start, at, count = start[count > 0], at[count > 0], count[count > 0]
        total, first = np.cumsum(count), 0
        while first < len(at):
            done = total[first] - count[first]
            last = max(first + 1, int(np.searchsorted(total, done + PAIRS, "right")))
            size = count[first:last]
            ends = total[first:last] - done
            compare(np.repeat(start[first:last] - (ends - size), size) + np.arange(ends[-1]), np.repeat(at[first:last], size))
            first = last


def scheme(n: int, radius: int) -> tuple[int, int]:
    """(blocks, blocks that must agree): the fewest blocks whose keys tell ``n`` apart, two agreeing
    at least (one block of 64 // (radius + 1) bits is too coarse from some 100,000 fingerprints on).
    For radius 4 that is 15 keys up to 2^25 fingerprints, 35 beyond."""
    for blocks in range(radius + 2, radius + 4):
        agree = blocks - radius
        if agree * (64 // blocks) >= np.log2(max(2, n)) - 5:
            break
    return blocks, agree


def keys_for(n: int, words: int) -> list[list[int]]:
    """The bytes of each key by which near ones of ``n`` wide fingerprints are linked first.

    A key has two bytes up to 2^27 fingerprints and one more for each 2^8 times as many. The bytes of
    two texts of similarity j agree in a bit with the chance 1 - acos(2j / (1 + j)) / pi; there are as
    many keys as find a pair of similarity ``ALIKE`` with the chance ``FOUND``, whatever ``n``: 31 of
    two bytes, 119 of three. They are runs of shuffled orders of all bytes, the same ones at every call.
    """
    size, width = max(2, math.ceil((math.log2(max(2, n)) - 11) / 8)), 8 * words
    same = (1 - math.acos(2 * ALIKE / (1 + ALIKE)) / math.pi) ** (8 * size)
    count = math.ceil(math.log(1 - FOUND) / math.log(1 - same))
    order, deal, keys = list(range(width)), random.Random(SEED), []
    while len(keys) < count:
        runs = [sorted(order[i : i + size]) for i in range(0, width - size + 1, size)]
        keys += [run for run in runs if run not in keys]
        deal.shuffle(order)
    return keys[:count]


def _pigeonhole(n: int, radius: int) -> list[Column]:
    """The key of every choice of blocks that must agree."""
    blocks, agree = scheme(n, radius)
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for choice in combinations(range(blocks), agree):
        mask = sum(((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in choice)
        keys.append(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return keys


def links(points: DataFrame, n: int, radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """Spanning edges (a, b) of all links among distinct ``fp`` values at most ``radius`` bits apart."""
    words = _words(points)
    task, names = ["choice", "value", "lo", "hi"], [f"w{w}" for w in range(len(words))]
    ends = [f"{end}{w}" for end in "ab" for w in range(len(words))]
    if len(words) == 1:
        keys = [F.struct(F.lit(k).alias("choice"), key.alias("value")) for k, key in enumerate(_pigeonhole(n, radius))]
        dealt = points.select("fp", F.explode(F.array(*keys)).alias("_k")).select("fp", "_k.choice", "_k.value")
        dealt = chunk_pairs(dealt, ["choice", "value"], F.xxhash64("fp"), shard or SHARD)
        compare, tasks = forest, None
    else:
        parts = max(1, math.ceil(n / shard) if shard else max(math.ceil(n / PART), min(8, n // FEW)))
        dealt = points.select("fp", F.pmod(F.xxhash64("fp"), F.lit(parts)).cast("int").alias("part"))
        dealt = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        dealt = dealt.select("fp", "part", F.lit(0).alias("choice"), F.lit(0).alias("value"), F.least("part", "_j").alias("lo"), F.greatest("part", "_j").alias("hi"))
        compare, tasks = wide_forest, min(2000, parts * (parts + 1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, part, fps in _groups(batches):
            member, root = compare(fps, part, int(keys[2]), int(keys[3]), radius)
            if len(member):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*fps[member].T, *fps[root].T]], ends)
        release()

    flat = dealt.select(*task, "part", *(w.alias(name) for w, name in zip(words, names)))
    placed = (flat.repartition(tasks, *task) if tasks else flat.repartition(*task)).sortWithinPartitions(*task)
    found = placed.mapInArrow(search, ", ".join(f"{e} long" for e in ends))
    if len(words) == 1:
        return found.toDF("a", "b")
    return found.select(*(F.struct(*(F.col(f"{end}{w}").alias(f"w{w}") for w in range(len(words)))).alias(end) for end in "ab"))


def _groups(batches: Iterator[pa.RecordBatch]):
    """(key, part, fps) of each run of equal keys with two rows or more; runs may span batches."""
    held: list[np.ndarray] = []
    for batch in batches:
        columns = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns])
        if not columns.shape[1]:
            continue
        if held and (held[-1][:4, -1] != columns[:4, 0]).any():
            yield from _cut(np.concatenate(held, 1))
            held = []
        change = np.nonzero((columns[:4, 1:] != columns[:4, :-1]).any(0))[0] + 1
        if len(change):
            yield from _cut(np.concatenate([*held, columns[:, : change[-1]]], 1))
            held = [columns[:, change[-1] :]]
        else:
            held.append(columns)
    if held:
        yield from _cut(np.concatenate(held, 1))


def _cut(columns: np.ndarray):
    change = np.nonzero((columns[:4, 1:] != columns[:4, :-1]).any(0))[0] + 1
    bounds = np.concatenate([[0], change, [columns.shape[1]]])
    for k in np.nonzero(np.diff(bounds) > 1)[0]:
        a, b = bounds[k], bounds[k + 1]
        yield columns[:4, a], columns[4, a:b], columns[5:, a:b].T


def _placed(prints: DataFrame, key: list[str], radius: int, shard: int | None) -> DataFrame:
    """``prints`` with ``first``: of the rows that links reach, the least by doc_id (nulls last) and ``key``."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *key)).alias("least")
    points = written(prints.groupBy("fp").agg(least), "points")
    roots = components(links(points.select("fp"), points.count(), radius, shard))
    placed = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    placed = placed.withColumn("root", F.coalesce("root", "fp"))
    first = placed.groupBy("root").agg(F.min("least").alias("first"))
    placed = placed.join(first, "root").select("fp", "first")
    return prints.join(placed, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int | None = None, words: int = 1) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (least doc_id reachable by links), one row per row."""
    prints = written(fingerprints(docs, shingle, words), "fingerprints")
    digits = [F.lower(F.lpad(F.hex(w), 16, "0")) for w in reversed(_words(prints))]
    return _placed(prints, [], radius, shard).select("doc_id", F.concat(*digits).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int | None = None, words: int = 1) -> DataFrame:
    """The rows of ``docs`` of which each component keeps one: the row with the least doc_id (nulls
    last) and, of several texts with that id, the one whose hash is least."""
    text_key = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    prints = written(fingerprints(docs, shingle, words, text_key.alias("text_key")), "fingerprints")
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    got = _placed(prints, ["text_key"], radius, shard).select("doc_id", "text_key", first.alias("kept"))
    return rows_that_stay(docs, text_key, got)
