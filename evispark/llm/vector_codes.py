"""Vector code compression: product quantization whose nearest entries come from kd-trees.

Components become integers, so every distance, tie and mean is exact and the result doesn't depend on how
rows are dealt out. A vector is cut into ``PARTS`` consecutive parts; each part position has a codebook of
``ENTRIES`` entries, which starts as that part of the least vec_ids.

Each round builds one kd-tree per codebook on the driver (a codebook has ``ENTRIES`` entries, whatever the
table's size) and broadcasts the four. Tasks search them by branch and bound, many rows at a time: at a
node a row first visits the child on its side of the cut, then the other one unless that child's bounding
box is farther than the best entry so far. Boxes at an equal distance are visited, for an entry in them may
have a lower index. A task adds its parts up by entry and sends at most ``PARTS * ENTRIES`` sums per component;
Spark adds these up by key, and the new entries are all that comes to the driver.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; an empty
table gives no rows; components beyond +-2^22 after scaling count as that; vectors shorter than the
longest, or than the next multiple of ``PARTS``, count as padded with zeros; rows that repeat a vec_id are rows
of their own, as starting entries ordered by their vectors; null vec_ids come last among these; with
fewer rows than ``ENTRIES`` a codebook has as many entries; null labels are one label; a label_error beyond 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .integers import EXACT, matrix, padded, products, scaled

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries that a leaf of a tree holds at most.
LEAF = 16
#: Rows that search a tree together.
BLOCK = 4096
#: A label of over this share of all rows, and of HOT_LEAST, is joined back by broadcast.
HOT_SHARE, HOT_LEAST = 1 / 2000, 1000


@dataclass
class Node:
    """A kd-tree node: the box of its entries, and either a cut with two children or entries by index."""

    low: np.ndarray
    high: np.ndarray
    at: np.ndarray
    axis: int = -1
    cut: int = 0
    children: tuple[Node, Node] | None = None


def kd_tree(entries: np.ndarray, at: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Cuts the widest axis at its median until ``leaf`` entries are left; equal entries may share a leaf of any size."""
    at = np.arange(len(entries)) if at is None else at
    points = entries[at]
    node = Node(points.min(0), points.max(0), at)
    axis = int((node.high - node.low).argmax())
    if len(at) > leaf and node.high[axis] > node.low[axis]:
        values = np.sort(points[:, axis])
        cut = values[len(values) // 2]
        cut = cut if cut > values[0] else values[np.searchsorted(values, cut, "right")]
        left = points[:, axis] < cut
        node.axis, node.cut = axis, int(cut)
        node.children = (kd_tree(entries, at[left], leaf), kd_tree(entries, at[~left], leaf))
    return node


class Search:
    """The nearest entry of every row, ties to the lower index."""

    def __init__(self, tree: Node, entries: np.ndarray, rows: np.ndarray):
        self.entries, self.rows = entries, rows
        self.sizes, self.own = (entries**2).sum(1), (rows**2).sum(1)
        self.best = np.full(len(rows), np.iinfo(np.int64).max)
        self.index = np.full(len(rows), len(entries))
        if len(rows):
            self.visit(tree, np.arange(len(rows)))

    def visit(self, node: Node, ask: np.ndarray) -> None:
        if node.children is None:
            far = self.own[ask][:, None] + self.sizes[node.at] - 2 * products(self.rows[ask], self.entries[node.at])
            least = far.min(1)
            first = np.where(far == least[:, None], node.at, len(self.entries)).min(1)
            closer = (least < self.best[ask]) | ((least == self.best[ask]) & (first < self.index[ask]))
            self.best[ask[closer]], self.index[ask[closer]] = least[closer], first[closer]
            return
        left = self.rows[ask, node.axis] < node.cut
        for own, other in (node.children, ask[left]), (node.children[::-1], ask[~left]):
            if len(other):
                self.visit(own[0], other)
                again = other[self.bound(own[1], other) <= self.best[other]]
                if len(again):
                    self.visit(own[1], again)

    def bound(self, node: Node, ask: np.ndarray) -> np.ndarray:
        """Squared distance of rows to a node's box."""
        rows = self.rows[ask]
        return (np.maximum(0, np.maximum(node.low - rows, rows - node.high)) ** 2).sum(1)


def nearest(trees: list[Node], books: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry by row and part, squared distance by row and part)."""
    width = books.shape[2]
    found = [Search(t, book, rows[:, p * width : (p + 1) * width]) for p, (t, book) in enumerate(zip(trees, books))]
    return np.stack([f.index for f in found], 1), np.stack([f.best for f in found], 1)


def start(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks by part, entry and position: the parts of the least vec_ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()  # at most ``entries`` rows
    vectors = np.array([r[0] for r in first], np.int64)
    return vectors.reshape(len(first), parts, -1).transpose(1, 0, 2)


def _sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, at, total, n: component sums of the parts nearest to each entry, added up by task and then by key."""
    shipped = rows.sparkSession.sparkContext.broadcast((books, [kd_tree(b) for b in books]))  # parts * entries entries
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = shipped.value
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                x = matrix(batch.column(0).slice(a, BLOCK), parts * width)
                index, _ = nearest(trees, books, x)
                for p in range(parts):
                    order = np.argsort(index[:, p], kind="stable")
                    used, first = np.unique(index[order, p], return_index=True)
                    total[p, used] += np.add.reduceat(x[order, p * width : (p + 1) * width], first, axis=0)
                    n[p, used] += np.diff(np.append(first, len(x)))
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(total[part, entry].tolist(), pa.list_(pa.int64())), pa.array(n[part, entry])], ["part", "entry", "total", "n"]
        )

    got = rows.select("q").mapInArrow(add, "part long, entry long, total array<long>, n long")
    each = got.select("part", "entry", "n", F.posexplode("total").alias("at", "total"))
    return each.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` rounds over all rows; entries that are nearest to nothing stay."""
    books = start(rows, parts, entries)
    for _ in range(rounds):
        books = books.copy()
        for part, entry, at, total, n in _sums(rows, books).collect():  # at most one row an entry and component
            books[part, entry, at] = total // n  # Python's // goes down
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with codes (array<int>, by part) and error (squared distance over all parts) in place of q."""
    shipped = rows.sparkSession.sparkContext.broadcast((books, [kd_tree(b) for b in books]))
    parts, _, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = shipped.value
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                some = batch.slice(a, BLOCK)
                index, far = nearest(trees, books, matrix(some.column(2), parts * width))
                code = pa.ListArray.from_arrays(np.arange(0, index.size + 1, parts, dtype=np.int32), pa.array(index.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), code, pa.array(far.sum(1))], ["vec_id", "label", "codes", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "q").mapInArrow(assign, f"vec_id long, label {kind}, codes array<int>, error long")


def compress(embeddings: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, error of every usable row; the codebooks)."""
    prepare(embeddings.sparkSession)
    rows = written(scaled(embeddings, scale, F.col("label")), "integers")
    longest = rows.agg(F.max(F.size("q"))).first()[0]
    if not longest:  # no rows, or vectors without components
        none = F.array_repeat(F.lit(0), parts if longest is not None else 0)
        return rows.select("vec_id", "label", none.alias("codes"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 1, 0), np.int64)
    width = -(-longest // parts) * parts
    if rows.where(F.size("q") != width).limit(1).count():
        rows = rows.withColumn("q", padded(rows, width))
    books = train(rows, parts, entries, rounds)
    return codes(rows, books), books


def summary(embeddings: DataFrame, **how) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    found, books = compress(embeddings, **how)
    found = written(found, "codes")
    return _with_label_error(found).select(
        "vec_id", F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "").alias("code"),
        "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"),
    )


def _with_label_error(found: DataFrame) -> DataFrame:
    """Adds the sum of ``error`` over rows of the same label. Labels that very many rows share (at most
    1 / HOT_SHARE of them) are joined by broadcast, so that no task gets all rows of one."""
    sums = written(found.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label_sums")
    hot = F.col("n") > max(HOT_LEAST, int((sums.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE))
    often = F.broadcast(sums.where(hot).select(F.col("label").alias("_l"), F.col("label_error").alias("_e"), F.lit(True).alias("_hot")))
    first = found.join(often, F.col("label").eqNullSafe(F.col("_l")), "left")
    one = first.where("_hot").select("vec_id", "codes", "error", F.col("_e").alias("label_error"))
    seldom = sums.where(~hot).select(F.col("label").alias("_l2"), "label_error")
    rest = first.where("_hot IS NULL").join(seldom, F.col("label").eqNullSafe(F.col("_l2")))
    return one.unionByName(rest.select("vec_id", "codes", "error", "label_error"))
