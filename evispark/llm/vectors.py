"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside cells.

Vectors are assigned to the nearest of K unit centroids, fitted on a bounded sample. Cells grow in
number with the table: beyond ``MOST_CELLS`` of them each is cut again by a second set of centroids,
fitted on what the first leave over of the sample (vector less its centroid), so that there are up to
``MOST_CELLS`` squared from two short lists. Inside a cell, cosines come from blocked matrix products in double precision, and links are pairs at or above the
threshold. A pair near a border may fall into two cells, so a vector also visits the cells whose
border is near: x with home c is shown in c' if its distance to the bisecting hyperplane of the two
centroids is at most ``margin``. Two vectors whose cosine is t are sqrt(2 - 2t) apart; a margin of
that length loses no pair, but in many dimensions it would show every vector in most cells. A
difference in no particular direction has 1 / sqrt(d) of its length along the border's normal;
``MARGINS`` of those are shown. Recall against brute force is measured in the tests (0.99 and more).

A pair is compared in one cell: the higher of the two homes at either level. Equal vectors are one class first
(partial aggregation), so a vector that a third of the rows share is one row here. Cells of over
``CELL`` rows are cut into parts that meet pairwise. Tasks return, per class, its number of links
and its local root: at most a row a class, never the pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components link with
nothing; vectors of different lengths don't link; rows that repeat a vec_id count as other vectors;
rows with a null vec_id link and count, and form no id of their own; kept is false for them unless
nothing else names the component (component_id null); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunk_pairs, components, hash_share, least_roots, prepare, written

LEAST = 0.95
MARGINS = 3.0
#: Rows to fit the centroids on, rows a cell should hold, rows a part may hold.
SAMPLE = 20_000
CELL_ROWS = 400
MOST_CELLS = 2048
CELL = 2048
#: A vector of over this share of all rows, and of HOT_LEAST, is joined back by broadcast.
HOT_SHARE, HOT_LEAST = 1 / 2000, 1000
BLOCK = 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Their largest magnitude is divided out first, as squares of very large or very small ones leave the doubles."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; empty cells keep their place."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ centroids.T).argmax(1) for a in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        cells, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        size = np.linalg.norm(sums, axis=1)
        centroids[cells[size > 0]] = sums[size > 0] / size[size > 0, None]
    return centroids


def classes(embeddings: DataFrame) -> DataFrame:
    """Distinct usable vectors: cls, rep (least vec_id), n rows, dim, embedding."""
    found = _rows(embeddings).where(usable()).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    return written(found.select(F.monotonically_increasing_id().alias("cls"), "rep", "n", F.size("embedding").alias("dim"), "embedding"), "classes")


def usable() -> Column:
    """Not null, all components finite, one of them not zero."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))


def _rows(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding; floats stay floats, which halves what moves, anything else is double."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _gaps(centroids: np.ndarray) -> np.ndarray:
    """Distances between all centroids."""
    square = (centroids**2).sum(1)
    return np.sqrt(np.maximum(0, square[:, None] + square[None] - 2 * centroids @ centroids.T))


def _shown(x: np.ndarray, centroids: np.ndarray, gaps: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): every row in its nearest cell, and in the higher ones whose border is near.

    Twice the distance to the border of cells a and b is (|x - b|^2 - |x - a|^2) / |a - b|."""
    near = 2 * x @ centroids.T - (centroids**2).sum(1)
    own = near.argmax(1)
    far = near[np.arange(len(own)), own][:, None] - near
    row, other = np.nonzero((far <= 2 * margin * gaps[own]) & (np.arange(len(centroids)) > own[:, None]))
    every = np.arange(len(own))
    return np.concatenate([every, row]), np.concatenate([own, other]), np.concatenate([np.ones(len(own), bool), np.zeros(len(row), bool)])


def _residual_centroids(x: np.ndarray, centroids: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """k-means of what ``centroids`` leave over of ``x``."""
    rest = x - centroids[(x @ centroids.T).argmax(1)]
    rng = np.random.default_rng(seed)
    found = rest[rng.choice(len(rest), min(k, len(rest)), replace=False)].copy()
    for _ in range(rounds):
        near = (2 * rest @ found.T - (found**2).sum(1)).argmax(1)
        sums, n = np.zeros_like(found), np.bincount(near, minlength=len(found))
        np.add.at(sums, near, rest)
        found[n > 0] = sums[n > 0] / n[n > 0, None]
    return found


def cells(found: DataFrame, least: float, margins: float, sample: int, cell_rows: int, most_cells: int) -> DataFrame:
    """cls, n, embedding, cell, home: every class in its home cell and in the near higher ones.
    ``home`` has bit 1 if the first level's part of the cell is the vector's home, bit 2 for the second's."""
    dim_row = found.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim, rows = dim_row if dim_row else (1, 0)
    picked = found.where((F.col("dim") == dim) & hash_share(4 * sample / max(1, rows), "embedding"))
    picked = picked.orderBy(F.xxhash64("embedding"), "cls").limit(sample)
    fit = unit(np.array([r[0] for r in picked.select("embedding").collect()] or [[1.0] * dim]))
    wanted = max(1, rows // cell_rows)
    first = spherical_kmeans(fit, int(min(most_cells, wanted, len(fit))))
    second = np.zeros((1, dim))
    if wanted > 2 * len(first):
        second = _residual_centroids(fit, first, int(min(most_cells, wanted // len(first), len(fit))))
    margin = np.sqrt(2 - 2 * least) * min(1.0, margins / np.sqrt(dim))
    shipped = found.sparkSession.sparkContext.broadcast((first, _gaps(first), second, _gaps(second)))  # most_cells rows each

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, gaps, second, inner = shipped.value
        for batch in batches:
            dims = np.asarray(batch.column(2))
            other, usual = np.nonzero(dims != dim)[0], np.nonzero(dims == dim)[0]
            if len(other):
                yield _placed(batch, other, -dims[other].astype(np.int64), np.full(len(other), 3))
            for a in range(0, len(usual), BLOCK):
                at = usual[a : a + BLOCK]
                x = unit(_matrix(batch.column(3).take(pa.array(at)), dim))
                row, cell, home = _shown(x, first, gaps, margin)
                level = np.where(home, 1, 0)
                if len(second) > 1:
                    for b in range(0, len(row), BLOCK):
                        r, c, up = row[b : b + BLOCK], cell[b : b + BLOCK], level[b : b + BLOCK]
                        deep, inside, own = _shown(x[r] - first[c], second, inner, margin)
                        yield _placed(batch, at[r[deep]], c[deep] * len(second) + inside, up[deep] + np.where(own, 2, 0))
                else:
                    yield _placed(batch, at[row], cell, level + 2)

    kind = found.schema["embedding"].dataType.simpleString()
    return found.select("cls", "n", "dim", "embedding").mapInArrow(place, f"cls long, n long, embedding {kind}, cell long, home int")


def _placed(batch: pa.RecordBatch, at: np.ndarray, cell: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
    rows = batch.select([0, 1, 3]).take(pa.array(at))
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell, pa.int64()), pa.array(home, pa.int32())], ["cls", "n", "embedding", "cell", "home"])


def compare(cls: np.ndarray, n: np.ndarray, x: np.ndarray, home: np.ndarray, part: np.ndarray, lo: int, hi: int, least: float):
    """(cls, links, root cls) of the classes linked in this task. A pair belongs to this cell if at each
    level it is the home of one of the two."""
    x = unit(x)
    a, b = np.nonzero(part == lo)[0], np.nonzero(part == hi)[0]
    links, left, right = np.zeros(len(cls), np.int64), [], []
    for i in range(0, len(a), BLOCK):
        for j in range(i if lo == hi else 0, len(b), BLOCK):
            p, q = a[i : i + BLOCK], b[j : j + BLOCK]
            hit = (x[p] @ x[q].T >= least) & ((home[p][:, None] | home[q][None, :]) == 3)
            if lo == hi:
                hit &= p[:, None] < q[None, :]
            r, c = np.nonzero(hit)
            np.add.at(links, p[r], n[q[c]])
            np.add.at(links, q[c], n[p[r]])
            left.append(p[r])
            right.append(q[c])
    linked = np.nonzero(links)[0]
    if not len(linked):
        return linked, linked, linked
    root = np.array(least_roots(len(cls), np.concatenate(left), np.concatenate(right)))
    return cls[linked], links[linked], cls[root[linked]]


def links(found: DataFrame, least: float = LEAST, margins: float = MARGINS, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, cell: int = CELL, most_cells: int = MOST_CELLS) -> DataFrame:
    """cls, links, root: a row for each class and task in which it has links."""
    dealt = chunk_pairs(written(cells(found, least, margins, sample, cell_rows, most_cells), "cells"), ["cell"], F.xxhash64("cls"), cell)
    task = ["cell", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in _runs(batches):
            dim = len(group.column(5)[0])
            got = compare(
                np.asarray(group.column(3)), np.asarray(group.column(4)), _matrix(group.column(5).combine_chunks(), dim),
                np.asarray(group.column(6)), np.asarray(group.column(7)), key[1], key[2], least,
            )
            if len(got[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], ["cls", "links", "root"])

    placed = dealt.select(*task, "cls", "n", "embedding", "home", "part").repartition(*task).sortWithinPartitions(*task)
    return placed.mapInArrow(run, "cls long, links long, root long")


def _runs(batches: Iterator[pa.RecordBatch]):
    """(key, table) of each run of equal first three columns; runs may span batches."""
    held, now = [], None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)])
        bounds = np.concatenate([[0], np.nonzero((keys[:, 1:] != keys[:, :-1]).any(0))[0] + 1, [len(batch)]])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            key = tuple(keys[:, a].tolist())
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def near_duplicates(embeddings: DataFrame, least: float = LEAST, margins: float = MARGINS, **how) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``embeddings``."""
    prepare(embeddings.sparkSession)
    found = classes(embeddings)
    got = written(links(found, least, margins, **how), "links")
    roots = components(got.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    counts = got.groupBy("cls").agg(F.sum("links").alias("links"))
    placed = found.join(roots.withColumnRenamed("node", "cls"), "cls", "left").join(counts, "cls", "left")
    placed = placed.withColumns({"root": F.coalesce("root", "cls"), "links": F.coalesce("links", F.lit(0))})
    first = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    placed = placed.join(first, "root").select("embedding", "n", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    joined = _joined(_rows(embeddings), placed)
    own = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )


def _joined(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``rows`` with their class's facts. Vectors that link with nothing have none; those that very many
    rows share (at most 1 / HOT_SHARE) are joined by broadcast, so that no task gets all rows of one."""
    found = written(placed, "placed")
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(HOT_LEAST, int(total * HOT_SHARE))
    often = F.broadcast(found.where(hot).select("embedding", F.col("n_links").alias("_n"), F.col("component_id").alias("_c")))
    none = rows.where(~usable()).select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    first = rows.where(usable()).join(often, "embedding", "left")
    one = first.where("_n IS NOT NULL").select("vec_id", F.col("_n").alias("n_links"), F.col("_c").alias("component_id"))
    rest = first.where("_n IS NULL").select("vec_id", "embedding").join(found.where(~hot), "embedding", "left")
    return none.unionByName(one).unionByName(rest.select("vec_id", "n_links", "component_id"))
