"""Hard-negative mining: rows of another label that score nearly as high as an anchor's positives.

Components become integers, so scores are exact. An anchor's positives are its best rows of the same label.
A negative of a positive is a row of another label whose score lies between ``LOWER`` and ``UPPER`` percent of the
positive's; the best ``k`` are returned.

Every anchor is scored against every row, in blocks. Anchors go to the tasks in batches of about
``ANCHORS`` (by a hash of their row number, so that batches are equal), as a broadcast of bounded size; rows
stay where they are. A task takes its rows block by block: it sorts an anchor's scores by score and id
(lexsort), finds for each positive by binary search where scores of at most the upper limit begin and where
those of at least the lower limit end, and reads the first ``k`` rows of other labels in between. It merges them with the best of the
blocks before, so it holds ``k`` rows a positive and sends at most these; the best ``k`` of all tasks' ``k`` are
the best ``k``. Positives are found the same way in a pass before, over rows of the anchor's label only.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; an
empty table gives no rows; components beyond +-2^22 after scaling count as that; shorter vectors
count as padded with zeros; rows that repeat a vec_id are rows of their own, as anchors too; rows with a null vec_id are no
anchors, and come after all others among equal scores; a negative positive's limits cross, so it has no
negatives; an anchor alone in its label has no positives and no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_folder, prepare, written
from .integers import matrix, padded, products, scaled

SCALE, POSITIVES, NEGATIVES, LOWER, UPPER = 256, 5, 5, 80, 100
#: Anchors that a batch holds, and that are scored together.
ANCHORS, TOGETHER = 8192, 256
#: Stands for a null vec_id, and for no row: after every other id.
NONE = np.iinfo(np.int64).max
WORST = -NONE


def usable_rows(embeddings: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id, label, q of the rows that take part; all q of one length."""
    rows = scaled(embeddings.withColumn("_label", label).where("_label IS NOT NULL"), scale, F.col("_label").cast("long").alias("label"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "integers")
    width = rows.agg(F.max(F.size("q"))).first()[0] or 0
    return rows.select("row", "vec_id", "label", padded(rows, width).alias("q"))


def _order(score: np.ndarray, vec_id: np.ndarray) -> np.ndarray:
    """By score from the highest, then by id."""
    return np.lexsort((vec_id, -score))


class Best:
    """The ``k`` best (score, id, row) seen for each of n slots."""

    def __init__(self, n: int, k: int):
        self.k, self.score = k, np.full((n, k), WORST)
        self.vec_id, self.row = np.full((n, k), NONE), np.full((n, k), -1)

    def add(self, slot: int, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if not len(score):
            return
        score, vec_id, row = np.append(self.score[slot], score), np.append(self.vec_id[slot], vec_id), np.append(self.row[slot], row)
        first = np.lexsort((row < 0, vec_id, -score))[: self.k]
        self.score[slot], self.vec_id[slot], self.row[slot] = score[first], vec_id[first], row[first]

    def found(self) -> tuple[np.ndarray, ...]:
        """(slot, score, id, row) of all that was seen."""
        slot, place = np.nonzero(self.row >= 0)
        return slot, self.score[slot, place], self.vec_id[slot, place], self.row[slot, place]


def _columns(batch: pa.RecordBatch, width: int):
    """row, id (NONE for null), label, matrix."""
    ids = batch.column(1).fill_null(int(NONE))
    return np.asarray(batch.column(0)), np.asarray(ids), np.asarray(batch.column(2)), matrix(batch.column(3), width)


def limits(sorted_scores: np.ndarray, positive: int, lower: int, upper: int) -> tuple[int, int]:
    """Where scores of at most upper percent of ``positive`` begin and those of at least lower percent end, in falling scores."""
    rising = -sorted_scores
    first = np.searchsorted(rising, -(upper * positive // 100), "left")
    last = np.searchsorted(rising, lower * -positive // 100, "right")  # the lower limit, rounded up, with its sign changed
    return int(first), int(last)


def positives(rows: DataFrame, anchors, k: int) -> DataFrame:
    """anchor, positive (row numbers), positive_id, positive_score, place of the ``k`` best other rows of each anchor's label."""
    shipped = rows.sparkSession.sparkContext.broadcast(anchors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, labels, x = shipped.value
        best = Best(len(numbers), k)
        for batch in batches:
            row, vec_id, label, y = _columns(batch, x.shape[1])
            for same in np.intersect1d(label, labels):
                at, mine = np.flatnonzero(label == same), np.flatnonzero(labels == same)
                for a in range(0, len(mine), TOGETHER):
                    some = mine[a : a + TOGETHER]
                    for anchor, score in zip(some, products(x[some], y[at])):
                        other = row[at] != numbers[anchor]
                        score, here = score[other], at[other]
                        first = _order(score, vec_id[here])[:k]
                        best.add(anchor, score[first], vec_id[here[first]], row[here[first]])
        slot, score, vec_id, number = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (numbers[slot], number, vec_id, score)], ["anchor", "positive", "positive_id", "positive_score"])

    got = rows.select("row", "vec_id", "label", "q").mapInArrow(scan, "anchor long, positive long, positive_id long, positive_score long")
    order = W.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    return got.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def negatives(rows: DataFrame, anchors, pairs: np.ndarray, k: int, lower: int, upper: int) -> DataFrame:
    """pair, negative_id, negative_score, rank of the ``k`` best rows of other labels between the limits of
    each pair: a row of ``pairs`` (place of its anchor in ``anchors``, positive score), sorted by anchor."""
    shipped = rows.sparkSession.sparkContext.broadcast((anchors, pairs))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, labels, x), pairs = shipped.value
        asked, begin = np.unique(pairs[:, 0], return_index=True)
        end = np.append(begin[1:], len(pairs))
        best = Best(len(pairs), k)
        for batch in batches:
            row, vec_id, label, y = _columns(batch, x.shape[1])
            for a in range(0, len(asked), TOGETHER):
                scores = products(x[asked[a : a + TOGETHER]], y)
                for slot, score in enumerate(scores, a):
                    order = _order(score, vec_id)
                    order = order[label[order] != labels[asked[slot]]]
                    falling = score[order]
                    for pair in range(begin[slot], end[slot]):
                        first, last = limits(falling, int(pairs[pair, 1]), lower, upper)
                        here = order[first : min(last, first + k)]
                        best.add(pair, score[here], vec_id[here], row[here])
        slot, score, vec_id, number = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (slot, vec_id, score, number)], ["pair", "negative_id", "negative_score", "negative"])

    got = rows.select("row", "vec_id", "label", "q").mapInArrow(scan, "pair long, negative_id long, negative_score long, negative long")
    order = W.partitionBy("pair").orderBy(F.desc("negative_score"), "negative_id", "negative")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    embeddings: DataFrame, is_anchor: Column, label: Column, scale: int = SCALE, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
    lower: int = LOWER, upper: int = UPPER, batch: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on vec_id, ``label`` an expression of ``embeddings``' columns."""
    spark = embeddings.sparkSession
    prepare(spark)
    rows = usable_rows(embeddings, label, scale)
    chosen = written(rows.where(F.coalesce(is_anchor, F.lit(False))), "anchors")
    batches = max(1, math.ceil(chosen.count() / batch))
    folder = new_folder(spark, "negatives")
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], kind).write.mode("append").parquet(folder)
    for b in range(batches):
        here = chosen.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == b).orderBy("row").collect()  # about ``batch`` rows
        if not here:
            continue
        anchors = tuple(np.array([r[name] for r in here], np.int64) for name in ("row", "label", "q"))
        found = positives(rows, anchors, n_positives).orderBy("anchor", "place").collect()  # at most ``n_positives`` an anchor
        place = {r["row"]: i for i, r in enumerate(here)}
        told = [(i, here[place[p["anchor"]]]["vec_id"], _id(p["positive_id"]), p["positive_score"]) for i, p in enumerate(found)]
        pairs = np.array([(place[p["anchor"]], p["positive_score"]) for p in found], np.int64).reshape(-1, 2)
        named = spark.createDataFrame(told, "pair long, anchor_id long, positive_id long, positive_score long")
        got = negatives(rows, anchors, pairs, n_negatives, lower, upper).join(F.broadcast(named), "pair")
        negative = F.when(F.col("negative_id") != int(NONE), F.col("negative_id"))
        got.select("anchor_id", "positive_id", "rank", negative.alias("negative_id"), "positive_score", "negative_score").write.mode("append").parquet(folder)
    return spark.read.schema(kind).parquet(folder)


def _id(value: int) -> int | None:
    return None if value == NONE else value
