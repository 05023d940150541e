"""Streaming form of the per-document operators: chunking and matching keep no state, so they run
unchanged on ``readStream``; rankings are kept by a sink that merges each micro-batch with what it has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators import chunking
from evispark.operators import evidence as E


def read_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def chunk_stream(documents: DataFrame, most: int = 5200) -> DataFrame:
    return chunking.chunks(documents, most)


STATE = "item_id long, chunk_id long, score double, rank int"

def _epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs that were written whole, in order."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*/_SUCCESS")
    listed = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found) or []
    return sorted(int(f.getPath().getParent().getName().rsplit("=", 1)[1]) for f in listed)


def top_k(spark: SparkSession, path: str) -> DataFrame:
    """The ranking as of the last epoch."""
    epochs = _epochs(spark, path)
    return spark.read.schema(STATE).parquet(f"{path}/epoch={epochs[-1]:012d}") if epochs else spark.createDataFrame([], STATE)


def top_k_sink(path: str, items: DataFrame, k: int, signals: E.Signals | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink over chunks (chunk_id, text) that keeps the ``k`` best of each item of all batches so far.

    A chunk's score doesn't depend on other chunks, so a batch is matched on its own, by the same score as a
    whole table. An epoch's ranking is that of the epoch before merged with the batch: the best of the union
    are among both sides' best. It is written under the epoch's own name, overwriting what an attempt that
    failed may have left, so an epoch that is replayed gives the same table, and chunks that come again, early or
    late, change nothing. ``k`` rows an item are kept, whatever has gone by."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [e for e in _epochs(spark, path) if e < epoch]
        found = E.matches(batch.select("chunk_id", "text"), items, signals).select("item_id", "chunk_id", "score")
        if before:
            held = spark.read.schema(STATE).parquet(f"{path}/epoch={before[-1]:012d}").select("item_id", "chunk_id", "score")
            found = found.unionByName(held)
        best = E.best(found, ["item_id"], k, [F.desc("score"), F.asc("chunk_id")], ["chunk_id"])
        best.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in STATE.split(", ")]).write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    return write
