"""Shared pieces of the corpus operators: shared folders, written tables, connected components.

Nothing here keeps state on one machine: intermediate tables go to the folder that the cluster
names in ``spark.checkpoint.dir``, so any executor can be lost and any other can read on.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Characters that the operators treat as white space: [\x20\x09-\x0D].
SPACES = "[\\x20\\x09-\\x0D]"

#: Most Arrow bytes handed to a Python worker at once.
BATCH_BYTES = "4m"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep their batches small."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_HELD: dict[str, object] = {}


def held(name: str, make):
    """The one large object that a Python worker keeps between tasks: workers are used again, and
    what an earlier operator kept there (a model, a memo) goes when another one starts."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    """Give a Python worker's free memory back: idle workers stay for a minute beside the next stage."""
    import ctypes

    import pyarrow as pa

    _HELD.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def hash_share(share: float | Column, *key) -> Column:
    """True for about ``share`` of all keys, the ones with the least hash."""
    return F.pmod(F.xxhash64(F.lit("share"), *key), F.lit(1 << 20)) < F.ceil(F.least(F.lit(1.0), share if isinstance(share, Column) else F.lit(share)) * F.lit(float(1 << 20)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="evispark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/evispark-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and ``more``, whatever other columns the table has."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def id_part(column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids give null."""
    return F.crc32(column.cast("string").cast("binary")) % parts


def quoted(name: str) -> Column:
    """A column by its whole name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(docs: DataFrame) -> list[Column]:
    return [quoted(c) for c in docs.columns]


#: Names that no table of documents has.
_ID, _TEXT, _SIZE, _ROW = "__stay_id__", "__stay_text__", "__stay_size__", "__stay_row__"


def rows_that_stay(docs: DataFrame, text_key: Column, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, text_key, kept: one row per row of ``docs``) keeps.

    Rows are told apart by doc_id, where null equals null, and ``text_key``. ``decided`` keeps at
    most one row of each such pair; of rows that share a kept one, one with the longest text stays, and of
    these the one whose columns as JSON have the least hash.
    """
    each = decided.groupBy(F.col("doc_id").alias(_ID), F.col("text_key").alias(_TEXT))
    each = written(each.agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")), "kept")
    marked = docs.withColumn(_TEXT + "2", text_key)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(_ID)) & (F.col(_TEXT + "2") == F.col(_TEXT))
    left = marked.join(each.where("NOT stays").select(_ID, _TEXT), same, "left_anti")
    again = each.where("stays AND n > 1").select(_ID, _TEXT)
    if again.isEmpty():
        return left.select(*columns_of(docs))
    once = left.join(again, same, "left_anti").select(*columns_of(docs))
    whole = F.struct(*columns_of(docs))
    first = F.struct(F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))), -F.xxhash64(F.to_json(whole)).cast("decimal(20,0)"))
    rest = left.join(again, same, "left_semi").select("doc_id", F.col(_TEXT + "2"), whole.alias(_ROW), first.alias(_SIZE))
    rest = rest.groupBy(F.col("doc_id").alias(_ID), _TEXT + "2").agg(F.max_by(_ROW, _SIZE).alias(_ROW))
    return once.unionByName(rest.select(f"{_ROW}.*"))


def in_id_order(df: DataFrame, *ties: Column) -> DataFrame:
    """Range-partitioned and sorted by doc_id (nulls first); rows of one id may be split by ``ties``."""
    keys = [F.col("doc_id").asc_nulls_first(), *(t.asc() for t in ties)]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def chunk_pairs(df: DataFrame, key: list[str], salt: Column, most: int) -> DataFrame:
    """Deal the rows of each key into tasks of at most about ``2 * most`` rows so that every two
    rows of a key meet in exactly one task.

    A key with n rows is cut into s = ceil(n / most) parts. Part i goes to the tasks (i, j) with
    every j; the task (lo, hi) compares part lo with part hi (lo = hi: the part with itself).
    Adds ``lo``, ``hi`` and ``part``. Keys of one part are not replicated.
    """
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    big = counts.where(F.col("_n") > most).select(*key, F.ceil(F.col("_n") / most).cast("int").alias("_s"))
    cut = df.join(big, key, "left").withColumn("_s", F.coalesce("_s", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(salt, F.col("_s")).cast("int"))
    cut = cut.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    return cut.withColumns(
        {"lo": F.least("part", "_j").cast("int"), "hi": F.greatest("part", "_j").cast("int")}
    ).drop("_j", "_s")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b of one type that has an order): rows (node, root), root the least node.

    Alternates large-star and small-star steps. Each step is a partial-aggregated minimum and an
    equi-join, which the adaptive planner may split, so a hub with very many links is no single
    task. Edges are written to the shared folder between rounds; the driver sees only a count and a
    checksum. Empty input gives an empty result.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def least_roots(n: int, left, right):
    """Union-find over rows 0..n-1: the least row of each row's component."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(left, right):
        a, b = find(int(a)), find(int(b))
        if a != b:
            up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


