"""Exact duplicates by deterministic block naming (DataFrame operations only).

Each normalised text is cut into blocks of ``BLOCK`` bytes. Equal blocks get equal integer names:
blocks are dealt into buckets by hash and sorted there; a block's name is its bucket and its rank
among the bucket's distinct blocks. Then neighbouring names are paired and the pairs named in the
same way, level by level, until each document has one name. Different blocks, and so different
texts, never share a name: ranks come from comparing contents, the hash only deals the work out. Two
documents are equal if they took the same number of levels and ended with the same name.

The blocks are written once and read by each later step. The first level ranks all blocks inside their
bucket, so the text moves once. Blocks that are very
common would make one bucket huge; those (found by counting hashes, at most ``1 / HOT_SHARE`` of
them) are reduced to their distinct contents by partial aggregation, ranked, and their names joined
back with an equi-join that the adaptive planner can split. Higher levels carry integers only and
name distinct pairs the same way.

Defined results: a null text equals an empty one; rows that repeat a doc_id are separate rows of the
same group and the group's keep_id is its least id among its longest texts (a null doc_id counts
last); with two rows of that id both are kept rows' ids but only ``kept`` rows with that id and
the longest text stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, prepare, rows_that_stay, written

BLOCK = 4096
BUCKETS = 1 << 20
#: A block whose hash is that of more than this share of all blocks, and of HOT_LEAST, is common.
HOT_SHARE = 1 / 2000
HOT_LEAST = 200


def normalised(text: Column) -> Column:
    """The text without [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES + "+", "")


def _rank_name(bucket: Column, rank: Column) -> Column:
    """A positive integer: 20 bits of bucket, 41 of rank; one more is left for the caller."""
    return F.shiftleft(bucket.cast("long"), 41) + rank


def _named_distinct(df: DataFrame, content: list[str]) -> DataFrame:
    """Distinct ``content`` with an integer ``name`` each."""
    distinct = df.groupBy(*content).agg(F.lit(1).alias("_one")).drop("_one")
    bucket = F.pmod(F.xxhash64(*content), F.lit(BUCKETS))
    distinct = distinct.withColumn("_b", bucket)
    order = W.partitionBy("_b").orderBy(*content)
    return distinct.withColumn("name", _rank_name(F.col("_b"), F.row_number().over(order).cast("long"))).drop("_b")


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """A row per document and block; document facts ride on block 0."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("n"),
        F.encode(normalised(F.col("text")), "UTF-8").alias("bytes"),
    ).withColumns({"row": F.monotonically_increasing_id(), "sha": F.sha2("bytes", 256)})
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("bytes"), i * block + 1, F.lit(block)))
    first = F.col("place") == 0
    return base.select("*", F.posexplode(cut).alias("place", "block"), count.alias("blocks")).select(
        "row",
        "place",
        "blocks",
        "block",
        F.when(first, F.col("doc_id")).alias("doc_id"),
        F.when(first, F.col("n")).alias("n"),
        F.when(first, F.col("sha")).alias("sha"),
    )


def _name_blocks(docs: DataFrame, block: int) -> DataFrame:
    # Written once: row numbers stay what they are if a task runs again, and texts are scanned once.
    rows = written(_blocks(docs, block).withColumn("_h", F.xxhash64("block")), "blocks")
    counts = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts.where(F.col("_n") > HOT_LEAST), "counts")
    n = rows.where("place = 0").count()
    hot = [r[0] for r in counts.where(F.col("_n") > max(HOT_LEAST, int(n * HOT_SHARE))).orderBy(F.desc("_n"), "_h").limit(int(1 / HOT_SHARE)).select("_h").collect()]
    common = F.col("_h").isin(hot) if hot else F.lit(False)
    keep = ["row", "place", "blocks", "doc_id", "n", "sha", "name"]
    bucket = F.pmod(F.col("_h"), F.lit(BUCKETS))
    order = W.partitionBy("_b").orderBy("block")
    rare = rows.where(~common).withColumn("_b", bucket)
    # Even names for rare blocks, odd ones for common ones: no name is used twice.
    rare = rare.withColumn("name", 2 * _rank_name(F.col("_b"), F.dense_rank().over(order).cast("long"))).select(*keep)
    if not hot:
        return written(rare, "names")
    often = rows.where(common)
    names = _named_distinct(often, ["_h", "block"]).withColumn("name", 2 * F.col("name") + 1)
    often = often.join(names, ["_h", "block"]).select(*keep)
    return written(rare.unionByName(often), "names")


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: row, doc_id, n, sha, levels, name; (levels, name) is the identity."""
    prepare(docs.sparkSession)
    at = _name_blocks(docs, block)
    most = at.agg(F.max("blocks")).first()[0] or 1
    facts = at.where("place = 0").select("row", "doc_id", "n", "sha", "blocks", "name")
    done = facts.where("blocks = 1").withColumn("levels", F.lit(0))
    rest, level = at.where("blocks > 1").select("row", "place", "blocks", "name"), 0
    ended = None
    size = most
    while size > 1:
        size, level = -(-size // 2), level + 1
        pairs = rest.groupBy("row", (F.col("place") / 2).cast("int").alias("place"), "blocks").agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(0)).alias("right"),
        )
        pairs = pairs.withColumn("blocks", F.ceil(F.col("blocks") / 2).cast("int"))
        pairs = written(pairs, "pairs")
        names = _named_distinct(pairs, ["left", "right"])
        rest = written(pairs.join(names, ["left", "right"]).select("row", "place", "blocks", "name"), "level")
        over = rest.where("blocks = 1").select("row", "name", F.lit(level).alias("levels"))
        ended = over if ended is None else ended.unionByName(over)
        rest = rest.where("blocks > 1")
    out = done.select("row", "doc_id", "n", "sha", "levels", "name")
    if ended is not None:
        long = facts.where("blocks > 1").drop("name", "blocks").join(ended, "row")
        out = out.unionByName(long.select("row", "doc_id", "n", "sha", "levels", "name"))
    return out


def duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    named = identities(docs, block)
    # Longest first, then the least id, null ids last.
    best = F.min(F.struct(-F.col("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    groups = named.groupBy("levels", "name").agg(best, F.count(F.lit(1)).alias("group_size"))
    return named.join(groups, ["levels", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def representatives(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` of which each group of equal texts keeps one, the one that is ``kept``."""
    got = duplicates(docs, block).select("doc_id", F.col("text_sha256").alias("text_key"), "kept")
    return rows_that_stay(docs, F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256), got)
