"""Shards by fixed virtual slots: records hash into thousands of slots, a versioned map places slots.

A record's slot never changes. The map from slots to shards is data. Version 1, made before anything
is known of the records, deals the slots evenly; each later version is an edit of the one before that
moves only the slots that a rebalancing by measured bytes, or another shard, asks for. ``shard`` loads
the latest version of its folder, stores the edit as the next one if any slot moves, and places
records by that. Law: ``bytes``, the shards' sizes are near equal.

Per-slot bytes are partial aggregates and there are ``SLOTS`` of them at most, so the map is made on
the driver. A record's place in its shard is its slot's base (prefix sums over slots) plus its place
inside the slot, so no task sorts a whole shard. Slots are ranked in ``SPREAD`` parts each, dealt by
row, so that one id that repeats in a third of the rows is no single task.

Records hash by id, text and occurrence: rows that agree in id and text are numbered (in parts of
``PART`` rows or less, so that no task ranks all of them), the first keeps the record's own slot and the others get slots of their own. So a
row that repeats very often doesn't fill one slot, and the law holds for any rows that are small beside a shard.

Defined results: a null text has size 8 and checksum 0; a null doc_id hashes like an id of its own;
rows that repeat have places of their own; an empty table gives no rows and an even map; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_folder, prepare, written

SLOTS = 8192
SHARDS = 24
SPREAD = 16
#: Rows that agree in id and text and are numbered by one task.
PART = 10_000
OVERHEAD = 8

MAP = "version int, slot int, shard int, bytes long"


def slot_of(slots: int, again: Column) -> Column:
    """The slot of doc_id, text_crc32 and ``again``, which numbers rows that agree in the others from 0."""
    key = F.when(again == 0, F.xxhash64("doc_id", "text_crc32")).otherwise(F.xxhash64("doc_id", "text_crc32", again))
    return F.pmod(key, F.lit(slots)).cast("int")


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """Shard of every slot, before any record is seen."""
    return [slot % shards for slot in range(slots)]


def rebalanced(placed: list[int], sizes: dict[int, int], shards: int, slack: float = 0.002) -> list[int]:
    """An edit of the map: slots move from the heaviest shard to the lightest, the one nearest to half
    their gap first, until they are within ``slack`` of the mean or no move helps. A shard that no slot
    can leave (one slot of it outweighs the mean) is set aside. Also fills new shards."""
    out, load = list(placed), [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(out):
        load[shard] += sizes.get(slot, 0)
        held[shard].add(slot)
    mean, open_ = sum(load) / shards, set(range(shards))
    while open_:
        top, low = max(open_, key=lambda s: (load[s], -s)), min(range(shards), key=load.__getitem__)
        gap = load[top] - load[low]
        if gap <= slack * mean:
            break
        fit = [s for s in held[top] if 0 < sizes.get(s, 0) < gap]
        if not fit:
            open_.remove(top)
            continue
        slot = min(fit, key=lambda s: (abs(sizes[s] - gap / 2), s))
        held[top].remove(slot)
        held[low].add(slot)
        load[top], load[low], out[slot] = load[top] - sizes[slot], load[low] + sizes[slot], low
    return out


def store_map(spark: SparkSession, folder: str, version: int, placed: list[int], sizes: dict[int, int]) -> None:
    rows = [(version, slot, shard, sizes.get(slot, 0)) for slot, shard in enumerate(placed)]
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{folder}/version={version:06d}")


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{folder}/version={version:06d}")


def latest_version(spark: SparkSession, folder: str) -> int:
    """The highest version whose map was written whole; 0 if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return max((int(f.getPath().getParent().getName().rsplit("=", 1)[1]) for f in found), default=0)


def rebalance(spark: SparkSession, folder: str, sizes: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> int:
    """Edit the stored map for ``sizes`` and ``shards``; returns the version that is in force."""
    version = latest_version(spark, folder)
    if not version:
        version = 1
        store_map(spark, folder, 1, first_map(slots, shards), {})
    placed = [r["shard"] for r in load_map(spark, folder, version).orderBy("slot").select("shard").collect()]  # SLOTS rows
    if len(placed) != slots or max(placed) >= shards:
        raise ValueError(f"the map in {folder} has {len(placed)} slots in {max(placed) + 1} shards")
    edited = rebalanced(placed, sizes, shards)
    if edited != placed:
        version += 1
        store_map(spark, folder, version, edited, sizes)
    return version


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a number of each row."""
    plain = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(plain) + OVERHEAD).cast("long").alias("size"),
        F.crc32(plain).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )


def slotted(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual slot and the part of the slot that ranks the row."""
    # By size too: texts of one checksum and another size aren't the same row again.
    same, part = ["doc_id", "text_crc32", "size"], F.pmod("row", F.lit(SPREAD)).cast("int").alias("part")
    often = written(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    if often.isEmpty():
        return rows.select(*same, slot_of(slots, F.lit(0)).alias("virtual_slot"), part)
    often = often.select(*(F.col(c).alias(f"_{c}") for c in same), F.ceil(F.col("n") / PART).alias("parts"))
    match = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_crc32") == F.col("_text_crc32")) & (F.col("size") == F.col("_size"))
    met = rows.join(often, match, "left").withColumn("deal", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))))
    many = met.where("parts IS NOT NULL").withColumn("again", (F.row_number().over(W.partitionBy(*same, "deal").orderBy("row")) - 1) * F.col("parts") + F.col("deal"))
    one = met.where("parts IS NULL").withColumn("again", F.lit(0).cast("long"))
    whole = one.select(*same, "again", "row").unionByName(many.select(*same, "again", "row"))
    return whole.select(*same, slot_of(slots, F.col("again")).alias("virtual_slot"), part)


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    """Bytes of each slot: SLOTS rows at most."""
    return {r[0]: r[1] for r in rows.groupBy("virtual_slot").agg(F.sum("size")).collect()}


def place(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Adds ``shard`` and ``slot``, the row's place in its shard, gapless from 0."""
    counts = rows.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("n"))
    placed = F.broadcast(placed.select(F.col("slot").alias("virtual_slot"), "shard"))  # SLOTS rows
    before = W.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.join(placed, "virtual_slot").withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = F.broadcast(base.drop("n"))  # SLOTS * SPREAD rows at most
    inside = W.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("_k", F.row_number().over(inside)).join(base, ["virtual_slot", "part"]).withColumn("slot", F.col("base") + F.col("_k") - 1)


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot and map_version of every
    row; ``folder`` holds the versions of the map."""
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or new_folder(spark, "slot-map")
    rows = written(slotted(written(sized(docs), "sized"), slots), "slotted")
    version = rebalance(spark, folder, slot_bytes(rows), shards, slots)
    return place(rows, load_map(spark, folder, version)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(version).alias("map_version"),
    )
