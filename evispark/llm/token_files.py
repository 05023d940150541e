"""Token-id files: independent zstandard frames, a trailing seek table, a checksum per frame.

Layout of a shard (``*.ztok``), readable by any zstandard decoder as one stream:

* one frame per document (a document of over ``FRAME_TOKENS`` ids takes several), each the ids as
  little-endian unsigned 32-bit integers;
* a skippable frame (0x184D2A50) with the document index: count, doc_ids, null flags, first frames;
* a skippable frame (0x184D2A5E) with the seek table of the zstandard seekable format: compressed
  size, decompressed size and low 32 bits of XXH64 for each frame, then frame count, descriptor
  (checksum flag) and the magic number 0x8F92EAB1.

A reader takes the tail, finds a document's frames and decompresses those alone.

Defined results: a null or empty text is a document of the end id alone; rows with the same doc_id
are separate documents, in the order of a hash of their texts; null doc_ids come first; an empty
table writes an empty manifest; other columns are ignored; a very long text is cut into frames, so
readers hold one frame at a time.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import in_id_order, new_folder, prepare, texts

# Fixed values of the zstandard formats.
INDEX_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
FOOT_MAGIC = 0x8F92EAB1

#: Most ids in a frame; a shard is closed once it holds so many bytes or documents.
FRAME_TOKENS = 1 << 20
SHARD_BYTES = 256 << 20
SHARD_DOCS = 2_000_000

END_ID = 1
_READ = 8 << 20

MANIFEST = "partition int, seq int, name string, docs long, tokens long, bytes long, least_id long, most_id long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _filesystem(folder: str):
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


class ShardWriter:
    """Writes one shard beside its final name and moves it there when whole, so that a task that
    dies or runs twice leaves no half file under a final name."""

    def __init__(self, folder: str, name: str, level: int):
        import xxhash
        import zstandard

        self.fs, root = _filesystem(folder)
        self.final, self.temp = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.sum = lambda b: xxhash.xxh64_intdigest(b) & 0xFFFFFFFF
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.first: list[int] = []
        self.tokens = self.bytes = 0

    def _put(self, frame: bytes, plain: int, check: int) -> None:
        self.out.write(frame)
        self.table.append((len(frame), plain, check))
        self.bytes += len(frame)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.first.append(len(self.table))
        for at in range(0, len(ids), 4 * FRAME_TOKENS):
            part = ids[at : at + 4 * FRAME_TOKENS]
            self._put(self.pack(part), len(part), self.sum(part))
        self.tokens += len(ids) // 4

    def close(self) -> tuple[int, int, int, int | None, int | None]:
        """Documents, tokens, bytes, least and greatest doc_id (null: no document has one)."""
        index = struct.pack("<Q", len(self.ids))
        index += np.array([x or 0 for x in self.ids], "<i8").tobytes()
        index += np.array([x is None for x in self.ids], "u1").tobytes()
        index += np.array(self.first, "<u4").tobytes()
        self._put(struct.pack("<II", INDEX_MAGIC, len(index)) + index, 0, self.sum(b""))
        body = np.array(self.table, "<u4").tobytes()
        foot = struct.pack("<IBI", len(self.table), 0x80, FOOT_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(body) + len(foot)) + body + foot)
        self.out.close()
        self.fs.move(self.temp, self.final)
        named = [x for x in self.ids if x is not None]
        return len(self.ids), self.tokens, self.bytes + 8 + len(body) + len(foot), min(named, default=None), max(named, default=None)


@dataclass
class Shard:
    """An open shard: its index, and documents on request."""

    source: object
    doc_ids: np.ndarray
    null: np.ndarray
    first: np.ndarray
    table: np.ndarray
    offsets: np.ndarray

    @classmethod
    def open(cls, folder: str, name: str) -> "Shard":
        files, root = _filesystem(folder)
        source = files.open_input_file(f"{root}/{name}")
        size = source.size()
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOT_MAGIC or not flags & 0x80:
            raise ValueError(f"{name}: no seek table")
        source.seek(size - 9 - 12 * frames)
        table = np.frombuffer(source.read(12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(table[:, 0])])
        source.seek(int(offsets[-2]))
        magic, length = struct.unpack("<II", source.read(8))
        if magic != INDEX_MAGIC:
            raise ValueError(f"{name}: no document index")
        index = source.read(length)
        n = struct.unpack_from("<Q", index)[0]
        ids, null = np.frombuffer(index, "<i8", n, 8), np.frombuffer(index, "u1", n, 8 + 8 * n) > 0
        first = np.frombuffer(index, "<u4", n, 8 + 9 * n).astype(np.int64)
        return cls(source, ids, null, np.append(first, frames - 1), table[:-1], offsets)

    def _frames(self, lo: int, hi: int) -> Iterator[bytes]:
        """The decompressed, verified frames lo..hi-1, fetched a few MB at a time."""
        import xxhash
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        while lo < hi:
            upto = int(np.searchsorted(self.offsets, self.offsets[lo] + _READ, "right")) - 1
            upto = min(hi, max(upto, lo + 1))
            self.source.seek(int(self.offsets[lo]))
            base = int(self.offsets[lo])
            block = memoryview(self.source.read(int(self.offsets[upto]) - base))
            for k in range(lo, upto):
                data = unpack(block[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base])
                _, plain, check = self.table[k]
                if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                    raise ValueError(f"frame {k} is damaged")
                yield data
            lo = upto

    def document(self, at: int) -> np.ndarray:
        """Ids of the document at this place of the index; no other frame is read."""
        return np.frombuffer(b"".join(self._frames(int(self.first[at]), int(self.first[at + 1]))), "<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        return [self.document(int(k)) for k in np.nonzero((self.doc_ids == doc_id) & ~self.null)[0]]

    def digests(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, tokens, crc32 of the ids) of every document, from the frames."""
        frames = self._frames(0, len(self.table))
        for k in range(len(self.doc_ids)):
            crc = size = 0
            for _ in range(int(self.first[k]), int(self.first[k + 1])):
                data = next(frames)
                crc, size = zlib.crc32(data, crc), size + len(data)
            yield (None if self.null[k] else int(self.doc_ids[k])), size // 4, crc


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, level: int = 3) -> str:
    """Tokenize ``docs`` and write shards in ascending doc_id order; returns the folder.

    Ranges of doc_id become partitions and each partition streams its sorted rows into its own
    shards, so memory holds one Arrow batch and one frame. A manifest (Parquet, one row per shard
    that a successful task reported) makes the output whole: readers follow it, not the listing.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or new_folder(spark, "tokens")
    fs, root = _filesystem(folder)
    fs.create_dir(root)
    end = struct.pack("<I", END_ID)

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, out, seq, rows = ChunkEncoder.at(tokenizer), None, 0, []

        def close():
            rows.append((part, seq, out.final.rsplit("/", 1)[1], *out.close()))

        for batch in batches:
            ids, texts_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, encoded in zip(ids, encoder.batch(texts_)):
                if out is None:
                    out = ShardWriter(folder, f"part-{part:07d}-{seq:04d}.ztok", level)
                out.add(doc_id, b"".join(encoded) + end)
                if out.bytes >= SHARD_BYTES or len(out.ids) >= SHARD_DOCS:
                    close()
                    out, seq = None, seq + 1
        if out is not None:
            close()
        if rows:
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    ordered = in_id_order(texts(docs), F.xxhash64("text"))
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Shards in order, with ``base``: the ids in all shards before. One row per shard."""
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = W.orderBy("partition", "seq").rowsBetween(W.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before), n_tokens and
    ids_crc32, each frame decompressed and checked."""
    prepare(spark)
    shards = manifest(spark, folder)
    n = max(1, shards.count())

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                start, rows = row["base"], []
                for doc_id, tokens, crc in Shard.open(folder, row["name"]).digests():
                    rows.append((doc_id, start, tokens, crc))
                    start += tokens
                    if len(rows) >= 20_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return shards.repartitionByRange(n, "partition", "seq").mapInArrow(read, ROWS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Ids of the documents named by the caller: (doc_id, ids array<int>). Only shards whose range of
    doc_ids holds one are opened, and only the wanted frames decompressed."""
    prepare(spark)
    wanted = np.array(sorted(set(doc_ids)), np.int64)
    if not len(wanted):
        return spark.createDataFrame([], "doc_id long, ids array<int>")

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                shard = Shard.open(folder, name)
                for at in np.nonzero(np.isin(shard.doc_ids, wanted) & ~shard.null)[0].tolist():
                    ids = pa.array([shard.document(at).astype("i4")], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array([int(shard.doc_ids[at])]), ids], ["doc_id", "ids"])

    asked = F.broadcast(spark.createDataFrame([(int(x),) for x in wanted], "_wanted long"))  # the caller's list
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    shards = shards.join(asked, F.col("_wanted").between(F.col("least_id"), F.col("most_id")), "left_semi")
    return shards.select("name").repartition("name").mapInArrow(read, "doc_id long, ids array<int>")
