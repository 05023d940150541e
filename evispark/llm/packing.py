"""Order-preserving packing of documents into sequences by dynamic programming.

Documents in doc_id order form one stream of ids. Windows of the stream become sequences. A window
may end at a document end (free), after a sentence (a truncation penalty), or after any chunk or,
where nothing else is near, inside one (a larger penalty). The cheapest set of cuts minimises

    sum over windows of padding(length) + SEQUENCE_COST + penalty(cut)

with padding(length) = size - length, or 0 if the length is a power of two. The first form is
``size - pos[j] + (best[i] + pos[i])``, so the best i of the last ``size`` ids is the head of a
monotone queue; the power-of-two windows are a few exact look-ups per cut. Each cut is pushed and
popped once: linear time.

Blocks of about ``BLOCK`` ids are solved one after another inside a range partition, which bounds
memory; a block may end inside a very long document.

Defined results: a null or empty text is the end id alone; rows with one doc_id are separate
documents in the order of a hash of their texts; null doc_ids come first; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import in_id_order, prepare, texts

SIZE = 2048
#: Ids solved at once.
BLOCK = 1 << 18
#: In units of one padding id: any sequence at all, a cut after a sentence, elsewhere.
SEQUENCE_COST, SENTENCE_CUT, OTHER_CUT = 8, 4, 24
#: Power-of-two lengths that a window may have without padding.
POWERS = [1 << k for k in range(11)]
#: Chunk ends become candidate cuts where sentence ends lie farther apart than this.
SPARSE = 64

END_ID = 1
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long"
)
NAMES = [x.split()[0] for x in PIECES.split(", ")]


def best_cuts(pos: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices of the cheapest cuts of candidates ``pos`` (ascending, from 0, gaps at most ``size``)."""
    m = len(pos) - 1
    place = np.full(int(pos[-1]) + 1, -1)
    place[pos[::-1]] = np.arange(m, -1, -1)
    before = [np.where(pos >= p, place[np.maximum(pos - p, 0)], -1) for p in POWERS if p < size]
    # Of each cut, those a power of two before it: exact[first[j] : first[j + 1]].
    at, _ = np.nonzero((before := np.array(before, np.int64).reshape(-1, m + 1).T) >= 0)
    exact, first = before[before >= 0].tolist(), np.searchsorted(at, np.arange(m + 2)).tolist()
    where, cost = pos.tolist(), penalty.tolist()
    best, back = [0] * (m + 1), [0] * (m + 1)
    queue, values, head = [0] * (m + 1), [0] * (m + 1), 0
    tail = 0
    for j in range(1, m + 1):
        at, value = where[j], best[j - 1] + where[j - 1]
        while tail > head and values[tail - 1] >= value:
            tail -= 1
        queue[tail], values[tail] = j - 1, value
        tail += 1
        while where[queue[head]] < at - size:
            head += 1
        least, arg = values[head] + size - at, queue[head]
        for i in exact[first[j] : first[j + 1]]:
            if best[i] < least:
                least, arg = best[i], i
        best[j], back[j] = least + SEQUENCE_COST + cost[j], arg
    cuts, j = [], m
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def _fill(pos: np.ndarray, penalty: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Add cuts where neighbours are farther apart than ``size``."""
    gaps = np.nonzero(np.diff(pos) > size)[0]
    if not len(gaps):
        return pos, penalty
    step = max(1, size // 2)
    more = np.concatenate([np.arange(pos[g] + step, pos[g + 1], step) for g in gaps])
    at = np.searchsorted(pos, more)
    return np.insert(pos, at, more), np.insert(penalty, at, OTHER_CUT)


class Block:
    """Consecutive pieces of documents that are cut together."""

    def __init__(self, size: int):
        self.size, self.docs, self.n = size, [], 0
        self.pos: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.penalty: list[np.ndarray] = [np.zeros(1, np.int64)]

    def add(self, doc_id, start: int, ids: np.ndarray, total: int, pos: np.ndarray, penalty: np.ndarray) -> None:
        self.docs.append((doc_id, start, ids, total))
        self.pos.append(pos + self.n)
        self.penalty.append(penalty)
        self.n += len(ids)

    def pieces(self, first_sequence: int) -> tuple[list[tuple], int]:
        pos, penalty = _fill(np.concatenate(self.pos), np.concatenate(self.penalty), self.size)
        ends = pos[best_cuts(pos, penalty, self.size)].tolist()
        rows, k, begin, number = [], 0, 0, first_sequence
        at = 0
        for doc_id, start, ids, total in self.docs:
            upto, done = at + len(ids), 0
            raw = memoryview(np.ascontiguousarray(ids)).cast("B")
            while at < upto:
                stop = min(upto, ends[k])
                length = stop - at
                rows.append((doc_id, start + done, length, zlib.crc32(raw[4 * done : 4 * (done + length)]), total, number, at - begin, ends[k] - begin))
                at, done = stop, done + length
                if at == ends[k]:
                    begin, k, number = at, k + 1, number + 1
        return rows, number


def document_cuts(encoder: ChunkEncoder, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids with the end id, candidate cuts, their penalties) of one document."""
    ids = np.frombuffer(b"".join(encoded) + END_ID.to_bytes(4, "little"), "<u4")
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    ends = np.cumsum(sizes[sizes > 0]) >> 2
    if not len(ends):
        return ids, np.array([len(ids)]), np.zeros(1, np.int64)
    sentence = encoder.sentence_end[ids[ends - 1]]
    full, keep = ends[sentence], sentence
    if not len(full) or full[0] > SPARSE or (full[1:] - full[:-1]).max(initial=0) > SPARSE or len(ids) - full[-1] > SPARSE:
        block = ends // SPARSE  # the last chunk end of each stretch without a sentence end
        last = np.append(block[1:] != block[:-1], True)
        keep = sentence | last
    # Chunks end before the end id, so the document's end is one cut more.
    pos, penalty = np.concatenate((ends[keep], [len(ids)])), np.zeros(int(keep.sum()) + 1, np.int64)
    penalty[:-1] = np.where(sentence[keep], SENTENCE_CUT, OTHER_CUT)
    return ids, pos, penalty


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """Pieces of all documents; see the module text. ``sequence_id`` rises with doc_id."""
    spark = docs.sparkSession
    prepare(spark)

    def run(batches):
        from pyspark import TaskContext

        encoder, number = ChunkEncoder.at(tokenizer), TaskContext.get().partitionId() << 32
        now = Block(size)

        def out(rows):
            kinds = [pa.int64()] * len(NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], NAMES)

        for batch in batches:
            for doc_id, encoded in zip(batch.column(0).to_pylist(), encoder.batch(batch.column(1).to_pylist())):
                ids, pos, penalty = document_cuts(encoder, encoded)
                total, start = len(ids), 0
                while start < total:  # a document longer than the block's room goes on in the next
                    room = max(size, block - now.n)
                    if total - start <= max(room, block // 2):
                        stop = total
                    else:
                        stop = int(pos[max(0, np.searchsorted(pos, start + room, "right") - 1)])
                        stop = stop if stop > start else start + room
                    where, cost = pos, penalty
                    if stop - start < total:
                        inside = (pos > start) & (pos <= stop)
                        where, cost = pos[inside] - start, penalty[inside]
                    if not len(where) or where[-1] != stop - start:
                        where, cost = np.append(where, stop - start), np.append(cost, OTHER_CUT)
                    now.add(doc_id, start, ids[start:stop], total, where, cost)
                    start = stop
                    if now.n >= block:
                        rows, number = now.pieces(number)
                        yield out(rows)
                        now = Block(size)
        if now.n:
            yield out(now.pieces(number)[0])

    return in_id_order(texts(docs), F.xxhash64("text")).mapInArrow(run, PIECES)
