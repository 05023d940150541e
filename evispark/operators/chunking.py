"""Chunking: line modes, block runs, greedy packing of sentences and blocks.

Line modes and runs are folds over each row's own lines. Packing keeps a carry from chunk to chunk, which
no window expresses, so it is a fold per document in an Arrow UDF: parallel over documents and
without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark.functions import text as T

CHUNK = "array<struct<ord:int,heading:string,start:int,end:int,text:string>>"
_KIND = pa.list_(pa.struct([("ord", pa.int32()), ("heading", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_HEADING = re.compile(r"^\s*(#{1,6})\s+(.+?)\s*$")


def line_mode(line: Column) -> Column:
    return (
        F.when(T.strip(line) == "", "blank")
        .when(T.heading_level(line).isNotNull(), "heading")
        .when(line.rlike(T.BULLET), "list")
        .when(line.contains("|"), "table")
        .otherwise("text")
    )


def block_runs(docs: DataFrame) -> DataFrame:
    """doc_id, block, mode, n_lines, first_line, chars: consecutive lines of one mode; headings stand
    alone; blank lines separate. A fold over each row's own lines: nothing is shuffled."""
    found = docs.select("doc_id", F.split("text", "\n").alias("_l"))
    found = found.withColumn("_m", F.transform("_l", line_mode))
    fresh = F.filter(
        F.sequence(F.lit(0), F.size("_m") - 1),
        lambda i: (i == 0) | (F.get("_m", i) == "heading") | (F.get("_m", i) != F.get("_m", i - 1)),
    )
    found = found.withColumn("_s", fresh)

    def block(at: Column, k: Column) -> Column:
        n = F.coalesce(F.get("_s", k + 1), F.size("_m")) - at
        chars = F.aggregate(F.slice("_l", at + 1, n), F.lit(0).cast("long"), lambda a, x: a + F.length(x))
        return F.struct((k + 1).cast("long").alias("block"), F.get("_m", at).alias("mode"), n.cast("long").alias("n_lines"), at.cast("long").alias("first_line"), chars.alias("chars"))

    runs = F.filter(F.transform("_s", block), lambda b: b["mode"] != "blank")
    return found.select("doc_id", F.explode(runs).alias("b")).select("doc_id", "b.*")


def with_context(blocks: DataFrame, last_line: str = "last_line") -> DataFrame:
    """Adds the previous block's last line where that introduces this block."""
    before = F.lag(last_line).over(W.partitionBy("doc_id").orderBy("block"))
    return blocks.withColumn("context", F.when(before.endswith(":") | T.heading_level(before).isNotNull(), before))


def pack(text: str, most: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Greedy (start, end) spans of whole sentences up to ``most`` characters. A longer sentence is
    cut at its last blank past three fifths of the room, with ``overlap`` characters repeated."""
    spans, at = [], 0
    for m in [*_SENTENCE.finditer(text), None]:
        spans.append((at, m.start() if m else len(text)))
        at = m.end() if m else at
    out: list[tuple[int, int]] = []
    for a, b in spans:
        while b - a > most:
            cut = text.rfind(" ", a + most * 3 // 5, a + most)
            cut = cut if cut > a else a + most
            out.append((a, cut))
            a = max(a + 1, cut - overlap) if overlap else cut
        if out and b - out[-1][0] <= most and out[-1][1] <= a:
            out[-1] = (out[-1][0], b)
        elif b > a:
            out.append((a, b))
    return out


def sections(text: str) -> list[tuple[str, int, int]]:
    """(heading path, start, end) by markdown headings; deeper ones nest."""
    stack: list[tuple[int, str]] = []
    out, begin, at = [], 0, 0
    for line in text.split("\n"):
        if m := _HEADING.match(line):
            if at > begin:
                out.append((" > ".join(h for _, h in stack), begin, at))
            level = len(m[1])
            stack = [(k, h) for k, h in stack if k < level] + [(level, " ".join(m[2].split()))]
            begin = at
        at += len(line) + 1
    out.append((" > ".join(h for _, h in stack), begin, len(text)))
    return [s for s in out if text[s[1] : s[2]].strip()]


def chunks(docs: DataFrame, most: int = 5200, overlap: int = 0) -> DataFrame:
    """doc_id, chunk_id, ord, heading, start, end, text of every chunk of every document."""

    @F.arrow_udf(CHUNK)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for text in batch.to_pylist():
                found = []
                for heading, a, b in sections(text or ""):
                    for s, e in pack(text[a:b], most, overlap):
                        if piece := text[a + s : a + e].strip():
                            found.append({"ord": len(found), "heading": heading, "start": a + s, "end": a + e, "text": piece})
                rows.append(found)
            yield pa.array(rows, _KIND)

    got = docs.select("doc_id", F.explode(cut("text")).alias("c")).select("doc_id", "c.*")
    return got.withColumn("chunk_id", F.format_string("doc-%d-c%03d", "doc_id", "ord"))


def quality_gate(chunks_: DataFrame, salient: list[str], text: str = "text") -> DataFrame:
    """Drops chunks that are short or hold under two sentences, unless they are salient."""
    low = (F.length(text) < 300) | (T.sentence_count(F.col(text)) < 2)
    marked = F.lit(False)
    for word in salient:
        marked = marked | F.lower(text).contains(word)
    return chunks_.where(~low | marked)
