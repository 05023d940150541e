"""Documents to chunks that respect their structure: sections by headings, then blocks (paragraphs,
lists, tables) that are cut by their own rules and packed together up to a size.

A chunk's extent depends on all before it in its section, which no window expresses, so it is a fold per
document in an Arrow UDF: parallel over documents, no shuffle, ids numbered after the quality gate.

Every piece knows where it comes from: ``start`` and ``end`` are the extent of its own text in the
document, also where a table's header or an introducing line is repeated in front of it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.functions import text as T
from evispark.operators.chunking import pack

LIST_LEAST, LIST_MOST = 6, 12
GENERAL = "General"

_MARKDOWN, _NUMBERED, _UPPER = re.compile(T.MARKDOWN_HEADING), re.compile(T.NUMBERED_HEADING), re.compile(T.UPPER_HEADING)
_BULLET = re.compile(T.BULLET)
_CLOSED = re.compile(r"[.!?](?:\s|$)")
_LINE = re.compile(r"[^\n]*\n?")


@dataclass
class Span:
    """A stretch of the document, with text that is repeated in front of it."""

    start: int
    end: int
    lead: str = ""


@dataclass
class Options:
    most: int = 5200
    overlap: int = 480
    semantic: bool = False
    salient: list[str] = field(default_factory=lambda: L.SALIENT)

    @property
    def listed(self) -> int:
        """Room for a piece of a list or table."""
        return max(500, min(self.most, max(1400, min(1800, int(0.45 * self.most))))) if self.semantic else self.most


def heading(line: str) -> tuple[int, str] | None:
    """(level, label) of a markdown, numbered or upper-case heading."""
    line = line.strip()
    if m := _MARKDOWN.match(line):
        return len(m[1]), " ".join(m[2].split())
    if m := _NUMBERED.match(line):
        return min(6, m[1].count(".") + 1), " ".join(m[2].split())
    if m := _UPPER.match(line):
        return 1, " ".join(m[1].split()).title()
    return None


def lines(text: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, str]]:
    """(start, end, line) without line ends; ``end`` of a line is where its text ends."""
    at, end = start, len(text) if end is None else end
    while at < end:
        found = _LINE.match(text, at, end)
        raw = found[0]
        yield at, at + len(raw.rstrip("\r\n")), raw.rstrip("\r\n")
        at = found.end()


def structured(text: Column) -> Column:
    """One markdown heading, or two of the other kinds."""
    found = F.split(text, r"\r?\n")
    markdown = F.size(F.filter(found, lambda s: s.rlike(T.MARKDOWN_HEADING)))
    other = F.size(F.filter(found, lambda s: ~s.rlike(T.MARKDOWN_HEADING) & T.heading_level(T.strip(s)).isNotNull()))
    return (markdown >= 1) | (other >= 2)


def looks_structured(text: str) -> bool:
    kinds = [bool(_MARKDOWN.match(line.strip())) for _, _, line in lines(text) if heading(line)]
    return any(kinds) or len(kinds) >= 2


def section_ids(table: DataFrame) -> DataFrame:
    """Adds section (number of headings so far) and level (the last heading's) to lines (doc_id, pos, line)."""
    order = W.partitionBy("doc_id").orderBy("pos")
    level = T.heading_level(T.strip(F.col("line")))
    found = table.withColumn("own", level).withColumn("section", F.count("own").over(order))
    return found.withColumn("level", F.last("own", ignorenulls=True).over(order)).drop("own")


def sections(text: str) -> list[tuple[list[str], int, int]]:
    """(heading path, start, end): a heading opens a section and closes those of its level and deeper."""
    found: list[tuple[list[str], int, int]] = []
    stack: list[tuple[int, str]] = []
    begin = 0
    for a, _, line in lines(text):
        if told := heading(line):
            found.append(([label for _, label in stack], begin, a))
            stack = [s for s in stack if s[0] < told[0]] + [told]
            begin = a
    found.append(([label for _, label in stack], begin, len(text)))
    return [(path or [GENERAL], a, b) for path, a, b in found if text[a:b].strip()]


def mode_of(line: str) -> str:
    if not line.strip():
        return "blank"
    if heading(line):
        return "heading"
    return "list" if _BULLET.match(line) else "table" if "|" in line else "text"


def blocks(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """(mode, start, end) of runs of lines of one mode; headings stand alone, blank lines part."""
    out: list[tuple[str, int, int]] = []
    last = "blank"
    for a, b, line in lines(text, start, end):
        mode = mode_of(line)
        if mode != "blank":
            if mode == last and mode != "heading":
                out[-1] = (mode, out[-1][1], b)
            else:
                out.append((mode, a, b))
        last = mode
    return out


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def long_pieces(text: str, a: int, b: int, most: int, overlap: int = 0) -> list[Span]:
    """Whole sentences up to ``most`` characters, or lines if there is one sentence only."""
    spans = [(a + s, a + e) for s, e in pack(text[a:b], most, overlap)]
    return [Span(*t) for t in (_trimmed(text, *s) for s in spans) if t[0] < t[1]]


def list_pieces(text: str, a: int, b: int, most: int) -> list[Span]:
    """Whole entries, ``LIST_LEAST`` to ``LIST_MOST`` of them to a piece; fewer only where more can't
    be had, more than fit only up to the least."""
    if b - a <= most:
        return [Span(a, b)]
    starts = [s for s, _, line in lines(text, a, b) if _BULLET.match(line)] or [a]
    starts[0] = a
    entries = list(zip(starts, [*starts[1:], b]))
    if len(entries) == 1:
        return long_pieces(text, a, b, most)
    out, held = [], []
    for entry in entries:
        full = len(held) >= LIST_MOST or len(held) >= LIST_LEAST and entry[1] - held[0][0] > most
        if full:
            out.append((held[0][0], held[-1][1]))
            held = []
        held.append(entry)
    out.append((held[0][0], held[-1][1]))
    pieces = [_trimmed(text, *p) for p in out]
    return [s for p in pieces for s in ([Span(*p)] if p[1] - p[0] <= most else long_pieces(text, *p, most))]


def table_pieces(text: str, a: int, b: int, most: int) -> list[Span]:
    """Whole rows, each piece after the table's header: its first line and a rule below it."""
    rows = [(s, e) for s, e, line in lines(text, a, b) if line.strip()]
    if b - a <= most or len(rows) <= 2:
        return [Span(a, b)] if b - a <= most else long_pieces(text, a, b, most)
    rule = set(text[slice(*rows[1])].replace("|", "").strip()) <= {"-", ":"}
    n = 2 if rule else 1
    header = "\n".join(text[s:e] for s, e in rows[:n])
    out, size = [], len(header)
    for s, e in rows[n:]:
        if out and size + e - s + 1 <= most:
            out[-1].end, size = e, size + e - s + 1
        else:
            first = not out
            out.append(Span(a if first else s, e, "" if first else header))
            size = len(header) + e - s + 1
    return out


def context_line(text: str, block: tuple[str, int, int] | None) -> str:
    """A block's last line, if it introduces what follows: it ends with a colon or is a heading."""
    if not block:
        return ""
    last = text[block[1] : block[2]].rstrip().rsplit("\n", 1)[-1].strip()
    return last if last.endswith(":") or block[0] == "heading" else ""


def packed(text: str, start: int, end: int, options: Options) -> list[tuple[int, int, str]]:
    """(start, end, chunk) of one section: blocks' pieces joined by blank lines while they fit."""
    start, end = _trimmed(text, start, end)
    if end - start <= options.most:
        return [(start, end, text[start:end])] if start < end else []
    out: list[tuple[int, int, str]] = []
    before = None
    open_ = False
    for block in blocks(text, start, end):
        mode, a, b = block
        if mode == "list":
            found = list_pieces(text, a, b, options.listed)
        elif mode == "table":
            found = table_pieces(text, a, b, options.listed)
        else:
            found = long_pieces(text, a, b, options.most, options.overlap) if b - a > options.most else [Span(a, b)]
        lead = context_line(text, before) if mode in ("list", "table") else ""
        for piece in found:
            own = "\n".join(x for x in (piece.lead, text[piece.start : piece.end]) if x)
            if lead and lead not in own and not (open_ and out[-1][2].endswith(lead)):
                own = f"{lead}\n{own}"
            if open_ and len(out[-1][2]) + 2 + len(own) <= options.most:
                out[-1] = (out[-1][0], piece.end, f"{out[-1][2]}\n\n{own}")
            else:
                out.append((piece.start, piece.end, own))
            open_ = True
        before = block
    return out


def passes(text: str, salient: list[str]) -> bool:
    """Long enough with two sentences, or with a word that matters."""
    low = text.lower()
    return len(text) >= 300 and len(_CLOSED.findall(text)) >= 2 or any(w in low for w in salient)


def document_chunks(text: str, source_type: str, options: Options) -> list[dict]:
    """Chunks of one document. Pasted text is never cut at headings, files only in semantic mode; the
    quality gate is for pages."""
    by_heading = (source_type == "url" or source_type == "file" and options.semantic) and looks_structured(text)
    parts = sections(text) if by_heading else [([GENERAL], 0, len(text))]
    rows: list[dict] = []
    for path, a, b in parts:
        for start, end, chunk in packed(text, a, b, options):
            if chunk and (source_type != "url" or passes(chunk, options.salient)):
                rows.append({"ord": len(rows) + 1, "section": path[-1], "path": path, "start": start, "end": end, "text": chunk})
    return rows


_KIND = pa.list_(pa.struct([("ord", pa.int32()), ("section", pa.string()), ("path", pa.list_(pa.string())), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))


def chunk_documents(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """doc_id, chunk_id, ord, section, heading_path, start_char, end_char, is_list, is_table, nav_score,
    text of every chunk of ``docs`` (doc_id, source_type, text)."""
    options = options or Options()

    @F.arrow_udf("array<struct<ord:int,section:string,path:array<string>,start:int,end:int,text:string>>")
    def cut(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        return pa.array([document_chunks(t or "", k or "text", options) for t, k in zip(texts.to_pylist(), kinds.to_pylist())], _KIND)

    got = docs.select("doc_id", F.explode(cut(F.col("text"), F.col("source_type"))).alias("c")).select("doc_id", "c.*")
    text = F.col("text")
    return got.select(
        "doc_id", F.format_string("%s-c%03d", F.col("doc_id").cast("string"), "ord").alias("chunk_id"), "ord", "section", F.col("path").alias("heading_path"),
        F.col("start").alias("start_char"), F.col("end").alias("end_char"), T.is_list(text).alias("is_list"), T.is_table(text).alias("is_table"), T.nav_balance(text).alias("nav_score"), "text",
    )


def chunk_statistics(chunks: DataFrame, gate: list[str] | None = None) -> DataFrame:
    """One row: chunks by type, those kept for a word alone, their mean size."""
    kind = F.when(F.col("is_list"), "list").when(F.col("is_table"), "table").otherwise("prose")
    short = (F.length("text") < 300) | (T.sentence_count(F.col("text")) < 2)
    marked = F.lit(False)
    for word in L.SALIENT if gate is None else gate:
        marked = marked | F.contains(F.lower("text"), F.lit(word))
    counts = [F.count_if(kind == k).alias(k) for k in ("list", "table", "prose")]
    return chunks.agg(F.count(F.lit(1)).alias("kept"), *counts, F.count_if(short & marked).alias("short_but_salient"), F.round(F.coalesce(F.avg(F.length("text")), F.lit(0.0)), 2).alias("mean_chars"))
