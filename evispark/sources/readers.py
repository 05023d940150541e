"""Sources: files by suffix, CSV as prose, pasted text, pages; discovery of files and addresses.

Binary documents go through ``mapInArrow`` parsers, so files are read on the executors.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark.functions import html as H
from evispark.functions import text as T

SUFFIXES = (".txt", ".md", ".pdf", ".docx", ".csv")
RAW = "doc_id string, source string, source_type string, title string, content_hash string, text string"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of the supported files below ``path``, or of the one file that it names.
    A path that doesn't exist raises, and so does a single file of another kind."""
    last = path.rstrip("/").rsplit("/", 1)[-1]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if "." in last and not last.lower().endswith(SUFFIXES) and found.select("path").limit(2).count() == 1 and found.first()["path"].endswith(last):
        raise ValueError(f"{last}: not one of {', '.join(SUFFIXES)}")
    return found.where(F.lower("path").rlike("(" + "|".join(x.replace(".", r"\.") for x in SUFFIXES) + ")$"))


def parser_of(path: str, parsers: dict[str, Callable[[bytes], str]]) -> Callable[[bytes], str]:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in parsers:
        raise ValueError(f"{path}: no parser for .{suffix}")
    return parsers[suffix]


def linearized(table: DataFrame) -> DataFrame:
    """Each row of a table as 'name: value | name: value', blanks dropped."""
    cells = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string")))) for c in table.columns]
    return table.select(F.concat_ws(" | ", *cells).alias("line"))


def docx_text(data: bytes) -> str:
    body = ElementTree.parse(zipfile.ZipFile(io.BytesIO(data)).open("word/document.xml")).getroot()
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in body.iter(f"{_WORD}p"))


def pdf_text(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("PDF needs the pypdf package; pass parsers={'pdf': ...} to use another") from e
    return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)


def csv_text(data: bytes) -> str:
    import csv

    rows = list(csv.reader(io.StringIO(data.decode("utf-8", "ignore"))))
    if not rows:
        return ""
    names = [h.strip() or f"column_{i + 1}" for i, h in enumerate(rows[0])]
    out = ["CSV headers: " + " | ".join(names)]
    for row in rows[1:]:
        row_names = names + [f"column_{i + 1}" for i in range(len(names), len(row))]
        if cells := [f"{h}: {v.strip()}" for h, v in zip(row_names, row) if v.strip()]:
            out.append(" | ".join(cells))
    return "\n".join(out)


PARSERS: dict[str, Callable[[bytes], str]] = {
    "txt": lambda b: b.decode("utf-8", "ignore"),
    "md": lambda b: b.decode("utf-8", "ignore"),
    "csv": csv_text,
    "docx": docx_text,
    "pdf": pdf_text,
}


def read_files(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """source, title stem and normalized text of every file."""
    parsers = PARSERS | (parsers or {})

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [parser_of(p, parsers)(d) for p, d in zip(paths, data)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["source", "text"])

    return files(spark, path).select("path", "content").mapInArrow(parse, "source string, text string")


#: Sources that are looked at to part them into ranges for numbering.
RANGES = 200


def numbered(table: DataFrame, kind: str = "kind", key: str = "source", ranges: int = RANGES) -> DataFrame:
    """Adds _n: place by (kind, key) over the whole table, from 1, without a sort in one task.

    A bounded sample of keys parts the table into ranges; rows are numbered inside their range, after the
    rows of all ranges before. Ranges are literals, so both passes deal rows alike."""
    name = F.concat_ws("\u0000", F.col(kind).cast("string"), F.col(key))
    few = table.select(name.alias("k")).distinct().orderBy(F.xxhash64("k")).limit(ranges).collect()
    bounds = F.array(*[F.lit(r["k"]) for r in sorted(few, key=lambda r: r["k"].encode())]) if few else F.array().cast("array<string>")
    dealt = table.withColumn("_range", F.size(F.filter(bounds, lambda b: b <= name)))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    base = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_base"))  # a row a range
    inside = F.row_number().over(W.partitionBy("_range").orderBy(kind, key))
    return dealt.withColumn("_k", inside).join(F.broadcast(base), "_range").withColumn("_n", F.col("_base") + F.col("_k")).drop("_range", "_k", "_base")


def documents(spark: SparkSession, path: str | None = None, pasted: list[str] | None = None, pages: DataFrame | None = None) -> DataFrame:
    """All sources as one table: files by path, then pasted texts, then pages by address (each final
    address once). Ids count through in that order; blank texts are dropped."""
    parts = []
    if path:
        parts.append(read_files(spark, path).select(F.lit(0).alias("kind"), "source", F.lit("file").alias("source_type"), F.col("text")))
    if pasted:
        rows = [(1, f"pasted-{i:06d}", "text", t) for i, t in enumerate(pasted, 1)]
        parts.append(spark.createDataFrame(rows, "kind int, source string, source_type string, text string"))
    if pages is not None:
        first = pages.groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
        parts.append(first.select(F.lit(2).alias("kind"), F.col("url").alias("source"), F.lit("url").alias("source_type"), H.page_text("html").alias("text")))
    if not parts:
        raise ValueError("no source given")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # A generator between the parsed text and its test: a plain filter would be pushed below it and parse twice.
    once = F.explode(F.filter(F.array(T.normalize(F.col("text"))), lambda t: t != ""))
    found = numbered(found.select("kind", "source", "source_type", once.alias("text")))
    stem = F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.[^.]*$", "")
    is_file = F.col("source_type") == "file"
    title = F.when(is_file, T.file_title(F.col("text"), stem, F.lower("source").endswith(".md"))).otherwise(T.title_of(F.col("text"), stem))
    return found.select(
        F.concat(F.format_string("doc-%03d-", "_n"), T.slug(title)).alias("doc_id"), "source", "source_type", title.alias("title"), F.sha1("text").alias("content_hash"), "text"
    )


def addresses(text: Column) -> Column:
    """Addresses in free text: 'https:/x' repaired, run-together ones parted, each once."""
    fixed = F.regexp_replace(text, r"(?i)(https?):/+(?=[^/\s])", "$1://")
    parted = F.regexp_replace(fixed, r"(?i)(?<=\S)(?=https?://)", " ")
    found = F.regexp_extract_all(parted, F.lit(r"(?i)https?://[^\s,;<>\"'\)\]]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def crawl(pages: DataFrame, seeds: DataFrame, keywords: list[str], per_host: int = 8) -> DataFrame:
    """Depth-1 crawl over a table of fetched pages: each seed's links on its own host, scored, the
    best ``per_host`` of each host that were fetched."""
    found = seeds.select("url", F.explode(H.links(F.col("html"))).alias("l"))
    link = H.absolute(F.col("l.href"), F.col("url"))
    found = found.select("url", link.alias("target"), F.lower(F.concat_ws(" ", link, F.col("l.anchor"))).alias("seen"))
    found = found.where((H.host(F.col("target")) == H.host(F.col("url"))) & (F.col("target") != F.col("url")))
    score = sum((F.col("seen").contains(k).cast("int") for k in keywords), F.lit(0))
    best = found.groupBy(H.host(F.col("target")).alias("host"), "target").agg(F.max(score).alias("score"))
    order = W.partitionBy("host").orderBy(F.desc("score"), F.length("target"), "target")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_host)
    return best.join(pages.withColumnRenamed("url", "target"), "target")


def crawl_directories(
    pages: DataFrame, seeds: DataFrame, keywords: list[str], bonus: str, irrelevant: list[str], foreign: list[str],
    most_links: int = 25, per_host: int = 8, top: int = 8, budget: int = 60, sentences: int = 3,
) -> DataFrame:
    """root, url, role, score, place: every seed that was fetched, and of those that are directories the
    best children by a preview of their text.

    ``pages``: url, html. ``seeds``: url. A link counts with a score of 1 at least; ``per_host`` of a host
    and ``most_links`` of a root are looked at, ``top`` of them kept, ``budget`` pages in all, roots first."""
    text = T.normalize(F.coalesce(H.page_text(F.col("html")), F.lit("")))
    known = pages.select("url", "html", text.alias("text"))
    roots = known.join(seeds.select("url").distinct(), "url")
    listing = H.is_directory(F.col("text"), H.link_density(F.col("html")), H.mean_line(F.col("text")))
    links = roots.where(listing).select(F.col("url").alias("root"), F.explode(H.links(F.col("html"))).alias("l"))
    link = H.absolute(F.col("l.href"), F.col("root"))
    links = links.select("root", link.alias("url"), F.col("l.anchor").alias("anchor"))
    links = links.where((H.host(F.col("url")) == H.host(F.col("root"))) & (F.col("url") != F.col("root")))
    score = H.link_score(F.col("url"), F.col("anchor"), keywords, bonus, irrelevant, foreign)
    links = links.groupBy("root", "url").agg(F.max(score).alias("priority")).where("priority >= 1")
    order = W.partitionBy("root").orderBy(F.desc("priority"), F.length(H.path(F.col("url"))), "url")
    links = links.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= min(most_links, per_host)).drop("_k")
    seen = links.join(known, "url").withColumn("preview", T.first_sentences(F.col("text"), sentences))
    told = sum((F.contains(F.lower("preview"), F.lit(k)).cast("int") for k in keywords), F.lit(0))
    seen = seen.withColumn("score", H.link_score(F.col("url"), F.substring("preview", 1, 200), keywords, bonus, irrelevant, foreign) + told)
    best = W.partitionBy("root").orderBy(F.desc("score"), "url")
    kept = seen.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    first = roots.select(F.col("url").alias("root"), "url", F.lit("root").alias("role"), F.lit(0).alias("score"), F.lit(0).alias("place"))
    both = first.unionByName(kept.select("root", "url", F.lit("child").alias("role"), "score", "place"))
    # A page that several roots lead to is fetched once.
    once = W.partitionBy("url").orderBy(F.col("role").desc(), "root")
    both = both.withColumn("_k", F.row_number().over(once)).where("_k = 1").drop("_k")
    return both.orderBy(F.col("role").desc(), "place", "root", "url").limit(budget)
