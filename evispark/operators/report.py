"""A report from its tables: lines per section, one JSON text, files. Tables stay tables until written;
a report has as many lines as its rubric has items, not as the corpus has documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.functions import text as T
from evispark.operators import decide as D

QUESTIONS, UNKNOWN, LIMITATIONS = 8, 12, 5


def ranked_findings(findings: DataFrame) -> DataFrame:
    """Findings worst first: severity, status, retrieval, area, title, all falling. Adds rank."""
    title = F.lower("claim")
    order = [D.rank_of(F.col("severity"), L.SEVERITY), D.rank_of(F.col("status"), L.STATUS_ORDER), D.rank_of(F.col("retrieval"), L.RETRIEVAL_RANK), F.col("area"), title]
    return findings.withColumn("rank", F.row_number().over(W.orderBy(*[c.desc() for c in order], F.asc("item_id"))))  # a row an item


def questions(findings: DataFrame, k: int = QUESTIONS) -> DataFrame:
    """question, n, severity, place: what to ask, the same question once, often and severe first."""
    asked = findings.where("question IS NOT NULL").withColumn("key", T.question_key(F.col("question"))).where("key <> ''")
    each = asked.groupBy("key").agg(F.min_by("question", "item_id").alias("question"), F.count(F.lit(1)).alias("n"), F.max(D.rank_of(F.col("severity"), L.SEVERITY, 1)).alias("severity"), F.min("item_id").alias("first"))
    order = [(F.col("n") * F.col("severity")).desc(), F.desc("severity"), F.desc("n"), F.asc("first")]
    return each.withColumn("place", F.row_number().over(W.orderBy(*order))).where(F.col("place") <= k).select("question", "n", "severity", "place")


def limitations(unknown: DataFrame, not_retrieved: Column, not_found: Column) -> DataFrame:
    """place, line: counts of fields that couldn't be had, then the first unknown lines (``unknown``: place,
    line); one line if there is nothing to say. The counts are aggregates over ``unknown``'s retrieval."""
    count = unknown.agg(not_retrieved.alias("a"), not_found.alias("b"))
    said = F.array(
        F.when(F.col("a") > 0, F.concat(F.col("a").cast("string"), F.lit(" tracked field(s) were not retrievable from the reviewed corpus and may require follow-up."))),
        F.when(F.col("b") > 0, F.concat(F.col("b").cast("string"), F.lit(" tracked field(s) were searched but not explicitly found in retrieved sources."))),
    )
    head = count.select(F.posexplode(F.filter(said, lambda x: x.isNotNull())).alias("place", "line"))
    rest = unknown.where(F.col("place") <= LIMITATIONS).select((F.col("place") + 10).alias("place"), "line")
    both = head.unionByName(rest)
    none = both.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(0).alias("place"), F.lit("No major source coverage limitations were detected from ingestion metrics.").alias("line"))
    return both.unionByName(none)


def cell(text: Column) -> Column:
    """A text inside a markdown table."""
    return F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("|"), F.lit("/"))


def lines(scorecard: DataFrame, findings: DataFrame, asked: DataFrame, unknown: DataFrame) -> DataFrame:
    """section, ord, line of the markdown report; headings have ord 0."""
    row = F.concat(F.lit("| "), cell(F.col("label")), F.lit(" | "), F.col("maturity"), F.lit(" | "), F.col("impact"), F.lit(" |"))
    cards = scorecard.select(F.lit(1).alias("section"), (F.col("rank") + 2).alias("ord"), row.alias("line"))
    told = F.concat(F.lit("- **"), cell(F.col("claim")), F.lit("** ("), F.col("severity"), F.lit(", "), F.col("status"), F.lit("; owner: "), F.col("owner"), F.lit(")"))
    found = findings.select(F.lit(2).alias("section"), F.col("rank").alias("ord"), told.alias("line"))
    more = asked.select(F.lit(3).alias("section"), F.col("place").alias("ord"), F.concat(F.lit("- "), "question").alias("line"))
    open_ = unknown.select(F.lit(4).alias("section"), F.col("place").alias("ord"), F.concat(F.lit("- "), "line").alias("line"))
    heads = [(1, 0, "## Functional Scorecard"), (1, 1, "| Area | Maturity | Impact |"), (1, 2, "|---|---|---|"), (2, 0, "## Findings"), (3, 0, "## Follow-up Questions"), (4, 0, "## Not Confirmed")]
    head = scorecard.sparkSession.createDataFrame(heads, "section int, ord int, line string")
    return head.unionByName(cards).unionByName(found).unionByName(more).unionByName(open_)


def markdown(report_lines: DataFrame) -> DataFrame:
    """One row: the lines as a text, sections apart by a blank line."""
    parts = report_lines.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), "\n\n").alias("markdown"))


def as_json(**tables: DataFrame) -> DataFrame:
    """One row: a JSON object with a list of rows per table. For tables as small as a report's."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.to_json(F.array_sort(F.collect_list(F.to_json(F.struct(*rows.columns))))).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.select(F.to_json(F.struct(*tables)).alias("report"))


def write_artifacts(folder: str, tables: dict[str, DataFrame], text: DataFrame | None = None) -> None:
    """Each table as JSON lines under its name, and the markdown text; a folder that exists is replaced
    table by table."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")
    if text is not None:
        text.coalesce(1).write.mode("overwrite").text(f"{folder}/report")


def append_transcript(calls: DataFrame, folder: str) -> None:
    calls.write.mode("append").json(folder)


def read_artifact(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table read back by its schema; a column that is missing there is null, one too many is left out."""
    return spark.read.schema(schema).json(f"{folder}/{name}")
