"""A table that one task reads is dealt out before anything is done with its texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evispark.operators import evidence as E
from evispark.plans import evidence_queries as EQ
from evispark.plans import matching_queries as MQ
from evispark.plans import registry

WORDS = ["leave", "rule", "absence", "house"]


def one_file(spark, folder) -> str:
    rows = [(k, f"{WORDS[k % 4]} of {WORDS[(k + 1) % 4]} w{k}" + (" cookies" if k % 10 == 0 else "")) for k in range(400)]
    spark.createDataFrame(rows, "chunk_id long, text string").coalesce(1).write.parquet(f"{folder}/chunks")
    return f"{folder}/chunks"


def test_one_file_is_indexed_by_many_tasks(spark, tmp_path, monkeypatch):
    chunks = spark.read.parquet(one_file(spark, tmp_path))
    signals = E.Signals(irrelevant=["cookies"], noise=["of"])
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merge)
    spark.conf.set(merge, "false")  # these rows are too few for the planner to keep apart
    try:
        index = E.token_index(chunks, signals)
    finally:
        spark.conf.set(merge, before)
    assert len(chunks.inputFiles()) == 1 and len(index.inputFiles()) >= 4
    assert {r["chunk_id"] for r in index.collect()} == {k for k in range(400) if k % 10}


def test_no_text_is_searched_before_the_dealing(spark, tmp_path, monkeypatch):
    made, write = {}, E.stored
    monkeypatch.setattr(E, "stored", lambda df, name: made.setdefault(name, df) and write(df, name))
    E.token_index(spark.read.parquet(one_file(spark, tmp_path)), E.Signals(irrelevant=["cookies"]))
    plan = made["index"]._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression")
    assert "Contains" in above and "Contains" not in below and "lower" not in below
    assert above.count("lower(") == 1


def test_what_the_index_carries_is_handed_on(spark):
    chunks = spark.createDataFrame([(1, "leave of absence"), (2, "the leave\n\nabsence leave"), (3, "nothing")], "chunk_id long, text string")
    items = spark.createDataFrame([(1, 0, "leave absence")], "item_id long, q int, query string")
    index = E.token_index(chunks, E.Signals(noise=["of"]), {"size": F.length("text")})
    got = E.matches(chunks, items, E.Signals(noise=["of"]), index)
    assert {r["chunk_id"]: r["size"] for r in got.collect()} == {1: 16, 2: 24}


def tables(spark, folder) -> str:
    texts = ["The leave of absence is paid. " * 60, "Nothing.", None, "gnu general leave of absence"]
    spark.createDataFrame([(k, texts[k % 4]) for k in range(40)], "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "leave of absence")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, "NOWHERE")], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
    return str(folder)


def test_documents_are_searched_once(spark, tmp_path):
    """Whether there was anything to search is read from the index."""
    registry._WRITTEN.clear()
    found = EQ.status(spark, tables(spark, tmp_path))
    assert not any("documents.parquet" in f for f in found.inputFiles())
    assert {r["item_id"]: (r["status"], r["n_rows"]) for r in found.collect()} == {1: ("MENTIONED_EXPLICIT", 6), 100_000: ("NOT_FOUND_IN_RETRIEVED", 0)}


def test_documents_are_cut_and_read_by_many_tasks(spark, tmp_path):
    """Documents are dealt out before they are cut, and only those of the looked-at pieces for their passages."""
    sf = tables(spark, tmp_path)
    seen = spark.createDataFrame([(4 * MQ.MOST_PIECES + 1,), (-4 * MQ.MOST_PIECES + 1,)], "chunk_id long")
    some, every = MQ.pieces(spark, sf, seen), MQ.pieces(spark, sf)
    assert [(r["chunk_id"], r["start"]) for r in some.orderBy("start").collect()] == [(4 * MQ.MOST_PIECES, 0), (4 * MQ.MOST_PIECES + 1, 1200)]
    assert every.count() == 10 * 2 + 20
    for found in (some, every):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("RepartitionByExpression")
