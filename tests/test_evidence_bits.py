"""What a chunk has of an item is a row of bits: nothing that the matching writes grows with the chunks but their index."""

from __future__ import annotations

from evispark.operators import evidence as E

TEXTS = {
    1: "we speak of the leave of absence here",  # a phrase over noise words, of five tokens
    2: "leave and absence of the",  # its words, not its phrase
    3: "one two.\n\nStaff leave\n\nis paid. Absence",  # a sentence over two paragraphs
    4: "absence?\n\nleave",
    5: "overtimes rule",
    6: "it is the rule of the house",
}
ITEMS = [(1, 0, "of the leave of absence"), (1, 1, "of the"), (2, 0, "overtime rule"), (3, 0, "leave paid"), (3, 1, "house rule")]


def rows(spark):
    return spark.createDataFrame(list(TEXTS.items()), "chunk_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, q int, query string")


def test_phrases_windows_and_stems(spark):
    chunks, items = rows(spark)
    got = E.matches(chunks, items, E.Signals(noise=["the", "and", "one", "two"])).collect()
    assert {(r["chunk_id"], r["item_id"]): (list(r["terms"]), r["n_terms"], r["n_phrases"]) for r in got} == {
        (1, 1): (["absence", "leave"], 2, 2), (2, 1): (["absence", "leave"], 2, 1), (3, 3): (["leave", "paid"], 2, 0), (5, 2): (["overtime", "rule"], 2, 0), (6, 3): (["house", "rule"], 2, 0),
    }


def test_nothing_but_the_index_grows(spark, monkeypatch):
    """Tables that are written: the index has a row a chunk, all others are of the rubric."""
    made, write = {}, E.stored
    monkeypatch.setattr(E, "stored", lambda df, name: made.setdefault(name, write(df, name)))
    chunks, items = rows(spark)
    sizes = []
    for n in (1, 20):
        made.clear()
        more = spark.range(n).crossJoin(chunks).selectExpr("id * 10 + chunk_id AS chunk_id", "text || ' word' || id AS text")
        assert E.matches(more, items, E.Signals(noise=["the", "and"])).count() > 0
        sizes.append({k: d.count() for k, d in made.items()})
    assert sizes[0].pop("index") == len(TEXTS) and sizes[1].pop("index") == 20 * len(TEXTS)
    assert sizes[0] == sizes[1]
