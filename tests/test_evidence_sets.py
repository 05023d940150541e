"""Sets of a query's terms as bits: queries of any length, and candidates that aren't dealt by bytes."""

from __future__ import annotations

from evispark.operators import evidence as E
from evispark.storage import stored


def test_long_queries_and_windows(spark):
    """A query of 150 terms (three longs) in chunks of one paragraph and of several."""
    words = [f"term{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(150)]
    far = f"{words[0]}.\n\nNone of these.\n\n{words[149]}"
    texts = {1: f"{words[149]} or {words[3]}", 2: far, 3: f"first here\n\n{words[70]} beside {words[140]} that", 4: f"{words[64]} {words[65]}", 5: words[149], 6: "nothing"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    items = spark.createDataFrame([(9, 0, " ".join(words))], "item_id long, q int, query string")
    got = {r["chunk_id"]: r for r in E.matches(chunks, items, E.Signals(noise=["none"])).collect()}
    assert set(got) == {1, 3, 4}  # in 2 the terms are in different paragraphs and sentences, in 5 there is one
    assert {k: list(r["terms"]) for k, r in got.items()} == {1: [words[3], words[149]], 3: [words[70], words[140]], 4: [words[64], words[65]]}
    assert {k: r["n_phrases"] for k, r in got.items()} == {1: 0, 3: 0, 4: 1}


def test_candidates_keep_their_parts(spark):
    """Few bytes, much work: the planner must not join the parts of the candidates by size."""
    have = spark.createDataFrame([(k, ["aaa", "bbb"], ["aaa", "bbb"]) for k in range(200)], "chunk_id long, have array<string>, exact array<string>")
    queries = stored(spark.createDataFrame([(1, 0, "p", ["aaa", "bbb"], 0, False)], "item_id long, q int, phrase string, terms array<string>, often int, easy boolean"), "queries")
    got = E.candidates(have, queries, 1)
    assert sorted(map(tuple, ((r["chunk_id"], r["found"][0], r["same"][0]) for r in got.collect()))) == [(k, 3, 3) for k in range(200)]
    assert len(got.inputFiles()) >= 4
