"""The driver keeps a plan's text: the table of words isn't part of it."""

from evispark.llm import mixing


def test_the_table_of_words_is_no_literal(spark):
    rows = [(k, f"word{k % 7} other{k % 5} {k}", f"source{k % 3}") for k in range(60)] + [(60, None, None), (61, "", "source0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    model = mixing.train(docs, "source")
    got = mixing.memberships(docs, model, "doc_id", label="source")
    plan = got._jdf.queryExecution().toString()
    assert len(plan) < 200_000 and str(model.table[0][0]) not in plan
    found = {r["doc_id"]: r for r in got.collect()}
    assert len(found) == 62 and found[60]["tokens"] == found[61]["tokens"] == 0 and found[3]["tokens"] == 3
    assert all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in found.values())
