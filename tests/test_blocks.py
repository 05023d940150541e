"""The structured chunker, by properties and by example."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark.operators import blocks as B

LINE = st.one_of(
    st.sampled_from(["", "", "# Top", "## Sub", "1.2 Numbered Part", "UPPER CASE", "Things to do:", "| a | b |", "| - | - |", "| one | two words |", "- item one", "2) item two", "  - nested item"]),
    st.lists(st.sampled_from(["alpha", "beta.", "gamma", "delta!", "x"]), min_size=1, max_size=30).map(" ".join),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(LINE, max_size=40).map("\n".join), st.sampled_from([60, 200, 700]), st.booleans())
def test_no_word_is_lost_or_moved(text, most, semantic):
    options = B.Options(most=most, overlap=0, semantic=semantic)
    for kind in ("text", "file"):
        rows = B.document_chunks(text, kind, options)
        assert [r["ord"] for r in rows] == list(range(1, len(rows) + 1))
        at, covered = 0, []
        for r in rows:
            assert r["start"] >= at and not text[at : r["start"]].strip() and r["start"] < r["end"] <= len(text)
            at = r["end"]
            covered.append(text[r["start"] : r["end"]])
            own = re.sub(r"\s+", " ", covered[-1])
            assert own.split() == [w for w in r["text"].split()][-len(own.split()) :] or len(r["text"]) > len(own)
            longest = max((len(x) for x in text.split("\n")), default=0)
            assert len(r["text"]) <= max(most, 500) + 2 * longest + 4
        assert not text[at:].strip() and "".join(" ".join(covered).split()) == "".join(text.split())


def test_tables_repeat_their_header_and_lists_keep_their_lead():
    table = "| name | days |\n|---|---|\n" + "\n".join(f"| row {i} | {i} days |" for i in range(60))
    rows = B.document_chunks(table, "text", B.Options(most=600))
    assert len(rows) > 1 and all(r["text"].startswith("| name | days |\n|---|---|\n") for r in rows)
    assert sum(r["text"].count("| row ") for r in rows) == 60
    items = "Leave types:\n" + "\n".join(f"- entry {i} " + "word " * 12 for i in range(40))
    rows = B.document_chunks(items, "text", B.Options(most=900))
    assert all(r["text"].startswith("Leave types:") for r in rows) and sum(r["text"].count("- entry") for r in rows) == 40
    assert all(6 <= r["text"].count("- entry") <= 12 for r in rows[:-1])


def test_sections_and_modes():
    text = "Intro words.\n# Top\na.\n## Sub\nb.\n### Deep\nc.\n## Next\nd.\n1.1 Numbered Part\ne.\nALL CAPS\nf."
    assert [(p, text[a:b].split("\n")[0]) for p, a, b in B.sections(text)] == [
        (["General"], "Intro words."), (["Top"], "# Top"), (["Top", "Sub"], "## Sub"), (["Top", "Sub", "Deep"], "### Deep"), (["Top", "Next"], "## Next"),
        (["Top", "Numbered Part"], "1.1 Numbered Part"), (["All Caps"], "ALL CAPS"),
    ]
    assert len(B.document_chunks(text, "file", B.Options())) == 1 and len(B.document_chunks(text, "file", B.Options(semantic=True))) == 7
    assert B.document_chunks(text, "url", B.Options()) == [] and B.document_chunks("", "url", B.Options()) == []
    kept = B.document_chunks(text + " overtime", "url", B.Options())
    assert [r["section"] for r in kept] == ["All Caps"] and kept[0]["ord"] == 1
    assert not B.looks_structured("UPPER ONLY\ntext") and B.looks_structured("UPPER ONLY\n1. Numbered here")


def test_chunks_as_a_table(spark):
    docs = spark.createDataFrame([("d1", "file", "one. two."), ("d2", "url", None), ("d3", "url", "Overtime | a\nOvertime | b")], "doc_id string, source_type string, text string")
    got = B.chunk_documents(docs).orderBy("doc_id").collect()
    assert [(r["chunk_id"], r["is_table"]) for r in got] == [("d1-c001", False), ("d3-c001", True)]
    stats = B.chunk_statistics(B.chunk_documents(docs)).first()
    assert (stats["kept"], stats["table"], stats["prose"], stats["short_but_salient"]) == (2, 1, 1, 1)
    assert B.chunk_documents(docs.limit(0)).count() == 0
    flags = docs.select("doc_id", B.structured(F.col("text")).alias("s")).where("s").collect()
    assert flags == []
