"""Queries that do whole what a query with SQL cuts, against brute force."""

import hashlib
import re

import pytest

from evispark.functions import citation
from evispark.plans.catalogue import QUERIES

LATE = "The policy is reviewed by the people team every single year."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    long = "Menu Links\n" * 400 + LATE + " More follows here.\n"
    rows = [(1, long), (2, "- [a](http://x.co) [b](y)\n\n* see docs/readme.md\n" + LATE), (3, "Short."), (4, None), (5, "word " * 300 + "end")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_citation_snippet(spark, folder):
    path, rows = folder
    got = {r["doc_id"]: r for r in QUERIES["citation_snippet"](spark, path).collect()}
    assert got[1]["snippet"] == got[2]["snippet"] == LATE
    assert got[3]["snippet"] is None and got[4]["snippet"] is None
    assert len(got[5]["snippet"]) <= citation.CLIP + 1 and got[5]["snippet"].endswith("word.")
    whole = " ".join(rows[0][1].split())
    assert len(whole) > 2000 and got[1]["chars"] == len(whole) and got[1]["digest"] == hashlib.sha256(whole.encode()).hexdigest()


def test_slug_and_clip(spark, folder):
    path, rows = folder
    got = {r["doc_id"]: r["slug"] for r in QUERIES["slug_and_clip"](spark, path).collect()}
    assert got == {i: re.sub("[^a-z0-9]+", "-", (t or "").lower()).strip("-") or "document" for i, t in rows}


def test_noise_lines():
    for line in ("12 34", "See https://x.co for all of the details here", "# Our Great Company Values And Mission", "benefits and how we work with other people", "one two three four five", "a ----- b c d e f g h"):
        assert citation.noise_line(line, citation.cleaned(line)), line
    assert not citation.noise_line("- " + LATE, citation.cleaned("- " + LATE))


def pages_at(spark, path, rows, kind):
    spark.createDataFrame(rows, kind).write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.mark.parametrize("n", [1, 2, 10, 40])
def test_boilerplate_removal(spark, tmp_path, n):
    shared = [f"Passage number {k} that stands on several pages of this corpus." for k in range(n + 1)]
    texts = {i: [p for k, p in enumerate(shared) if i < k] + [f"Only page {i} has this paragraph, no other page does."] for i in range(n)}
    rows = [(i, "http://x.co/", "".join(f"<p>{p}</p>" for p in ps)) for i, ps in texts.items()]
    got = {r["page_id"]: r["kept"] for r in QUERIES["boilerplate_removal"](spark, pages_at(spark, tmp_path, rows, "page_id long, url string, html string")).collect()}
    least = max(2, int(n * 0.3) + 1)
    on = {p: sum(p in ps for ps in texts.values()) for p in shared}
    assert got == {i: sum(on.get(p, 1) < least for p in ps) for i, ps in texts.items()}


def test_page_relevance(spark, tmp_path):
    body = "Our leave policy and overtime rules. " + "Filler words stand here. " * 20
    plain = "Filler words stand here. " * 20
    rows = [
        (1, "http://x.co/a", "http://x.co/b", f"<title>Q</title><p>{body}</p>"), (2, "http://x.co/a", "http://x.co/b", f"<title>Q</title><p>{plain}</p>"),
        (3, "http://x.co/a", "http://x.co/b", f"<title>Q</title><p>About 250 employees. {plain}</p>"), (4, "http://x.co/a", "http://x.co/a", f"<title>Q</title><p>{plain}</p>"),
        (5, "http://x.co/a", None, f"<title>Q</title><p>{plain}</p>"),
    ]
    path = pages_at(spark, tmp_path, rows, "page_id long, url string, requested_url string, html string")
    got = {r["page_id"]: (r["score"], r["seed"]) for r in QUERIES["page_relevance"](spark, path).collect()}
    assert got == {1: (2, False), 3: (3, False), 4: (0, True)}
