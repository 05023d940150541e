"""Operators on small inline fixtures."""

import zipfile

import pytest
from pyspark.sql import functions as F

from evispark import lexicon as L
from evispark.functions import html as H
from evispark.functions import text as T
from evispark.operators import chunking as C
from evispark.operators import decide as D
from evispark.sources import readers
from evispark.streaming import stream


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def test_normalize(spark):
    got = one(spark, T.normalize(F.col("t")), t=" a\x07b \t c\r\nd\r\r\r\re\u00a0f\x7f ")
    assert got == "ab c\nd\n\ne f"
    assert one(spark, T.normalize(F.col("t")), t="the cafeâ€™s doorâ€”open") in ("the cafe's door-open", "the cafe's door-open".replace("-", "—"))


def test_addresses(spark):
    got = one(spark, readers.addresses(F.col("t")), t="see http:/one.test/p?q=1; (https://two.test/x.) https://two.test/x")
    assert got == ["http://one.test/p?q=1", "https://two.test/x"]
    assert len(one(spark, readers.addresses(F.col("t")), t="https://three.test/ahttp:/four.test/b")) == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Topic,Answer,\nParking,No,\n,,\n\n")
    (tmp_path / "b.md").write_text("# Title here\nbody")
    (tmp_path / "skip.bin").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    got = {r["source"].rsplit("/", 1)[-1]: r for r in readers.documents(spark, str(tmp_path), ["pasted", " "]).collect()}
    assert "Topic: Parking | Answer: No" in got["a.csv"]["text"] and got["c.docx"]["text"] == "One\nTwo"
    assert got["b.md"]["title"] == "Title here" and len(got) == 4


def test_headcount(spark):
    assert one(spark, T.headcount_range(F.col("t")), t="some 70 to 50 of us") == "50-70"
    assert one(spark, T.exact_headcount(F.col("t")), t="it has 31 employees in all") == 31
    assert one(spark, T.exact_headcount(F.col("t")), t="nearly 31 employees") is None


@pytest.mark.parametrize("most,overlap", [(60, 0), (60, 10), (10, 3)])
def test_pack_covers(most, overlap):
    text = "One two three. Four five six seven! " * 5 + "x" * 150 + " end."
    spans = C.pack(text, most, overlap)
    assert all(b - a <= most for a, b in spans)
    assert "".join(text.split()) == "".join("".join(text[a:b] for a, b in C.pack(text, most)).split())
    covered = set()
    for a, b in spans:
        covered |= set(range(a, b))
    assert all(text[i].isspace() for i in set(range(len(text))) - covered)


def test_sections():
    text = "# A\nx\n## B\ny\n# C\nz"
    assert [s[0] for s in C.sections(text)] == ["A", "A > B", "C"]


def test_statuses(spark):
    kind = D.evidence_kind(F.col("t"), F.lit(False))
    assert one(spark, kind, t="a badge system is not in place") == "explicit_absence"
    assert one(spark, kind, t="it uses a visitor control") == "explicit"
    assert one(spark, D.rank_of(F.col("t"), L.SEVERITY), t="high") == 3


def test_html(spark):
    page = '<html><title> A  b </title><nav><a href="/x#y">go</a></nav><h1>Head</h1><ul><li>item</li></ul><p>Body text</p></html>'
    assert one(spark, H.title(F.col("t")), t=page) == "A b"
    assert one(spark, H.links(F.col("t")), t=page)[0]["href"] == "/x"
    assert H.parsed_text(page).split("\n\n")[-3:] == ["## Head", "- item", "Body text"]
    assert one(spark, H.absolute(F.col("u"), F.col("b")), u="/x", b="https://a.b/c/d") == "https://a.b/x"


def test_stream(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.limit(20).write.parquet(str(tmp_path / "in"))
    live = stream.chunk_stream(stream.read_documents(spark, str(tmp_path / "in"), docs.schema), 1200)
    q = live.writeStream.format("memory").queryName("chunks").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("chunks").count() == C.chunks(spark.read.parquet(str(tmp_path / "in")), 1200).count()
