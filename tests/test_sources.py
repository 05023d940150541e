"""Sources, profiles, sinks and streams on local files and a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from evispark.operators import evidence as E
from evispark.operators import model, report
from evispark.plans.catalogue import QUERIES
from evispark.sources import profile, readers, web
from evispark.streaming import stream


def test_numbering_is_that_of_one_sort(spark):
    rows = [(k % 3, f"s{k * 7919 % 1000:04d}" if k % 9 else "same") for k in range(1500)]
    table = spark.createDataFrame(rows, "kind int, source string").repartition(7)
    got = sorted((r["_n"], r["kind"], r["source"]) for r in readers.numbered(table, ranges=20).collect())
    assert [g[0] for g in got] == list(range(1, 1501)) and [g[1:] for g in got] == sorted(rows)
    assert readers.numbered(table.limit(0)).count() == 0


def test_unknown_files_raise(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x")
    with pytest.raises(ValueError, match="not one of"):
        readers.files(spark, str(tmp_path / "a.bin"))
    with pytest.raises(ValueError, match="no parser"):
        readers.parser_of("x.odt", readers.PARSERS)
    with pytest.raises(Exception, match="(?i)path"):
        readers.read_files(spark, str(tmp_path / "gone")).count()
    assert readers.files(spark, str(tmp_path)).count() == 0


def test_made_crawl_has_rows(spark):
    got = QUERIES["crawl_atlas"](spark, "/root/testdata/sf0.001").groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in got}["root"] == 5 and {r["role"]: r["count"] for r in got}["child"] > 5


class Site(BaseHTTPRequestHandler):
    asked: dict[str, int] = {}

    def do_GET(self):  # noqa: N802
        n = Site.asked[self.path] = Site.asked.get(self.path, 0) + 1
        status = {"/busy": 503 if n < 3 else 200, "/gone": 404}.get(self.path, 200)
        body = f"<html><title>{self.path}</title></html>".encode()
        self.send_response(status)
        self.send_header("content-type", "text/html")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_pages_over_http(spark):
    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    web.register(spark)
    urls = " ".join(f"{base}{p}" for p in ("/a", "/busy", "/gone", "/a")) + " http://127.0.0.1:1/x"
    table = spark.read.format("web_pages").options(urls=urls, backoff=0.01, throttle=0, timeout=3).load()
    got = {r["requested_url"].removeprefix(base): r for r in table.collect()}
    server.shutdown()
    assert len(got) == 4 and got["/a"]["status"] == 200 and "<title>/a" in got["/a"]["html"] and got["/a"]["error"] is None
    assert got["/busy"]["attempts"] == 3 and got["/busy"]["html"] and got["/gone"]["status"] == 404 and got["/gone"]["attempts"] == 1
    dead = got["http://127.0.0.1:1/x"]
    assert dead["html"] is None and dead["attempts"] == 3 and dead["error"]
    assert spark.read.format("web_pages").load().count() == 0


PROFILE = """
name: Test
stages:
  - {id: big, label: Big, min_headcount: 10, expectations: [a]}
  - {id: small, label: Small, min_headcount: 0, max_headcount: 9, expectations: [b, a]}
funding_stages: [{id: seed, label: Seed, aliases: [pre-seed]}]
startup_guidance_sources: [{id: s1, title: Guide, url: x}]
startup_guidance_rules: [{id: r1, size_stage_ids: [small], recommended_practices: [Hire], source_ids: [s1]}]
expectations:
  - {id: a, area: x, claim: Claim A, severity_if_missing: high, evidence_queries: [one, two], snapshot_fields: [f.a]}
  - {id: b, area: y, claim: Claim B, severity_if_missing: low, evidence_queries: [Claim B], compliance: true}
"""


def test_profile(spark, tmp_path):
    (tmp_path / "p.yaml").write_text(PROFILE)
    read = profile.Profile.read(tmp_path / "p.yaml")
    got = read.tables(spark)
    assert [r["band"] for r in got["bands"].orderBy("ord").collect()] == ["small", "big"]
    assert {(r["item_id"], r["q"], r["query"]) for r in got["queries"].collect()} == {("a", 0, "one"), ("a", 1, "two"), ("a", 2, "Claim A"), ("b", 0, "Claim B")}
    assert got["red_flags"].count() == 0 and got["rule_lines"].count() == 2 and got["items"].where("compliance").count() == 1
    broken = profile.Profile("x", {**read.entries, "expectations": [*read.entries["expectations"], {"id": "a", "area": "z", "claim": "c", "severity_if_missing": "dire"}, {"id": "c"}], "stages": [{"id": "s", "label": "S", "min_headcount": 5, "max_headcount": 1, "expectations": ["nope"]}]})
    said = " ".join(broken.problems())
    assert all(x in said for x in ("a repeats", "lacks area", "nope is in no expectations", "severity dire", "small is in no stages", "ends before it starts"))
    for name, text, kind in (("p.txt", "", ValueError), ("l.json", "[]", ValueError), ("q.json", json.dumps({"expectations": [{"id": 1}]}), ValueError)):
        (tmp_path / name).write_text(text)
        with pytest.raises(kind):
            profile.Profile.read(tmp_path / name)
    with pytest.raises(FileNotFoundError):
        profile.Profile.read(tmp_path / "none.yaml")


def test_options_and_snapshot(spark, tmp_path):
    made = profile.Options.from_environment({"EVISPARK_CHUNK_CHARS": "100", "EVISPARK_URLS_PER_HOST": "x", "EVISPARK_PROVISIONAL_BELOW": "0.5"})
    assert (made.chunk_chars, made.urls_per_host, made.provisional_below) == (800, 8, 0.5)
    (tmp_path / ".env").write_text("# no\nA=1\nexport B='two words'\nbad line\n")
    assert profile.environment_file(str(tmp_path / ".env")) == {"A": "1", "B": "two words"} and profile.environment_file(str(tmp_path / "x")) == {}
    (tmp_path / "s.json").write_text(json.dumps({"headcount": 12, "policies": {"leave_policy": True, "none": None}, "name": "Co", "list": ["a"]}))
    got = {r["field"]: r["value"] for r in profile.read_snapshot(spark, str(tmp_path / "s.json")).collect()}
    assert got == {"headcount": "12", "policies.leave_policy": "true", "name": "Co", "list": '["a"]'}


def test_artifacts_and_transcript(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    folder = str(tmp_path / "out")
    for _ in range(2):
        report.write_artifacts(folder, {"rows": table}, spark.createDataFrame([("# T\n\nx",)], "markdown string"))
    assert report.read_artifact(spark, folder, "rows", "id int, name string, other double").orderBy("id").collect()[1]["id"] == 2
    assert "# T" in "\n".join(r[0] for r in spark.read.text(folder + "/report").collect())
    assert json.loads(json.loads(json.loads(report.as_json(rows=table, more=table.limit(0)).first()[0])["rows"])[0]) == {"id": 1, "name": "a"}
    reader = model.Reader()
    assert reader.ask("x", "p") is None and not reader.enabled
    for _ in range(2):
        report.append_transcript(reader.transcript(spark), folder + "/calls")
    assert spark.read.json(folder + "/calls").count() == 2


def test_reader_retries_halves_and_gives_up():
    answers = iter(["", '{"a": [1, ', '{"a": 1}'])
    room = []
    reader = model.Reader(lambda p, n: room.append(n) or next(answers))
    assert reader.ask("x", "p", 1000) == {"a": 1} and room == [1000, 1000, 2000] and reader.calls[0][3:5] == ("ok", 3)

    def small(prompt, n):
        if len(prompt) > 2:
            raise RuntimeError("maximum context length exceeded")
        return json.dumps(prompt)

    assert model.Reader(small).ask_halves("x", list("abcde"), "".join) == ["ab", "c", "de"]
    lost = model.Reader(lambda p, n: (_ for _ in ()).throw(RuntimeError("Connection refused")))
    assert lost.ask("x", "p") is None and not lost.enabled and lost.calls[0][3] == "connection"
    assert model.batch_budget(60, 4) == 16 and not model.truncated('{"a": 1}') and model.truncated('{"a": "b')
    schema = {"type": "object", "properties": {"a": {"type": "object", "properties": {"b": {"type": "string"}}}}}
    assert model.strict_schema(schema)["properties"]["a"]["required"] == ["b"]


def test_stream_keeps_the_best_of_all_batches(spark, tmp_path):
    items = spark.createDataFrame([(1, 0, "alpha beta gamma delta"), (2, 0, "one two three"), (2, 1, "three four")], "item_id long, q int, query string")
    texts = ["alpha beta gamma delta", "alpha beta. Gamma", "one two three x", "three four. One, two three"]
    docs = [(k, texts[k % 4] + f" n{k}" * (k % 3)) for k in range(24)]
    for i in range(3):
        spark.createDataFrame(docs[8 * i : 8 * i + 8], "chunk_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    state = str(tmp_path / "state")
    sink = stream.top_k_sink(state, items, 3)
    source = stream.read_documents(spark, str(tmp_path / "in/*"), "chunk_id long, text string")

    def run():
        source.writeStream.option("maxFilesPerTrigger", 1).foreachBatch(sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    def state_now():
        return {(r["item_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in stream.top_k(spark, state).collect()}

    def whole(rows):
        found = E.matches(spark.createDataFrame(rows, "chunk_id long, text string"), items)
        best = E.best(found, ["item_id"], 3, [F.desc("score"), F.asc("chunk_id")], ["chunk_id"])
        return {(r["item_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in best.collect()}

    run()
    assert state_now() == whole(docs) and len(state_now()) == 6
    # An epoch that is replayed gives the same table, and so do chunks that come late once more.
    last = stream._epochs(spark, state)[-1]
    for epoch in (last + 1, last + 1):
        sink(spark.createDataFrame(docs[16:], "chunk_id long, text string"), epoch)
        assert state_now() == whole(docs)
    # A query that is started again goes on from its checkpoint, with what has come since.
    more = [(100, "alpha beta gamma delta alpha"), (-1, "one two three four")]
    spark.createDataFrame(more, "chunk_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in/3"))
    sink = stream.top_k_sink(state, items, 3)
    source = stream.read_documents(spark, str(tmp_path / "in/*"), "chunk_id long, text string")
    run()
    assert state_now() == whole(docs + more)
    assert stream.top_k(spark, str(tmp_path / "none")).count() == 0
    assert stream.chunk_stream(source.withColumnRenamed("chunk_id", "doc_id")).isStreaming
