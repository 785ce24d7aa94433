"""Sources and sinks round trips in temp folders."""
import json

from pyspark.sql import functions as F

from feedlake import sinks
from feedlake.operators import extract as ex
from feedlake.sources import (attach_feed, completions_from_json, read_completions, read_feed_registry,
                              read_file_inventory, read_payloads, read_report_lines, read_scorecards,
                              normalize_search_hits, select_sources)


def test_feed_registry_defaults(spark, tmp_path):
    cfg = tmp_path / "config.json"
    cfg.write_text(json.dumps({"feeds": [{"name": "A", "url": "http://a"}, {"url": "http://b"},
                                         {"name": "C", "url": ""}, {"name": "D"}]}, indent=2))
    reg = [tuple(r) for r in read_feed_registry(spark, str(cfg)).orderBy("registry_pos").collect()]
    assert reg == [(0, "A", "http://a"), (1, "RSS", "http://b")]


def test_payload_files_to_articles(spark, tmp_path):
    d = tmp_path / "landing"
    d.mkdir()
    (d / "a.xml").write_bytes('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>é</title></entry></feed>'
                              .encode("utf-8"))
    (d / "b.xml").write_bytes(b"<rss><channel><item><title>bad \xff byte</title></item></channel></rss>")
    p = read_payloads(spark, str(d), "feed")
    reg = spark.createDataFrame([(0, "Feed A", p.where(F.col("payload_id").endswith("a.xml")).first().url)],
                                "registry_pos int, name string, url string")
    arts = ex.extract_articles(attach_feed(p, reg))
    got = {r.title: r.feed_name for r in arts.collect()}
    assert got == {"é": "Feed A"}
    assert [r.payload_id.endswith("b.xml") for r in ex.rejects(p).collect()] == [True]
    (d / "page.html").write_bytes(b'<a x class="result__a" href="h">T\xff1</a><a class="result__snippet">s</a>')
    hits = ex.extract_web_results(read_payloads(spark, str(d), "serp", glob="*.html")).collect()
    assert [(h.title, h.href, h.body) for h in hits] == [("T1", "h", "s")]


def test_select_sources(spark):
    p = spark.createDataFrame([("1", "feed"), ("2", "arxiv"), ("3", "serp")], "payload_id string, kind string")
    assert [r.kind for r in select_sources(p).orderBy("kind").collect()] == ["arxiv", "feed"]
    assert [r.kind for r in select_sources(p, papers=False, feeds=False, web=True).collect()] == ["serp"]


def test_inventory_and_report_lines(spark, tmp_path):
    (tmp_path / "digest_2026-04-01.md").write_text("x" * 10)
    (tmp_path / "cycle_report_1.txt").write_text("ok\nERROR one\r\nlast\n")
    inv = read_file_inventory(spark, str(tmp_path), glob="digest_*")
    (r,) = inv.collect()
    assert r.length == 10 and r.path.endswith("digest_2026-04-01.md")
    assert "content" not in inv.columns
    lines = read_report_lines(spark, str(tmp_path))
    assert [(l.line_no, l.line) for l in lines.orderBy("line_no").collect()] == [(0, "ok"), (1, "ERROR one"),
                                                                                 (2, "last")]


def test_completions_and_scorecards(spark, tmp_path):
    rows = [("article", "a#0", json.dumps({"message": {"content": "HEADLINE: h"}})),
            ("article", "a#1", json.dumps({"other": 1}))]
    df = spark.createDataFrame(rows, "item_kind string, item_id string, body string")
    assert {r.item_id: r.response for r in completions_from_json(df).collect()} == {"a#0": "HEADLINE: h", "a#1": ""}
    f = tmp_path / "comp.jsonl"
    f.write_text("\n".join(json.dumps({"item_kind": k, "item_id": i, "body": b}) for k, i, b in rows))
    assert read_completions(spark, str(f)).count() == 2
    assert read_scorecards(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "h.json").write_text(json.dumps({"score": 0.71, "grade": "C"}, indent=2))
    assert read_scorecards(spark, str(tmp_path / "h.json")).first().score == 0.71
    hits = spark.createDataFrame([(None, "h", None)], "title string, href string, body string")
    assert tuple(normalize_search_hits(hits).first()) == ("Untitled", "h", "", "web")


def test_write_digests_rerun_replaces_one_date(spark, tmp_path):
    out = str(tmp_path / "digests")
    d = spark.createDataFrame([("2026-04-01", "# one"), ("2026-04-02", "# two")], "digest_key string, md string")
    sinks.write_digests(d, out)
    sinks.write_digests(spark.createDataFrame([("2026-04-02", "# two v2")], "digest_key string, md string"), out)
    got = {r.digest_date.isoformat() if hasattr(r.digest_date, "isoformat") else r.digest_date: r.value
           for r in spark.read.text(out).collect()}
    assert got == {"2026-04-01": "# one", "2026-04-02": "# two v2"}
    sinks.write_scorecard(spark.createDataFrame([("c", 0.5)], "cycle string, score double"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().score == 0.5


def test_source_selection_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "payloads")
    rows = [(f"p{i}", "u", k, None, "<feed/>") for i, k in enumerate(["feed", "arxiv", "serp"] * 3)]
    (spark.createDataFrame(rows, "payload_id string, url string, kind string, fetched_at timestamp, body string")
     .write.partitionBy("kind").parquet(path))
    chosen = select_sources(spark.read.parquet(path), papers=False, feeds=True, web=False).select("payload_id")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "feed" in plan.split("PartitionFilters:")[1]
    assert "body" not in plan.split("ReadSchema:")[1].split("\n")[0]   # column pruning
    assert chosen.count() == 3


def test_registry_missing_config_uses_defaults(spark, tmp_path):
    reg = read_feed_registry(spark, str(tmp_path / "nope.json"), default_feeds=[{"name": "N", "url": "http://n"}])
    assert [tuple(r) for r in reg.collect()] == [(0, "N", "http://n")]
    (tmp_path / "empty.json").write_text("{}")
    assert read_feed_registry(spark, str(tmp_path / "empty.json"), default_feeds=[{"url": "u"}]).count() == 0


def test_error_scan_over_real_report_files(spark, tmp_path):
    from feedlake.operators import quality as qa
    (tmp_path / "cycle_report_a.txt").write_text("ok\nERROR x\nno errors here\n")
    (tmp_path / "cycle_report_b.txt").write_text("fine\n")
    (tmp_path / "other.txt").write_text("ERROR ignored\n")
    inv = read_file_inventory(spark, str(tmp_path), glob="cycle_report_*")
    scan = qa.error_scan(read_report_lines(spark, str(tmp_path)), inv)
    got = {r.path.rsplit("/", 1)[-1]: (r.n_lines, r.n_errors) for r in scan.collect()}
    assert got == {"cycle_report_a.txt": (3, 1), "cycle_report_b.txt": (1, 0)}
    assert qa.error_total(scan).first().ok is False


def test_compact_payloads(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for i in range(12):
        (landing / f"p{i}.xml").write_text(
            f'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t{i}</title></entry></feed>')
    n = sinks.compact_payloads(spark, str(landing), str(tmp_path / "table"), "feed", target_files=1)
    assert n == 12
    table = spark.read.parquet(str(tmp_path / "table"))
    assert len([f for f in (tmp_path / "table").iterdir() if f.name.endswith(".parquet")]) == 1
    assert sorted(r.title for r in ex.extract_articles(table).collect()) == sorted(f"t{i}" for i in range(12))
    (landing / "late.xml").write_text("<feed/>")
    assert sinks.compact_payloads(spark, str(landing), str(tmp_path / "table"), "feed") == 1   # only what is new
    assert sinks.compact_payloads(spark, str(landing), str(tmp_path / "table"), "feed") == 0
    assert spark.read.parquet(str(tmp_path / "table")).count() == 13
