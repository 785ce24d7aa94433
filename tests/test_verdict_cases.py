"""Cases that once lost data or took the wrong branch."""
import pytest
from pyspark.sql import functions as F

from feedlake.functions.xml import root_name
from feedlake.operators import digest as dg
from feedlake.operators import quality as qa
from feedlake.operators import retention as rt
from feedlake.operators import search as se
from feedlake.plans import fixtures as fx
from feedlake.plans import jobs
from feedlake.sources import read_report_lines, read_file_inventory
from conftest import payloads_df


def feed(n, start):
    items = "".join(f"<item><title>T{start + i}</title><link>http://l/{start + i}</link></item>" for i in range(n))
    return f"<rss version='2.0'><channel>{items}</channel></rss>"


def test_feeds_without_a_name_are_capped_apart(spark, tmp_path):
    pays = payloads_df(spark, [feed(20, 0), feed(20, 100), feed(20, 200)]).withColumn("fetched_at", F.to_timestamp(F.lit("2026-04-22 08:00:00")))
    registry = spark.createDataFrame([(0, "RSS", "http://x/0"), (1, "RSS", "http://x/1")], "registry_pos int, name string, url string")
    md = jobs.digest_job(spark, pays, registry, out=str(tmp_path / "o")).first()["md"]   # no papers landed: an empty table
    assert sum(line.startswith("### ") for line in md.splitlines()) == 45


def test_long_blank_prolog_does_not_recurse(spark):
    body = "\n" * 300_000 + "<?xml version='1.0'?>" + " " * 300_000 + "<!-- c --><a:feed/>"
    assert spark.createDataFrame([(body,), ("no xml",), ("﻿<rss/>",)], "b string").select(root_name("b").alias("r")).collect() == [("feed",), ("",), ("rss",)]


def test_arxiv_ids_stay_unique(spark):
    ids = spark.createDataFrame([(7,), (123456,), (123459,)], "d long").select(fx.arxiv_id(F.col("d")).alias("i")).collect()
    assert [r.i.split("v")[0] for r in ids] == ["2401.00007", "2401.123456", "2401.123459"]


def test_gates_that_are_null_or_absent(spark):
    gates = spark.createDataFrame([("a", "tests", None), ("b", "health", None), ("b", "tests", True), ("c", "tests", True)],
                                  "cycle string, gate string, ok boolean")
    plain = {r.cycle: r.action for r in qa.release_gate(gates, ["cycle"]).collect()}
    assert plain == {"a": "INVESTIGATE", "b": "FAST-FORWARD", "c": "FAST-FORWARD"}
    strict = {r.cycle: (r.action, r.n_failed) for r in qa.release_gate(gates, ["cycle"], required=["tests", "digest_size"]).collect()}
    assert strict["c"] == ("INVESTIGATE", 1)


def test_feed_probe_statuses(spark):
    rows = [("feed", 204), ("feed", 206), ("feed", 301), ("arxiv", 204), ("arxiv", 429)]
    got = spark.createDataFrame(rows, "kind string, status int").select(qa.check_ok(F.col("kind"), F.lit("GET"), F.col("status")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, True, False, False, True]


def test_report_names_with_blanks_and_empty_reports(spark, tmp_path):
    (tmp_path / "cycle_report_a b+c.txt").write_text("ERROR here\nfine\n")
    seen = read_file_inventory(spark, str(tmp_path)).select("path", "modificationTime")
    files = seen.unionByName(seen.withColumn("path", F.lit("cycle_report_empty.txt")))   # listed, but without a line
    scan = qa.error_scan(read_report_lines(spark, str(tmp_path)), files).collect()
    assert sorted((r.n_lines, r.n_errors) for r in scan) == [(0, 0), (2, 1)]


def test_every_query_term_counts(spark):
    papers = spark.createDataFrame([("1", "graph nets", "", ["x"], ["cs.CL", "cs.AI"], "2026-01-01"), ("2", "graph", "", ["x"], ["cs.CL"], "2026-01-02")],
                                   "arxiv_id string, title string, summary string, authors array<string>, categories array<string>, published string")
    ids = lambda q, **k: [r.arxiv_id for r in se.search_papers(papers, query=q, **k).collect()]
    assert ids("cat:cs.CL AND cat:cs.AI") == ["1"] and ids("all:graph AND all:nets") == ["1"]
    assert ids("cat:cs.CL", max_results=None) == ["2", "1"]


@pytest.mark.parametrize("as_of", ["2026-04-22 00:00:00", "2026-04-22 12:00:00"])
def test_retention_applies_its_plan(spark, tmp_path, as_of):
    live, archive = str(tmp_path / "live"), str(tmp_path / "archive")
    days = [f"2026-04-{d:02d}" for d in (13, 14, 15, 16)]
    spark.createDataFrame([(f"x{d}", d) for d in days], "md string, digest_date string").write.partitionBy("digest_date").parquet(live)
    files = spark.createDataFrame([(f"digest_{d}.md", 1) for d in days], "path string, length long")
    plan = rt.retention_plan(rt.mark_expired(files, as_of, 7)).first()
    done = rt.apply_retention(spark, live, as_of, 7, archive_path=archive).first()
    assert done.archived == plan.archived == done.partitions_removed
    assert spark.read.parquet(live).count() == 4 - plan.archived


def test_equal_names_in_one_table(spark):
    a = spark.range(60).select(F.lit("RSS").alias("feed_name"), F.concat(F.lit("p"), F.col("id") % 3).alias("payload_id"),
                               F.col("id").alias("pos"))
    assert dg.cap_per_feed(a, 15).count() == 45


def test_namespaces_are_those_of_the_root_tag(spark):
    from feedlake.operators.extract import extract_articles
    from feedlake.functions.xml import ATOM_NS
    entry, item = "<entry><title>{}</title></entry>", "<item><title>{}</title></item>"
    bodies = [
        f"<feed xmlns='{ATOM_NS}'>{entry.format('default')}</feed>",
        f"<?xml version='1.0'?><a:feed note='x > y' xmlns:a='{ATOM_NS}'><a:entry><a:title>prefixed</a:title></a:entry></a:feed>",
        f"<feed><x:note xmlns:x='{ATOM_NS}'/>{entry.format('nested binding')}</feed>",
        f"<feed xmlns:atom='{ATOM_NS}'>{entry.format('unqualified')}</feed>",
        f"<rss version='2.0' xmlns:atom='{ATOM_NS}'><channel>{item.format('rss')}</channel></rss>",
        f"<rss xmlns='http://elsewhere.test/ns'><channel>{item.format('rss in a default namespace')}</channel></rss>",
    ]
    assert sorted(r.title for r in extract_articles(payloads_df(spark, bodies)).collect()) == ["default", "prefixed", "rss"]


def test_rerun_leaves_out_items_of_earlier_runs(spark, tmp_path):
    day = lambda d, body: payloads_df(spark, [body]).withColumn("fetched_at", F.to_timestamp(F.lit(f"{d} 08:00:00")))
    out = str(tmp_path / "o")
    jobs.digest_job(spark, day("2026-04-21", feed(2, 0)), out=out)
    jobs.digest_job(spark, day("2026-04-22", feed(3, 10)), out=out)
    again = jobs.digest_job(spark, day("2026-04-22", feed(1, 50)), out=out).collect()
    assert [r.digest_key for r in again] == ["2026-04-22"]
    assert [line for line in again[0].md.splitlines() if line.startswith("### ")] == ["### 1. T50"]
    assert spark.read.text(f"{out}/digests").select("digest_date").distinct().count() == 2


def test_manifest_gives_landed_files_their_feed_url(spark, tmp_path):
    from feedlake.sources import read_payloads
    for name in ("a b+c.xml", "other.xml"):
        (tmp_path / name).write_text(feed(1, 0))
    manifest = spark.createDataFrame([("a b+c.xml", "http://feeds.test/a")], "file string, url string")
    urls = {r.payload_id.rsplit("/", 1)[1]: r.url for r in read_payloads(spark, str(tmp_path), "feed", manifest=manifest).collect()}
    assert urls.pop("other.xml").endswith("/other.xml") and list(urls.values()) == ["http://feeds.test/a"]
