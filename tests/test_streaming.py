"""Streaming ingest equals the batch extraction; the windowed scorecard drops late rows."""
import datetime as dt

from pyspark.sql import functions as F

from feedlake.operators import extract as ex
from feedlake.plans import fixtures as fx
from feedlake.streaming.ingest import land_payloads, run_ingest_once
from feedlake.operators import quality as qa
from feedlake.streaming.scorecard import run_probe_outcomes, stream_scorecard


def test_stream_ingest_equals_batch(spark, sf_small, tmp_path):
    payloads = fx.feed_payloads(spark, sf_small)
    cols = ["payload_id", "pos", "title", "link", "summary", "published"]
    batch = ex.extract_articles(payloads).select(*cols)
    for layout in ("table", "files"):
        landing, out, ck = (str(tmp_path / layout / d) for d in ("landing", "out", "ckpt"))
        land_payloads(payloads, landing, layout=layout)
        streamed = run_ingest_once(spark, landing, out, kind="feed", checkpoint=ck, layout=layout,
                                   schema=payloads.schema)
        assert streamed.select(*cols).exceptAll(batch).count() == 0, layout
        assert batch.exceptAll(streamed.select(*cols)).count() == 0, layout
        # a second run over the same landing folder appends nothing (exactly once)
        again = run_ingest_once(spark, landing, out, kind="feed", checkpoint=ck, layout=layout,
                                schema=payloads.schema)
        assert again.count() == batch.count(), layout


def test_stream_scorecard_watermark(spark, tmp_path):
    src = tmp_path / "checks"
    t0 = dt.datetime(2026, 4, 1, 12)
    batch1 = [(t0, "feed", "GET", 200), (t0, "feed", "GET", 500), (t0 + dt.timedelta(days=2), "feed", "GET", 200)]
    late = [(t0 - dt.timedelta(hours=1), "feed", "GET", 500)]   # day 1, after the watermark passed it
    schema = "ts timestamp, kind string, method string, status int"
    spark.createDataFrame(batch1, schema).write.parquet(str(src / "b1"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def run():
        q = (stream_scorecard(stream, "1 day", "1 hour").writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    run()
    spark.createDataFrame(late, schema).write.parquet(str(src / "b2"))
    run()
    rows = {r.window_start.date().isoformat(): (r.n_checks, r.n_passed)
            for r in spark.read.parquet(out).collect()}
    assert rows == {"2026-04-01": (2, 1)}   # the late row is dropped; the last day is still open


def test_streamed_outcomes_equal_the_batch(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / d) for d in ("checks", "out", "ckpt"))
    t0, hour = dt.datetime(2026, 4, 1, 12), dt.timedelta(hours=1)
    schema = "ts timestamp, kind string, target string, method string, status int, attempt long"
    first = [(t0, "feed", "a", "HEAD", 405, 1), (t0, "feed", "b", "GET", 500, 2), (t0, "arxiv", "p", "GET", 429, 3)]
    second = [(t0 + hour, "feed", "a", "GET", 204, 4), (t0 + 30 * hour, "feed", "c", "HEAD", 405, 5)]
    spark.createDataFrame([], schema).write.parquet(f"{src}/b0")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
    assert run_probe_outcomes(stream, out, ckpt).count() == 0
    for i, rows in enumerate((first, second), 1):
        spark.createDataFrame(rows, schema).write.parquet(f"{src}/b{i}")
        got = run_probe_outcomes(stream, out, ckpt)
    given = spark.createDataFrame(first + second, schema).withColumn("cycle_ts", F.date_trunc("day", "ts"))
    want = qa.classify_checks(given).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.target: r.ok for r in got.collect()} == {"a": True, "b": False, "p": True, "c": False}
    late = [(t0 - 40 * hour, "feed", "z", "GET", 200, 6)]   # its window is closed: dropped
    spark.createDataFrame(late, schema).write.parquet(f"{src}/b3")
    assert run_probe_outcomes(stream, out, ckpt).where("target = 'z'").count() == 0


def test_stream_digests_rerender_only_touched_days(spark, sf_small, tmp_path):
    from feedlake.operators import digest as dg
    from feedlake.plans import catalog as C
    from feedlake.streaming.digests import stream_digests
    payloads = fx.all_payloads(spark, sf_small)
    day = F.date_format("fetched_at", "yyyy-MM-dd")
    days = sorted(r.d for r in payloads.select(day.alias("d")).distinct().collect())
    landing, items, out, ck = (str(tmp_path / d) for d in ("landing", "items", "digests", "ckpt"))
    registry, comps = fx.feed_registry(spark, sf_small), C.completions(spark, sf_small)

    def run():
        q = stream_digests(spark, landing, items, out, registry=registry, completions=comps, checkpoint=ck,
                           schema=payloads.schema)
        q.awaitTermination()
        assert q.exception() is None

    def read():
        return {str(r.digest_date): r.value for r in spark.read.text(out, wholetext=True).collect()}

    land_payloads(payloads.where(day == days[0]), landing)
    run()
    first = read()
    land_payloads(payloads.where(day != days[0]), landing)
    run()
    final = read()
    assert list(first) == [days[0]] and sorted(final) == days
    batch = {r.digest_key: r.md + "\n" for r in C.digests(spark, sf_small).collect()}
    assert final == batch   # streamed in two batches == one batch job, all three sections


def test_stream_ingest_papers_and_search_pages(spark, sf_small, tmp_path):
    for kind, payloads, extract, cols in (
            ("arxiv", fx.arxiv_payloads(spark, sf_small), ex.extract_papers, ["payload_id", "pos", "arxiv_id", "title"]),
            ("serp", fx.serp_payloads(spark, sf_small), ex.extract_web_results, ["payload_id", "pos", "href", "title"])):
        landing, out, ck = (str(tmp_path / kind / d) for d in ("landing", "out", "ckpt"))
        land_payloads(payloads, landing)
        streamed = run_ingest_once(spark, landing, out, kind=kind, checkpoint=ck, schema=payloads.schema)
        batch = extract(payloads).select(*cols)
        assert streamed.count() == batch.count() > 0, kind
        assert streamed.select(*cols).exceptAll(batch).count() == 0, kind
