"""The written-table digest job gives the same digests as the in-memory plan."""
from pyspark.sql import functions as F

from feedlake.plans import catalog as C
from feedlake.plans import fixtures as fx
from feedlake.plans.jobs import digest_job


def test_digest_job_matches_catalog(spark, sf_small, tmp_path):
    payloads = fx.all_payloads(spark, sf_small)
    got = digest_job(spark, payloads, fx.feed_registry(spark, sf_small), C.completions(spark, sf_small),
                     out=str(tmp_path / "run"), web=True)
    expected = C.digests(spark, sf_small)
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0
    assert spark.read.text(str(tmp_path / "run" / "digests")).count() > 0


def test_uncapped_job_uses_split_numbering(spark, sf_small, tmp_path):
    payloads = fx.all_payloads(spark, sf_small)
    reg = fx.feed_registry(spark, sf_small)
    kw = dict(papers_per_digest=None, articles_per_feed=None, web_per_digest=None, web=True)
    split = digest_job(spark, payloads, reg, out=str(tmp_path / "a"), **kw)
    plain = digest_job(spark, payloads, reg, out=str(tmp_path / "b"), split_hot_groups=False, **kw)
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0


def test_all_hits_of_a_page_reach_the_tables(spark, tmp_path):
    from feedlake.streaming.ingest import land_payloads, run_ingest_once
    block = '<a class="result__a" href="http://h{i}">T{i}</a> <a class="result__snippet" href="#">S{i}</a> '
    body = "".join(block.format(i=i) for i in range(8))
    pages = spark.sql("SELECT 'p' payload_id, 'http://x' url, 'serp' kind, TIMESTAMP_NTZ'2026-04-22 08:00:00' fetched_at").selectExpr("*", f"'{body}' body")
    kw = dict(papers=False, feeds=False, web=True, web_per_digest=None)
    md = [digest_job(spark, pages, out=str(tmp_path / f"job{n}"), web_results=n, **kw).first().md for n in (5, None)]
    assert [sum(f"T{i}" in m for i in range(8)) for m in md] == [5, 8]
    land_payloads(pages, str(tmp_path / "landing"))
    got = run_ingest_once(spark, str(tmp_path / "landing"), str(tmp_path / "out"), kind="serp", schema=pages.schema,
                          checkpoint=str(tmp_path / "ck"), web_results=None)
    assert sorted(r.href for r in got.collect()) == [f"http://h{i}" for i in range(8)]


def test_readers_see_committed_runs_only(spark, sf_small, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from feedlake import sinks
    from feedlake.plans.jobs import extract_items
    out = str(tmp_path / "items")
    hits = fx.serp_payloads(spark, sf_small)
    first = extract_items(spark, hits, out=out, papers=False, feeds=False, web=True)["web"]
    n = first.count()
    assert n > 0 and sinks.committed_runs(spark, out).count() == 1
    keyed = first.withColumn("run_id", F.lit("half"))
    sinks.write_items(keyed, sinks.run_path(out, "web"), ["run_id", "digest_key"])  # a run that broke off here
    assert sinks.read_run(spark, out, "web").count() == n
    with pytest.raises(ValueError):
        sinks.read_run(spark, out, "web", "half")
    sinks.commit_run(spark, out, "half", {"web": keyed.schema})
    assert sinks.read_run(spark, out, "web", "half").exceptAll(first).count() == 0
    empty = extract_items(spark, hits.limit(0), out=out, papers=False, feeds=False, web=True)["web"]
    assert empty.count() == 0 and sinks.read_run(spark, out, "web").count() == 0
    assert first.count() == n  # an earlier run's rows stay readable


def test_item_files_follow_bytes(spark, tmp_path):
    from feedlake import sinks
    days = spark.range(0, 4000, numPartitions=16).selectExpr("id", "cast(id % 10 as string) digest_key")
    sinks.write_items(days, str(tmp_path / "t"))
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 20  # 16 tasks x 10 days before


def test_a_run_is_read_without_a_look_at_other_runs(spark, tmp_path):
    from feedlake import sinks
    out, schemas = str(tmp_path / "runs-out"), {}
    for run in ("first", "half", "second"):
        rows = spark.createDataFrame([(run, 1)], "title string, pos int").withColumns({"run_id": F.lit(run), "digest_key": F.lit("2026-04-02")})
        sinks.write_items(rows, sinks.run_path(out, "papers"), ["run_id", "digest_key"])
        schemas = {"papers": rows.schema, "web": rows.schema}
        if run != "half":
            sinks.commit_run(spark, out, run, schemas)
    for run, title in (("first", "first"), (None, "second")):
        df = sinks.read_run(spark, out, "papers", run)
        assert [r.title for r in df.collect()] == [title]
        assert all(f"run_id={title}/" in f for f in df.inputFiles())
    empty = sinks.read_run(spark, out, "web")
    assert empty.count() == 0 and sorted(empty.columns) == ["digest_key", "pos", "title"]
