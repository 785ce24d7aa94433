"""Digest rendering, caps and numbering."""
import pytest
from pyspark.sql import functions as F

from feedlake.operators import digest as dg
from feedlake.operators import summarize as sm


def _papers(spark, rows):
    return spark.createDataFrame(rows, "digest_key string, payload_id string, pos int, fetched_at timestamp, "
                                       "arxiv_id string, title string, summary string, authors array<string>, "
                                       "published string, primary_category string, pdf_url string, comment string")


def _articles(spark, rows):
    return spark.createDataFrame(rows, "digest_key string, payload_id string, pos int, fetched_at timestamp, "
                                       "feed_name string, title string, link string, summary string, "
                                       "published string, authors array<string>")


def _web(spark, rows):
    return spark.createDataFrame(rows, "digest_key string, payload_id string, pos int, fetched_at timestamp, "
                                       "title string, href string, body string, source string")


def test_day_without_items(spark):
    keys = spark.createDataFrame([("2019-02-28",), ("2019-03-01",)], "digest_key string")
    items = dg.build_digest_items(_papers(spark, []).withColumn("summary_s", sm.fallback_summary("paper")), None, None)
    got = {r.digest_key: r.md for r in dg.render_digests(items, title="Quiet days", keys=keys).collect()}
    assert set(got) == {"2019-02-28", "2019-03-01"}
    for day, md in got.items():
        head, *sections = md.split("\n\n## ")
        assert head == f"# Quiet days\n\n**Date:** {day}"
        assert [x.split("\n\n")[1][:4] for x in sections] == ["_No "] * 3 and md.endswith(dg.DEFAULT_FOOTER)


def test_day_with_every_kind(spark):
    day = "2019-03-01"
    p = _papers(spark, [(day, "ax", n, None, f"1903.0{n}v1", f"Lattice {n}", "Long text.", ["Noor", "Wen", "Ola"],
                         f"2019-02-2{n}", "math.CO", "u", "3 pages" if n else "") for n in range(2)])
    a = _articles(spark, [(day, "fd", n, None, "Kettle Weekly", f"Pot {n}", f"https://brew.invalid/{n}", "Steam.", "2019-02-27", []) for n in range(2)])
    w = _web(spark, [(day, "sp", 0, None, "Hit", "https://hit.invalid/", "Found.", "engine")])
    said = "headline: ignored\nHEADLINE: Short {0}\nKEY POINTS:\n- one {0}\n- two\nRELEVANCE: much {0}"
    comps = spark.createDataFrame([(kind, item, said.format(item)) for kind, item in
                                   (("paper", "ax#0"), ("paper", "ax#1"), ("article", "fd#1"), ("web", "sp#0"))],
                                  "item_kind string, item_id string, response string")
    md = dg.render_digests(dg.build_digest_items(*(sm.with_summaries(x, kind, comps) for x, kind in
                                                   ((p, "paper"), (a, "article"), (w, "web"))))).first().md
    papers, articles, web = md.split("\n## ")[1:4]
    assert papers.index("### 1. Lattice 1") < papers.index("### 2. Lattice 0") and papers.count("**Comment:**") == 1
    assert papers.count("- **Authors:** Noor, Wen, Ola\n") == 2 and "**Short ax#0**" in papers and "- one ax#1" in papers
    assert "**Short fd#1**" in articles and "Short fd#0" not in articles and "**Authors:**" not in articles
    assert articles.count("- **Source:** Kettle Weekly") == 2 and "- **Source:** engine" in web
    assert "_Relevance:_ much sp#0" in web and not md.endswith("\n")


def test_authors_et_al_and_numbering(spark):
    k = "d"
    rows = [(k, "a", i, None, f"id{i}", f"P{i}", "s", [f"n{j}" for j in range(n)], f"2026-01-0{i + 1}", "c",
             "u", "c1" if i == 0 else "") for i, n in enumerate([0, 4, 5])]
    items = dg.build_digest_items(_papers(spark, rows).withColumn("summary_s", sm.fallback_summary("paper")),
                                  None, None)
    md = dg.render_digests(items).first().md
    # newest first: P2 (5 authors), P1 (4), P0 (0)
    assert "### 1. P2\n- **Authors:** n0, n1, n2, n3 et al.\n" in md
    assert "### 2. P1\n- **Authors:** n0, n1, n2, n3\n" in md
    assert "### 3. P0\n- **Authors:** \n" in md and "- **Comment:** c1" in md


def test_cap_per_feed(spark):
    rows = [("d", f"p{f}", i, None, f"F{f}", f"t{f}{i}", "l", "s", "", []) for f in range(2) for i in range(20)]
    a = _articles(spark, rows)
    assert dg.cap_per_feed(a, 15).count() == 30
    assert dg.cap_per_feed(a, 0).count() == 0
    assert dg.cap_per_feed(a, None).count() == 40
    with pytest.raises(ValueError):
        dg.cap_per_feed(a, -1)
    kept = {(r.feed_name, r.pos) for r in dg.cap_per_feed(a, 3).collect()}
    assert kept == {(f"F{f}", i) for f in range(2) for i in range(3)}


def test_numbering_restarts_per_section_and_plan_shares_exchange(spark):
    k = "d"
    a = _articles(spark, [(k, "f", i, None, "", f"A{i}", "l", "s", "", []) for i in range(3)])
    w = _web(spark, [(k, "s", i, None, f"W{i}", "h", "b", "web") for i in range(2)])
    items = dg.build_digest_items(None, a.withColumn("summary_s", sm.fallback_summary("article")),
                                  w.withColumn("summary_s", sm.fallback_summary("web")))
    n = {(r.section, r.title): r.rn for r in dg.number_items(items).collect()}
    assert n == {(2, "A0"): 1, (2, "A1"): 2, (2, "A2"): 3, (3, "W0"): 1, (3, "W1"): 2}
    md = dg.render_digests(items).first().md
    assert "- **Source:** RSS" in md  # empty feed name falls back
    plan = dg.render_digests(items)._jdf.queryExecution().executedPlan().toString()
    # one exchange on digest_key feeds both the numbering window and the render aggregate:
    # above it (window, partial and final aggregate) there is no other exchange
    above = plan.split("REPARTITION_BY_COL")[0]
    assert above.count("Exchange") == 1 and "Window" in above and "ObjectHashAggregate" in above, plan


def test_split_numbering_equals_window_numbering(spark, sf_small):
    from feedlake.plans import catalog as C
    items = dg.summarized_digest_items(*C.digest_sources(spark, sf_small), articles_per_feed=None,
                                       papers_per_digest=None, web_per_digest=None)
    cols = ["digest_key", "section", "rn", "title", "block"]
    a = dg.number_items(items).select(*cols)
    b = dg.number_items_split(items, partitions=7).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # one hot digest: 3000 items of one section spread over several range partitions
    hot = _articles(spark, [("hot", f"p{i // 50:03d}", i % 50, None, "F", f"t{i}", "l", "s", "", [])
                            for i in range(3000)])
    hot_items = dg.build_digest_items(None, hot.withColumn("summary_s", sm.fallback_summary("article")), None,
                                      articles_per_feed=None)
    nums = dg.number_items_split(hot_items, partitions=6)
    got = sorted((r.title, r.rn) for r in nums.collect())
    assert sorted(r for _, r in got) == list(range(1, 3001))
    assert dict(got)["t0"] == 1 and dict(got)["t2999"] == 3000 and dict(got)["t1234"] == 1235
    assert dg.render_digests(hot_items, split_hot_groups=True).first().md == dg.render_digests(hot_items).first().md


def _hot_items(spark, n, extra=()):
    rows = spark.range(n).select(
        F.lit("2026-04-02").alias("digest_key"), F.lit(2).alias("section"),
        F.struct(F.lit(0).cast("bigint").alias("o_rank"), F.lit(None).cast("timestamp").alias("fetched_at"),
                 F.format_string("p%07d", "id").alias("payload_id"), F.lit(0).alias("pos")).alias("ord"),
        F.concat(F.lit("title "), F.col("id")).alias("title"), F.concat(F.lit("line\nrest "), F.col("id")).alias("rest"))
    for key, section in extra:
        rows = rows.unionByName(rows.limit(1).withColumns({"digest_key": F.lit(key), "section": F.lit(section)}))
    return rows


def test_digest_files_equal_rendered_digests(spark, tmp_path):
    """Ordered files, one after the other, are the text; sections without items and days without any included."""
    from feedlake import sinks
    from feedlake.sources import read_digests

    items = _hot_items(spark, 300, [("2026-04-01", 1), ("2026-04-03", 3)]).cache()
    keys = spark.createDataFrame([("2026-04-04",), ("2026-04-02",)], "digest_key string")
    out = str(tmp_path / "d")
    for _ in range(2):  # writing again replaces
        sinks.write_digest_blocks(dg.digest_blocks(items, keys=keys, partitions=5), out, partitions=6)
    want = {r.digest_key: r.md for r in dg.render_digests(items, keys=keys).collect()}
    assert {r.digest_key: r.md for r in read_digests(spark, out).collect()} == want and len(want) == 4
    files = sorted(p for p in (tmp_path / "d" / "digest_date=2026-04-02").iterdir() if p.name.startswith("part"))
    assert len(files) > 1 and "".join(f.read_text() for f in files) == want["2026-04-02"] + "\n"


def test_a_day_of_100_000_items_is_spread(spark, tmp_path):
    from feedlake import sinks

    out = str(tmp_path / "d")
    sinks.write_digest_blocks(dg.digest_blocks(_hot_items(spark, 100_000), partitions=40), out, partitions=40)
    lines = spark.read.text(out).where("value like '### %'").groupBy(F.col("_metadata.file_name")).count().collect()
    assert sum(r["count"] for r in lines) == 100_000 and max(r["count"] for r in lines) < 8_000
    numbers = spark.read.text(out).where("value like '### %'").select(F.regexp_extract("value", r"### (\d+)\. title (\d+)", 1).cast("int").alias("n"),
                                                                    F.regexp_extract("value", r"title (\d+)", 1).cast("int").alias("t"))
    assert numbers.where("n <> t + 1").count() == 0


def test_items_are_computed_once_for_blocks(spark):
    from pyspark.sql import functions as F

    from feedlake.operators.digest import digest_blocks
    seen = spark.sparkContext.accumulator(0)

    def told(title):
        seen.add(1)
        return title
    items = spark.range(200, numPartitions=3).select(
        F.concat(F.lit("2024-01-0"), (F.col("id") % 3 + 1).cast("string")).alias("digest_key"), F.lit(1).alias("section"),
        F.struct(F.col("id").alias("o_rank")).alias("ord"), F.udf(told, "string").asNondeterministic()(F.col("id").cast("string")).alias("title"),
        F.lit("rest").alias("rest"))
    rows = digest_blocks(items, partitions=4).where("rn > 0").collect()
    assert len(rows) == 200 and seen.value == 200
