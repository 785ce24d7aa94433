"""Physical-plan properties the scale design relies on."""
from pyspark.sql import functions as F

from conftest import payloads_df
from feedlake.operators import digest as dg
from feedlake.operators import extract as ex
from feedlake.operators import summarize as sm
from feedlake.sources import attach_feed, broadcast_if_small


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cap_is_limited_before_the_exchange(spark):
    a = spark.range(1000).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("feed_name"),
                                 F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("payload_id"), F.col("id").cast("int").alias("pos"),
                                 F.lit(None).cast("timestamp").alias("fetched_at"))
    plan = _plan(dg.cap_per_feed(a, 15))
    below = plan.split("Exchange hashpartitioning(payload_id")[1]
    above = plan.split("Exchange hashpartitioning(payload_id")[0]
    assert "WindowGroupLimit" in below and "Partial" in below.split("\n")[1]
    assert "WindowGroupLimit" in above


def test_extraction_is_narrow(spark):
    df = payloads_df(spark, ['<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t</title></entry></feed>'])
    for plan in (_plan(ex.extract_articles(df)), _plan(ex.extract_papers(df)), _plan(ex.extract_web_results(df))):
        assert "Exchange" not in plan and plan.count("from_xml(") <= 1


def test_registry_broadcast_is_size_checked(spark):
    p = spark.createDataFrame([("p", "u1")], "payload_id string, url string")
    reg = spark.createDataFrame([(i, f"n{i}", f"u{i}") for i in range(5)], "registry_pos int, name string, url string")
    with_hint = _plan(attach_feed(p, reg))
    assert "BroadcastHashJoin" in with_hint or "BroadcastExchange" in with_hint
    # over the bound the hint is not given (AQE may still choose from runtime sizes)
    assert "ResolvedHint" not in broadcast_if_small(reg, max_rows=2)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in broadcast_if_small(reg, max_rows=10)._jdf.queryExecution().analyzed().toString()


def _item_tables(spark, n=300):
    day = F.lit("2026-04-02").alias("digest_key")
    base = [day, F.lit(None).cast("timestamp").alias("fetched_at"), F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("payload_id"),
            F.floor(F.col("id") / 7).cast("int").alias("pos"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title")]
    text = F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 100)
    none = F.array().cast("array<string>")
    rows = spark.range(n)
    papers = rows.select(*base, text.alias("summary"), none.alias("authors"), F.lit("2026-04-01").alias("published"),
                         F.col("id").cast("string").alias("arxiv_id"), *[F.lit("").alias(c) for c in ("pdf_url", "comment", "primary_category")])
    articles = rows.select(*base, text.alias("summary"), none.alias("authors"), F.lit("F").alias("feed_name"),
                           *[F.lit("").alias(c) for c in ("link", "published")])
    web = rows.select(*base, text.alias("body"), *[F.lit("").alias(c) for c in ("href", "source")])
    comps = rows.select(F.element_at(F.array(F.lit("paper"), F.lit("article"), F.lit("web")), (F.col("id") % 3 + 1).cast("int")).alias("item_kind"),
                        F.concat(F.lit("p"), (F.col("id") % 7).cast("string"), F.lit("#"), F.floor(F.col("id") / 7).cast("string")).alias("item_id"),
                        F.concat(F.lit("HEADLINE: h"), F.col("id").cast("string")).alias("response"))
    return papers, articles, web, comps


def test_texts_never_cross_an_exchange(spark, tmp_path):
    """Cap first, then summaries: exchanges carry keys, metadata and at most 200 characters of a text."""
    tables = []
    for i, t in enumerate(_item_tables(spark)):
        t.write.parquet(str(tmp_path / str(i)))
        tables.append(spark.read.parquet(str(tmp_path / str(i))))
    papers, articles, web, comps = tables
    items = dg.summarized_digest_items(papers, articles, web, comps)
    plan = dg.render_digests(items)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanges = [part.split("\n")[1] for part in plan.split("\n\n") if part.startswith("(") and "Exchange" in part.split("\n")[0]]
    carried = [e for e in exchanges if "fallback_s#" in e]
    assert len(exchanges) >= 5 and carried, plan
    assert not any(f"{c}#" in e for e in exchanges for c in ("summary", "body")), exchanges
    # nothing is lost by the order: the same digest as summarising everything first
    every = dg.build_digest_items(*(sm.with_summaries(t, k, comps) for t, k in ((papers, "paper"), (articles, "article"), (web, "web"))))
    assert dg.render_digests(items).collect() == dg.render_digests(every).collect()


def test_slice_cap_needs_no_exchange_and_equals_the_window(spark):
    entry = "<entry><title>t{}</title></entry>"
    feed = '<feed xmlns="http://www.w3.org/2005/Atom">{}</feed>'
    item = "<item><title>t{}</title></item>"
    bodies = [feed.format("".join(entry.format(i) for i in range(n))) for n in (0, 1, 14, 15, 16, 40)]
    bodies += [f"<rss><channel>{''.join(item.format(i) for i in range(n))}</channel></rss>" for n in (0, 15, 16, 33)]
    df = payloads_df(spark, bodies)
    for n in (0, 1, 15, None):
        sliced = ex.extract_articles(df, n)
        assert "Exchange" not in _plan(sliced)
        same = dg.cap_per_feed(ex.extract_articles(df), n)
        assert sorted(map(tuple, sliced.select("payload_id", "pos").collect())) == sorted(map(tuple, same.select("payload_id", "pos").collect()))


def _whole_plan(spark, df):
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)


def test_a_body_is_searched_once_for_each_question(spark):
    """Rewrites of whole bodies are columns of their own: none is repeated inside another expression."""
    df = payloads_df(spark, ['<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t</title></entry></feed>'])
    for items in (ex.extract_papers(df), ex.feed_format(df), ex.rejects(df)):
        plan = _whole_plan(spark, items)
        assert plan.count("regexp_extract(") + plan.count("regexp_replace(") <= 40


def test_a_completion_is_read_once(spark):
    comps = spark.createDataFrame([("article", "a#0", "HEADLINE: h\nKEY POINTS:\n- p\nRELEVANCE: r")], "item_kind string, item_id string, response string")
    arts = spark.createDataFrame([("a", 0, "t", "s")], "payload_id string, pos int, title string, summary string")
    for df in (sm.structure_completions(comps), sm.with_summaries(arts, "article", comps), sm.summarize_capped(sm.slim(arts, "article"), "article", comps)):
        assert _whole_plan(spark, df).count("split(") == 1
