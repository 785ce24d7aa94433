"""Named queries over the driver tables: each is ``(spark, sf_dir) -> DataFrame``.

Outputs are compact and comparison-friendly: long texts are returned as
``md5`` + length, arrays as joined strings, counts as BIGINT.
"""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake import sinks
from feedlake.functions.dates import norm_date
from feedlake.operators import digest as dg
from feedlake.operators import extract as ex
from feedlake.operators import quality as qa
from feedlake.operators import retention as rt
from feedlake.operators.positions import pair_summaries
from feedlake.operators import search as se
from feedlake.operators import summarize as sm
from feedlake.plans import fixtures as fx
from feedlake.plans.jobs import extract_items
from feedlake.session import ensure_checkpoint_dir, write_once
from feedlake.sources import (attach_feed, attach_urls, completions_from_json, read_digests, read_file_inventory, read_payloads,
                              read_report_lines, read_scorecards, read_search_hits, select_sources)
from feedlake.streaming.ingest import land_payloads, run_ingest_once
from feedlake.streaming.scorecard import run_probe_outcomes

AS_OF = "2024-02-15 00:00:00"
KEEP_DAYS = 30
REPORT_KEEP_DAYS = 7
ARTICLES_PER_FEED = 15
LANDED_A_TURN = 20_000  # files that are listed at once


def _bigint(c):
    return F.col(c).cast("bigint")


# ---- shared building blocks ------------------------------------------------

def registered_feed_payloads(spark: SparkSession, sf: str, with_rejects: bool = True) -> DataFrame:
    return attach_feed(fx.feed_payloads(spark, sf, with_rejects), fx.feed_registry(spark, sf))


def completions(spark: SparkSession, sf: str) -> DataFrame:
    return completions_from_json(fx.completion_payloads(spark, sf))


def digest_sources(spark: SparkSession, sf: str, summarize: bool = True, papers: bool = True,
                   feeds: bool = True, web: bool = True, cap: int | None = ARTICLES_PER_FEED):
    """Extracted items of the three kinds, keyed by digest day, and the completions."""
    key = {"digest_key": dg.digest_day()}
    pap = arts = hits = None
    if papers:
        pap = ex.extract_papers(fx.arxiv_payloads(spark, sf)).withColumns(key)
    if feeds:
        arts = ex.extract_articles(registered_feed_payloads(spark, sf), cap).withColumns(key)
    if web:
        hits = ex.extract_web_results(fx.serp_payloads(spark, sf)).withColumns(key)
    return pap, arts, hits, completions(spark, sf) if summarize else None


def digest_rows(spark: SparkSession, sf: str, **kw) -> DataFrame:
    """Digest items: caps, then summaries of what is left. Articles are cut in their payloads already."""
    return dg.summarized_digest_items(*digest_sources(spark, sf, **kw), articles_per_feed=None)


def digests(spark: SparkSession, sf: str, **kw) -> DataFrame:
    """Full digest job: payloads -> items -> caps -> summaries -> one Markdown per day."""
    return dg.render_digests(digest_rows(spark, sf, **kw))


def _md_out(df: DataFrame) -> DataFrame:
    return df.select("digest_key", F.md5("md").alias("md_md5"), F.length("md").cast("bigint").alias("md_chars"),
                     F.size(F.split("md", "\n")).cast("bigint").alias("md_lines"))


# ---- digest ------------------------------------------------------------------

def q_digest_render(spark, sf):
    """AGG-1 + full job (EXT-*, JOIN-2/3, WIN-1/2, SET-2, PRJ-5..8)."""
    return _md_out(digests(spark, sf))


def q_digest_items(spark, sf):
    """SET-2, JOIN-1, WIN-2, PRJ-5..8: one row per rendered item."""
    n = dg.number_items(digest_rows(spark, sf))
    return n.select("digest_key", _bigint("section").alias("section"), _bigint("rn").alias("rn"), "title",
                    F.md5("block").alias("block_md5"))


def q_digest_files(spark, sf):
    """AGG-1, WIN-2, SNK-1: every day's digest without a cap, written as ordered files and read back."""
    out = _scratch(spark, "digests")
    pap, arts, hits, comps = digest_sources(spark, sf, cap=None)
    items = dg.summarized_digest_items(pap, arts, hits, comps, None, None, None)
    sinks.write_digest_blocks(dg.digest_blocks(items, partitions=32), out, partitions=32)
    return _md_out(read_digests(spark, out))


def q_digest_empty_sections(spark, sf):
    """JOIN-4: feeds-only run without summarizer over every event day (empty digests too)."""
    items = digest_rows(spark, sf, summarize=False, papers=False, web=False)
    keys = fx.table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("digest_key"))
    return _md_out(dg.render_digests(items, keys=keys))


def q_feed_cap(spark, sf):
    """WIN-1: first 15 articles of every feed in fetch/feed order."""
    capped = ex.extract_articles(registered_feed_payloads(spark, sf), ARTICLES_PER_FEED)
    return capped.select("feed_name", "payload_id", _bigint("pos").alias("pos"), "title")


# ---- extraction --------------------------------------------------------------

def _article_out(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("payload_id", _bigint("pos").alias("pos"), *extra, "title", "link",
                     F.md5("summary").alias("summary_md5"), F.length("summary").cast("bigint").alias("summary_chars"),
                     "published", F.array_join("authors", "|").alias("authors"))


def q_atom_articles(spark, sf):
    """EXT-1, STR-F1/F2, ARR-1/2, DATE-1."""
    return _article_out(ex.extract_atom(fx.feed_payloads(spark, sf)))


def q_rss_articles(spark, sf):
    """EXT-2."""
    return _article_out(ex.extract_rss(fx.feed_payloads(spark, sf)))


def q_feed_dispatch(spark, sf):
    """EXT-3, EXT-8: payloads and items per detected format (rejects included)."""
    f = ex.feed_format(fx.feed_payloads(spark, sf))
    return f.groupBy("format").agg(F.count(F.lit(1)).alias("n_payloads"),
                                   F.sum("n_items").cast("bigint").alias("n_items"))


def q_arxiv_papers(spark, sf):
    """EXT-4, STR-F4."""
    p = ex.extract_papers(fx.arxiv_payloads(spark, sf))
    return p.select("payload_id", _bigint("pos").alias("pos"), "arxiv_id", "title",
                    F.md5("summary").alias("summary_md5"), F.array_join("authors", "|").alias("authors"),
                    "published", "primary_category", F.array_join("categories", "|").alias("categories"),
                    "pdf_url", "comment")


def q_paper_listing(spark, sf):
    """EXT-5."""
    l = se.paper_listing(ex.extract_papers(fx.arxiv_payloads(spark, sf)))
    return l.select("id", "title", "published", "authors_text", "categories_text",
                    F.md5("abstract").alias("abstract_md5"), F.length("abstract").cast("bigint").alias("abstract_chars"),
                    "pdf")


def q_date_normalize(spark, sf):
    """DATE-1 over seven feed spellings and five old mail spellings of every document's day."""
    d = fx.table(spark, sf, "documents").select("doc_id")
    raw = fx.published_variant(F.col("doc_id"), F.date_add(F.lit(fx.BASE_DAY).cast("date"),
                                                           (F.col("doc_id") % 30).cast("int")))
    mail = fx.mail_variant(F.col("doc_id"), F.date_add(F.lit(fx.BASE_DAY).cast("date"), (F.col("doc_id") % 30).cast("int")))
    return d.select("doc_id", raw.alias("raw"), norm_date(raw).alias("published"), mail.alias("raw_mail"), norm_date(mail).alias("mail_day"))


def q_web_results(spark, sf):
    """EXT-6, TOP-2, STR-F5: first 5 hits per page."""
    w = ex.extract_web_results(fx.serp_payloads(spark, sf), 5)
    return w.select("payload_id", _bigint("pos").alias("pos"), "title", "href", "body", "source")


def q_feed_registry_join(spark, sf):
    """SRC-3, FIL-1, JOIN-2: payloads with their registry entry."""
    p = registered_feed_payloads(spark, sf)
    return p.select("payload_id", "feed_name", _bigint("registry_pos").alias("registry_pos"))


def q_source_selection(spark, sf):
    """FIL-2, SET-1, EXT-9: item counts per source with papers+feeds on, web off."""
    payloads = select_sources(fx.all_payloads(spark, sf), papers=True, feeds=True, web=False)
    arts = ex.extract_articles(attach_feed(payloads.where(F.col("kind") == "feed"), fx.feed_registry(spark, sf)))
    paps = ex.extract_papers(payloads.where(F.col("kind") == "arxiv")).withColumn("feed_name", F.lit("arXiv"))
    items = arts.select("kind", "feed_name").unionByName(paps.select("kind", "feed_name"))
    return ex.source_counts(items).withColumn("n_items", _bigint("n_items"))


def q_landed_files(spark, sf):
    """SRC-1/2/4: payloads landed as raw files, read back with a manifest of their urls and matched to the registry (JOIN-2)."""
    landing = _scratch(spark, "landed")
    payloads = fx.feed_payloads(spark, sf)
    # the driver keeps the names of what it writes and lists: files land and are read in turns of so many
    last = max(0, payloads.count() - 1) // LANDED_A_TURN
    if last:
        kept = _scratch(spark, "payloads")
        payloads.withColumn("turn", F.pmod(F.xxhash64("payload_id"), F.lit(last + 1))).write.partitionBy("turn").parquet(kept)
        payloads = spark.read.parquet(kept)
    items = None
    for turn in range(last + 1):
        fx.land_files(payloads.where(F.col("turn") == turn) if last else payloads, f"{landing}/{turn}")
        # one listing; bodies are parsed where they are read, and only counts meet the manifest and the registry
        some = (ex.extract_articles(read_payloads(spark, f"{landing}/{turn}", "feed", recursive=True))
                .groupBy("payload_id", "url").agg(F.count(F.lit(1)).alias("n")))
        some = some if turn == last else write_once(some, "landed-items")
        items = some if items is None else items.unionByName(some)
    manifest = payloads.select(F.concat(F.lit("payload_id="), F.col("payload_id")).alias("folder"), "url")
    known = attach_feed(attach_urls(items, manifest), fx.feed_registry(spark, sf))
    return (known.groupBy(F.regexp_extract("payload_id", r"/payload_id=([^/]+)/", 1).alias("payload_id"), "feed_name")
            .agg(F.sum("n").alias("n_items")))


# ---- search ------------------------------------------------------------------

def q_search_papers(spark, sf):
    """FIL-3 (cat:), TOP-1: 10 newest cs.CL papers."""
    p = ex.extract_papers(fx.arxiv_payloads(spark, sf))
    r = se.search_papers(p, category="cs.CL", max_results=10)
    return r.select("arxiv_id", "published", "title")


def q_search_keyword(spark, sf):
    """FIL-3 (all:), TOP-1 per category: 5 oldest papers per category mentioning 'the'."""
    p = ex.extract_papers(fx.arxiv_payloads(spark, sf))
    r = se.search_papers(p, keyword="the", sort_order="ascending", max_results=5,
                         group_cols=["primary_category"])
    return r.select("primary_category", _bigint("rank").alias("rank"), "arxiv_id", "published")


def q_listing_text(spark, sf):
    """PRJ-9, WIN-3, STR-F6: numbered listing of the 5 newest papers per category."""
    p = ex.extract_papers(fx.arxiv_payloads(spark, sf))
    top = se.search_papers(p, max_results=5, group_cols=["primary_category"])
    text = se.listing_text(se.paper_listing(top), ["primary_category"], [F.col("rank")])
    return text.select("primary_category", _bigint("n_papers").alias("n_papers"), F.md5("text").alias("text_md5"),
                       F.length("text").cast("bigint").alias("text_chars"))


# ---- summaries -----------------------------------------------------------------

def _summary_out(df: DataFrame, kind_col: str = "item_kind") -> DataFrame:
    return df.select(kind_col, "item_id", "headline", F.size("key_points").cast("bigint").alias("n_points"),
                     F.md5(F.array_join("key_points", "\n")).alias("points_md5"), "relevance")


def q_prompts(spark, sf):
    """PRJ-2..4: one prompt per paper, article and web hit."""
    pap, arts, hits = (ex.extract_papers(fx.arxiv_payloads(spark, sf)),
                       ex.extract_articles(fx.feed_payloads(spark, sf)),
                       ex.extract_web_results(fx.serp_payloads(spark, sf)))
    out = sm.build_prompts(pap, "paper").unionByName(sm.build_prompts(arts, "article")) \
        .unionByName(sm.build_prompts(hits, "web"))
    return out.select("item_kind", "item_id", F.md5("prompt").alias("prompt_md5"),
                      F.length("prompt").cast("bigint").alias("prompt_chars"))


def q_structured_summaries(spark, sf):
    """EXT-7, SRC-8, JSON-1: completions parsed into summaries."""
    return _summary_out(sm.structure_completions(completions(spark, sf)))


def q_summary_fallback(spark, sf):
    """PRJ-1, JOIN-3: every article gets a summary; completion when present."""
    arts = ex.extract_articles(fx.feed_payloads(spark, sf))
    s = sm.with_summaries(arts, "article", completions(spark, sf))
    return s.select("item_kind", "item_id", F.col("summary_s.headline").alias("headline"),
                    F.size("summary_s.key_points").cast("bigint").alias("n_points"),
                    F.md5(F.array_join("summary_s.key_points", "\n")).alias("points_md5"),
                    F.col("summary_s.relevance").alias("relevance"))


def q_pair_summaries(spark, sf):
    """JOIN-1: the list of papers (newest first by id) and the list of parsed completions paired by position, the longer one cut."""
    papers = ex.extract_papers(fx.arxiv_payloads(spark, sf)).select("arxiv_id", "title", F.length("arxiv_id").alias("digits"))
    parsed = sm.structure_completions(completions(spark, sf)).select("item_id", "headline")
    paired = pair_summaries(papers, parsed, ["digits", "arxiv_id"], ["item_id"], partitions=16)
    return paired.select("position", "arxiv_id", "title", F.col("summary_s.item_id").alias("item_id"),
                         F.md5("summary_s.headline").alias("headline_md5"))


# ---- retention -----------------------------------------------------------------

def q_retention_plan(spark, sf):
    """FIL-4, DATE-2, AGG-2: archive plan per folder, keep 30 days."""
    m = rt.mark_expired(fx.digest_inventory(spark, sf), AS_OF, KEEP_DAYS, by="name")
    return rt.retention_plan(m, "archive", ["folder"])


def q_retention_kept(spark, sf):
    """JOIN-5: files that stay live (kept and skipped)."""
    m = rt.mark_expired(fx.digest_inventory(spark, sf), AS_OF, KEEP_DAYS, by="name")
    return rt.kept(m).select("path", F.date_format("file_date", "yyyy-MM-dd").alias("file_date"), "status")


def q_retention_by_mtime(spark, sf):
    """FIL-5, AGG-3: delete plan for reports older than 7 days."""
    files = fx.report_files(fx.report_lines(spark, sf))
    m = rt.mark_expired(files, AS_OF.replace("02-15", "01-25"), REPORT_KEEP_DAYS, by="mtime")
    return rt.retention_plan(m, "delete")


def q_retention_apply(spark, sf):
    """SNK-1, SNK-3: digests written as text files, then archived and deleted from their manifest; what is left is read again."""
    live, archive = _scratch(spark, "live"), _scratch(spark, "archive")
    sinks.write_digests(fx.digest_texts(spark, sf).repartition("digest_key"), live)
    done = rt.apply_retention(spark, live, AS_OF, KEEP_DAYS, archive_path=archive)
    held = rt.read_archive(spark, archive).agg(F.sum(F.octet_length("content")).cast("bigint").alias("bytes_archived"))
    left = (read_file_inventory(spark, live, recursive=True)
            .agg(F.count("*").alias("files_left"), F.sum("length").cast("bigint").alias("bytes_left")))
    return done.crossJoin(held).crossJoin(left)  # one row each


def q_file_inventory(spark, sf):
    """SRC-5/6, TOP-4: a metadata-only listing of written digests with the action that a dry run names for each file."""
    live = _scratch(spark, "inventory")
    sinks.write_digests(fx.digest_texts(spark, sf).repartition("digest_key"), live)
    marked = rt.mark_expired(read_file_inventory(spark, live, recursive=True), AS_OF, KEEP_DAYS, by="partition")
    plan = rt.dry_run_listing(marked, "delete")
    return (marked.join(plan, "path", "left")
            .select(F.date_format("file_date", "yyyy-MM-dd").alias("file_date"), _bigint("length").alias("length"), "status", "action"))


def q_search_hits(spark, sf):
    """SRC-10: structured hits written as JSON lines, read back with their response id and place."""
    out = _scratch(spark, "hits")
    fx.search_hits(spark, sf).write.json(out)
    hits = read_search_hits(spark, out)
    return hits.select("payload_id", _bigint("pos").alias("pos"), "title", "href", F.md5("body").alias("body_md5"), "source")


def q_item_tables(spark, sf):
    """SNK-4: item tables of two runs, the second never committed; what a reader sees is the first."""
    out = _scratch(spark, "items")
    run = extract_items(spark, fx.all_payloads(spark, sf), fx.feed_registry(spark, sf), out, web=True)
    half = sinks.run_path(out, "papers")
    sinks.write_items(run["papers"].withColumn("run_id", F.lit("half")), half, ["run_id", "digest_key"])
    return reduce(DataFrame.unionByName, [
        sinks.read_run(spark, out, t).groupBy(F.col("digest_key").cast("string").alias("digest_key"))
        .agg(F.count("*").alias("n_items"), F.sum(F.length("title")).alias("title_chars"))
        .select(F.lit(t).alias("kind"), "digest_key", "n_items", "title_chars") for t in ("papers", "articles", "web")])


# ---- quality -------------------------------------------------------------------

def q_error_scan(spark, sf):
    """FIL-6, TOP-3, AGG-4: error lines in the 10 newest reports."""
    lines = fx.report_lines(spark, sf)
    s = qa.error_scan(lines, fx.report_files(lines))
    return s.select("path", _bigint("n_lines").alias("n_lines"), _bigint("n_errors").alias("n_errors"))


def q_report_lines(spark, sf):
    """SRC-7: report files read back by splits, with line numbers."""
    out = _scratch(spark, "reports")
    fx.write_reports(spark, sf, out)
    lines = read_report_lines(spark, out, glob="*.txt")
    return lines.select(F.regexp_extract("path", r"/day=([^/]+)/", 1).alias("day"), "line_no", F.md5("line").alias("line_md5"))


def q_latest_artifact(spark, sf):
    """AGG-5: newest digest file per folder and its size gate."""
    l = qa.latest_artifact(fx.digest_inventory(spark, sf), group_cols=["folder"])
    return l.select("folder", "path", _bigint("length").alias("length"), "ok")


def _outcomes(spark, sf):
    return qa.classify_checks(fx.check_results(spark, sf))


def _day_str(c="cycle_ts"):
    return F.date_format(c, "yyyy-MM-dd").alias("cycle")


def q_check_status(spark, sf):
    """FIL-7: one outcome per (cycle, probe)."""
    o = _outcomes(spark, sf)
    return o.select(_day_str(), "kind", "target", "ok", _bigint("status").alias("status"))


def q_feed_details(spark, sf):
    """AGG-6: feeds all-ok flag and detail map per cycle."""
    d = qa.feed_details(_outcomes(spark, sf))
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("details")),
                                       lambda e: F.concat(e["key"], F.lit("="), e["value"]["ok"].cast("string"),
                                                          F.lit("/"), e["value"]["status"].cast("string"))), ";")
    return d.select(_day_str(), "all_ok", _bigint("n_feeds").alias("n_feeds"), F.md5(entries).alias("details_md5"))


def q_scorecard(spark, sf):
    """AGG-7, AGG-8, MATH-1: score, grade and pass flag per cycle."""
    s = qa.scorecard(_outcomes(spark, sf))
    return s.select(_day_str(), _bigint("n_checks").alias("n_checks"), _bigint("n_passed").alias("n_passed"),
                    "grade", "passed")


def q_scorecard_files(spark, sf):
    """SNK-2, SRC-9, MATH-1: scorecards written as JSON reports, one per cycle, and their rounded scores read back."""
    out = _scratch(spark, "scorecards")
    s = qa.scorecard(_outcomes(spark, sf)).select(_day_str(), F.col("score_2dp").alias("score"), "grade")
    sinks.write_scorecard(s, out, partition_cols=["cycle"])
    return read_scorecards(spark, out).select(F.regexp_extract("path", r"/cycle=([^/]+)/", 1).alias("cycle"), "score")


def release_gates(spark, sf) -> DataFrame:
    """Rows of the five gates per cycle: last test run, working tree, report errors of the day, digest size, saved health score."""
    health = qa.scorecard(_outcomes(spark, sf)).select(_day_str(), F.lit("health").alias("gate"),
                                                       F.col("passed").alias("ok"))
    lines = fx.report_lines(spark, sf)
    errs = (lines.withColumn("cycle", F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1))
            .groupBy("cycle").agg((F.count_if(qa.is_error_line("line")) == 0).alias("ok"))
            .select("cycle", F.lit("report_errors").alias("gate"), "ok"))
    inv = fx.digest_inventory(spark, sf).withColumn("cycle", F.date_format("modificationTime", "yyyy-MM-dd"))
    size = qa.latest_artifact(inv, group_cols=["cycle"]).select("cycle", F.lit("digest_size").alias("gate"), "ok")
    tests = qa.test_run_gate(fx.test_runs(spark, sf), ["cycle"])
    tree = qa.clean_tree_gate(fx.tree_status(spark, sf), ["cycle"])
    return health.unionByName(errs).unionByName(size).unionByName(tests).unionByName(tree)


def q_release_gate(spark, sf):
    """AGG-9: FAST-FORWARD / INVESTIGATE per cycle from all five gates; a cycle without a test run or tree status fails."""
    g = qa.release_gate(release_gates(spark, sf), ["cycle"], required=["tests", "clean_tree"])
    return g.select("cycle", "ok", _bigint("n_gates").alias("n_gates"), _bigint("n_failed").alias("n_failed"),
                    "action")


# ---- streaming -------------------------------------------------------------------

def _scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared checkpoint dir (never machine-local on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/feedlake-{what}-{uuid.uuid4().hex}"


def q_stream_ingest(spark, sf):
    """STR-1: feed payloads are appended to a landing table; the stream extracts and appends articles."""
    landing, out = _scratch(spark, "landing"), _scratch(spark, "articles")
    payloads = fx.feed_payloads(spark, sf)
    land_payloads(payloads, landing)
    arts = run_ingest_once(spark, landing, out, kind="feed", registry=fx.feed_registry(spark, sf),
                           schema=payloads.schema)
    return _article_out(arts, "feed_name")


def ntz_as_instant(c) -> Column:
    """TIMESTAMP_NTZ wall clock -> the TIMESTAMP instant with that UTC wall clock."""
    tz = F.current_timezone()
    return F.from_utc_timestamp(F.col(c).cast("timestamp"), tz)


def q_stream_scorecard(spark, sf):
    """STR-2: daily scorecard from streamed probe outcomes, 1 hour watermark; the open day included."""
    events = fx.table_stream(spark, sf, "events")
    checks = fx.check_rows(events).withColumn("ts", ntz_as_instant("ts"))
    outcomes = run_probe_outcomes(checks, _scratch(spark, "outcomes"), _scratch(spark, "outcomes-ckpt"))
    s = qa.scorecard(outcomes)
    day = F.date_from_unix_date(F.floor(F.unix_seconds("cycle_ts") / 86400).cast("int"))
    return s.select(F.date_format(day, "yyyy-MM-dd").alias("cycle"), _bigint("n_checks").alias("n_checks"),
                    _bigint("n_passed").alias("n_passed"), "grade", "passed")
