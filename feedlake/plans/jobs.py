"""End-to-end jobs over real inputs (landed payloads, a registry, completions).

The digest job writes its item tables before rendering: the written table cuts
the lineage (a lost executor never re-parses XML upstream of it) and is the
SNK-4 output anyway. Intermediate tables go to the session's shared
``spark.checkpoint.dir`` unless an output folder is given.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake import sinks
from feedlake.operators import digest as dg
from feedlake.operators import extract as ex
from feedlake.session import ensure_checkpoint_dir
from feedlake.sources import attach_feed, select_sources


def extract_items(spark: SparkSession, payloads: DataFrame, registry: DataFrame | None = None,
                  out: str | None = None, papers: bool = True, feeds: bool = True,
                  web: bool = False, web_results: int | None = 5) -> dict[str, DataFrame]:
    """Parse payloads into the three item tables, written partitioned by digest day.

    Returns this run's rows read back from storage (lineage starts there). A run is a folder of
    its own in every table (``run_id``) and is committed after all its tables are written
    (``sinks.commit_run``): readers see whole runs only, and items of earlier runs take no part.
    """
    chosen = select_sources(payloads, papers=papers, feeds=feeds, web=web)
    key = {"digest_key": dg.digest_day()}
    base = out or f"{ensure_checkpoint_dir(spark).rstrip('/')}/feedlake-job-{uuid.uuid4().hex}"
    parts = {}
    if papers:
        parts["papers"] = ex.extract_papers(chosen.where(F.col("kind") == "arxiv"))
    if feeds:
        fp = chosen.where(F.col("kind") == "feed")
        parts["articles"] = ex.extract_articles(attach_feed(fp, registry) if registry is not None else fp)
    if web:
        parts["web"] = ex.extract_web_results(chosen.where(F.col("kind") == "serp"), web_results)
    schemas, run = {}, uuid.uuid4().hex
    for name, df in parts.items():
        keyed = df.withColumns(key).withColumn("run_id", F.lit(run))
        sinks.write_items(keyed, sinks.run_path(base, name), ["run_id", "digest_key"])
        schemas[name] = keyed.schema
    sinks.commit_run(spark, base, run, schemas)
    return {name: sinks.read_run(spark, base, name, run) for name in parts}


def digest_job(spark: SparkSession, payloads: DataFrame, registry: DataFrame | None = None,
               completions: DataFrame | None = None, out: str | None = None, title: str = dg.DEFAULT_TITLE,
               footer: str = dg.DEFAULT_FOOTER, papers_per_digest: int | None = 5,
               articles_per_feed: int | None = 15, web_per_digest: int | None = 5,
               papers: bool = True, feeds: bool = True, web: bool = False,
               split_hot_groups: bool = False, web_results: int | None = 5) -> DataFrame:
    """payloads -> item tables (written) -> summaries -> one digest per day (written when ``out``).

    Written digests are ordered files per day (``sinks.write_digest_blocks``): a day of any size is numbered
    and written by many tasks. The returned frame has one string per digest; ``split_hot_groups`` numbers
    it in the same way (for runs without caps). ``web_results``: hits kept per search page (None: all).
    """
    t = extract_items(spark, payloads, registry, out, papers=papers, feeds=feeds, web=web, web_results=web_results)
    t = {k: v.withColumn("digest_key", F.col("digest_key").cast("string")) for k, v in t.items()}
    items = dg.summarized_digest_items(t.get("papers"), t.get("articles"), t.get("web"), completions,
                                       papers_per_digest=papers_per_digest, articles_per_feed=articles_per_feed,
                                       web_per_digest=web_per_digest)
    digests = dg.render_digests(items, title=title, footer=footer, split_hot_groups=split_hot_groups)
    if out:
        sinks.write_digest_blocks(dg.digest_blocks(items, title=title, footer=footer), f"{out.rstrip('/')}/digests")
    return digests
