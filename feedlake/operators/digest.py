"""Digest building: caps, section numbering and Markdown rendering.

Shuffle plan of a digest job: the per-feed cap and the per-digest top-k run as
``WindowGroupLimit`` (a partial limit before the exchange, so a hot feed ships
at most ``n`` rows per map task); the items are then exchanged once on
``digest_key`` and both the section numbering window and the rendering
aggregate reuse that partitioning. Only pre-rendered text blocks cross the
exchange, never item bodies.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlake.functions.text import join_names, or_default
from feedlake.operators import summarize as sm

# Section headers and empty-section notes, in section order.
SECTIONS = {
    1: ("## arXiv Papers", "_No papers fetched._"),
    2: ("## RSS / Blog Articles", "_No articles fetched._"),
    3: ("## Web Search Highlights", "_No web results fetched._"),
}
# Markdown line formats of a digest, one %s per field.
DIGEST_FORMATS = {
    "title": "# %s",
    "date": "**Date:** %s",
    "item_heading": "### %s. %s",
    "paper_authors": "- **Authors:** %s%s",
    "paper_et_al": " et al.",
    "paper_published": "- **Published:** %s | **Category:** %s",
    "paper_pdf": "- **PDF:** [%s](%s)",
    "paper_id": "- **arXiv ID:** [%s](https://arxiv.org/abs/%s)",
    "paper_comment": "- **Comment:** %s",
    "article_source": "- **Source:** %s",
    "article_source_default": "RSS",
    "article_published": "- **Published:** %s",
    "article_link": "- **Link:** [%s](%s)",
    "article_authors": "- **Authors:** %s",
    "web_link": "- **Link:** [%s](%s)",
    "web_source": "- **Source:** %s",
    "headline": "**%s**",
    "key_point": "- %s",
    "relevance": "_Relevance:_ %s",
    "item_rule": "---",
}
SECTION_OF_KIND = {"paper": 1, "article": 2, "web": 3}
DEFAULT_TITLE = "Research Digest"
DEFAULT_FOOTER = "*Generated by feedlake*"
MAX_LISTED_AUTHORS = 4


def _check_n(n: int | None) -> None:
    if n is not None and n < 0:
        raise ValueError("a cap must be >= 0 or None")


def top_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column | str],
                  n: int | None, rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows of each group in ``order_cols`` order (None = all).

    ``row_number() <= n`` is planned as WindowGroupLimit: each map task keeps
    ``n`` rows per group before the shuffle, so a skewed group costs ``n`` rows
    per task in the exchange, not its full size.
    """
    _check_n(n)
    if n is None and rank_col is None:
        return df
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    out = df.withColumn("_rn", F.row_number().over(w))
    if n is not None:
        out = out.where(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank_col) if rank_col else out.drop("_rn")


def cap_per_feed(articles: DataFrame, n: int | None = 15,
                 group_cols: Sequence[str] = ("payload_id",),
                 order_cols: Sequence[str] = ("fetched_at", "payload_id", "pos")) -> DataFrame:
    """Keep the first ``n`` articles of each fetched feed in feed order (WIN-1).

    A fetched feed is one payload: feeds that share a display name (or have
    none, or are not registered) are never capped together.
    """
    return top_per_group(articles, list(group_cols), [c for c in order_cols if c in articles.columns], n)


def digest_day(ts_col: str = "fetched_at") -> Column:
    """Digest key of an item: the UTC day it was fetched."""
    return F.date_format(F.col(ts_col), "yyyy-MM-dd")


# ---- per-item lines (PRJ-5..8) ---------------------------------------------

def _fmt(name: str, *cols: Column) -> Column:
    return F.format_string(DIGEST_FORMATS[name], *cols)


def _body_lines(summary: Column) -> Column:
    return F.concat(
        F.array(F.lit(""), _fmt("headline", summary["headline"]), F.lit("")),
        F.transform(summary["key_points"], lambda p: _fmt("key_point", p)),
        F.array(F.lit(""), _fmt("relevance", summary["relevance"]), F.lit(""),
                F.lit(DIGEST_FORMATS["item_rule"]), F.lit("")),
    )


def paper_meta_lines() -> Column:
    authors = F.col("authors")
    et_al = F.when(F.size(authors) > MAX_LISTED_AUTHORS, F.lit(DIGEST_FORMATS["paper_et_al"])).otherwise(F.lit(""))
    lines = F.array(
        _fmt("paper_authors", join_names(F.slice(authors, 1, MAX_LISTED_AUTHORS)), et_al),
        _fmt("paper_published", F.col("published"), F.col("primary_category")),
        _fmt("paper_pdf", F.col("pdf_url"), F.col("pdf_url")),
        _fmt("paper_id", F.col("arxiv_id"), F.col("arxiv_id")),
        F.when(F.col("comment") != "", _fmt("paper_comment", F.col("comment"))),
    )
    return F.filter(lines, lambda x: x.isNotNull())


def article_meta_lines() -> Column:
    authors = F.coalesce(F.col("authors"), F.array().cast("array<string>"))
    lines = F.array(
        _fmt("article_source", or_default(F.col("feed_name"), DIGEST_FORMATS["article_source_default"])),
        _fmt("article_published", F.col("published")),
        _fmt("article_link", F.col("link"), F.col("link")),
        F.when(F.size(authors) > 0, _fmt("article_authors", join_names(authors))),
    )
    return F.filter(lines, lambda x: x.isNotNull())


def web_meta_lines() -> Column:
    return F.array(_fmt("web_link", F.col("href"), F.col("href")), _fmt("web_source", F.col("source")))


_META = {"paper": paper_meta_lines, "article": article_meta_lines, "web": web_meta_lines}


def item_lines(kind: str) -> Column:
    """Every line of an item after its ``### i. title`` heading."""
    return F.concat(_META[kind](), _body_lines(F.col("summary_s")))


def digest_items(kind: str, items: DataFrame, rank_col: str | None = None) -> DataFrame:
    """Project summarised items of one kind to the digest item shape (SET-2 input).

    ``items`` carry ``digest_key`` and ``summary_s`` (see ``with_summaries``).
    Items are ordered in source order: ``rank_col`` (the paper ranking, or the
    feed's registry position), then fetch time, payload and position. Only keys,
    that order and the pre-rendered text leave this step.
    """
    rank = F.col(rank_col).cast("bigint") if rank_col else F.lit(0).cast("bigint")
    order = F.struct(F.coalesce(rank, F.lit(1 << 62).cast("bigint")).alias("o_rank"),
                     F.col("fetched_at"), F.col("payload_id"), F.col("pos").cast("int").alias("pos"))
    return items.select(
        "digest_key",
        F.lit(SECTION_OF_KIND[kind]).alias("section"),
        order.alias("ord"),
        F.col("title").alias("title"),
        F.array_join(item_lines(kind), "\n").alias("rest"),
    )


def number_items(items: DataFrame) -> DataFrame:
    """Number items within each (digest, section) in source order (WIN-2).

    The explicit exchange on ``digest_key`` also satisfies the window's
    (digest_key, section) clustering and the later per-digest aggregate, so
    numbering and rendering share one shuffle.
    """
    w = Window.partitionBy("digest_key", "section").orderBy("ord")
    return (items.repartition("digest_key")
            .withColumn("rn", F.row_number().over(w))
            .withColumn("block", F.concat(_fmt("item_heading", F.col("rn"), F.col("title")),
                                          F.lit("\n"), F.col("rest"))))


def number_items_split(items: DataFrame, partitions: int | None = None) -> DataFrame:
    """WIN-2 for uncapped digests: a hot (digest, section) is numbered by many tasks.

    Items are range-partitioned on (digest_key, section, ord), so one large
    group spans several partitions; each row gets its position inside its
    partition, and a small table of per-partition counts (one row per
    partition and group) yields the offsets. That layout is written to the
    shared checkpoint folder first, so a recomputation after a lost executor
    cannot move rows between partitions. The items are written before it: choosing
    the ranges samples its input, which would run the whole plan of the items a
    second time. Same numbers as ``number_items``.
    """
    from feedlake.session import write_once
    from feedlake.sources import broadcast_if_small

    n = partitions or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["_pid", "digest_key", "section"]
    layout = (write_once(items, "items").repartitionByRange(n, "digest_key", "section", "ord")
              .sortWithinPartitions("digest_key", "section", "ord")
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_i", F.monotonically_increasing_id()))
    ranged = write_once(layout, "layout")
    counts = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_i0"))
    # one row per (partition, group): a group spans at most ``n`` rows here
    w = Window.partitionBy("digest_key", "section").orderBy("_pid")
    offsets = counts.withColumn("_off", F.sum("_n").over(w) - F.col("_n")).select(*keys, "_off", "_i0")
    rn = F.col("_off") + (F.col("_i") - F.col("_i0")) + 1
    return (ranged.join(broadcast_if_small(offsets), keys)
            .withColumn("rn", rn.cast("int"))
            .withColumn("block", F.concat(_fmt("item_heading", F.col("rn"), F.col("title")),
                                          F.lit("\n"), F.col("rest")))
            .drop("_pid", "_i", "_off", "_i0"))


def digest_blocks(items: DataFrame, title: str = DEFAULT_TITLE, footer: str = DEFAULT_FOOTER,
                  keys: DataFrame | None = None, show_date: bool = True, partitions: int | None = None) -> DataFrame:
    """The rows of all digests: (digest_key, section, rn, block); a digest's rows in order, joined by line ends, are its text.

    A digest of any size is numbered and rendered as rows by many tasks and is never one value.
    Row 0 of a section holds its heading (of the first one also title and date) and, if the
    section is empty, its note; section ``len(SECTIONS) + 1`` is the footer. Headings come from
    one small aggregate: a row per digest and section.
    """
    # written once by the numbering; everything below reads that
    blocks = number_items_split(items, partitions).select("digest_key", "section", "rn", "block")
    counts = blocks.groupBy("digest_key", "section").agg(F.count(F.lit(1)).alias("n"))
    days = counts.select("digest_key").distinct()
    if keys is not None:
        days = days.unionByName(keys.select("digest_key")).distinct()
    spine = days.withColumn("section", F.explode(F.array(*[F.lit(s) for s in SECTIONS])))
    dated = F.col("digest_key") != "" if show_date else F.lit(False)
    first = F.when(F.col("section") == min(SECTIONS), F.concat(
        F.lit(DIGEST_FORMATS["title"] % title), F.lit("\n\n"),
        F.when(dated, F.concat(_fmt("date", F.col("digest_key")), F.lit("\n\n"))).otherwise(F.lit("")))).otherwise(F.lit(""))
    heading, note = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s, (header, empty) in SECTIONS.items():
        heading = F.when(F.col("section") == s, F.lit(header)).otherwise(heading)
        note = F.when(F.col("section") == s, F.lit(empty)).otherwise(note)
    heads = (spine.join(counts, ["digest_key", "section"], "left")
             .select("digest_key", "section", F.lit(0).alias("rn"),
                     F.concat(first, heading, F.lit("\n"), F.when(F.col("n").isNull(), F.concat(F.lit("\n"), note, F.lit("\n"))).otherwise(F.lit("")))
                     .alias("block")))
    foot = days.select("digest_key", F.lit(len(SECTIONS) + 1).alias("section"), F.lit(0).alias("rn"), F.lit(footer).alias("block"))
    return blocks.unionByName(heads).unionByName(foot)


def _section_lines(sorted_items: Column, section: int) -> Column:
    header, empty = SECTIONS[section]
    blocks = F.transform(F.filter(sorted_items, lambda x: x["section"] == section), lambda x: x["block"])
    return F.concat(F.array(F.lit(header), F.lit("")),
                    F.when(F.size(blocks) == 0, F.array(F.lit(empty), F.lit(""))).otherwise(blocks))


def render_digests(items: DataFrame, title: str = DEFAULT_TITLE, footer: str = DEFAULT_FOOTER,
                   keys: DataFrame | None = None, show_date: bool = True,
                   split_hot_groups: bool = False) -> DataFrame:
    """One Markdown document per ``digest_key`` (AGG-1, JOIN-4).

    ``items`` is the union of ``digest_items`` of the three kinds. Every
    digest has all three sections; an empty one shows its note. ``keys`` (a
    frame with ``digest_key``) adds digests that have no items at all: they
    enter as marker rows, so no join is needed for the section spine. The
    ``digest_key`` doubles as the date line when ``show_date``.
    ``split_hot_groups`` numbers with ``number_items_split`` (for uncapped
    runs); the one string per digest is still assembled per digest, as the
    output requires.
    """
    if keys is not None:
        markers = keys.select("digest_key").distinct().select(
            "digest_key", F.lit(0).alias("section"), F.lit(None).cast(items.schema["ord"].dataType).alias("ord"),
            F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("rest"))
        items = items.unionByName(markers)
    numbered = number_items_split(items) if split_hot_groups else number_items(items)
    agg = numbered.groupBy("digest_key").agg(
        F.array_sort(F.collect_list(F.struct("section", "rn", "block"))).alias("_items"))
    head = F.array(F.lit(DIGEST_FORMATS["title"] % title), F.lit(""))
    date = (F.array(_fmt("date", F.col("digest_key")), F.lit(""))
            if show_date else F.array().cast("array<string>"))
    lines = F.concat(head, F.when(F.col("digest_key") != "", date).otherwise(F.array().cast("array<string>")),
                     _section_lines(F.col("_items"), 1), _section_lines(F.col("_items"), 2),
                     _section_lines(F.col("_items"), 3), F.array(F.lit(footer)))
    return agg.select("digest_key", F.array_join(lines, "\n").alias("md"))


def capped_items(kind: str, items: DataFrame, n: int | None) -> tuple[DataFrame, str | None]:
    """(items of one kind within their cap, the column that ranks them in a digest).

    Papers: newest first (published, arXiv id), first ``n`` of a digest. Articles: feed order,
    first ``n`` of each fetched payload. Web hits: page order, first ``n`` of a digest.
    """
    if kind == "paper":
        return top_per_group(items, ["digest_key"], [F.col("published").desc(), F.col("arxiv_id").desc()], n, rank_col="_prank"), "_prank"
    if kind == "article":
        capped = cap_per_feed(items, n, group_cols=("digest_key", "payload_id"))
        return capped, "registry_pos" if "registry_pos" in capped.columns else None
    return top_per_group(items, ["digest_key"], ["fetched_at", "payload_id", "pos"], n), None


def _union(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no item kinds given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _kinds(papers, articles, web, papers_per_digest, articles_per_feed, web_per_digest):
    given = (("paper", papers, papers_per_digest), ("article", articles, articles_per_feed), ("web", web, web_per_digest))
    return [k for k in given if k[1] is not None]


def build_digest_items(papers: DataFrame | None, articles: DataFrame | None, web: DataFrame | None,
                       papers_per_digest: int | None = 5, articles_per_feed: int | None = 15,
                       web_per_digest: int | None = 5) -> DataFrame:
    """Union three kinds of items that carry ``digest_key`` and ``summary_s`` into digest items, applying the caps."""
    return _union([digest_items(kind, *capped_items(kind, items, n)) for kind, items, n in
                   _kinds(papers, articles, web, papers_per_digest, articles_per_feed, web_per_digest)])


def summarized_digest_items(papers: DataFrame | None, articles: DataFrame | None, web: DataFrame | None,
                            completions: DataFrame | None = None, papers_per_digest: int | None = 5,
                            articles_per_feed: int | None = 15, web_per_digest: int | None = 5) -> DataFrame:
    """Extracted items (with ``digest_key``) to digest items: cap first, then summarise what is left.

    Texts are reduced to fallbacks in the extracting stage, caps run on the narrow rows, and
    completions join survivors alone, so neither bodies nor capped items reach the join.
    """
    parts = []
    for kind, items, n in _kinds(papers, articles, web, papers_per_digest, articles_per_feed, web_per_digest):
        kept, rank = capped_items(kind, sm.slim(items, kind), n)
        parts.append(digest_items(kind, sm.summarize_capped(kept, kind, completions), rank))
    return _union(parts)
