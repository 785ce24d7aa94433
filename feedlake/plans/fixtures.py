"""Operator inputs derived, in Spark, from the driver tables.

Every fixture is a deterministic function of whole driver tables, so its size
grows with them. Dates come from ids, never from the clock; operators that
depend on "now" take an explicit ``as_of``.

The payload builders group documents into bounded chunks: a payload is one
fetch of one feed on one day and holds at most ``CHUNK`` documents of one
source, however skewed the sources are.
"""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlake import sinks
from feedlake.session import task_slots

CHUNK = 100          # document ids per fetch day
BASE_DAY = "2024-01-01"
MEDIA_NS = "http://search.yahoo.com/mrss/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a file stream (a directory of parts, or one file in the sf folder)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if os.path.isdir(path):
        return reader.parquet(path)
    # a streaming file source needs a folder: read the sf folder, keep only this file
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def esc(c: Column) -> Column:
    """XML text escaping."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _day(c: Column) -> Column:
    return F.date_add(F.lit(BASE_DAY).cast("date"), c.cast("int"))


def published_variant(doc_id: Column, day: Column) -> Column:
    """Seven spellings of one calendar day (ISO, offsets, RFC 2822, garbage)."""
    v = doc_id % 7
    return (F.when(v == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T08:15:00Z")))
            .when(v == 1, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:30:00-07:00")))
            .when(v == 2, F.date_format(day, "yyyy-MM-dd"))
            .when(v == 3, F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 23:30:00 -0700")))
            .when(v == 4, F.concat(F.date_format(day, "d MMM yyyy"), F.lit(" 06:00:00 +0000")))
            .when(v == 5, F.date_format(day, "yyyy-M-d"))
            .otherwise(F.lit("not a date")))


def mail_variant(doc_id: Column, day: Column) -> Column:
    """Five spellings that mail dates had: dotted time, ``asctime`` order, three-digit year, an offset beyond a day, RFC 850."""
    v = doc_id % 5
    text = lambda form, rest: F.concat(F.date_format(day, form), F.lit(rest))
    return (F.when(v == 0, text("EEE, dd MMM yyyy", " 10.30.00 GMT"))
            .when(v == 1, F.concat(F.date_format(day, "EEE MMM dd"), F.lit(" 10:00:00 "), F.date_format(day, "yyyy")))
            .when(v == 2, text("dd MMM", " 126 10:00:00 GMT"))
            .when(v == 3, text("dd MMM yyyy", " 10:00:00 +9999"))
            .otherwise(text("EEEE, dd-MMM-yy", " 10:00:00 GMT")))


def doc_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fetch day, publish day, title sentence, feed format."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    chunk = F.floor(F.col("doc_id") / CHUNK)
    return d.select(
        "*",
        chunk.alias("chunk"),
        ((F.ascii(F.substring("source", -1, 1)) + chunk) % 4).alias("fmt"),
        _day(chunk).alias("fetch_day"),
        _day(F.col("doc_id") % 30).alias("pub_day"),
        F.substring_index("text", ".", 1).alias("title_src"),
        (F.col("doc_id") % 6).alias("n_auth"),
    )


def _authors_xml(p: str, doc_id: Column, n: Column, empty_fifth: bool) -> Column:
    names = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.when((i == 5) & F.lit(empty_fifth), F.lit(""))
                   .otherwise(F.concat(F.lit("Author "), doc_id.cast("string"), F.lit("."), i.cast("string"))))
    xml = F.transform(names, lambda s: F.concat(F.lit(f"<{p}author><{p}name>"), s, F.lit(f"</{p}name></{p}author>")))
    return F.when(n > 0, F.array_join(xml, "")).otherwise(F.lit(""))


def _mixed(every: int) -> Column:
    """Child elements after the text of one in ``every`` documents' leaves: no reader of the text sees them."""
    child = '<div xmlns="http://www.w3.org/1999/xhtml" title="a > b">child <i>of</i> it <br/></div> and tail'
    return F.when(F.col("doc_id") % every == 0, F.lit(child)).otherwise(F.lit(""))


def _atom_entry(p: str) -> Column:
    doc_id = F.col("doc_id")
    link = F.concat(F.lit("http://feeds.test/"), F.col("source"), F.lit("/"), doc_id.cast("string"))
    self_link = F.when(doc_id % 2 == 0, F.concat(
        F.lit(f'<{p}link rel="self" href="http://feeds.test/'), F.col("source"), F.lit("/self/"),
        doc_id.cast("string"), F.lit('"/>'))).otherwise(F.lit(""))
    pub = published_variant(doc_id, F.col("pub_day"))
    pub_tag = F.when(doc_id % 7 == 2, F.lit("updated")).otherwise(F.lit("published"))
    return F.concat(
        F.lit(f"<{p}entry><{p}title>\n  "), esc(F.col("title_src")), F.lit("  "), _mixed(11), F.lit(f"</{p}title>"),
        self_link, F.lit(f'<{p}link href="'), link, F.lit('"/>'),
        F.lit("<media:title>decoy "), doc_id.cast("string"), F.lit("</media:title>"),
        F.lit(f"<{p}summary>"), esc(F.col("text")), _mixed(13), F.lit(f"</{p}summary>"),
        F.lit(f"<{p}"), pub_tag, F.lit(">"), pub, F.lit(f"</{p}"), pub_tag, F.lit(">"),
        _authors_xml(p, doc_id, F.col("n_auth"), True),
        F.lit(f"</{p}entry>"))


def _rss_item(updated_tag: str) -> Column:
    doc_id = F.col("doc_id")
    link = F.concat(F.lit("http://feeds.test/"), F.col("source"), F.lit("/"), doc_id.cast("string"))
    pub = published_variant(doc_id, F.col("pub_day"))
    date_xml = F.when(doc_id % 7 == 2, F.concat(F.lit(f"<{updated_tag}>"), pub, F.lit(f"</{updated_tag}>"))) \
        .otherwise(F.concat(F.lit("<pubDate>"), pub, F.lit("</pubDate>")))
    return F.concat(
        F.lit("<item><title>"), esc(F.col("title_src")), _mixed(11), F.lit("</title><link>"), link, F.lit("</link>"),
        F.lit("<media:title>"), F.when(F.col("fmt") == 2, F.lit("&decoy;")).otherwise(F.lit("decoy")),
        F.lit("</media:title><description>"), esc(F.col("text")), _mixed(13),
        F.lit("</description>"), date_xml, F.lit("</item>"))


_HEAD = {
    0: f'<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="{MEDIA_NS}"><title>',
    1: '\ufeff<?xml version="1.0"?><!-- mirrored --><a:feed xmlns:a="http://www.w3.org/2005/Atom" '
       f'xmlns:media="{MEDIA_NS}"><a:title>',
    2: '<!DOCTYPE rss [<!-- one entity ] > --><!ENTITY decoy "dec>oy">]>'
       f'<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:media="{MEDIA_NS}"><channel><title>',
    3: f'<rdf-items xmlns:a10="http://www.w3.org/2005/Atom" xmlns:media="{MEDIA_NS}"><title>',
}
_TITLE_END = {0: "</title>", 1: "</a:title>", 2: "</title>", 3: "</title>"}
_TAIL = {0: "</feed>", 1: "</a:feed>", 2: "</channel></rss>", 3: "</rdf-items>"}


def _by_fmt(mapping: dict) -> Column:
    out = F.lit(mapping[3])
    for k in (2, 1, 0):
        out = F.when(F.col("fmt") == k, F.lit(mapping[k]) if isinstance(mapping[k], str) else mapping[k]) \
            .otherwise(out)
    return out


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in four tasks a slot, and at most as many as the session has shuffle partitions.

    A payload's parse costs far more than its bytes in the exchange: by bytes, adaptive execution packs
    these stages into a few tasks more than there are slots, and those few then run alone.
    """
    spark = df.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * task_slots(spark))
    return df.repartition(n, *keys)


def _assemble(entries: DataFrame, key_cols: list[str], head: Column, tail: Column) -> DataFrame:
    """Group entries of one payload (bounded chunk) in document order."""
    return (entries.groupBy(*key_cols)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "entry"))),
                                          lambda x: x["entry"]), "").alias("_entries"),
                 F.first(head).alias("_head"), F.first(tail).alias("_tail")))


def feed_payloads(spark: SparkSession, sf_dir: str, with_rejects: bool = True) -> DataFrame:
    """``payloads`` of kind ``feed``: one XML document per (source, fetch day).

    Formats rotate over Atom (default namespace), Atom (prefixed, with BOM,
    declaration and comment), RSS 2.0 and an unknown root holding bare items.
    With ``with_rejects`` a truncated copy and a non-XML copy of some payloads
    are added (EXT-8 inputs).
    """
    b = doc_base(spark, sf_dir)
    entry = (F.when(F.col("fmt") == 0, _atom_entry(""))
             .when(F.col("fmt") == 1, _atom_entry("a:"))
             .when(F.col("fmt") == 2, _rss_item("atom:updated"))
             .otherwise(_rss_item("a10:updated")))
    head = F.concat(_by_fmt(_HEAD), F.col("source"), _by_fmt(_TITLE_END))
    # Exchange raw documents on the payload key first: the entry text is then
    # built after the shuffle, in parallel, and the grouping reuses the layout.
    b = _spread(b, "source", "chunk")
    g = _assemble(b.select("source", "chunk", "fmt", "fetch_day", "doc_id", entry.alias("entry")),
                  ["source", "chunk", "fmt", "fetch_day"], head, _by_fmt(_TAIL))
    good = g.select(
        F.concat(F.lit("feed-"), F.col("source"), F.lit("-"), F.col("chunk").cast("string")).alias("payload_id"),
        F.concat(F.lit("http://feeds.test/"), F.col("source")).alias("url"),
        F.lit("feed").alias("kind"),
        (F.col("fetch_day").cast("timestamp_ntz") + F.expr("INTERVAL 6 HOURS")).alias("fetched_at"),
        F.concat("_head", "_entries", "_tail").alias("body"),
        ((F.ascii(F.substring("source", -1, 1)) + F.col("chunk")) % 5).alias("_r"),
    )
    cols = ["payload_id", "url", "kind", "fetched_at", "body"]
    if not with_rejects:
        return good.select(*cols)
    # Copies come from the same aggregate (no union re-running it): variant 1
    # is the payload cut short (unclosed XML), variant 2 a non-XML error page.
    v = F.col("_v")
    copies = good.select("*", F.explode(
        F.when(F.col("_r") == 0, F.array(F.lit(0), F.lit(1)))
         .when(F.col("_r") == 1, F.array(F.lit(0), F.lit(2)))
         .otherwise(F.array(F.lit(0)))).alias("_v"))
    return copies.select(
        F.when(v == 0, F.col("payload_id")).when(v == 1, F.concat("payload_id", F.lit("-bad")))
         .otherwise(F.concat("payload_id", F.lit("-txt"))).alias("payload_id"),
        "url", "kind", "fetched_at",
        F.when(v == 0, F.col("body")).when(v == 1, F.expr("substring(body, 1, length(body) - 10)"))
         .otherwise(F.concat(F.lit("HTTP 503 Service Unavailable for "), F.col("url"))).alias("body"))


PRIMARY_BY_LANG = {"en": "cs.CL", "fr": "cs.AI", "de": "cs.LG"}
OTHER_PRIMARY = "cs.IR"


def primary_category(lang: Column) -> Column:
    out = F.lit(OTHER_PRIMARY)
    for k, v in PRIMARY_BY_LANG.items():
        out = F.when(lang == k, F.lit(v)).otherwise(out)
    return out


def arxiv_id(doc_id: Column) -> Column:
    return F.concat(F.lit("2401."), F.lpad(doc_id.cast("string"), F.greatest(F.lit(5), F.length(doc_id.cast("string"))), F.lit("0")), F.lit("v"),
                    (doc_id % 3 + 1).cast("string"))


def arxiv_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``payloads`` of kind ``arxiv``: one API response per (category, fetch day).

    Odd days bind the arXiv extension namespace to a different prefix.
    """
    b = doc_base(spark, sf_dir).withColumn("primary", primary_category(F.col("lang")))
    odd = F.col("chunk") % 2 == 1
    ax = lambda name: F.when(odd, F.lit("ax:" + name)).otherwise(F.lit("arxiv:" + name))
    doc_id = F.col("doc_id")
    aid = arxiv_id(doc_id)
    day = F.date_format("pub_day", "yyyy-MM-dd")
    comment = F.when(doc_id % 4 == 1, F.concat(
        F.lit("<"), ax("comment"), F.lit(">  "), F.col("n_chars").cast("string"), F.lit(" characters, "),
        F.col("lang"), F.lit("  </"), ax("comment"), F.lit(">"))).otherwise(F.lit(""))
    stat = F.when(doc_id % 3 == 0, F.lit('<category term="stat.ML" scheme="http://arxiv.org/schemas/atom"/>')) \
        .otherwise(F.lit(""))
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/"), aid, F.lit("</id><updated>"), day, F.lit("T12:00:00Z</updated>"),
        F.lit("<published>"), day, F.lit("T"), F.lpad((doc_id % 24).cast("string"), 2, "0"),
        F.lit(":00:00Z</published><title>\n  "), esc(F.col("title_src")), F.lit("\n  </title><summary>  "),
        esc(F.col("text")), F.lit("\n</summary>"), _authors_xml("", doc_id, F.col("n_auth"), False), comment,
        F.lit('<link href="http://arxiv.org/abs/'), aid, F.lit('" rel="alternate" type="text/html"/>'),
        F.lit("<"), ax("primary_category"), F.lit(' term="'), F.col("primary"),
        F.lit('" scheme="http://arxiv.org/schemas/atom"/><category term="'), F.col("primary"),
        F.lit('" scheme="http://arxiv.org/schemas/atom"/>'), stat, F.lit("</entry>"))
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:'),
        F.when(odd, F.lit("ax")).otherwise(F.lit("arxiv")),
        F.lit('="http://arxiv.org/schemas/atom"><title>arXiv Query: cat:'), F.col("primary"), F.lit("</title>"))
    b = _spread(b, "primary", "chunk")
    g = _assemble(b.select("primary", "chunk", "fetch_day", "doc_id", entry.alias("entry"), head.alias("h")),
                  ["primary", "chunk", "fetch_day"], F.col("h"), F.lit("</feed>"))
    return g.select(
        F.concat(F.lit("arxiv-"), F.col("primary"), F.lit("-"), F.col("chunk").cast("string")).alias("payload_id"),
        F.concat(F.lit("http://export.arxiv.org/api/query?search_query=cat:"), F.col("primary")).alias("url"),
        F.lit("arxiv").alias("kind"),
        (F.col("fetch_day").cast("timestamp_ntz") + F.expr("INTERVAL 7 HOURS")).alias("fetched_at"),
        F.concat("_head", "_entries", "_tail").alias("body"))


PAGES_PER_DAY = 25
# Navigation anchors of the driver's pages become search-result blocks.
NAV_ANCHOR = r'<li><a href="([^"]*)">([^<]*)</a></li>'
RESULT_BLOCK = ('<li><a rel="nofollow" class="result__a" href="$1">$2</a> <span class="sep"></span>'
                '<a class="result__snippet" href="$1">Snippet for <b>$2</b> ...</a></li>')


def serp_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``payloads`` of kind ``serp``: each driver page rewritten as a result page."""
    p = table(spark, sf_dir, "pages")
    day = F.floor(F.col("page_id") / PAGES_PER_DAY)
    return p.select(
        F.concat(F.lit("serp-"), F.col("page_id").cast("string")).alias("payload_id"),
        F.col("url"), F.lit("serp").alias("kind"),
        (_day(day).cast("timestamp_ntz") + F.expr("INTERVAL 8 HOURS")).alias("fetched_at"),
        F.regexp_replace("html", NAV_ANCHOR, RESULT_BLOCK).alias("body"))


def all_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (feed_payloads(spark, sf_dir).unionByName(arxiv_payloads(spark, sf_dir))
            .unionByName(serp_payloads(spark, sf_dir)))


def feed_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed config as one JSON document: a ``feeds`` entry per document source.

    Sources sorted by name, then an entry without url (skipped) and one
    without name (defaults to ``RSS``). A config is one document by nature;
    its size is the number of configured feeds, not the data volume.
    """
    src = table(spark, sf_dir, "documents").select("source").distinct()
    feeds = F.transform(
        F.array_sort(F.collect_list(F.struct(
            "source", F.concat(F.lit("Feed "), F.upper("source")).alias("name"),
            F.concat(F.lit("http://feeds.test/"), F.col("source")).alias("url")))),
        lambda f: F.struct(f["name"].alias("name"), f["url"].alias("url")))
    extra = F.array(F.struct(F.lit("Disabled feed").alias("name"), F.lit(None).cast("string").alias("url")),
                    F.struct(F.lit(None).cast("string").alias("name"),
                             F.lit("http://feeds.test/unregistered").alias("url")))
    return src.agg(F.to_json(F.struct(F.concat(feeds, extra).alias("feeds"))).alias("value"))


def feed_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows parsed from the feed config document (SRC-3, FIL-1)."""
    from feedlake.sources import registry_from_config_text
    return registry_from_config_text(feed_config(spark, sf_dir))


def completion_response(text: Column, lines: Column, doc_id: Column) -> Column:
    """Four response shapes (plain text, full markers, messy markers, points only), each of all lines of the text."""
    first, last = F.get(lines, F.lit(0)), F.element_at(lines, -1)
    further = F.slice(lines, 2, F.size(lines))
    bullets = lambda mark, what: F.array_join(F.transform(what, lambda l: F.concat(F.lit(mark), l)), "\n")
    shape = doc_id % 4
    return (F.when(shape == 0, text)
            .when(shape == 1, F.concat(F.lit("HEADLINE: "), first, F.lit("\nKEY POINTS:\n"), bullets("- ", further),
                                       F.lit("\nRELEVANCE: "), last))
            .when(shape == 2, F.concat(F.lit("Intro "), first, F.lit("\n- stray\nheadline: first\nKey Points:\n"),
                                       bullets("-- ", further), F.lit("\n-\nRELEVANCE:\n"), last, F.lit("\nHEADLINE: "), first))
            .otherwise(F.concat(F.lit("key points:\n"), bullets("  - ", lines))))


def article_item_id(source: Column, chunk: Column, pos: Column) -> Column:
    return F.concat(F.lit("feed-"), source, F.lit("-"), chunk.cast("string"), F.lit("#"), pos.cast("string"))


def completion_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM chat responses (JSON) for the articles of all documents but those with id % 5 = 3, which get none."""
    b = doc_base(spark, sf_dir)
    # Position of the document inside its payload: a window bounded by one chunk.
    pos = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("doc_id")) - 1
    with_pos = b.select("doc_id", "source", "chunk", "text", pos.alias("pos")).where("doc_id % 5 <> 3")
    with_pos = with_pos.withColumn("lines", F.split("text", "\n"))  # split once
    return with_pos.select(
        F.lit("article").alias("item_kind"),
        article_item_id(F.col("source"), F.col("chunk"), F.col("pos")).alias("item_id"),
        F.to_json(F.struct(F.struct(completion_response(F.col("text"), F.col("lines"), F.col("doc_id"))
                                    .alias("content")).alias("message"))).alias("body"))


# Check outcomes by event type: the status a probe saw.
def check_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe results per cycle (day) from ``events``."""
    return check_rows(table(spark, sf_dir, "events"))


def check_rows(e: DataFrame) -> DataFrame:
    """Probe results from an events frame (batch or streaming; row-wise only)."""
    kind = F.when(F.col("user_id") % 5 == 0, F.lit("arxiv")).otherwise(F.lit("feed"))
    method = F.when(F.col("event_type") == "click", F.lit("HEAD")).otherwise(F.lit("GET"))
    status = (F.when(F.col("event_type") == "error", 500)
              .when(F.col("event_type") == "purchase", 429)
              .when((F.col("event_type") == "click") & (F.col("value") < 20), 405)
              .otherwise(200))
    return e.select(
        F.to_date("ts").cast("timestamp_ntz").alias("cycle_ts"),
        kind.alias("kind"),
        # one endpoint per user id, probed again by every event of the cycle
        F.concat(kind, F.lit(":"), F.col("user_id").cast("string")).alias("target"),
        method.alias("method"), status.cast("int").alias("status"),
        F.col("event_id").alias("attempt"),
        F.col("ts"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle report lines, one report file per day, from ``events``."""
    e = table(spark, sf_dir, "events")
    step = F.concat(F.lit("step "), F.col("event_id").cast("string"), F.lit(": "))
    t, v = F.col("event_type"), F.col("value")
    body = (F.when((t == "error") & (v < 10), F.concat(F.lit("retry done, no error left "), F.col("props")))
            .when((t == "error") & (v < 20), F.concat(F.lit("terror alert "), F.col("props")))
            .when(t == "error", F.concat(F.lit("ERROR failed to fetch "), F.col("props")))
            .when((t == "signup") & (v < 5), F.concat(F.lit("Phase 2 exception handler ready "), F.col("props")))
            .when(t == "signup", F.concat(F.lit("Traceback (most recent call last) "), F.col("props")))
            .otherwise(F.concat(t, F.lit(" ok "), F.col("props"))))
    day = F.to_date("ts")
    return e.select(
        F.concat(F.lit("/reports/cycle_report_"), F.date_format(day, "yyyy-MM-dd"), F.lit(".txt")).alias("path"),
        # A report is written once, at the end of its day.
        (day.cast("timestamp_ntz") + F.expr("INTERVAL 23 HOURS 59 MINUTES")).alias("mtime"),
        F.col("event_id").alias("line_no"),
        F.concat(step, body).alias("line"))


def report_files(lines: DataFrame) -> DataFrame:
    """File inventory of the report folder (path, mtime, length in bytes)."""
    return (lines.groupBy("path")
            .agg(F.max("mtime").alias("modificationTime"),
                 F.sum(F.octet_length("line") + 1).cast("bigint").alias("length")))


def test_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last test run of every cycle (day): passed or not, and its duration if one was measured."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    run = F.struct((F.col("value") >= 2).alias("ok"), F.when(F.col("user_id") % 11 != 0, F.col("value") / 8).alias("duration_sec"))
    return (e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("cycle")).agg(F.max_by(run, "event_id").alias("run"))
            .select("cycle", "run.ok", "run.duration_sec"))


def tree_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working-tree status lines per cycle: tracked changes, untracked files, and blank lines of clean looks."""
    line = (F.when((F.col("event_type") == "view") & (F.col("value") < 0.2), F.concat(F.lit(" M file"), F.col("user_id").cast("string")))
            .when(F.col("event_type") == "view", F.concat(F.lit("?? note"), F.col("user_id").cast("string"))).otherwise(F.lit("")))
    return table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("cycle"), line.alias("line"))


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured search hits, one per page: five to a response, some without title or body."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.concat(F.lit("hits-"), F.floor(F.col("page_id") / 5).cast("string")).alias("payload_id"), (F.col("page_id") % 5).cast("int").alias("pos"),
        F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("Page "), F.col("page_id").cast("string"))).alias("title"), F.col("url").alias("href"),
        F.when(F.col("page_id") % 7 != 0, F.col("html")).alias("body"))


def digest_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing of a digest folder: one file per document, some bad names."""
    d = table(spark, sf_dir, "documents")
    day = _day(F.floor(F.col("doc_id") / 20))
    ymd = F.date_format(day, "yyyy-MM-dd")
    v = F.col("doc_id") % 10
    name = (F.when(v == 5, F.concat(F.lit("digest_"), F.date_format(day, "yyyy-M-d"), F.lit(".md")))
            .when(v == 7, F.concat(F.lit("digest_"), ymd, F.lit("_x.md")))
            .when(v == 8, F.lit("digest_.md"))
            .when(v == 9, F.concat(F.lit("other_"), ymd, F.lit(".md")))
            .otherwise(F.concat(F.lit("digest_"), ymd, F.lit(".md"))))
    return d.select(
        F.concat(F.lit("/digests/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
                 F.lit("/"), name).alias("path"),
        (day.cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("doc_id") % 24).cast("int"))).alias("modificationTime"),
        F.col("n_chars").cast("bigint").alias("length"),
        F.col("source").alias("folder"))


def digest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written digests: the texts of sixty days, many a day."""
    return table(spark, sf_dir, "documents").select(
        F.date_format(_day(F.col("doc_id") % 60), "yyyy-MM-dd").alias("digest_key"), F.col("text").alias("md"))


def land_files(payloads: DataFrame, path: str) -> None:
    """Payload bodies as raw files, one per payload, under ``payload_id=<id>/``: plain ones, as a fetcher leaves them."""
    payloads.select("body", "payload_id").write.options(**sinks.PLAIN_LOCAL_FILES).partitionBy("payload_id").text(path)


def write_reports(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Report lines as one text file per day under ``day=<day>/``, in the order of their numbers."""
    lines = report_lines(spark, sf_dir).withColumn("day", F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1))
    lines.repartition("day").sortWithinPartitions("day", "line_no").select("line", "day").write.partitionBy("day").text(path)
