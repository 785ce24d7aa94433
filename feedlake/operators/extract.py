"""Payload -> item tables (Atom/RSS articles, arXiv papers, search-page hits).

Every function here is narrow (no shuffle, no window, no sort), so it is also
valid on a streaming DataFrame. One ``from_xml`` parse per payload serves all
formats; a payload that fails to parse yields no items and one reject row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake import schemas
from feedlake.functions.dates import norm_date
from feedlake.functions.text import after_abs, first, first_match, left_n, one_line, strip, strip_tags
from feedlake.functions.xml import (ATOM_NS, canonical, children_in, cut_leaves, has_default_namespace, head, root_name,
                                    without_bom, without_doctype)

# Title of an item without one, the link relation kept besides none,
# the PDF link around an arXiv id, and the source name of search hits.
UNTITLED = "Untitled"
ALTERNATE_REL = "alternate"
PDF_URL_PREFIX, PDF_URL_SUFFIX = "https://arxiv.org/pdf/", ".pdf"
WEB_SOURCE = "web"

PARSED = "_doc"
# Payload columns carried onto every extracted item.
PAYLOAD_KEEP = ("payload_id", "url", "kind", "fetched_at", "registry_pos")


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _text_or(*cols: Column) -> Column:
    """First value that is present and non-empty (``a or b``), else null."""
    out = None
    for c in reversed(cols):
        out = F.when(_present(c), c) if out is None else F.when(_present(c), c).otherwise(out)
    return out


def _title(raw: Column, missing: str | None = UNTITLED) -> Column:
    if missing is None:
        return one_line(F.coalesce(raw, F.lit("")))
    return F.when(_present(raw), one_line(raw)).otherwise(F.lit(missing))


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Add the parsed document (``_doc``), its root name and Atom-namespace flag."""
    head_ = F.col("_head")
    df = payloads.withColumn("_body", without_bom("body")).withColumn("_head", head("_body"))
    df = df.select("*", root_name(head_).alias("_root"), children_in(head_, ATOM_NS).alias("_has_atom"),
                   has_default_namespace(head_).alias("_has_default"))
    df = canonical(without_doctype(df, "_body"), "_body")
    doc = F.from_xml(cut_leaves("_body"), schemas.FEED_DOC, schemas.XML_OPTIONS)
    return df.withColumn(PARSED, F.when(F.is_valid_utf8("body"), doc)).drop("_head", "_body")


def _parsed(df: DataFrame) -> DataFrame:
    return df if PARSED in df.columns else parse_payloads(df)


# Inside the per-entry lambdas (interpreted, like every higher-order function)
# only raw fields are picked; all normalisation runs after the explode, in a
# code-generated projection where common subexpressions are computed once.

def _atom_raw(e: Column) -> Column:
    link = first_match(e["link"], lambda l: l["_rel"].isNull() | (l["_rel"] == ALTERNATE_REL))
    names = F.transform(e["author"], lambda a: first(a["name"]))
    return F.struct(
        first(e["title"]).alias("title_raw"),
        F.when(link.isNull(), F.lit("")).otherwise(F.coalesce(link["_href"], F.lit(""))).alias("link"),
        _text_or(first(e["summary"]), first(e["content"])).alias("summary_raw"),
        _text_or(first(e["published"]), first(e["updated"])).alias("published_raw"),
        F.coalesce(F.filter(names, _present), F.array().cast("array<string>")).alias("authors"),
    )


def _rss_raw(i: Column) -> Column:
    return F.struct(
        first(i["title"]).alias("title_raw"),
        F.coalesce(first(i["link"]), F.lit("")).alias("link"),
        _text_or(first(i["description"])).alias("summary_raw"),
        _text_or(first(i["pubDate"]), first(i["atom:updated"])).alias("published_raw"),
        F.array().cast("array<string>").alias("authors"),
    )


def _article_fields() -> list[Column]:
    pub = F.col("published_raw")
    return [
        _title(F.col("title_raw")).alias("title"),
        F.col("link"),
        F.coalesce(strip(F.col("summary_raw")), F.lit("")).alias("summary"),
        F.when(pub.isNull(), F.lit("")).otherwise(norm_date(pub)).alias("published"),
        F.col("authors"),
    ]


def _empty(elem_type) -> Column:
    """Typed empty array (``elem_type``: a DataType or a simple type name)."""
    if isinstance(elem_type, str):
        return F.array().cast(f"array<{elem_type}>")
    return F.array().cast(T.ArrayType(elem_type))


def _atom_entries(doc: Column, has_atom: Column) -> Column:
    return F.when(has_atom, F.coalesce(doc["entry"], _empty(schemas.ATOM_ENTRY))) \
        .otherwise(_empty(schemas.ATOM_ENTRY))


def _rss_items(doc: Column, has_default: Column) -> Column:
    """Items of no namespace: a default namespace on the root leaves none."""
    item_t = _empty(schemas.RSS_ITEM)
    return F.when(has_default, item_t).when(F.size(F.coalesce(doc["channel"], F.array())) > 0,
                  F.coalesce(doc["channel"][0]["item"], item_t)) \
        .otherwise(F.coalesce(doc["item"], item_t))


def _article_array(df: DataFrame, fmt: str, first_n: int | None = None) -> Column:
    """Raw articles of a payload; the first ``first_n`` entries are cut out before any is read."""
    if first_n is not None and first_n < 0:
        raise ValueError("a cap must be >= 0 or None")
    cut = (lambda a: a) if first_n is None else (lambda a: F.slice(a, 1, first_n))
    doc = F.col(PARSED)
    atom = F.transform(cut(_atom_entries(doc, F.col("_has_atom"))), _atom_raw)
    rss = F.transform(cut(_rss_items(doc, F.col("_has_default"))), _rss_raw)
    if fmt == "atom":
        return atom
    if fmt == "rss":
        return rss
    root = F.col("_root")
    return (F.when(root == "feed", atom)
            .when(root.isin("rss", "Rss"), rss)
            .when(F.size(atom) > 0, atom)
            .otherwise(rss))


def _explode_articles(df: DataFrame, arr: Column, feed_name: Column) -> DataFrame:
    keep = [c for c in PAYLOAD_KEEP if c in df.columns]
    raw = (df.select(*keep, feed_name.alias("feed_name"), F.posexplode(arr).alias("pos", "a"))
             .select(*keep, F.col("pos").cast("int").alias("pos"), "feed_name", "a.*"))
    return raw.select(*keep, "pos", "feed_name", *_article_fields())


def _feed_name(df: DataFrame) -> Column:
    return F.coalesce(F.col("feed_name"), F.lit("")) if "feed_name" in df.columns else F.lit("")


def extract_atom(payloads: DataFrame) -> DataFrame:
    """Atom entries -> articles (EXT-1)."""
    df = _parsed(payloads)
    return _explode_articles(df, _article_array(df, "atom"), _feed_name(df))


def extract_rss(payloads: DataFrame) -> DataFrame:
    """RSS items -> articles (EXT-2)."""
    df = _parsed(payloads)
    return _explode_articles(df, _article_array(df, "rss"), _feed_name(df))


def extract_articles(payloads: DataFrame, per_payload: int | None = None) -> DataFrame:
    """Articles of any feed format, chosen by the root element (EXT-3).

    ``per_payload`` keeps the first so many of each fetched feed (WIN-1): a payload is one
    row, so the cap is a slice before the explode and needs no exchange.
    """
    df = _parsed(payloads)
    return _explode_articles(df, _article_array(df, "auto", per_payload), _feed_name(df))


def feed_format(payloads: DataFrame) -> DataFrame:
    """Per payload: detected format, item count, and whether it parsed (EXT-3/8)."""
    df = _parsed(payloads)
    doc = F.col(PARSED)
    ok = doc.isNotNull() & doc[schemas.CORRUPT].isNull()
    atom_n = F.size(_atom_entries(doc, F.col("_has_atom")))
    root = F.col("_root")
    fmt = (F.when(~ok, F.lit("reject"))
           .when(root == "feed", F.lit("atom"))
           .when(root.isin("rss", "Rss"), F.lit("rss"))
           .when(atom_n > 0, F.lit("atom"))
           .otherwise(F.lit("rss")))
    return df.select("payload_id", fmt.alias("format"), ok.alias("parsed"),
                     F.when(ok, F.size(_article_array(df, "auto"))).otherwise(0).alias("n_items"))


def rejects(payloads: DataFrame) -> DataFrame:
    """Payloads that did not parse: ``(payload_id, reason)`` (EXT-8)."""
    df = _parsed(payloads)
    doc = F.col(PARSED)
    # a filter on the document would be pushed below and repeat the parse: the verdict is generated, then filtered
    why = F.when(doc.isNull() | doc[schemas.CORRUPT].isNotNull(), F.lit("malformed XML"))
    return df.select("payload_id", F.explode_outer(F.array(why)).alias("reason")).where("reason is not null")


def _paper_raw(e: Column) -> Column:
    names = F.transform(F.filter(e["author"], lambda a: F.size(F.coalesce(a["name"], F.array())) > 0),
                        lambda a: first(a["name"]))
    return F.struct(
        first(e["id"]).alias("id_raw"),
        first(e["title"]).alias("title_raw"),
        first(e["summary"]).alias("summary_raw"),
        F.coalesce(names, _empty("string")).alias("authors"),
        first(e["published"]).alias("published_raw"),
        first(e["updated"]).alias("updated_raw"),
        first(e["arxiv:primary_category"])["_term"].alias("primary_raw"),
        F.coalesce(F.transform(e["category"], lambda c: F.coalesce(c["_term"], F.lit(""))),
                   _empty("string")).alias("categories"),
        first(e["arxiv:comment"]).alias("comment_raw"),
    )


def _paper_fields() -> list[Column]:
    aid = after_abs(F.coalesce(F.col("id_raw"), F.lit("")))
    comment = F.col("comment_raw")
    return [
        aid.alias("arxiv_id"),
        _title(F.col("title_raw"), missing=None).alias("title"),
        strip(F.coalesce(F.col("summary_raw"), F.lit(""))).alias("summary"),
        F.col("authors"),
        left_n(F.coalesce(F.col("published_raw"), F.lit("")), 10).alias("published"),
        left_n(F.coalesce(F.col("updated_raw"), F.lit("")), 10).alias("updated"),
        F.coalesce(F.col("primary_raw"), F.lit("")).alias("primary_category"),
        F.col("categories"),
        F.concat(F.lit(PDF_URL_PREFIX), aid, F.lit(PDF_URL_SUFFIX)).alias("pdf_url"),
        F.when(_present(comment), strip(comment)).otherwise(F.lit("")).alias("comment"),
    ]


def extract_papers(payloads: DataFrame) -> DataFrame:
    """arXiv API responses -> papers (EXT-4)."""
    df = _parsed(payloads)
    arr = F.transform(_atom_entries(F.col(PARSED), F.col("_has_atom")), _paper_raw)
    keep = [c for c in PAYLOAD_KEEP if c in df.columns]
    raw = (df.select(*keep, F.posexplode(arr).alias("pos", "p"))
             .select(*keep, F.col("pos").cast("int").alias("pos"), "p.*"))
    return raw.select(*keep, "pos", *_paper_fields())


# Fixed value: the result-block pattern of the HTML search page.
SERP_PATTERN = (r'(?s)<a[^>]+class="result__a"[^>]+href="([^"]+)"[^>]*>(.*?)</a>'
                r'.*?<a[^>]+class="result__snippet"[^>]*>(.*?)</a>')


def extract_web_results(pages: DataFrame, max_results: int | None = 5,
                        body_col: str = "body") -> DataFrame:
    """Search-result pages -> first ``max_results`` hits per page (EXT-6, TOP-2).

    The page is scanned once; only the kept matches are re-read for groups.
    """
    matches = F.regexp_extract_all(F.col(body_col), F.lit(SERP_PATTERN), 0)
    if max_results is not None:
        if max_results < 0:
            raise ValueError("max_results must be >= 0")
        matches = F.slice(matches, 1, max_results) if max_results > 0 else F.array().cast("array<string>")
    keep = [c for c in PAYLOAD_KEEP if c in pages.columns]
    g = lambda i: F.regexp_extract(F.col("m"), SERP_PATTERN, i)
    return (pages.select(*keep, F.posexplode(matches).alias("pos", "m"))
                 .select(*keep, F.col("pos").cast("int").alias("pos"),
                         strip(strip_tags(g(2))).alias("title"),
                         strip(g(1)).alias("href"),
                         strip(strip_tags(g(3))).alias("body"),
                         F.lit(WEB_SOURCE).alias("source")))


def source_counts(items: DataFrame, by=("kind", "feed_name")) -> DataFrame:
    """Item count per source (EXT-9); a partial count runs before the shuffle."""
    cols = [c for c in by if c in items.columns]
    return items.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_items"))
