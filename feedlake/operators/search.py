"""Paper search, top-k and compact listings."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlake.functions.text import join_names, left_n, strip

SORT_COLUMNS = {"submittedDate": "published", "lastUpdatedDate": "updated"}

# The compact listing: abstract length and suffix, PDF link prefix,
# and one entry (number, id, title, authors, published, categories, abstract, pdf).
LISTING_ABSTRACT_CHARS = 200
LISTING_ABSTRACT_SUFFIX = "..."
LISTING_PDF_PREFIX = "https://arxiv.org/pdf/"
LISTING_ENTRY = ("%s. [%s] %s\n   Authors: %s\n   Published: %s | Categories: %s\n"
                 "   Abstract: %s\n   PDF: %s\n\n")


def keyword_match(keyword: str, cols: Sequence[Column]) -> Column:
    """Case-insensitive whole-word match of ``keyword`` in any of ``cols``."""
    pat = r"(?iU)(?<![\p{L}\p{N}_])" + re.escape(keyword).replace(r"\ ", r"\s+") + r"(?![\p{L}\p{N}_])"
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(c.rlike(pat), F.lit(False))
    return out


def parse_query(query: str) -> dict:
    """``cat:cs.CL`` -> categories, ``all:word`` -> keywords (terms joined by ``AND``, all must match)."""
    out: dict = {"category": [], "keyword": []}
    for term in re.split(r"\s+AND\s+", query.strip()):
        field, _, value = term.partition(":")
        if field == "cat" and value:
            out["category"].append(value)
        elif field == "all" and value:
            out["keyword"].append(value)
        else:
            raise ValueError(f"unsupported query term {term!r} (use cat:<category> or all:<word>)")
    return out


def search_papers(papers: DataFrame, category: str | Sequence[str] | None = None,
                  keyword: str | Sequence[str] | None = None,
                  sort_by: str = "submittedDate", sort_order: str = "descending",
                  max_results: int | None = 10, group_cols: Sequence[str] = (),
                  query: str | None = None) -> DataFrame:
    """Filter papers by ``cat:`` category and/or ``all:`` keyword, newest first (FIL-3, TOP-1).

    Ties on the date are broken by arXiv id in the same direction. With
    ``group_cols`` the top-k is taken per group (WindowGroupLimit), otherwise
    globally (TakeOrderedAndProject: each task keeps k rows).
    """
    if query is not None:
        q = parse_query(query)
        category, keyword = q["category"] or category, q["keyword"] or keyword
    if sort_by not in SORT_COLUMNS:
        raise ValueError(f"sort_by must be one of {sorted(SORT_COLUMNS)}")
    if sort_order not in ("ascending", "descending"):
        raise ValueError("sort_order must be 'ascending' or 'descending'")
    df = papers
    for one in [category] if isinstance(category, str) else category or []:
        df = df.where(F.array_contains("categories", one))
    for one in [keyword] if isinstance(keyword, str) else keyword or []:
        df = df.where(keyword_match(one, [F.col("title"), F.col("summary"),
                                              F.array_join("authors", " ")]))
    key = SORT_COLUMNS[sort_by]
    if key not in df.columns:
        raise ValueError(f"sort_by={sort_by!r} needs the column {key!r}")
    asc = sort_order == "ascending"
    order = [F.col(key).asc() if asc else F.col(key).desc(),
             F.col("arxiv_id").asc() if asc else F.col("arxiv_id").desc()]
    if max_results is None:  # everything, in the same order and with the same rank per group
        if not group_cols:
            return df.orderBy(*order)
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order)))
    if max_results < 0:
        raise ValueError("max_results must be >= 0")
    if group_cols:
        w = Window.partitionBy(*group_cols).orderBy(*order)
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_results)
    return df.orderBy(*order).limit(max_results)


def paper_listing(papers: DataFrame) -> DataFrame:
    """Compact listing row per paper (EXT-5): joined authors/categories, 200-char abstract."""
    authors = F.transform(F.coalesce("authors", F.array().cast("array<string>")),
                          lambda a: F.coalesce(a, F.lit("")))
    pid = strip(F.col("arxiv_id"))  # the listing reads the id stripped
    return papers.select(
        "*",
        pid.alias("id"),
        join_names(authors).alias("authors_text"),
        join_names(F.col("categories")).alias("categories_text"),
        F.concat(left_n(F.col("summary"), LISTING_ABSTRACT_CHARS), F.lit(LISTING_ABSTRACT_SUFFIX)).alias("abstract"),
        F.concat(F.lit(LISTING_PDF_PREFIX), pid).alias("pdf"),
    )


def listing_text(listing: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column]) -> DataFrame:
    """Numbered plain-text listing per group (PRJ-9, WIN-3).

    Groups are result lists of a bounded top-k, so one group's text is small.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    entry = F.format_string(LISTING_ENTRY, F.col("n"), F.col("id"), F.col("title"), F.col("authors_text"),
                            F.col("published"), F.col("categories_text"), F.col("abstract"), F.col("pdf"))
    numbered = listing.withColumn("n", F.row_number().over(w)).withColumn("_entry", entry)
    return (numbered.groupBy(*group_cols)
            .agg(F.count(F.lit(1)).alias("n_papers"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "_entry"))),
                                          lambda x: x["_entry"]), "").alias("text")))
