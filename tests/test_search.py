"""Paper search, top-k and listing text."""
import pytest
from pyspark.sql import functions as F

from feedlake.operators import search as se


def _papers(spark):
    rows = [("2401.00001v1", "Attention is all", "We study the Transformer.", ["A", None], "2024-01-03", "2024-01-05",
             "cs.CL", ["cs.CL", "cs.LG"]),
            ("2401.00002v1", "Graphs", "Transformers-like nets on graphs", ["B"], "2024-01-02", "2024-01-02",
             "cs.LG", ["cs.LG"]),
            ("2401.00003v1", "Another", "x" * 250, [], "2024-01-03", "2024-01-09", "cs.CL", ["cs.CL"])]
    return spark.createDataFrame(rows, "arxiv_id string, title string, summary string, authors array<string>, "
                                       "published string, updated string, primary_category string, "
                                       "categories array<string>")


def test_query_strings_and_order(spark):
    p = _papers(spark)
    assert [r.arxiv_id for r in se.search_papers(p, query="cat:cs.CL").collect()] == ["2401.00003v1", "2401.00001v1"]
    # whole-word match: 'transformer' does not match 'Transformers-like'
    assert [r.arxiv_id for r in se.search_papers(p, query="all:transformer").collect()] == ["2401.00001v1"]
    asc = se.search_papers(p, sort_order="ascending", max_results=2).collect()
    assert [r.arxiv_id for r in asc] == ["2401.00002v1", "2401.00001v1"]
    upd = se.search_papers(p, sort_by="lastUpdatedDate", max_results=1).collect()
    assert upd[0].arxiv_id == "2401.00003v1"
    with pytest.raises(ValueError):
        se.search_papers(p, sort_by="relevance")
    with pytest.raises(ValueError):
        se.parse_query("ti:foo")


def test_listing_text(spark):
    top = se.search_papers(_papers(spark), max_results=5, group_cols=["primary_category"])
    rows = {r.primary_category: r for r in
            se.listing_text(se.paper_listing(top), ["primary_category"], [F.col("rank")]).collect()}
    assert rows["cs.LG"].text == ("1. [2401.00002v1] Graphs\n   Authors: B\n   Published: 2024-01-02 | "
                                  "Categories: cs.LG\n   Abstract: Transformers-like nets on graphs...\n"
                                  "   PDF: https://arxiv.org/pdf/2401.00002v1\n\n")
    cl = rows["cs.CL"].text
    assert cl.startswith("1. [2401.00003v1] Another\n   Authors: \n") and ("x" * 200 + "...\n") in cl
    assert "2. [2401.00001v1] Attention is all\n   Authors: A, \n" in cl


def test_absent_sort_column_raises(spark):
    p = spark.createDataFrame([("a", "2024-01-01")], "arxiv_id string, published string")
    with pytest.raises(ValueError):
        se.search_papers(p, sort_by="lastUpdatedDate")
