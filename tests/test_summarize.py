"""Completion parsing (checked against a field-by-field Python oracle), prompts, fallback join."""
import itertools
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from feedlake.operators import summarize as sm


MARKERS = (("H", "HEADLINE:"), ("P", "KEY POINTS:"), ("R", "RELEVANCE:"))


def brute_parse(text):
    """Field-by-field reading of the summary format (test oracle).

    Classify every stripped line, carry the last marker forward as the
    section, then derive each field on its own: the last headline marker, the
    dash lines under KEY POINTS, the last relevance marker or the first
    non-empty plain line in its section.
    """
    lines = [l.strip() for l in text.splitlines()]
    tags = [next((t for t, m in MARKERS if l.upper().startswith(m)), None) for l in lines]
    sections = list(itertools.accumulate(tags, lambda prev, t: t or prev))
    plain = [t is None for t in tags]
    heads = [i for i, t in enumerate(tags) if t == "H"]
    headline = lines[heads[-1]].partition(":")[2].strip() if heads else ""
    points = [re.sub(r"^[- ]+", "", l).strip()
              for l, p, s in zip(lines, plain, sections) if p and s == "P" and l.startswith("-")]
    rels = [i for i, t in enumerate(tags) if t == "R"]
    relevance = ""
    if rels:
        r = rels[-1]
        relevance = lines[r].partition(":")[2].strip() or next(
            (l for l, p, s in zip(lines[r + 1:], plain[r + 1:], sections[r + 1:]) if p and s == "R" and l), "")
    return (headline or text.split("\n")[0][:120], points or [text[:200]],
            relevance or "See abstract for details.")


CASES = [
    "no markers at all\nsecond line",
    "headline: lower case\nkey points:\n- a\nrelevance: r",
    "HEADLINE: one\nHEADLINE: two\nKEY POINTS:\n-- dashed\n-\n- - mixed\nRELEVANCE:\n\nnext line\nlater",
    "",
    "KEY POINTS:\n  - indented\nnot a bullet\n- b\nHEADLINE: h\n- after headline",
    "RELEVANCE: first\nRELEVANCE:\n- dash line becomes relevance",
    "HEADLINE:\nKEY POINTS:\nRELEVANCE:",
    "Title: x: y\nHEADLINE: a: b: c",
]


def _parse_all(spark, texts):
    df = spark.createDataFrame([("article", str(i), t) for i, t in enumerate(texts)],
                               "item_kind string, item_id string, response string")
    rows = sm.structure_completions(df).collect()
    return {int(r.item_id): (r.headline, r.key_points, r.relevance) for r in rows}


def test_parse_edge_cases(spark):
    got = _parse_all(spark, CASES)
    for i, t in enumerate(CASES):
        assert got[i] == brute_parse(t), t


line = st.one_of(st.sampled_from(["HEADLINE: h", "headline:x", "KEY POINTS:", "key points: extra", "RELEVANCE:",
                                  "Relevance: why", "- p", "--q", "-", "  - r  ", "", "text", "a:b"]),
                 st.text(alphabet="ab -:\t", max_size=6))


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(line, max_size=8).map("\n".join), min_size=40, max_size=40))
def test_parse_matches_brute_force(spark, texts):
    got = _parse_all(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute_parse(t), repr(t)


def test_prompts_and_fallback(spark):
    items = spark.createDataFrame(
        [("p", 0, "T1", "x" * 5000), ("p", 1, "T2", "short")],
        "payload_id string, pos int, title string, summary string")
    pr = {r.item_id: r.prompt for r in sm.build_prompts(items, "article").collect()}
    assert pr["p#0"].startswith("Title: T1\nContent: " + "x" * 4000 + "\n\nSummarize this article")
    assert "- Bullet 3\nRELEVANCE:" in pr["p#1"]
    paper = {r.item_id: r.prompt for r in sm.build_prompts(items, "paper").collect()}
    assert ("x" * 5000) in paper["p#0"]
    comps = spark.createDataFrame([("article", "p#1", "HEADLINE: H\nKEY POINTS:\n- k")],
                                  "item_kind string, item_id string, response string")
    s = {r.item_id: r.summary_s for r in sm.with_summaries(items, "article", comps).collect()}
    assert (s["p#0"].headline, s["p#0"].key_points, s["p#0"].relevance) == ("T1", ["x" * 200], "See article.")
    assert (s["p#1"].headline, s["p#1"].key_points) == ("H", ["k"])
    off = {r.item_id: r.summary_s.relevance for r in sm.with_summaries(items, "paper").collect()}
    assert off == {"p#0": "See abstract.", "p#1": "See abstract."}
