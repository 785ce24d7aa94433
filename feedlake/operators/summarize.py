"""Summaries: prompts out, completions in, fallback for every item.

The chat call itself is outside Spark; prompts are emitted as a table and the
responses come back as a ``completions`` table keyed by ``(item_kind, item_id)``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.text import LINE_BREAKS, left_n, strip, strip_bullet

KINDS = ("paper", "article", "web")

# Section markers of a completion (matched case-insensitively at line start).
HEADLINE_MARKER = "HEADLINE:"
POINTS_MARKER = "KEY POINTS:"
RELEVANCE_MARKER = "RELEVANCE:"

# Prompt templates per item kind (title, text placeholders).
PROMPT_TEMPLATES = {
    "paper": (
        "Title: %s\nAbstract: %s\n\n"
        "Summarize this paper in the following format:\n"
        "HEADLINE: One sentence headline.\nKEY POINTS:\n- Bullet 1\n- Bullet 2\n- Bullet 3\n"
        "RELEVANCE: One sentence on why this matters.\n"
    ),
    "article": (
        "Title: %s\nContent: %s\n\n"
        "Summarize this article in the following format:\n"
        "HEADLINE: One sentence headline.\nKEY POINTS:\n- Bullet 1\n- Bullet 2\n- Bullet 3\n"
        "RELEVANCE: One sentence on why this matters.\n"
    ),
    "web": (
        "Title: %s\nSnippet: %s\n\n"
        "Summarize this source in the following format:\n"
        "HEADLINE: One sentence headline.\nKEY POINTS:\n- Bullet 1\n- Bullet 2\n"
        "RELEVANCE: One sentence on why this matters.\n"
    ),
}
# How much of the item text goes into the prompt (None = all).
PROMPT_TEXT_LIMIT = {"paper": None, "article": 4000, "web": 4000}
# Fallback relevance line per kind, and the parser's default.
FALLBACK_RELEVANCE = {"paper": "See abstract.", "article": "See article.", "web": "See source."}
PARSED_DEFAULT_RELEVANCE = "See abstract for details."
FALLBACK_POINT_CHARS = 200
DEFAULT_HEADLINE_CHARS = 120



def item_text_col(kind: str) -> str:
    return "body" if kind == "web" else "summary"


def with_item_id(items: DataFrame, kind: str) -> DataFrame:
    """Add ``item_kind`` and ``item_id`` = ``<payload_id>#<pos>`` (unique per occurrence)."""
    return items.withColumns({
        "item_kind": F.lit(kind),
        "item_id": F.concat(F.col("payload_id"), F.lit("#"), F.col("pos").cast("string")),
    })


def build_prompts(items: DataFrame, kind: str) -> DataFrame:
    """``(item_kind, item_id, prompt)`` for the chat model (PRJ-2..4)."""
    if kind not in KINDS:
        raise ValueError(f"unknown item kind {kind!r}")
    text = F.col(item_text_col(kind))
    limit = PROMPT_TEXT_LIMIT[kind]
    if limit is not None:
        text = left_n(text, limit)
    df = items if "item_id" in items.columns else with_item_id(items, kind)
    return df.select("item_kind", "item_id",
                     F.format_string(PROMPT_TEMPLATES[kind], F.col("title"), text).alias("prompt"))


_MARKERS = {"headline": HEADLINE_MARKER, "points": POINTS_MARKER, "relevance": RELEVANCE_MARKER}


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is mentioned."""
    return F.transform(F.array(value), use)[0]


def _marks(lines: Column) -> Column:
    """Marker lines of a completion in order: array<struct<kind, at>>."""
    starts = F.transform(lines, lambda line: F.upper(left_n(line, max(map(len, _MARKERS.values())))))
    kind = lambda up: F.coalesce(*[F.when(up.startswith(m), F.lit(k)) for k, m in _MARKERS.items()])
    marks = F.transform(starts, lambda up, i: F.struct(kind(up).alias("kind"), i.alias("at")))
    return F.filter(marks, lambda m: m["kind"].isNotNull())


def _after_colon(line: Column) -> Column:
    return strip(F.regexp_replace(line, "^[^:]*:", ""))


def _parts(lines: Column, marks: Column) -> Column:
    """struct<headline, points, relevance> of the lines, '' or empty where a part is missing."""
    ends = F.transform(marks, lambda m, i: F.struct(m["kind"].alias("kind"), m["at"].alias("at"),
                                                    F.coalesce(F.get(marks, i + 1)["at"], F.size(lines)).alias("end")))
    inside = lambda m: F.slice(lines, m["at"] + 2, m["end"] - m["at"] - 1)
    of = lambda sections, kind: F.filter(sections, lambda m: m["kind"] == kind)
    bullets = lambda m: F.transform(F.filter(inside(m), lambda line: line.startswith("-")), strip_bullet)
    told = lambda m: F.concat(F.array(_after_colon(F.get(lines, m["at"]))), inside(m))
    last = lambda sections, kind: F.slice(F.reverse(of(sections, kind)), 1, 1)
    return _let(ends, lambda sections: F.struct(
        F.coalesce(F.get(F.transform(last(sections, "headline"), lambda m: _after_colon(F.get(lines, m["at"]))), F.lit(0)),
                   F.lit("")).alias("headline"),
        F.flatten(F.transform(of(sections, "points"), bullets)).alias("points"),
        F.coalesce(F.get(F.filter(F.flatten(F.transform(last(sections, "relevance"), told)), lambda line: line != ""), F.lit(0)),
                   F.lit("")).alias("relevance")))


def parse_completion(response) -> Column:
    """Completion text -> ``struct<headline, key_points, relevance>`` (EXT-7).

    Marker lines are case-insensitive; of several HEADLINE or RELEVANCE lines the last
    counts; bullets count only under KEY POINTS; an empty RELEVANCE takes the next
    non-empty line of its section. Missing parts fall back to the raw text. Every line is
    looked at once, and each intermediate value is bound once (``_let``).
    """
    text = F.col(response) if isinstance(response, str) else response
    text = F.coalesce(text, F.lit(""))
    lines = F.transform(F.split(text, LINE_BREAKS), strip)
    parts = _let(lines, lambda told: _let(_marks(told), lambda marks: _parts(told, marks)))
    return _let(parts, lambda st: F.struct(
        F.when(st["headline"] != "", st["headline"])
         .otherwise(left_n(F.substring_index(text, "\n", 1), DEFAULT_HEADLINE_CHARS)).alias("headline"),
        F.when(F.size(st["points"]) > 0, st["points"])
         .otherwise(F.array(left_n(text, FALLBACK_POINT_CHARS))).alias("key_points"),
        F.when(st["relevance"] != "", st["relevance"])
         .otherwise(F.lit(PARSED_DEFAULT_RELEVANCE)).alias("relevance"),
    ))


def structure_completions(completions: DataFrame) -> DataFrame:
    """completions -> summaries; narrow, no UDF, no shuffle."""
    parsed = completions.select("item_kind", "item_id", parse_completion("response").alias("_s"))
    return parsed.select("item_kind", "item_id", "_s.headline", "_s.key_points", "_s.relevance")


def fallback_summary(kind: str) -> Column:
    """Summary used when no completion exists for an item (PRJ-1)."""
    return F.struct(
        F.col("title").alias("headline"),
        F.array(left_n(F.coalesce(F.col(item_text_col(kind)), F.lit("")), FALLBACK_POINT_CHARS)).alias("key_points"),
        F.lit(FALLBACK_RELEVANCE[kind]).alias("relevance"),
    )


FALLBACK = "fallback_s"


def slim(items: DataFrame, kind: str) -> DataFrame:
    """Items as caps and joins need them: ``item_id`` and the fallback summary instead of the text.

    The fallback holds at most ``FALLBACK_POINT_CHARS`` of the text, so abstracts and article
    bodies stay in the scan's stage and never cross an exchange.
    """
    df = items if "item_id" in items.columns else with_item_id(items, kind)
    return df.withColumn(FALLBACK, fallback_summary(kind)).drop(item_text_col(kind))


def summarize_capped(survivors: DataFrame, kind: str, completions: DataFrame | None = None) -> DataFrame:
    """Attach ``summary_s`` to items that a cap has kept (JOIN-3 after the caps, as a run does it).

    ``survivors`` come from ``slim``. Completions join as raw text by ``item_id`` and only
    those of survivors are parsed; an item without one keeps its fallback.
    """
    if completions is None:
        return survivors.withColumnRenamed(FALLBACK, "summary_s")
    told = completions.where(F.col("item_kind") == kind).select("item_id", F.coalesce("response", F.lit("")).alias("response_s"))
    parsed = F.when(F.col("response_s").isNotNull(), parse_completion("response_s"))
    return (survivors.join(told, "item_id", "left")
            .withColumn("summary_s", F.coalesce(parsed, F.col(FALLBACK))).drop("response_s", FALLBACK))


def with_summaries(items: DataFrame, kind: str, completions: DataFrame | None = None) -> DataFrame:
    """Attach ``summary_s`` to every item (JOIN-3): parsed completion, else fallback.

    A left join keyed by ``item_id``: an item without a completion is never
    dropped. ``completions=None`` is the summarizer-disabled run. All items are
    summarised; a digest caps first (``slim`` and ``summarize_capped``).
    """
    df = items if "item_id" in items.columns else with_item_id(items, kind)
    if completions is None:
        return df.withColumn("summary_s", fallback_summary(kind))
    comp = (completions.where(F.col("item_kind") == kind)
            .select("item_id", parse_completion("response").alias("_parsed")))
    # the fallback is cut before the join: a text that nobody reads later does not cross it
    joined = df.withColumn(FALLBACK, fallback_summary(kind)).join(comp, "item_id", "left")
    return joined.withColumn("summary_s", F.coalesce(F.col("_parsed"), F.col(FALLBACK))).drop("_parsed", FALLBACK)
