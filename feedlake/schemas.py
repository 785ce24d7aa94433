"""Declared schemas. Payload parsing never infers a schema."""
from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
ARR_S = T.ArrayType(S)


def _leaves(*names: str) -> list[T.StructField]:
    # Leaves are arrays so that a repeated element keeps the *first* value.
    return [T.StructField(n, ARR_S) for n in names]


_TERM = T.ArrayType(T.StructType([T.StructField("_term", S)]))

ATOM_ENTRY = T.StructType(
    _leaves("id", "title", "summary", "content", "published", "updated")
    + [
        T.StructField("link", T.ArrayType(T.StructType([
            T.StructField("_rel", S), T.StructField("_href", S)]))),
        T.StructField("author", T.ArrayType(T.StructType([T.StructField("name", ARR_S)]))),
        T.StructField("arxiv:primary_category", _TERM),
        T.StructField("category", _TERM),
        T.StructField("arxiv:comment", ARR_S),
    ]
)

RSS_ITEM = T.StructType(_leaves("title", "link", "description", "pubDate", "atom:updated"))

CORRUPT = "_corrupt_record"

# One parse of any payload: Atom entries, RSS channel items and root-level items.
FEED_DOC = T.StructType([
    T.StructField("entry", T.ArrayType(ATOM_ENTRY)),
    T.StructField("channel", T.ArrayType(T.StructType([T.StructField("item", T.ArrayType(RSS_ITEM))]))),
    T.StructField("item", T.ArrayType(RSS_ITEM)),
    T.StructField(CORRUPT, S),
])

XML_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
    "ignoreSurroundingSpaces": "false",
}

PAYLOADS = T.StructType([
    T.StructField("payload_id", S),
    T.StructField("url", S),
    T.StructField("kind", S),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("body", S),
])

FEED_REGISTRY = T.StructType([
    T.StructField("registry_pos", T.IntegerType()),
    T.StructField("name", S),
    T.StructField("url", S),
])

ARTICLES = T.StructType([
    T.StructField("payload_id", S), T.StructField("pos", T.IntegerType()),
    T.StructField("feed_name", S), T.StructField("title", S), T.StructField("link", S),
    T.StructField("summary", S), T.StructField("published", S), T.StructField("authors", ARR_S),
])

PAPERS = T.StructType([
    T.StructField("payload_id", S), T.StructField("pos", T.IntegerType()),
    T.StructField("arxiv_id", S), T.StructField("title", S), T.StructField("summary", S),
    T.StructField("authors", ARR_S), T.StructField("published", S),
    T.StructField("primary_category", S), T.StructField("categories", ARR_S),
    T.StructField("pdf_url", S), T.StructField("comment", S),
])

WEB_RESULTS = T.StructType([
    T.StructField("payload_id", S), T.StructField("pos", T.IntegerType()),
    T.StructField("title", S), T.StructField("href", S), T.StructField("body", S),
    T.StructField("source", S),
])

COMPLETIONS = T.StructType([
    T.StructField("item_kind", S), T.StructField("item_id", S), T.StructField("response", S),
])

SUMMARIES = T.StructType([
    T.StructField("item_kind", S), T.StructField("item_id", S), T.StructField("headline", S),
    T.StructField("key_points", ARR_S), T.StructField("relevance", S),
])

CHECK_RESULTS = T.StructType([
    T.StructField("cycle_ts", T.TimestampType()), T.StructField("kind", S),
    T.StructField("target", S), T.StructField("method", S),
    T.StructField("status", T.IntegerType()), T.StructField("ok", T.BooleanType()),
])

SCORECARD = T.StructType([
    T.StructField("timestamp", S), T.StructField("score", T.DoubleType()),
    T.StructField("grade", S),
])
