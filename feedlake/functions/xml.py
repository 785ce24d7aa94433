"""Payload helpers for XML feeds (``Column -> Column``; rewrites of whole bodies: ``DataFrame -> DataFrame``).

A rewrite names every intermediate value as a column of a projection of its own: nested in one
expression, each of them would be computed again wherever it is mentioned, over the whole body.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.text import _col

# Namespace URIs the feed formats are defined by.
ATOM_NS = "http://www.w3.org/2005/Atom"
ARXIV_NS = "http://arxiv.org/schemas/atom"

# A DOCTYPE; group 1 is its internal subset, whose declarations, comments and quoted values may hold '>' and ']'.
_QUOTED = r"""\"[^\"]*+\"|'[^']*+'"""
_DOCTYPE_RE = rf"""(?s)<!DOCTYPE(?:[^\[>"']++|{_QUOTED})*+(?:\[((?:[^\]"'<]++|{_QUOTED}|<!--.*?-->|<)*+)\]\s*+)?+>"""
# Local name (and prefix) of the root element, skipping a byte-order mark, the
# XML declaration, comments, DOCTYPE and white space (possessive: the matcher
# never recurses per blank, whatever the length of the prolog).
_PROLOG_RE = rf"(?s)^[^\w<]*+(?:<\?.*?\?>|<!--.*?-->|{_DOCTYPE_RE.removeprefix('(?s)').replace('((?:', '(?:(?:', 1)}|\s++)*+"
_ROOT_RE = _PROLOG_RE + r"<(?:([\w.-]+):)?([\w.-]+)"
# All that the start of a document tells: up to the end of the root's start tag (or to where that tag breaks off).
_HEAD_RE = _PROLOG_RE + r"""<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>?"""
# The root's start tag; a quoted attribute value may hold '>'.
_ROOT_TAG_RE = _PROLOG_RE + r"""(<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>)"""


def _ns_decl(uri: str) -> str:
    return r"xmlns(?::([\w.-]+))?\s*=\s*[\"']" + re.escape(uri) + r"[\"']"


def without_bom(body) -> Column:
    """The document without a leading byte-order mark."""
    b = _col(body)
    return F.when(F.startswith(b, F.lit("\ufeff")), F.substr(b, F.lit(2))).otherwise(b)


def head(body) -> Column:
    """Start of the document up to the end of the root's start tag ('' when there is none).

    What is asked of the root has the same answer on the head, without a look at the whole body.
    """
    return F.regexp_extract(_col(body), _HEAD_RE, 0)


def root_name(body) -> Column:
    """Local name of the document's root element ('' when there is none)."""
    return F.regexp_extract(_col(body), _ROOT_RE, 2)


def root_prefix(body) -> Column:
    return F.regexp_extract(_col(body), _ROOT_RE, 1)


def root_tag(body) -> Column:
    """Start tag of the document's root element ('' when there is none)."""
    return F.regexp_extract(_col(body), _ROOT_TAG_RE, 1)


def children_in(body, uri: str) -> Column:
    """True when the root's start tag puts plain children (after ``canonical``) in namespace ``uri``.

    That is, it binds ``uri`` as default namespace or to the root's own prefix;
    a binding further down, or of another prefix, does not count.
    """
    tag = root_tag(body)
    prefix = ns_prefix(tag, uri)
    return binds(tag, uri) & ((prefix == "") | (prefix == root_prefix(body)))


def has_default_namespace(body) -> Column:
    """True when the root's start tag declares a non-empty default namespace."""
    return root_tag(body).rlike(r"""\sxmlns\s*=\s*["'][^"']""")


def binds(body, uri: str) -> Column:
    """True when the document declares namespace ``uri``."""
    return _col(body).rlike(_ns_decl(uri))


def ns_prefix(body, uri: str) -> Column:
    """Prefix bound to ``uri`` ('' for a default namespace or none)."""
    b = _col(body)  # a body that does not even hold the uri is not searched by the expression
    return F.when(~F.contains(b, F.lit(uri)), F.lit("")).otherwise(F.regexp_extract(b, _ns_decl(uri), 1))


def _rename_prefix(body: Column, prefix: Column, to: str) -> Column:
    pattern = F.concat(F.lit("(</?)"), prefix, F.lit(":"))
    return F.regexp_replace(body, pattern, F.lit("$1" + to))


def canonical(df: DataFrame, body: str) -> DataFrame:
    """Rewrite element prefixes so that field names identify namespaces.

    Spark's XML reader keys fields by their written qualified name. Elements of
    the Atom namespace are renamed to the bare local name when the root is in
    that namespace, otherwise to ``atom:``; the arXiv extension namespace always
    becomes ``arxiv:``. Other prefixes (``media:``, ``dc:`` ...) stay distinct,
    so they can never shadow a feed field. A leading byte-order mark is dropped.
    """
    b, p = F.col(body), F.col("_prefix")
    df = df.withColumn(body, without_bom(b)).withColumn("_prefix", ns_prefix(b, ATOM_NS))
    df = df.withColumn(body, F.when(p == "", b)
                       .when(root_prefix(b) == p, _rename_prefix(b, p, ""))
                       .when(p == "atom", b)
                       .otherwise(_rename_prefix(b, p, "atom:")))
    df = df.withColumn("_prefix", ns_prefix(b, ARXIV_NS))
    return df.withColumn(body, F.when((p == "") | (p == "arxiv"), b).otherwise(_rename_prefix(b, p, "arxiv:"))).drop("_prefix")


MAX_ENTITIES, MAX_ENTITY_CHARS = 16, 1000
_ENTITY_RE = rf"""<!ENTITY\s++([\w.-]++)\s++({_QUOTED})\s*+>"""


def without_doctype(df: DataFrame, body: str) -> DataFrame:
    """The documents with the entities of their internal subset expanded and the DOCTYPE taken out.

    General entities with literal values, in content and attributes, also if they name one another
    once. A subset with more than ``MAX_ENTITIES`` of them, or with a value of over ``MAX_ENTITY_CHARS``
    characters, gives null (a reject): a payload cannot grow without bound. CDATA sections are not told apart.
    """
    b, found = F.col(body), F.col("_found")
    subset = F.when(F.contains(b, F.lit("<!DOCTYPE")), F.regexp_extract(b, _DOCTYPE_RE, 1))
    entity = lambda e: F.struct(
        F.concat(F.lit("&"), F.regexp_extract(e, _ENTITY_RE, 1), F.lit(";")).alias("ref"),
        F.regexp_replace(F.regexp_extract(e, _ENTITY_RE, 2), r"^.|.$", "").alias("value"))
    df = df.withColumn("_subset", subset).withColumn("_found", F.regexp_extract_all("_subset", F.lit(_ENTITY_RE), 0))
    df = df.withColumn("_found", F.transform(found, entity))
    bounded = (F.size(found) <= MAX_ENTITIES) & ~F.exists(found, lambda e: F.length(e["value"]) > MAX_ENTITY_CHARS)
    expand = lambda acc, e: F.replace(acc, e["ref"], e["value"])
    expanded = F.when(bounded, F.aggregate(F.concat(found, found), F.regexp_replace(b, _DOCTYPE_RE, ""), expand))
    return df.withColumn(body, F.when(F.col("_subset").isNotNull(), expanded).otherwise(b)).drop("_subset", "_found")


# Elements whose text is read.
LEAVES = ("id", "title", "summary", "content", "published", "updated", "name", "link", "description", "pubDate",
          "atom:updated", "arxiv:comment")
# group 1: a CDATA section or comment, kept; 2: start tag and text of a leaf with a child; 4: its end tag
_LEAF_RE = (r"(?s)(<!\[CDATA\[.*?\]\]>|<!--.*?-->)"
            rf"""|(<({'|'.join(LEAVES)})(?:\s(?:[^<>"'/]++|{_QUOTED}|/(?!>))*+)?+>"""
            r"(?:[^<]++|<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>)*+)<(?![/!?]).*?(</\3\s*+>)")


def cut_leaves(body) -> Column:
    """Elements that are read as text, cut at their first child: mixed and XHTML content keeps the text before it.

    That is an element's text as a standard tree parser has it. ``body`` is canonical. (A leaf within a
    leaf of the same name is not told apart.)
    """
    return F.regexp_replace(_col(body), _LEAF_RE, "$1$2$4")
