"""String / array helpers with exact edge semantics (``Column -> Column``).

All are built-in Spark expressions: no UDF, whole-stage code generation stays
intact wherever the surrounding operator supports it.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` removes (``str.isspace``).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove leading/trailing whitespace, Unicode-aware (``str.strip``)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def lstrip_chars(c, chars: str) -> Column:
    """Remove leading characters drawn from ``chars`` (``str.lstrip(chars)``)."""
    return F.regexp_replace(_col(c), "^[" + _regex_class(chars) + "]+", "")


def _regex_class(chars: str) -> str:
    return "".join("\\" + ch if ch in "\\^-]" else ch for ch in chars)


def one_line(c) -> Column:
    """Strip, then turn each newline into one space (no run collapsing)."""
    return F.replace(strip(c), F.lit("\n"), F.lit(" "))


def left_n(c, n: int) -> Column:
    """First ``n`` code points (``s[:n]``)."""
    return F.substring(_col(c), 1, n)


# Fixed value: the path part that precedes an arXiv id in an entry id.
ABS_MARKER = "/abs/"


def after_abs(c) -> Column:
    """Text after the last ``/abs/`` (whole string when absent)."""
    return F.element_at(F.split(_col(c), ABS_MARKER), -1)


def strip_tags(c) -> Column:
    """Remove ``<...>`` tags."""
    return F.regexp_replace(_col(c), "<[^>]+>", "")


def join_names(c, sep: str = ", ") -> Column:
    """Join an array of strings; null array -> ``""``; null elements dropped."""
    return F.coalesce(F.array_join(_col(c), sep), F.lit(""))


def non_empty(c) -> Column:
    """Keep non-null, non-empty elements of an array of strings."""
    return F.filter(_col(c), lambda x: x.isNotNull() & (x != ""))


def first_match(c, pred) -> Column:
    """First element satisfying ``pred`` or null (never throws on empty arrays)."""
    return F.get(F.filter(_col(c), pred), 0)


def first(c) -> Column:
    """First element of an array, null when the array is null or empty."""
    return F.get(_col(c), 0)


def strip_bullet(c) -> Column:
    """``line.lstrip('- ').strip()``."""
    return strip(F.regexp_replace(_col(c), "^[- ]+", ""))


def json_get(c, path: str, default: str = "") -> Column:
    """``json.loads(x).get(a, {}).get(b, default)`` for a ``$.a.b`` style path."""
    return F.coalesce(F.get_json_object(_col(c), path), F.lit(default))


def or_default(c, default: str) -> Column:
    """``x or default`` for strings: null and ``""`` both give ``default``."""
    c = _col(c)
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)


# Line breaks as ``str.splitlines`` knows them.
LINE_BREAKS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"

# Those of them that do not end a line of a text file.
RARE_BREAKS = "[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def split_lines(c) -> Column:
    """``str.splitlines()``: no trailing empty line, empty text gives no lines."""
    c = _col(c)
    parts = F.split(c, LINE_BREAKS)
    return (F.when(c == "", F.array().cast("array<string>"))
            .when(c.rlike("(?:" + LINE_BREAKS + ")$"), F.slice(parts, 1, F.size(parts) - 1))
            .otherwise(parts))
