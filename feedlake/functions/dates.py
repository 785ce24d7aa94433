"""Date normalisation (``Column -> Column``), built-in expressions only."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake.functions.text import WHITESPACE, _col, left_n, strip

# Strict ``%Y-%m-%d`` (optionally ``T%H:%M:%S`` and a trailing ``Z``) as the
# C library parser accepts it: 4-digit year, 1-2 digit month/day/time fields.
_YMD = r"(?!0000)\d{4}-(?:1[0-2]|0[1-9]|[1-9])-(?:3[01]|[12]\d|0[1-9]|[1-9])"
_ISO_RE = r"^" + _YMD + r"(?:T(?:2[0-3]|[01]\d|\d):(?:[0-5]\d|\d):(?:[0-5]\d|\d)Z?)?$"
_YMD_RE = r"^" + _YMD + r"$"

# Month names accepted by RFC 2822 date parsing, abbreviations
# then full names, in calendar order (lower case).
MONTH_NAMES = [
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
]
# Fixed value: prefix of dated digest file names (``digest_<Y-M-D>.<ext>``).
DIGEST_NAME_PREFIX = "digest_"

# Day names that may lead an RFC 2822 date without a comma.
DAY_NAMES = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

_SPACE = "[" + WHITESPACE + "]+"
_INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
_LAST_COMMA = r",\z"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is named once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def _integer(c: Column) -> Column:
    """A whole number as ``int()`` reads it (sign, single underscores); null for anything else."""
    return F.when(c.rlike(_INTEGER), F.replace(c, F.lit("_"), F.lit("")).try_cast("bigint"))


def _drop_day_name(tokens: Column) -> Column:
    """Tokens without a leading day name; one that is glued to the next token ends at its last comma."""
    first, rest = F.get(tokens, 0), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    named = first.endswith(",") | F.lower(first).isin(DAY_NAMES)
    return F.when(named, rest).otherwise(F.concat(F.array(F.regexp_replace(first, "(?s)^.*,", "")), rest))


def _split_day(tokens: Column) -> Column:
    """``d-m-y`` in front of a time and a zone becomes three tokens."""
    parts = F.split(F.get(tokens, 0), "-")
    return F.when((F.size(tokens) == 3) & (F.size(parts) == 3), F.concat(parts, F.slice(tokens, 2, 2))).otherwise(tokens)


def _split_zone(tokens: Column) -> Column:
    """Of four tokens the last is a time with its offset, or a time alone."""
    last = F.get(tokens, 3)
    plus = F.instr(last, "+")
    at = F.when(plus == 0, F.instr(last, "-")).otherwise(plus)
    pair = F.when(at >= 2, F.array(F.substring(last, F.lit(1), at - 1), F.substring(last, at, F.length(last)))).otherwise(F.array(last, F.lit("")))
    return F.when(F.size(tokens) == 4, F.concat(F.slice(tokens, 1, 3), pair)).otherwise(tokens)


def _stamp_day(tokens: Column) -> Column:
    """``yyyy-MM-dd`` of the tokens day, month, year, time, zone in any order that mail dates use; null if they are no date."""
    one, two, three, four, zone = (F.get(tokens, i) for i in range(5))
    known = F.lower(two).isin(MONTH_NAMES)
    month_at = F.array_position(F.array(*[F.lit(n) for n in MONTH_NAMES]), F.lower(F.when(known, two).otherwise(one)))
    day = F.regexp_replace(F.when(known, one).otherwise(F.lower(two)), _LAST_COMMA, "")
    swapped = F.instr(three, ":") >= 2
    year = F.regexp_replace(F.when(swapped, four).otherwise(three), _LAST_COMMA, "")
    time = F.regexp_replace(F.when(swapped, three).otherwise(four), _LAST_COMMA, "")
    led = year.rlike("^[0-9]")  # else the zone comes before the year
    zone, year = F.when(led, zone).otherwise(year), F.when(led, year).when(year != "", zone)
    clock = F.when(F.contains(time, F.lit(":")), F.split(time, ":")).otherwise(F.split(time, r"\."))
    hour, minute = _integer(F.get(clock, 0)), _integer(F.get(clock, 1))
    second = F.when(F.size(clock) == 2, F.lit(0).cast("bigint")).when(F.size(clock) == 3, _integer(F.get(clock, 2)))
    far = F.abs(_integer(zone))
    offset = F.floor(far / 100) * 3600 + far % 100 * 60
    y = _integer(year)
    y = F.when(y >= 100, y).otherwise(y + F.when(y > 68, 1900).otherwise(2000))
    whole = ((one != "") & (two != "") & (three != "") & (month_at > 0) & hour.between(0, 23) & minute.between(0, 59)
             & second.between(0, 59) & y.between(1, 9999) & _integer(day).between(1, 31)
             & (~zone.rlike(_INTEGER) | F.coalesce(offset < 86400, F.lit(False))))
    month = (month_at - 1) % 12 + 1
    at = F.try_make_timestamp_ntz(y.cast("int"), month.cast("int"), _integer(day).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    return F.when(whole, at.cast("date").cast("string"))


def _mail_day(s: Column) -> Column:
    """Calendar day of an RFC 2822 stamp and its obsolete forms (dotted times, ``asctime`` order, RFC 850), or null."""
    tokens = F.filter(F.split(s, _SPACE), lambda x: x != "")
    return _let(tokens, lambda t: _let(_drop_day_name(t), lambda u: _let(_split_day(u), lambda v: _let(
        _split_zone(v), lambda w: F.when(F.size(w) >= 5, _stamp_day(w))))))


def _ymd_to_iso(y: Column, m: Column, d: Column) -> Column:
    """Validated ``yyyy-MM-dd`` string or null."""
    txt = F.format_string("%d-%d-%d", y, m, d)
    return F.date_format(F.call_function("try_to_date", txt, F.lit("yyyy-M-d")), "yyyy-MM-dd")


def norm_date(c) -> Column:
    """Feed date -> ``YYYY-MM-DD``.

    Strip; ISO date/date-time on the first 19 characters; else an RFC 2822
    stamp; else the first 10 characters. The calendar date of the stamp is kept
    as written (its UTC offset is not applied).
    """
    s = strip(c)
    s19 = left_n(s, 19)
    iso = F.when(s19.rlike(_ISO_RE),
                 _ymd_to_iso(*[F.split(F.regexp_extract(s19, r"^([^T]*)", 1), "-").getItem(i).cast("int")
                               for i in range(3)]))
    return F.coalesce(iso, _mail_day(s), left_n(s, 10))


def name_date(c) -> Column:
    """DATE from a file name ``digest_<Y-M-D>.<ext>``; null if it does not parse."""
    name = F.element_at(F.split(_col(c), "/"), -1)
    part = F.regexp_extract(name, "^" + DIGEST_NAME_PREFIX + r"([^.]*)", 1)
    return F.when(name.startswith(DIGEST_NAME_PREFIX) & part.rlike(_YMD_RE),
                  F.call_function("try_to_date", part, F.lit("yyyy-M-d")))
