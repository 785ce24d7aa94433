"""Scalar helpers: whitespace, dates, file-name dates, bullets."""
from datetime import datetime
import re
from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from feedlake.functions import name_date, norm_date, one_line, strip, strip_bullet, strip_tags


ISO_HEAD = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:T(\d{1,2}):(\d{1,2}):(\d{1,2})Z?)?")


def _expected_date(raw):
    """Expected normalisation, built from regex + ``datetime`` + ``email.utils`` (test oracle)."""
    s = raw.strip()
    m = ISO_HEAD.fullmatch(s[:19])
    if m:
        try:
            return datetime(*[int(g) for g in m.groups() if g is not None]).date().isoformat()
        except ValueError:
            pass
    try:
        return parsedate_to_datetime(s).date().isoformat()
    except (ValueError, OverflowError):
        return s[:10]


DATES = [
    "2026-04-22T23:30:00-07:00", "2026-04-22", "2026-4-2", "Wed, 22 Apr 2026 23:30:00 -0700",
    "22 Apr 2026 23:30:00 +0000", "not a date", "", "  2026-04-22T00:00:00Z ", "2026-02-30",
    "Tue, 3 April 26 10:00 GMT", "Apr 22 2026 10:00:00", "22 Apr 2026", "Wed,22 Apr 2026 01:02:03 +0100 (UTC)",
    "2026-4-2T1:2:3Z", "Fri, 31 Feb 2026 10:00:00 +0000", "1 jan 70 00:00:00", "12 Dec 1999 25:00:00 +0000",
    "2026-13-01", "x" * 30, "22 Apr 2026 23:30:00+0000", "Mon, 01 Jan 2024 23:30:00 -0700",
]


def test_norm_date_matches_stdlib(spark):
    df = spark.createDataFrame([(d,) for d in DATES], "raw string")
    got = {r.raw: r.d for r in df.select("raw", norm_date("raw").alias("d")).collect()}
    for d in DATES:
        assert got[d] == _expected_date(d), d


def test_strip_is_unicode_aware(spark):
    vals = ["  a b  ", " x\u3000\xa0", "\n\tline\x1c\n", "", "   "]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.s for r in df.select(strip("v").alias("s")).collect()]
    assert got == [v.strip() for v in vals]


def test_one_line_strips_then_replaces_newlines(spark):
    vals = ["\n  Title\nwith break  ", "a\n\nb", "plain"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.s for r in df.select(one_line("v").alias("s")).collect()]
    assert got == [v.strip().replace("\n", " ") for v in vals]


@pytest.mark.parametrize("name,expected", [
    ("digest_2026-04-01.md", "2026-04-01"), ("digest_2026-04-01_x.md", None), ("digest_.md", None),
    ("other.md", None), ("digest_2026-4-1.md", "2026-04-01"), ("digest_2026-02-30.md", None),
    ("/a/b/digest_2026-04-01.txt", "2026-04-01"),
])
def test_name_date(spark, name, expected):
    r = spark.createDataFrame([(name,)], "n string").select(name_date("n").cast("string").alias("d")).first()
    assert r.d == expected


def test_strip_bullet_and_tags(spark):
    df = spark.createDataFrame([("-- a point ",), ("- - b",), ("-",), ("<b>x</b> y",)], "v string")
    rows = df.select(strip_bullet("v").alias("b"), strip_tags("v").alias("t")).collect()
    assert [r.b for r in rows][:3] == ["a point", "b", ""]
    assert rows[3].t == "x y"


def test_round_matches_python_binary_rounding(spark):
    from feedlake.functions import round_binary_half_even
    rows = [(p, n) for n in range(1, 81) for p in range(n + 1)]
    df = spark.createDataFrame(rows, "p int, n int").withColumn("x", F.col("p") / F.col("n"))
    got = df.select("x", round_binary_half_even("x").alias("r")).collect()
    assert all(r.r == round(r.x, 2) for r in got)
    extra = [0.125, 0.375, 0.295, 2.675, -0.295, 7.125]
    got = spark.createDataFrame([(v,) for v in extra], "x double").select(round_binary_half_even("x").alias("r"))
    assert [r.r for r in got.collect()] == [round(v, 2) for v in extra]


def test_mail_dates_match_stdlib_on_generated_stamps(spark):
    import random
    rng = random.Random(5)
    pick = rng.choice

    def stamp():
        day = pick(["1", "05", "22", "31", "0", "32", "2,", "+3", "1_0", "x"])
        month = pick(["Apr", "april", "DEC", "Sept", "may", "feb", "13"])
        year = pick(["2026", "26", "70", "068", "126", "2026,", "0", "99999", "y", "19_99"])
        time = pick(["10:00:00", "10:00", "10.30.00", "10.30", "10", "24:00:00", "1:2:3", "23:59:60", "10:00:00,", "10:00:00-0700", "10:00+0100", "a:b", "1:2:3:4", "10:0_0:00"])
        zone = pick(["GMT", "-0700", "+9999", "+2359", "-0000", "EST", "(UTC)", "", "x", "+2400", "99999999999999999999"])
        order = pick([[day, month, year, time, zone]] * 6 + [[month, day, time, year], [month, day, time, year, zone], [day, month, year, zone, time],
                     [f"{day}-{month}-{year}", time, zone], [day, month, time, year, zone], [day, month, zone, time, year], [day, month, year]])
        return pick(["Wed, ", "Wed ", "Wed,", "Wednesday, ", "", "foo ", ", ", "  "]) + pick([" ", "  ", "\t", "　"]).join(order)

    raws = sorted({stamp() for _ in range(6000)}) + ["Wed, 22 Apr 2026 10.30.00 GMT", "Wed Apr 22 10:00:00 2026", "22 Apr 126 10:00:00 GMT", "22 Apr 2026 10:00:00 +9999"]
    df = spark.createDataFrame([(d,) for d in raws], "raw string").repartition(2)
    got = {r.raw: r.d for r in df.select("raw", norm_date("raw").alias("d")).collect()}
    wrong = [(d, got[d], _expected_date(d)) for d in raws if got[d] != _expected_date(d)]
    assert not wrong, (len(wrong), wrong[:5])
    assert sum(len(v) == 10 and v[4] == "-" for v in got.values()) > 300
