"""Pipeline health: report error scan, probe classification, scorecards, release gate."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions.numbers import round_binary_half_even
from feedlake.sources import broadcast_if_small

# Words that make a report line an error line (whole words, any case).
ERROR_WORDS = ["error", "exception", "traceback", "failed", "failure"]
# Phrases that clear a line (lower-case substring match).
BENIGN_PHRASES = [
    "error-free", "zero error", "no error", "no failures",
    "without error", "failure investigation", "failure investigate", "next phase:", "phase 2",
    "not a failure", "non-failure", "not failure", "no new failures", "no new error",
    "before it becomes a failure", "failure check", "report-error snapshots",
    "genuine error mentions",
]
# Grade thresholds on the unrounded score, and the pass mark.
GRADES = [(0.9, "A"), (0.8, "B"), (0.7, "C")]
FAIL_GRADE = "D"
PASS_SCORE = 0.8
MIN_DIGEST_BYTES = 1000
NEWEST_REPORTS = 10
# HTTP statuses of the probe rule (ok; rate limited, ok for the paper
# API; HEAD not allowed, retried with GET).
STATUS_OK, STATUS_RATE_LIMITED, STATUS_HEAD_NOT_ALLOWED = 200, 429, 405
# Latest-digest file pattern (``digest_*.md``).
DIGEST_FILE_PREFIX, DIGEST_FILE_SUFFIX = "digest_", ".md"

ERROR_PATTERN = r"(?iU)\b(" + "|".join(ERROR_WORDS) + r")\b"


def is_error_line(line, benign: Sequence[str] = BENIGN_PHRASES) -> Column:
    """Error word present and no benign phrase in the lower-cased line (FIL-6)."""
    c = F.col(line) if isinstance(line, str) else line
    low = F.lower(c)
    cleared = F.lit(False)
    for p in benign:
        cleared = cleared | F.contains(low, F.lit(p))
    return c.rlike(ERROR_PATTERN) & ~cleared


def newest_files(files: DataFrame, n: int = NEWEST_REPORTS, mtime_col: str = "modificationTime") -> DataFrame:
    """The ``n`` most recently modified files; ties broken by path (TOP-3)."""
    return files.orderBy(F.col(mtime_col).desc(), F.col("path").asc()).limit(n)


def error_scan(lines: DataFrame, files: DataFrame, newest: int | None = NEWEST_REPORTS,
               benign: Sequence[str] = BENIGN_PHRASES) -> DataFrame:
    """Error-line counts per report over the newest reports (AGG-4).

    The newest-``n`` file list has a proven bound (``n`` rows) and is broadcast
    into a semi join; the lines are filtered where they are read.
    """
    chosen = files if newest is None else newest_files(files, newest)
    chosen = chosen.select("path", "modificationTime")
    paths = chosen.select("path")
    scoped = lines.join(paths if newest is None else F.broadcast(paths), "path", "left_semi")
    counted = scoped.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"),
                                         F.count_if(is_error_line("line", benign)).alias("n_errors"))
    return (chosen.join(counted, "path", "left")  # an empty report has no lines and no errors
            .withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_lines", "n_errors")}))


def error_total(scan: DataFrame) -> DataFrame:
    """Global error count and the ``zero errors`` gate."""
    return scan.agg(F.coalesce(F.sum("n_errors"), F.lit(0)).cast("bigint").alias("n_errors"),
                    F.count(F.lit(1)).alias("n_reports")) \
        .withColumn("ok", F.col("n_errors") == 0)


def check_ok(kind: Column, method: Column, status: Column) -> Column:
    """Outcome of one probe attempt (FIL-7); null = decided by the retry.

    Any 2xx is ok for a feed; the paper API needs 200 or 429; a feed answering HEAD with
    405 is retried with GET and that attempt decides; anything else fails.
    """
    return (F.when(kind == "arxiv", status.isin(STATUS_OK, STATUS_RATE_LIMITED))
            .when(status.between(200, 299), F.lit(True))
            .when((method == "HEAD") & (status == STATUS_HEAD_NOT_ALLOWED), F.lit(None).cast("boolean"))
            .otherwise(F.lit(False)))


def classify_checks(checks: DataFrame, key_cols: Sequence[str] = ("cycle_ts", "kind", "target"),
                    attempt_col: str = "attempt") -> DataFrame:
    """One outcome per (cycle, probe): the last deciding attempt (FIL-7).

    A probe whose only attempts were deferred (HEAD 405 without a retry) fails.
    """
    ok = check_ok(F.col("kind"), F.col("method"), F.col("status"))
    rows = checks.withColumn("_ok", ok)
    decisive = F.when(F.col("_ok").isNotNull(), F.struct(F.col(attempt_col), F.col("_ok"), F.col("status")))
    agg = rows.groupBy(*key_cols).agg(F.max(decisive).alias("_d"), F.max_by("status", attempt_col).alias("_last"))
    return agg.select(*key_cols,
                      F.coalesce(F.col("_d._ok"), F.lit(False)).alias("ok"),
                      F.coalesce(F.col("_d.status"), F.col("_last")).alias("status"))


def feed_details(outcomes: DataFrame, group_cols: Sequence[str] = ("cycle_ts",)) -> DataFrame:
    """Feeds all-ok flag and url -> (ok, status) map per cycle (AGG-6).

    One entry per feed url (input is one outcome per probe), so the map never
    sees duplicate keys; its size is the number of registered feeds.
    """
    feeds = outcomes.where(F.col("kind") == "feed")
    return feeds.groupBy(*group_cols).agg(
        F.bool_and("ok").alias("all_ok"),
        F.count(F.lit(1)).alias("n_feeds"),
        F.map_from_entries(F.collect_list(F.struct("target", F.struct("ok", "status")))).alias("details"))


def grade(score: Column) -> Column:
    out = F.lit(FAIL_GRADE)
    for threshold, g in reversed(GRADES):
        out = F.when(score >= threshold, F.lit(g)).otherwise(out)
    return out


def scorecard(outcomes: DataFrame, group_cols: Sequence[str] = ("cycle_ts",)) -> DataFrame:
    """Score = passed / total probes, grade and pass flag per cycle (AGG-7, AGG-8).

    Grade and pass use the unrounded score; ``score_2dp`` is the report value.
    """
    agg = outcomes.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_checks"),
                                            F.count_if("ok").alias("n_passed"))
    score = F.col("n_passed") / F.col("n_checks")
    return agg.select(*group_cols, "n_checks", "n_passed", score.alias("score"),
                      round_binary_half_even(score, 2).alias("score_2dp"), grade(score).alias("grade"),
                      (score >= PASS_SCORE).alias("passed"))


def latest_artifact(inventory: DataFrame, min_bytes: int = MIN_DIGEST_BYTES,
                    group_cols: Sequence[str] = (), prefix: str = DIGEST_FILE_PREFIX, suffix: str = DIGEST_FILE_SUFFIX) -> DataFrame:
    """Most recently modified ``digest_*.md`` file and its size gate (AGG-5)."""
    name = F.element_at(F.split("path", "/"), -1)
    files = inventory.where(name.startswith(prefix) & name.endswith(suffix))
    agg = files.groupBy(*group_cols).agg(
        F.max_by(F.struct("path", "length"), F.struct("modificationTime", "path")).alias("_l"))
    return agg.select(*group_cols, F.col("_l.path").alias("path"), F.col("_l.length").alias("length"),
                      (F.col("_l.length") >= min_bytes).alias("ok"))


MAX_TEST_SECONDS = 5.0


def test_run_gate(runs: DataFrame, group_cols: Sequence[str] = ("cycle_ts",)) -> DataFrame:
    """Gate rows from test runs ``(ok, duration_sec)``: passed and no slower than 5 s.

    A run without a measured duration fails the gate.
    """
    ok = F.col("ok") & F.col("duration_sec").isNotNull() & (F.col("duration_sec") <= MAX_TEST_SECONDS)
    return runs.select(*group_cols, F.lit("tests").alias("gate"), F.coalesce(ok, F.lit(False)).alias("ok"))


def clean_tree_gate(status: DataFrame, group_cols: Sequence[str] = ("cycle_ts",)) -> DataFrame:
    """Gate rows from working-tree status lines ``(line)``: any tracked change fails.

    Untracked entries (``??``) are allowed; a cycle without status lines is clean.
    """
    code = F.substring(F.col("line"), 1, 2)
    tracked = (F.trim(code) != "") & (code != "??")
    return (status.groupBy(*group_cols).agg((F.count_if(tracked) == 0).alias("ok"))
            .select(*group_cols, F.lit("clean_tree").alias("gate"), "ok"))


def release_gate(gates: DataFrame, group_cols: Sequence[str] = ("cycle_ts",),
                 required: Sequence[str] = (), optional: Sequence[str] = ("health",)) -> DataFrame:
    """AND over all gates per cycle (AGG-9).

    A gate without a value fails, except the ``optional`` ones (a missing health
    score blocks nothing). A ``required`` gate without a row in a cycle fails too.
    """
    ok = F.coalesce("ok", F.col("gate").isin(list(optional)))
    absent = F.lit(0)
    for name in required:
        absent = absent + F.when(F.count_if(F.col("gate") == name) == 0, 1).otherwise(0)
    agg = gates.groupBy(*group_cols).agg((F.bool_and(ok) & (absent == 0)).alias("ok"),
                                         (F.count(F.lit(1)) + absent).cast("bigint").alias("n_gates"),
                                         (F.count_if(~ok) + absent).cast("bigint").alias("n_failed"))
    return agg.withColumn("action", F.when(F.col("ok"), F.lit("FAST-FORWARD")).otherwise(F.lit("INVESTIGATE")))
