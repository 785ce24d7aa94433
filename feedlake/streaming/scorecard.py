"""STR-2: health score per cycle window over a stream of probe results.

Event time is the probe timestamp; a watermark bounds the window state, and
rows later than the watermark are dropped. Two forms:

* ``run_probe_outcomes``: the state holds one outcome per (window, kind, target), by the
  same classification as the batch (FIL-7); every batch writes the outcomes it
  changed (update mode), so the open window shows too. ``quality.scorecard``
  over them equals the batch scorecard.
* ``stream_scorecard``: one aggregation in append mode that scores attempts and
  emits a window once the watermark has passed it; attempts deferred to a
  retry do not count.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.operators.quality import PASS_SCORE, check_ok, classify_checks, grade

OUTCOMES = "cycle_ts timestamp, kind string, target string, ok boolean, status int"


def run_probe_outcomes(checks: DataFrame, out: str, checkpoint: str, window: str = "1 day",
                       delay: str = "1 hour", ts_col: str = "ts") -> DataFrame:
    """Drain a stream of probe attempts; one outcome per (window start, kind, target).

    Each micro-batch writes its changed outcomes under its own ``batch`` folder, so a
    retried batch replaces what it wrote before; the latest batch of a probe counts.
    """
    spark = checks.sparkSession
    windowed = (checks.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, delay)
                .withColumn("w", F.window(ts_col, window)))
    outcomes = (classify_checks(windowed, ["w", "kind", "target"])
                .select(F.col("w.start").alias("cycle_ts"), "kind", "target", "ok", F.col("status").cast("int").alias("status")))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    write(spark.createDataFrame([], OUTCOMES), -1)   # an empty source still gives a table
    (outcomes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .outputMode("update").trigger(availableNow=True).start().awaitTermination())
    key = ["cycle_ts", "kind", "target"]
    return (spark.read.schema(OUTCOMES + ", batch long").parquet(out).groupBy(*key)
            .agg(F.max_by(F.struct("ok", "status"), "batch").alias("last")).select(*key, "last.ok", "last.status"))


def stream_scorecard(checks: DataFrame, window: str = "1 day", delay: str = "1 hour",
                     ts_col: str = "ts") -> DataFrame:
    """Windowed scorecard; works on streaming and batch frames alike."""
    ok = check_ok(F.col("kind"), F.col("method"), F.col("status"))
    scored = (checks.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
              .withWatermark(ts_col, delay)
              .where(ok.isNotNull())
              .groupBy(F.window(ts_col, window).alias("w"))
              .agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(ok).alias("n_passed")))
    score = F.col("n_passed") / F.col("n_checks")
    return scored.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                         "n_checks", "n_passed", score.alias("score"), grade(score).alias("grade"),
                         (score >= PASS_SCORE).alias("passed"))
