"""Positions of rows in an order, found by many tasks, and pairing by position."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlake.session import ensure_checkpoint_dir


def with_position(df: DataFrame, order: Sequence[str], partitions: int | None = None, name: str = "position") -> DataFrame:
    """``df`` with its rows' numbers from 0 in the order of ``order`` (a unique key, else ties are numbered arbitrarily).

    Rows are range-partitioned and sorted; the layout is written to the shared checkpoint folder, so a
    recomputed task cannot move rows. Offsets are prefix sums of one count per partition: a table of at
    most ``partitions`` rows, which bounds both its window and its broadcast.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
            .withColumn("_pid", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()).checkpoint())
    counts = laid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n") - F.col("_first")
    return (laid.join(F.broadcast(counts.select("_pid", before.alias("_off"))), "_pid")
            .withColumn(name, F.col("_off") + F.col("_i")).drop("_pid", "_i", "_off"))


def pair_summaries(items: DataFrame, summaries: DataFrame, item_order: Sequence[str], summary_order: Sequence[str],
                   partitions: int | None = None) -> DataFrame:
    """Items with the summary at the same place of the other list (JOIN-1); the longer list is cut.

    Returns the items' columns, ``summary_s`` (a struct of the summaries' columns) and ``position``.
    """
    one = F.struct(*[F.col(c) for c in summaries.columns])
    told = with_position(summaries.withColumn("summary_s", one), summary_order, partitions).select("position", "summary_s")
    return with_position(items, item_order, partitions).join(told, "position")
