"""Sinks: digests, scorecards and item tables."""
from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Many small files on a local file system: without checksum files and without a forked chmod for every
# folder, file and checksum. Options of one write; other file systems do not know them.
PLAIN_LOCAL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write_digests(digests: DataFrame, path: str, partition_cols: Sequence[str] = ("digest_date",)) -> None:
    """One text file per digest under ``digest_date=<day>/`` (SNK-1).

    Dynamic partition overwrite: re-running one date replaces only that date,
    other dates stay. ``digest_date`` defaults to ``digest_key``. The text sink
    ends each document with a newline.
    """
    df = digests
    if "digest_date" in partition_cols and "digest_date" not in df.columns:
        df = df.withColumn("digest_date", F.col("digest_key"))
    (df.select("md", *partition_cols).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).text(path))


def write_digest_blocks(blocks: DataFrame, path: str, partitions: int | None = None) -> None:
    """Digests as ordered text files under ``digest_date=<day>/`` (SNK-1 without one string per digest).

    ``blocks`` are the rows of ``operators.digest.digest_blocks``. They are range-partitioned and
    sorted by their place, so a large digest is written by many tasks; its files in name order, one
    after the other, are the same text that ``write_digests`` puts into one file.
    """
    n = partitions or int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["digest_date", "section", "rn"]
    (blocks.withColumnRenamed("digest_key", "digest_date").repartitionByRange(n, *place).sortWithinPartitions(*place)
     .select("block", "digest_date").write.mode("overwrite").options(partitionOverwriteMode="dynamic", **PLAIN_LOCAL_FILES)
     .partitionBy("digest_date").text(path))


def write_scorecard(scores: DataFrame, path: str, mode: str = "overwrite", partition_cols: Sequence[str] = ()) -> None:
    """Scorecards as JSON lines (SNK-2), in a folder per value of ``partition_cols`` if given."""
    scores.write.mode(mode).partitionBy(*partition_cols).json(path)


def write_items(items: DataFrame, path: str, partition_cols: Sequence[str] = ("digest_key",),
                mode: str = "overwrite") -> None:
    """Item tables as Parquet partitioned by day (SNK-4), dynamic overwrite.

    Rows are clustered by folder before the write: adaptive execution splits a large folder over
    several tasks and packs small ones, so files follow bytes and not tasks times days.
    """
    (items.hint("rebalance", *[F.col(c) for c in partition_cols]).write.mode(mode).option("partitionOverwriteMode", "dynamic")
          .partitionBy(*partition_cols).parquet(path))


def run_path(out: str, table: str) -> str:
    return f"{out.rstrip('/')}/{table}"


def commit_run(spark: SparkSession, out: str, run_id: str, tables: dict[str, T.StructType]) -> None:
    """Name ``run_id`` as a whole run of ``out``, after all its ``tables`` (name -> schema) are written (SNK-4).

    One file per run; it appears at once, when its job commits. Until then no reader of ``read_run`` sees a row of the run.
    """
    named = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v.json()).alias("schema")) for k, v in sorted(tables.items())])
    (spark.range(1, numPartitions=1).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("committed_at"), named.alias("tables"))
     .write.mode("append").json(run_path(out, "runs")))


def committed_runs(spark: SparkSession, out: str) -> DataFrame:
    """(run_id, committed_at, tables) of the whole runs under ``out``."""
    return spark.read.schema("run_id string, committed_at timestamp, tables array<struct<name:string,schema:string>>").json(run_path(out, "runs"))


def read_run(spark: SparkSession, out: str, table: str, run_id: str | None = None) -> DataFrame:
    """Rows of one table of a committed run, the newest if ``run_id`` is null; a run that is not committed raises."""
    runs = committed_runs(spark, out)
    last = (runs if run_id is None else runs.where(F.col("run_id") == run_id)).orderBy(F.col("committed_at").desc(), F.col("run_id").desc()).first()
    if last is None:
        raise ValueError(f"no committed run {run_id or ''} under {out}")
    schema = {t["name"]: t["schema"] for t in last["tables"]}[table]
    # only this run's folders are listed, however many runs there are
    base, declared = run_path(out, table), T.StructType.fromJson(json.loads(schema))
    try:
        df = spark.read.schema(declared).option("basePath", base).parquet(f"{base}/run_id={last['run_id']}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], declared)  # a table without rows in this run reads back empty
    return df.where(F.col("run_id") == last["run_id"]).drop("run_id")


def compact_payloads(spark, landing: str, table: str, kind: str, glob: str | None = None,
                     target_files: int | None = None) -> int:
    """Fold one-file-per-payload landings into the Parquet payload table (append).

    Reading packs many small files per task (``maxPartitionBytes`` /
    ``openCostInBytes``); the table then holds few large files, which keeps
    listing and task scheduling cheap for every later batch or stream read.
    Payloads that the table already has (by ``payload_id``) are left out, so a rerun
    adds nothing. Returns the number of payloads that this call wrote.
    """
    from feedlake.sources import read_payloads
    df = read_payloads(spark, landing, kind, glob=glob)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        df = df.join(spark.read.schema(df.schema).parquet(table).select("payload_id"), "payload_id", "left_anti").select(*df.columns)
    if target_files:
        df = df.coalesce(target_files)
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(table)
    return written.get["n"]
