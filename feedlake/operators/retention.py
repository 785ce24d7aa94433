"""Retention of dated outputs: plan (dry run) and apply."""
from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions.dates import name_date

MODES = ("archive", "delete")


def _cutoff(as_of: str, keep_days: int) -> Column:
    if keep_days < 0:
        raise ValueError("keep_days must be >= 0")
    return F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(keep_days))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _status(day: Column, cutoff: Column) -> Column:
    return (F.when(day.isNull(), F.lit("skipped"))
            .when(day.cast("timestamp") < cutoff, F.lit("expired")).otherwise(F.lit("kept")))


def mark_expired(inventory: DataFrame, as_of: str, keep_days: int, by: str = "name",
                 path_col: str = "path", mtime_col: str = "modificationTime",
                 date_col: str = "digest_date") -> DataFrame:
    """Add ``status`` = expired | kept | skipped (FIL-4, FIL-5, JOIN-5).

    ``by='name'``: only ``digest_<date>.*`` files count; the date in the name
    (midnight UTC) is expired when it is before ``as_of - keep_days``; other
    names are skipped. ``by='partition'``: the same with the day of the file's
    ``<date_col>=<date>`` folder, as the digest sink writes them. ``by='mtime'``: the
    modification time is compared instead (a file exactly at the cutoff is kept).
    """
    cutoff = _cutoff(as_of, keep_days)
    if by == "partition":
        day = F.regexp_extract(F.col(path_col), rf"/{date_col}=(\d{{4}}-\d{{1,2}}-\d{{1,2}})/", 1)
        d = F.call_function("try_to_date", day, F.lit("yyyy-M-d"))
        return inventory.withColumns({"file_date": d, "status": _status(d, cutoff)})
    if by == "name":
        d = name_date(file_name(F.col(path_col)))
        return inventory.withColumns({"file_date": d, "status": _status(d, cutoff)})
    if by == "mtime":
        status = F.when(F.col(mtime_col) < cutoff, F.lit("expired")).otherwise(F.lit("kept"))
        return inventory.withColumn("status", status)
    raise ValueError("by must be 'name', 'partition' or 'mtime'")


def retention_plan(marked: DataFrame, mode: str = "archive", group_cols: Sequence[str] = (),
                   length_col: str = "length") -> DataFrame:
    """Totals of a retention run: archived, deleted, bytes_freed (AGG-2, AGG-3).

    The dry run and the real run report the same numbers; this frame is both.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    expired = F.col("status") == "expired"
    n = F.count_if(expired)
    return marked.groupBy(*group_cols).agg(
        (n if mode == "archive" else F.lit(0).cast("bigint")).alias("archived"),
        (n if mode == "delete" else F.lit(0).cast("bigint")).alias("deleted"),
        F.coalesce(F.sum(F.when(expired, F.col(length_col))), F.lit(0)).cast("bigint").alias("bytes_freed"),
    )


def dry_run_listing(marked: DataFrame, mode: str = "archive", path_col: str = "path") -> DataFrame:
    """What a run would do, one row per expired file in name order (TOP-4).

    The sort is for the listed plan only; totals come from ``retention_plan``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return (marked.where(F.col("status") == "expired")
            .select(F.col(path_col).alias("path"), F.lit(mode).alias("action"))
            .orderBy("path"))


def kept(marked: DataFrame) -> DataFrame:
    """Files that stay live: everything not expired (JOIN-5 as a complement filter)."""
    return marked.where(F.col("status") != "expired")


BATCH_FILES = 1000  # files (about) whose names the driver holds at a time

MANIFEST = "path string, length long, modificationTime timestamp, batch int, batches int"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_manifest(marked: DataFrame, manifest: str, batch_files: int = BATCH_FILES) -> DataFrame:
    """The expired files of a marked inventory as a table, written before anything is touched.

    A complete manifest that is there already is taken as it is, so that a run that was cut off goes
    on with its own files. Files are dealt to batches by a hash of the path.
    """
    spark = marked.sparkSession
    if not _exists(spark, f"{manifest.rstrip('/')}/_SUCCESS"):
        files = marked.where("status = 'expired'").select("path", "length", "modificationTime")
        batches = max(1, -(-files.count() // batch_files))
        (files.withColumn("batch", F.pmod(F.xxhash64("path"), F.lit(batches)).cast("int"))
         .withColumn("batches", F.lit(batches)).write.mode("overwrite").parquet(manifest))
    return spark.read.schema(MANIFEST).parquet(manifest)


def archive_batch(spark: SparkSession, files: DataFrame, paths: list[str], target: str) -> DataFrame:
    """Copy the files of one batch into ``target`` (path, modificationTime, length, content); returns the verified ones.

    Executors read and write the contents. A target that is complete already is left alone: its
    files may be gone from the live folder. Verified: stored whole, with the manifest's length.
    """
    if not _exists(spark, f"{target}/_SUCCESS"):
        plain = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in paths]  # names, not globs
        found = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(plain)
        found.select("path", "modificationTime", "length", "content").write.mode("overwrite").parquet(target)
    held = spark.read.parquet(target).select("path", F.octet_length("content").cast("long").alias("held"))
    return files.join(held, "path").where("held = length").select(files.columns)


def _delete(spark: SparkSession, files: DataFrame) -> int:
    """Delete listed files that are still as listed, and folders that this leaves empty; returns the folders removed.

    One name at a time reaches the driver. A file that has changed since, or that the list does
    not have, stays, and so does its folder (folders are never deleted with contents).
    """
    parents, removed = set(), 0
    for r in files.select("path", "length", F.unix_millis("modificationTime").alias("ms")).toLocalIterator():
        fs, p = _fs(spark, r.path)
        if fs.exists(p):
            st = fs.getFileStatus(p)
            if st.getLen() == r.length and st.getModificationTime() == r.ms:
                fs.delete(p, False)
        parents.add(p.getParent().toString())
    for parent in sorted(parents):
        fs, p = _fs(spark, parent)
        if "=" in p.getName() and fs.exists(p) and len(fs.listStatus(p)) == 0:
            fs.delete(p, False)
            removed += 1
    return removed


def apply_manifest(spark: SparkSession, manifest: str, mode: str = "archive", archive_path: str | None = None) -> DataFrame:
    """Carry out a written manifest, batch by batch: archive, verify, then delete only what is listed (SNK-3).

    Every step may be cut off and repeated. Returns one row of totals over the whole manifest, equal to
    those of ``retention_plan`` for the same files, with the folders that this call removed.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "archive" and not archive_path:
        raise ValueError("archive mode needs archive_path")
    listed = spark.read.schema(MANIFEST).parquet(manifest)
    first = listed.select("batches").first()
    folders = 0
    for k in range(first.batches if first else 0):
        files = listed.where(F.col("batch") == k).select("path", "length", "modificationTime")
        if mode == "archive":
            paths = [r.path for r in files.select("path").collect()]  # about BATCH_FILES names
            if not paths:
                continue
            files = archive_batch(spark, files, paths, f"{archive_path.rstrip('/')}/{manifest.rstrip('/').rsplit('/', 1)[1]}-{k:06d}")
        folders += _delete(spark, files)
    return (retention_plan(listed.withColumn("status", F.lit("expired")), mode)
            .withColumn("partitions_removed", F.lit(folders).cast("long")))


def read_archive(spark: SparkSession, archive_path: str) -> DataFrame:
    """Every archived file: (path, modificationTime, length, content)."""
    return (spark.read.schema("path string, modificationTime timestamp, length long, content binary")
            .option("recursiveFileLookup", True).parquet(archive_path))


def apply_retention(spark: SparkSession, live_path: str, as_of: str, keep_days: int,
                    mode: str = "archive", archive_path: str | None = None,
                    date_col: str = "digest_date", by: str = "partition", glob: str | None = None,
                    manifest: str | None = None) -> DataFrame:
    """Retention of the files under ``live_path``, in any format (text digests, Parquet tables, reports).

    The expired files are listed in ``manifest`` first (default: a new table in the shared checkpoint
    folder; pass a path to be able to go on after a crash), then archived, verified and deleted.
    ``by``: see ``mark_expired``. Files that land meanwhile are not on the list and stay.
    """
    from feedlake.session import ensure_checkpoint_dir
    from feedlake.sources import read_file_inventory

    at = manifest or f"{ensure_checkpoint_dir(spark).rstrip('/')}/feedlake-retention-{uuid.uuid4().hex}"
    inventory = read_file_inventory(spark, live_path, glob=glob, recursive=True)
    write_manifest(mark_expired(inventory, as_of, keep_days, by=by, date_col=date_col), at)
    return apply_manifest(spark, at, mode, archive_path)
