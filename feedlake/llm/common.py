"""Small helpers shared by the operators of this package."""
from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


_WRITTEN: list[list[str]] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # a query's shuffle files go when it ends


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are removed at the end, but for those of ``kept`` that the block fills.

    Shuffle files of a query go when the query ends: its result is in a table by then and is
    read from there, also after the loss of an executor. An outer block removes what an inner one kept.
    """
    kept: list[DataFrame] = []
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    _WRITTEN.append([])
    try:
        yield kept
    finally:
        spark.conf.set(CLEANUP, before)
        paths, stay = _WRITTEN.pop(), {f for df in kept for f in df.inputFiles()}
        for path in paths:
            if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in stay):
                remove(spark, path)
            elif _WRITTEN:
                _WRITTEN[-1].append(path)


def write(df: DataFrame, name: str) -> str:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir``; returns its path."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/feedlake-{name}-{uuid.uuid4().hex}"
    for paths in _WRITTEN[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage and survives lost executors; the read-back uses the written
    schema, so an empty frame comes back empty.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more (what was derived from it is written already)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and an idle one should hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark an already written ``df`` for broadcast only if it has at most ``max_rows`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def slices(batch: pa.RecordBatch, column: int = 0, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``max_bytes`` of the variable-length ``column`` (a row is never cut)."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    cut, start, total = 0, 0, np.cumsum(lengths)
    while start < batch.num_rows:
        cut = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + max_bytes, "right")))
        yield batch.slice(start, cut - start)
        start = cut
