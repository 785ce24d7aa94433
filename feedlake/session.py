"""Session helpers.

Library code never creates or reconfigures a session on its own; these helpers
exist for tests, the bench and command-line use.
"""
from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every feedlake job assumes. Time-relative operators take explicit
# ``as_of`` values; UTC keeps TIMESTAMP <-> DATE conversions stable.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Re-running one digest date replaces only that date's partition.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


# Starting points for a large cluster (100 TB of payloads); the byte targets drive
# AQE coalescing and skew splitting, so partition counts follow the data size.
CLUSTER_CONF = {
    **DEFAULT_CONF,
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",  # respect the byte target
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",        # ~a few hundred MB of XML per parse task
    "spark.sql.shuffle.partitions": "20000",            # upper bound; AQE coalesces down
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "feedlake", coalesce: bool = True, driver_memory: str = "8g",
                  java_options: str | None = None) -> SparkSession:
    """A local session for tests and the bench.

    ``coalesce=False`` keeps every shuffle at ``shuffle_partitions`` tasks. AQE
    coalesces by bytes, which on a single machine squeezes the CPU-bound XML
    parsing after a small shuffle into a few tasks; on a cluster the byte-based
    target (``advisoryPartitionSizeInBytes``) is the right one and stays on.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.adaptive.coalescePartitions.enabled", str(coalesce).lower())
    if java_options:
        builder = builder.config("spark.driver.extraJavaOptions", java_options)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names shared storage and is used as is. Only when
    it is unset a local master gets a folder under the temp dir; any other master
    is an error, since executors would not see that folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:  # classic sessions; a Connect session has no SparkContext handle
        sc = spark.sparkContext
        conf_dir = conf_dir or sc.getConf().get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001
        pass
    if not conf_dir:
        if sc is None or not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="feedlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if sc is not None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def task_slots(spark: SparkSession) -> int:
    """Tasks that the session runs at once, as far as it tells; a Connect session tells its shuffle partitions only."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001
        return int(spark.conf.get("spark.sql.shuffle.partitions"))


LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession):
    """Folders are listed inside by four tasks a slot at most.

    By default a folder has a task of its own, up to 10,000 of them, and starting a task takes
    far longer than listing a folder.
    """
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(min(int(before), 4 * task_slots(spark))))
    try:
        yield
    finally:
        spark.conf.set(LISTING_TASKS, before)


def write_once(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table under the shared checkpoint folder: computed once, and later reads take only their columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/feedlake-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
