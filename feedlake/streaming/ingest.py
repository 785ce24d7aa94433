"""STR-1: payloads landing continuously -> item tables, exactly once.

The same narrow ``extract_*`` operators as the batch job run on the stream;
the file source plus the checkpoint give exactly-once appends. Two landing
layouts are supported:

* ``layout='table'`` (default): fetchers append payload rows (``payload_id,
  url, kind, fetched_at, body``) as Parquet files. Few, large files: listing
  and task packing stay cheap at any volume.
* ``layout='files'``: one raw document per file (``wholetext``); the payload id
  is the file path, or the ``payload_id=<id>`` folder it sits in.

The checkpoint lives under the session's ``spark.checkpoint.dir`` (shared
storage on a cluster) unless a location is given.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from feedlake import schemas
from feedlake.operators import extract as ex
from feedlake.session import ensure_checkpoint_dir
from feedlake.sources import attach_feed, read_payloads

EXTRACTORS = {"feed": ex.extract_articles, "arxiv": ex.extract_papers, "serp": ex.extract_web_results}


def land_payloads(payloads: DataFrame, landing: str, layout: str = "table") -> None:
    """Append payloads to a landing folder (what a fetcher does; used by tests and demos)."""
    if layout == "table":
        payloads.select("payload_id", "url", "kind", "fetched_at", "body").write.mode("append").parquet(landing)
    elif layout == "files":
        (payloads.select("body", "payload_id").write.mode("append")
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .partitionBy("payload_id").text(landing))
    else:
        raise ValueError("layout must be 'table' or 'files'")


def _payload_id_from_path(df: DataFrame) -> DataFrame:
    pid = F.regexp_extract(F.col("payload_id"), r"payload_id=([^/]+)/", 1)
    return df.withColumn("payload_id", F.when(pid != "", F.url_decode(pid)).otherwise(F.col("payload_id")))


def payload_stream(spark: SparkSession, landing: str, kind: str, layout: str = "table",
                   schema: T.StructType | None = None) -> DataFrame:
    if layout == "table":
        df = spark.readStream.schema(schema or schemas.PAYLOADS).parquet(landing)
        return df.where(F.col("kind") == kind)
    if layout == "files":
        return _payload_id_from_path(read_payloads(spark, landing, kind, stream=True, glob="*.txt"))
    raise ValueError("layout must be 'table' or 'files'")


def stream_ingest(spark: SparkSession, landing: str, out: str, kind: str = "feed",
                  registry: DataFrame | None = None, checkpoint: str | None = None,
                  url_from_payload=None, available_now: bool = True, layout: str = "table",
                  schema: T.StructType | None = None, web_results: int | None = 5) -> StreamingQuery:
    """Start the ingest stream; returns the running query.

    ``url_from_payload`` maps the payload-id column to the feed url used to
    attach registry names (stream-static broadcast join). ``web_results``: hits
    kept per search page of kind ``serp`` (None: all).
    """
    if kind not in EXTRACTORS:
        raise ValueError(f"kind must be one of {sorted(EXTRACTORS)}")
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/feedlake-ingest-{uuid.uuid4().hex}"
    payloads = payload_stream(spark, landing, kind, layout, schema)
    if url_from_payload is not None:
        payloads = payloads.withColumn("url", url_from_payload(F.col("payload_id")))
    if registry is not None and kind == "feed":
        payloads = attach_feed(payloads, registry)
    items = EXTRACTORS[kind](payloads, web_results) if kind == "serp" else EXTRACTORS[kind](payloads)
    writer = (items.writeStream.format("parquet").option("path", out)
              .option("checkpointLocation", ckpt).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def run_ingest_once(spark: SparkSession, landing: str, out: str, **kw) -> DataFrame:
    """Process everything landed so far, wait, and read the item table back."""
    q = stream_ingest(spark, landing, out, available_now=True, **kw)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(out)
