"""Sources: landed payloads, feed registry, file inventories, logs, completions."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from feedlake import schemas
from feedlake.functions.text import RARE_BREAKS, json_get, split_lines
from feedlake.session import few_listing_tasks

# Feed name when the config gives none; title of a search hit without one.
DEFAULT_FEED_NAME = "RSS"
UNTITLED_HIT = "Untitled"

# Largest side (rows) we broadcast without a shuffle join; checked per call.
BROADCAST_MAX_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``broadcast(df)`` only after checking it has at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows; beyond the bound the frame
    is returned unchanged and the join falls back to a shuffle join (AQE may
    still pick a broadcast from runtime statistics).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def read_payloads(spark: SparkSession, path: str, kind: str, glob: str | None = None,
                  stream: bool = False, manifest: DataFrame | None = None, recursive: bool = False) -> DataFrame:
    """Landed payload files (one document per file) -> ``payloads`` (SRC-1/2/4).

    ``wholetext`` keeps each file one row; Spark packs small files into tasks
    (``maxPartitionBytes``/``openCostInBytes``). Search pages
    (``kind='serp'``) are decoded leniently: invalid UTF-8 bytes are dropped.
    XML payloads keep their bytes; one with invalid UTF-8 is a parse failure
    (a reject), as for any conforming XML parser.

    ``manifest`` (file, url; one row per landed file name) gives each payload the url it was
    fetched from, which the feed registry is matched by; without it, or for a file
    that it does not list, ``url`` is the file's path (see ``attach_urls``). With ``recursive``
    files are taken from folders of any name and depth, which are not read as partitions.
    """
    reader = spark.readStream if stream else spark.read
    r = reader.format("text").option("wholetext", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    with few_listing_tasks(spark):
        df = r.load(path)
    out = df.select(
        F.col("_metadata.file_path").alias("payload_id"),
        F.col("_metadata.file_path").alias("url"),
        F.lit(kind).alias("kind"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        (drop_invalid_utf8(F.col("value")) if kind == "serp" else F.col("value")).alias("body"),
    )
    return out if manifest is None else attach_urls(out, manifest)


def attach_urls(landed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of landed files (``payload_id``: the file's path) with the url that ``manifest`` tells, else their own.

    The manifest names files by ``path`` (as in a file inventory), else by ``folder`` (the name of the folder
    that holds the file; no listing is needed to write one down), else by ``file`` (the file's name). Rows
    that carry bodies cross the exchange of this join with them: aggregate first where that will do.
    """
    by = next(c for c in ("path", "folder", "file") if c in manifest.columns)
    told = manifest.select(F.col(by).alias("_file"), F.col("url").alias("_url"))
    part = {"path": F.col("payload_id"), "folder": F.substring_index(F.substring_index("payload_id", "/", -2), "/", 1),
            "file": F.substring_index("payload_id", "/", -1)}[by]
    name = F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))
    return (landed.join(told, name == F.col("_file"), "left")
            .withColumn("url", F.coalesce("_url", "url")).drop("_file", "_url"))


def drop_invalid_utf8(c):
    """Remove invalid UTF-8 byte sequences (``bytes.decode('utf-8', 'ignore')``)."""
    return F.when(F.is_valid_utf8(c), c).otherwise(F.replace(F.make_valid_utf8(c), F.lit("\ufffd"), F.lit("")))


CONFIG_SCHEMA = T.StructType([T.StructField("feeds", T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("url", T.StringType())])))])


def read_feed_registry(spark: SparkSession, path: str,
                       default_feeds: list[dict] | None = None) -> DataFrame:
    """Config JSON ``{"feeds": [{"name":..,"url":..}, ...]}`` -> registry (SRC-3, FIL-1).

    Missing names become ``RSS``; entries without url are skipped; the list
    position is kept as ``registry_pos`` (feeds are processed in that order).
    A missing config file falls back to ``default_feeds`` (the built-in list);
    a config without ``feeds`` has no feeds (the file replaces the defaults).
    """
    from pyspark.errors import AnalysisException
    try:
        cfg = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path)
        cfg.limit(1).count()  # surfaces a missing path now, not at the first action downstream
    except AnalysisException:
        cfg = spark.createDataFrame([((default_feeds or []),)], CONFIG_SCHEMA)
    return registry_from_feeds(cfg.select(F.posexplode("feeds").alias("registry_pos", "f")))


def registry_from_config_text(config: DataFrame, col: str = "value") -> DataFrame:
    """Registry from config documents held as JSON text (one document per row)."""
    cfg = config.select(F.from_json(F.col(col), CONFIG_SCHEMA).alias("c"))
    return registry_from_feeds(cfg.select(F.posexplode("c.feeds").alias("registry_pos", "f")))


def registry_from_feeds(exploded: DataFrame) -> DataFrame:
    f = F.col("f")
    return (exploded.where(F.coalesce(f["url"], F.lit("")) != "")
            .select(F.col("registry_pos").cast("int").alias("registry_pos"),
                    F.coalesce(f["name"], F.lit(DEFAULT_FEED_NAME)).alias("name"), f["url"].alias("url")))


def attach_feed(payloads: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach ``feed_name``/``registry_pos`` to payloads by url (JOIN-2).

    The registry (one row per configured feed) is broadcast after a size
    check; payloads of unregistered urls keep an empty feed name.
    """
    reg = registry.select(F.col("url"), F.col("name").alias("feed_name"), "registry_pos")
    return (payloads.join(broadcast_if_small(reg), "url", "left")
            .withColumn("feed_name", F.coalesce("feed_name", F.lit(""))))


def select_sources(payloads: DataFrame, papers: bool = True, feeds: bool = True,
                   web: bool = False) -> DataFrame:
    """Keep payload kinds of the enabled sources (FIL-2); pushed to the scan."""
    kinds = [k for k, on in (("arxiv", papers), ("feed", feeds), ("serp", web)) if on]
    return payloads.where(F.col("kind").isin(kinds))


def read_file_inventory(spark: SparkSession, path: str, glob: str | None = None,
                        recursive: bool = False) -> DataFrame:
    """File listing ``(path, modificationTime, length)`` (SRC-5/6).

    ``binaryFile`` with only metadata columns selected: file contents are
    pruned from the scan and never read.
    """
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    with few_listing_tasks(spark):
        return r.load(path).select("path", "modificationTime", "length")


def read_digests(spark: SparkSession, path: str, date_col: str = "digest_date") -> DataFrame:
    """Written digests as (digest_key, md): a day's files in name order, without the last line end.

    One string per digest, for readers that want it whole; the files themselves need no such step.
    """
    with few_listing_tasks(spark):
        files = spark.read.format("text").option("wholetext", True).load(path)
    return (files.groupBy(F.col(date_col).cast("string").alias("digest_key"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_metadata.file_name").alias("name"), "value"))).alias("files"))
            .select("digest_key", F.regexp_replace(F.array_join(F.transform("files", lambda f: f["value"]), ""), r"\n\z", "").alias("md")))


def file_path_as_listed(metadata_path: str = "_metadata.file_path"):
    """A scan's file path in the spelling of a file inventory (not URL-encoded)."""
    return F.url_decode(F.replace(F.col(metadata_path), F.lit("+"), F.lit("%2B")))


def read_report_lines(spark: SparkSession, path: str, glob: str = "cycle_report_*.txt") -> DataFrame:
    """Report text lines with file path, file mtime and line number (SRC-7).

    A large report is read by many tasks: lines are counted per split, and a line's number is the
    count of the splits before it plus its place in its own. That table has one row per split. Breaks
    that only ``str.splitlines`` knows (form feed, U+2028, ...) cut a line further; splits that have
    some are numbered by a window over the split, all others without an exchange of lines. One case
    cannot be seen line by line: such a break at the very end of a file counts an empty line after it.
    """
    source = spark.read.format("text").option("pathGlobFilter", glob).load(path)
    lines = (source.select(file_path_as_listed().alias("path"), F.col("_metadata.file_modification_time").alias("mtime"),
                           F.col("_metadata.file_block_start").alias("split"), drop_invalid_utf8(F.col("value")).alias("line"))
             .withColumn("_i", F.monotonically_increasing_id()))
    # a line of the file as its parts; the line end that the reader took off is put back first
    parts = F.when(F.col("line").rlike(RARE_BREAKS), split_lines(F.concat("line", F.lit("\n")))).otherwise(F.array("line"))
    splits = lines.groupBy("path", "split").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size(parts)).alias("_total"), F.min("_i").alias("_first"))
    upto = Window.partitionBy("path").orderBy("split")
    splits = splits.select("path", "split", "_n", "_total", "_first", (F.sum("_total").over(upto) - F.col("_total")).alias("_before"))
    bound = len(source.inputFiles()) + source._jdf.queryExecution().toRdd().getNumPartitions()  # splits there can be
    placed = lines.join(F.broadcast(splits) if bound <= BROADCAST_MAX_ROWS else splits, ["path", "split"])
    plain = placed.where("_n = _total").select("path", "mtime", (F.col("_before") + F.col("_i") - F.col("_first")).alias("line_no"), "line")
    inside = Window.partitionBy("path", "split").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    cut = (placed.where("_n < _total").withColumn("_parts", parts)
           .withColumn("_at", F.col("_before") + F.coalesce(F.sum(F.size("_parts")).over(inside), F.lit(0)))
           .select("path", "mtime", "_at", F.posexplode("_parts").alias("_k", "line"))
           .select("path", "mtime", (F.col("_at") + F.col("_k")).alias("line_no"), "line"))
    return plain.unionByName(cut).withColumn("line_no", F.col("line_no").cast("bigint"))


def completions_from_json(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Chat responses ``{"message": {"content": ...}}`` -> ``response`` (SRC-8, JSON-1)."""
    return df.select("item_kind", "item_id", json_get(F.col(body_col), "$.message.content", "").alias("response"))


def read_completions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with ``item_kind``, ``item_id`` and the raw chat ``body``."""
    s = T.StructType([T.StructField("item_kind", T.StringType()), T.StructField("item_id", T.StringType()),
                      T.StructField("body", T.StringType())])
    return completions_from_json(spark.read.schema(s).json(path))


def read_scorecards(spark: SparkSession, path: str) -> DataFrame:
    """Health reports (one JSON document per file) -> ``(path, score)`` (SRC-9).

    A missing report is not an error: the result is empty. A report without
    ``score`` counts as 0.
    """
    from pyspark.errors import AnalysisException
    s = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("grade", T.StringType())])
    try:
        df = spark.read.schema(s).option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], "path string, score double")
    return df.select(F.col("_metadata.file_path").alias("path"), F.coalesce("score", F.lit(0.0)).alias("score"))


SEARCH_HITS = T.StructType([
    T.StructField("payload_id", T.StringType()), T.StructField("fetched_at", T.TimestampType()), T.StructField("pos", T.IntegerType()),
    T.StructField("title", T.StringType()), T.StructField("href", T.StringType()), T.StructField("body", T.StringType())])


def read_search_hits(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of structured hits with the id, the fetch time and the place of their response (SRC-10)."""
    return normalize_search_hits(spark.read.schema(SEARCH_HITS).json(path))


def normalize_search_hits(hits: DataFrame) -> DataFrame:
    """Structured search hits -> ``web_results`` columns (SRC-10).

    ``payload_id``, ``fetched_at`` and ``pos`` pass through where the hits have them: such
    rows enter a digest like the hits of a search page.
    """
    keep = [c for c in ("payload_id", "fetched_at", "pos") if c in hits.columns]
    return hits.select(
        *keep,
        F.coalesce(F.col("title"), F.lit(UNTITLED_HIT)).alias("title"),
        F.coalesce(F.col("href"), F.lit("")).alias("href"),
        F.coalesce(F.col("body"), F.lit("")).alias("body"),
        F.lit("web").alias("source"),
    )
