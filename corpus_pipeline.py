"""The corpus pipeline: documents in, token ids of a cleaned and mixed corpus out.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns the columns of ``documents`` (the last one: token ids). Between stages rows are
written as Parquet to the shared folder and read again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm import bpe, mixing, quality, suffix_dedup, vertical_join
from feedlake.llm.common import WORD, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ARROW_ROWS = 2000  # rows of a batch between the JVM and Python: some ten MB of texts at a time
REPEAT = 250  # bytes: about fifty words of short ones


def _bounded(spark: SparkSession) -> None:
    """Batches of few rows for the session: texts wait outside the heap on their way to and from Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; labels of ``sf_dir`` train it, held-out fold left out."""
    _bounded(spark)
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by five-word shingles at 0.8: the smallest (doc_id, set of shingles).

    Rows without id or words link with nothing and stay. Rows that share an id are told apart by
    their sets: unlike texts stay, of rows with one id and one set the least one stays.
    """
    _bounded(spark)
    docs = docs.select(*COLUMNS)
    found = vertical_join.jaccard_groups(docs, threshold=80, words=5).where("component is not null")
    rows = found.groupBy("doc_id").agg(F.count("*").alias("rows"))
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "cls")).alias("one"))
    stay = (first.select("one.doc_id", "one.cls").join(rows, "doc_id")
            .select(F.col("doc_id").alias("_id"), F.col("cls").alias("_cls"), F.col("rows").alias("_rows")))
    apart = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = docs.where(~apart).join(stay, F.col("doc_id") == F.col("_id"))
    again = (kept.where("_rows > 1").where(vertical_join.set_names(F.col("text"), 5) == F.col("_cls"))
             .groupBy("_id", "_cls").agg(F.min(F.struct(*COLUMNS)).alias("one")).select("one.*"))
    return kept.where("_rows = 1").select(*COLUMNS).unionByName(again).unionByName(docs.where(apart))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of ``REPEAT`` bytes that occur elsewhere; a document goes if nothing of it is left."""
    _bounded(spark)
    cut = suffix_dedup.dedup_suffixes(docs.select(*COLUMNS), length=REPEAT)
    text = F.when(F.size("spans") > 0, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col("text"))
    return (cut.where("size(spans) = 0 or octet_length(kept) > 0")
            .select("doc_id", text.alias("text"), "lang", "source",
                    F.when(F.size("spans") > 0, F.length(text)).otherwise(F.col("n_chars")).cast("long").alias("n_chars")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to the target weights; a document comes once per pass that takes it."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and the digests of a round trip."""
    import public_tokenizers

    _bounded(spark)
    coded = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(coded, "doc_id", "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", suffix_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", token_stage),
]

#: Training and byte-pair encoding have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
