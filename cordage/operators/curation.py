"""Instruction pairs to replay examples: rows of one language without a reason to drop them, the first of each content.

``rows``: language, inputs, targets, and ``place`` (what order they were read in).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

OTHER_LANGUAGE, DUPLICATE, KEPT = "other_language", "duplicate", "kept"


def read_in_order(spark: SparkSession, *files: str) -> DataFrame:
    """Parquet files with ``place``: files by name, rows as they stand in them."""
    rows = spark.read.parquet(*sorted(files))
    return rows.withColumn("place", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def outcomes(rows: DataFrame, language: str, max_words: int) -> DataFrame:
    """``rows`` with ``key`` (digest of both normalised texts) and ``outcome``: other_language, a reason, duplicate or kept.

    Only rows without a reason compete for a key; the first by place wins. The winners' places are partial
    aggregates, joined back by key, so a content that very many rows hold is one row before the join.
    """
    pair = F.concat(T.normalize_text(F.coalesce("inputs", F.lit(""))), F.lit("\u0000"), T.normalize_text(F.coalesce("targets", F.lit(""))))
    reason = F.when(~F.col("language").eqNullSafe(language), OTHER_LANGUAGE).otherwise(T.drop_reason(max_words, F.col("inputs"), F.col("targets")))
    told = rows.withColumn("key", F.sha2(pair, 256)).withColumn("reason", reason)
    first = told.where("reason is null").groupBy("key").agg(F.min("place").alias("first"))
    told = told.join(first, "key", "left")
    return told.withColumn("outcome", F.coalesce("reason", F.when(F.col("place") == F.col("first"), KEPT).otherwise(DUPLICATE))).drop("reason", "first")


def counters(told: DataFrame) -> DataFrame:
    """``(name, n)``: rows read, rows in the language, and rows of each outcome."""
    by = told.groupBy("outcome").agg(F.count("*").alias("n"))
    names = F.array(F.lit("read"), F.when(F.col("outcome") != OTHER_LANGUAGE, "in_language"), F.when(F.col("outcome") != OTHER_LANGUAGE, F.col("outcome")))
    return by.select(F.explode(F.array_compact(names)).alias("name"), "n").groupBy("name").agg(F.sum("n").alias("n"))


def examples(told: DataFrame, prefix: str = "rep-") -> DataFrame:
    """The rows kept as training examples; ids are made of the content."""
    id_ = F.concat(F.lit(prefix), F.substring("key", 1, 12))
    text = lambda c: T.squeeze(F.coalesce(c, F.lit("")))
    return told.where(F.col("outcome") == KEPT).select(
        id_.alias("id"), id_.alias("group"), F.lit("replay").alias("task"), F.lit("replay").alias("source"),
        F.to_json(F.struct(text("inputs").alias("instruction"))).alias("input"), F.to_json(F.struct(text("targets").alias("response"))).alias("output"),
    )
