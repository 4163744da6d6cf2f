"""Review of a phrase bank by people, as a table of decisions that is only added to.

``bank``: id, task, label, text, status. ``decisions``: id, at, reviewer, decision (approve, reject, edit, skip), text (of an
edit). The latest decision of an id counts, so a review can stop anywhere, go on later, and be taken back; nothing
that was decided is overwritten. ``publish_reviewed`` makes a new version of the bank of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from . import phrases

DECISIONS = "id string, at timestamp, reviewer string, decision string, text string"


def decide(decisions: DataFrame, path: str) -> None:
    """Add decisions to those there are."""
    decisions.select("id", "at", "reviewer", "decision", "text").write.mode("append").parquet(path)


def decided(spark: SparkSession, path: str) -> DataFrame:
    """The decisions so far; none before the first."""
    fs, at = sinks._fs(spark, path)
    return spark.read.schema(DECISIONS).parquet(path) if fs.exists(at) else spark.createDataFrame([], DECISIONS)


def reviewed(bank: DataFrame, decisions: DataFrame) -> DataFrame:
    """``bank`` after review, with ``original_text``, ``reviewed_by`` and ``reviewed_at``.

    Skips, unknown decisions, decisions on ids that the bank lacks and edits whose text the filter rejects change nothing. Of
    decisions at one time the larger by reviewer, decision and text counts. An edit approves its text; the bank's own is kept beside it.
    """
    told = bank.select("id", "task").join(decisions, "id").withColumn("text", phrases.clean(F.col("text")))
    counts = F.col("decision").isin("approve", "reject") | ((F.col("decision") == "edit") & F.col("text").isNotNull() & phrases.reject_reason(F.col("task"), F.col("text")).isNull())
    last = told.where(counts & F.col("at").isNotNull()).groupBy("id").agg(F.max(F.struct("at", "reviewer", "decision", "text")).alias("d"))
    rows = bank.join(last, "id", "left")
    edited = F.col("d.decision") == "edit"
    status = F.when(F.col("d.decision") == "reject", "rejected").when(F.col("d").isNotNull(), "approved").otherwise(F.col("status"))
    return rows.select(
        *(F.when(edited, F.col("d.text")).otherwise(F.col("text")).alias(c) if c == "text" else status.alias(c) if c == "status" else c for c in bank.columns),
        F.when(edited, F.col("text")).alias("original_text"), F.col("d.reviewer").alias("reviewed_by"), F.col("d.at").alias("reviewed_at"),
    )


def pending(bank: DataFrame, decisions: DataFrame) -> DataFrame:
    """What is still to be reviewed."""
    return reviewed(bank, decisions).where("status = 'pending'").select(bank.columns)


def publish_reviewed(bank: DataFrame, decisions: DataFrame, path: str) -> str:
    """A new version of the bank, whole or not at all; readers of the old one go on."""
    return sinks.publish(reviewed(bank, decisions), path, manifest={"decisions": decisions.count()})
