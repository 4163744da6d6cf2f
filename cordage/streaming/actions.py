"""Writes to contacts that a replayed batch does not repeat.

Actions go to a log with a folder a batch: writing a batch again replaces its folder, so a batch that Spark runs
twice counts once, and a write costs the batch, not the store. Contacts are read as the published base with the log behind it. ``compact``
publishes a new base together with the number of the last batch in it, by one pointer; batches up to that number are ignored from then
on, also when they are replayed later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks

ACTIONS = "call long, at timestamp, tool string, field string, value string, contact string"
BASE = "contact string, field string, value string, value_at struct<at: timestamp, call: long>, validated boolean, last_at struct<at: timestamp, call: long>"


def through(spark: SparkSession, path: str) -> int:
    """The last batch that the base holds; -1 without a base."""
    return sinks.published_manifest(spark, f"{path}/base").get("through", -1) if sinks.is_published(spark, f"{path}/base") else -1


def append(actions: DataFrame, batch: int, path: str) -> bool:
    """Write a batch's actions (``ACTIONS``) to the log, in place of what is there of it; False if the base has it already."""
    if batch <= through(actions.sparkSession, path):
        return False
    actions.select([x.split()[0] for x in ACTIONS.split(", ")]).write.mode("overwrite").parquet(f"{path}/log/batch={batch}")
    return True


def _folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Batches whose folder was written to the end."""
    fs, log = sinks._fs(spark, f"{path}/log")
    found = fs.listStatus(log) if fs.exists(log) else []
    names = [s.getPath().getName() for s in found if s.getPath().getName().startswith("batch=")]
    return sorted((int(n[6:]), f"{path}/log/{n}") for n in names if fs.exists(sinks._fs(spark, f"{path}/log/{n}/_SUCCESS")[1]))


def _latest(rows: DataFrame) -> DataFrame:
    last = lambda c, by: F.max_by(c, by).alias(c)
    return rows.groupBy("contact", "field").agg(last("value", "value_at"), F.max("value_at").alias("value_at"), last("validated", "last_at"), F.max("last_at").alias("last_at"))


def _as_rows(actions: DataFrame) -> DataFrame:
    at, wrote = F.struct("at", "call"), F.col("tool") == "update_contact"
    return actions.where("contact is not null and field is not null").select("contact", "field", F.when(wrote, F.col("value")).alias("value"), F.when(wrote, at).alias("value_at"), wrote.alias("validated"), at.alias("last_at"))


def contacts_of(actions: DataFrame) -> DataFrame:
    """``(contact, field, value, validated)``: the last value that was confirmed, and whether the last action confirmed one.

    A field that is only marked for review keeps the value it has. Of actions at one time the one of the largest call wins.
    """
    return _latest(_as_rows(actions)).select("contact", "field", "value", "validated")


def _state(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    done = through(spark, path)
    folders = [(b, p) for b, p in _folders(spark, path) if b > done]
    rows = sinks.read_published(spark, f"{path}/base") if done >= 0 else spark.createDataFrame([], BASE)
    if folders:
        rows = rows.unionByName(_as_rows(spark.read.schema(ACTIONS).parquet(*(p for _, p in folders))))
    return _latest(rows), max([done, *(b for b, _ in folders)])


def contacts(spark: SparkSession, path: str) -> DataFrame:
    """What base and log give now, as ``contacts_of`` has it."""
    return _state(spark, path)[0].select("contact", "field", "value", "validated")


def compact(spark: SparkSession, path: str) -> int:
    """Publish a base of all complete batches and drop their folders; gives the last batch in it."""
    rows, last = _state(spark, path)
    if last > through(spark, path):
        sinks.publish(rows, f"{path}/base", manifest={"through": last})
    for batch, folder in _folders(spark, path):
        if batch <= last:
            fs, at = sinks._fs(spark, folder)
            fs.delete(at, True)
    return last


def writer(path: str, contact: Column):
    """For ``foreachBatch`` of ``ordered_calls``: each batch's actions to the log."""

    def write(moved: DataFrame, batch: int) -> None:
        rows = moved.select("call", F.explode("actions").alias("a")).select("call", "a.*").withColumn("contact", contact.cast("string"))
        append(rows, batch, path)

    return write
