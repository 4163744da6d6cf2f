"""Structured Streaming over event files: keyed dedup under a watermark, and windowed counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.telemetry import topic_of


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """The directory's Parquet files as a stream; the schema is read from the table itself."""
    base, name = path.rsplit("/", 1)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{base}/{name}" if not name.endswith(".parquet") else f"{base}/{name}*")


def dedup(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """The first row of each key within the watermark's delay; it must cover the input's disorder."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run the stream over all that is there now into Parquet under ``folder``, and read it."""
    spark, run = stream.sparkSession, uuid.uuid4().hex
    out = f"{folder}/stream-{run}"
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/stream-{run}-checkpoint").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def hourly(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def to_bronze(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Events as they come into Parquet by day; a restart goes on where the checkpoint stands."""
    rows = stream.withColumn("event_date", F.to_date("ts"))
    return rows.writeStream.format("parquet").partitionBy("event_date").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)


def kafka_rows(stream: DataFrame) -> DataFrame:
    """``(key, value, topic)``: events keyed by call, each to the topic of its type."""
    return stream.select(F.col("user_id").cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), topic_of(F.col("event_type")).alias("topic"))


def to_kafka(stream: DataFrame, servers: str, checkpoint: str):
    """Needs Spark's Kafka connector on the class path."""
    return kafka_rows(stream).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint).start()
