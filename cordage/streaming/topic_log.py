"""An append-only log of topics in a shared folder, and a stream reader of it.

A log is a folder of appends, each a Spark job's Parquet: rows of ``ROW`` with the offset that each has in its topic's
partition, and the offsets at which the partitions then end, whose ``_SUCCESS`` makes the append count. Rows of a key are in one partition, in
the order of their times. One application appends at a time; an append that was not finished is removed by the next.

    spark.dataSource.register(TopicLog)
    spark.readStream.format("topic_log").option("topics", "calls.events").load(path)

The reader's offset is how many appends were read, so a stream that is started again goes on with the append after its last
batch's. A batch takes all appends that are there; a file is read by a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..sources.sinks import _fs
from ..sources.tables import drop, settle

ROW = "topic string, partition int, offset long, key string, value string, at timestamp"
PARTITIONS = 3


def append(rows: DataFrame, path: str, partitions: int = PARTITIONS) -> int:
    """Add ``(topic, key, value, at)`` rows to the log; the append's number.

    Rows are dealt by ranges of topic, partition and time, so a topic that holds most rows is written by many tasks; a row's
    offset is its place in its task's run plus the rows of the runs before it. A row without a key goes by its value.
    """
    spark = rows.sparkSession
    n = _appends(spark, path)
    fs, torn = _fs(spark, _name(path, n))
    fs.delete(torn, True)
    order = ["topic", "partition", "at", "key", "value"]
    part = F.pmod(F.xxhash64(F.coalesce("key", "value")), F.lit(partitions)).cast("int")
    dealt = rows.select("topic", part.alias("partition"), F.col("key").cast("string").alias("key"), "value", F.col("at").cast("timestamp").alias("at")).where("topic is not null")
    dealt = settle(dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    runs = dealt.groupBy("topic", "partition", "_task").agg(F.count("*").alias("n"), F.min("_row").alias("_low"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("topic", "partition").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ended = ends(spark, path, n)
    runs = runs.withColumn("_before", before).join(ended, ["topic", "partition"], "left").select("topic", "partition", "_task", "n", (F.col("_before") + F.coalesce("end", F.lit(0)) - F.col("_low")).alias("_shift"))
    runs = settle(runs)
    out = dealt.join(runs.drop("n"), ["topic", "partition", "_task"]).select("topic", "partition", (F.col("_row") + F.col("_shift")).alias("offset"), "key", "value", "at")
    out.write.parquet(f"{_name(path, n)}/rows")
    now = ended.unionByName(runs.select("topic", "partition", F.col("n").alias("end"))).groupBy("topic", "partition").agg(F.sum("end").alias("end"))
    now.coalesce(1).write.parquet(f"{_name(path, n)}/ends")  # a row a topic's partition
    drop(dealt, runs)
    return n


def ends(spark: SparkSession, path: str, appends: int | None = None) -> DataFrame:
    """``(topic, partition, end)``: the next offset of each partition after the first ``appends``, by default all."""
    n, kind = _appends(spark, path) if appends is None else appends, "topic string, partition int, end long"
    return spark.read.schema(kind).parquet(f"{_name(path, n - 1)}/ends") if n else spark.createDataFrame([], kind)


def _name(path: str, n: int) -> str:
    return f"{path}/append={n:010d}"


def _appends(spark: SparkSession, path: str) -> int:
    fs, done = _fs(spark, f"{path}/append=*/ends/_SUCCESS")
    return len(fs.globStatus(done) or [])


@dataclass
class _File(InputPartition):
    uri: str


class _Appends:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict):
        self.path, self.seen = options["path"].rstrip("/"), 0
        self.topics = [t for t in options.get("topics", "").split(",") if t]

    def count(self) -> int:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        while fs.get_file_info(f"{_name(root, self.seen)}/ends/_SUCCESS").type == pyarrow.fs.FileType.File:
            self.seen += 1
        return self.seen

    def files(self, start: int, end: int) -> list[_File]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        listed = (f for n in range(start, end) for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{_name(root, n)}/rows")))
        base = self.path.removesuffix(root) if self.path.endswith(root) else ""
        return [_File(base + f.path) for f in sorted(listed, key=lambda f: f.path) if f.path.endswith(".parquet")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        fs, name = pyarrow.fs.FileSystem.from_uri(partition.uri)
        fields = [("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("key", pa.string()), ("value", pa.string()), ("at", pa.timestamp("us", "UTC"))]
        with fs.open_input_file(name) as f:
            for b in pq.ParquetFile(f).iter_batches(10_000, columns=[n for n, _ in fields]):
                if self.topics:
                    b = b.filter(pc.is_in(b.column("topic"), pa.array(self.topics)))
                yield pa.RecordBatch.from_arrays([b.column(n).cast(t, safe=False) for n, t in fields], [n for n, _ in fields])


class _Stream(_Appends, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"appends": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"appends": self.count()}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return self.files(start["appends"], end["appends"])


class _Batch(_Appends, DataSourceReader):
    def partitions(self) -> list[_File]:
        return self.files(0, self.count()) or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.uri else iter(())


class TopicLog(DataSource):
    """``format("topic_log")``, as a table or a stream; option ``topics``: names with commas between, by default all."""

    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)
