"""Scans: Parquet tables by name, and JSON lines with an explicit schema that keep what they can't read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt by ``by`` over all cores, for work that costs much a row: a small file of many rows is read by one task."""
    spark = rows.sparkSession
    parts = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *by)


def json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of the schema; a malformed line is a row of nulls with its text in ``_corrupt``."""
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def settle(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the cluster's shared folder, by the values of a column if one is named, and read it again.

    What is made of it reads the columns and rows that it needs; a lost executor costs a reread. The files go with
    ``drop``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    (df.hint("rebalance", by).write.partitionBy(by) if by else df.write).parquet(path)
    target, system = _target(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path).select(df.columns)
    out._settled = path
    return out


def drop(*settled: DataFrame) -> None:
    """Delete the files behind tables that ``settle`` gave, when nothing is to be read of them any more."""
    for df in settled:
        target, system = _target(df.sparkSession, df._settled)
        system.delete(target, True)


def _target(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a temporary one only where one machine runs all."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def read_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of JSON lines with ``_file`` and, for those that can't be read, their text in ``_corrupt``; blank lines are no rows."""
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("_file"))
    return lines.select(F.from_json("value", full, {"columnNameOfCorruptRecord": CORRUPT}).alias("r"), "_file").select("r.*", "_file")


def line_counts(rows: DataFrame) -> DataFrame:
    """``(_file, lines, unreadable)`` of what ``read_lines`` gave."""
    return rows.groupBy("_file").agg(F.count("*").alias("lines"), F.count(CORRUPT).alias("unreadable"))


def read_splits(spark: SparkSession, folder: str, schema: StructType, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """The splits' files of a gold set as one table with ``split``; a split without a file has no rows."""
    rows = read_lines(spark, f"{folder}/{{{','.join(splits)}}}.jsonl", schema) if any_file(spark, folder, splits) else spark.createDataFrame([], StructType([*schema.fields, StructField(CORRUPT, StringType()), StructField("_file", StringType())]))
    return rows.withColumn("split", F.regexp_extract("_file", r"([^/]+)\.jsonl$", 1))


def any_file(spark: SparkSession, folder: str, names: tuple[str, ...]) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{{{','.join(names)}}}.jsonl")
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def read_bank(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A bank's rows; a bank that is not there yet is empty."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path, with their sizes; their contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listing.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def intact(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Sources whose every listed file is there with its size. ``manifest(source, name, bytes)``, ``listing(name, bytes)``."""
    found = manifest.join(listing.select("name", "bytes", F.lit(1).alias("hit")).distinct(), ["name", "bytes"], "left")
    return found.groupBy("source").agg(F.count("*").alias("files"), (F.count("hit") == F.count("*")).alias("intact"))
