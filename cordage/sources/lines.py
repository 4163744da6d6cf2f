"""JSON lines whose rows know where they stand: ``file:line``, counted as Python's ``splitlines`` counts.

Files are read in splits. A split's lines are numbered as they stream by, a batch at a time, and how many lines the
splits before it have is a sum over one row a split, so nothing but those rows is shuffled, whatever a file's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .tables import CORRUPT

#: Ends of a line beside those that the text source knows (line feed, carriage return and both).
BREAKS = "[\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
SPLIT = ["_path", "_block"]


class BadRows(ValueError):
    """Rows that must not go on; the message counts them and shows the first."""


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value)``: every line of the files, blank ones too, with the file's name and the line's number from 1."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.split("value", BREAKS, -1).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            paths, blocks = b.column(0), b.column(1).to_numpy()
            sizes = pc.list_value_length(b.column(2)).to_numpy()
            new = np.ones(b.num_rows, bool)
            new[1:] = (blocks[1:] != blocks[:-1]) | pc.not_equal(paths[1:], paths[:-1]).to_numpy(zero_copy_only=False)
            new[0] = (paths[0].as_py(), int(blocks[0])) != last
            before = np.cumsum(sizes) - sizes + (0 if new[0] else count)
            since = np.maximum.accumulate(np.where(new, np.arange(b.num_rows), -1))
            before = before - np.where(since >= 0, before[np.maximum(since, 0)], 0)
            last, count = (paths[-1].as_py(), int(blocks[-1])), int(before[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before.astype(np.int64))], [*b.schema.names, "_before"])

    inside = read.mapInArrow(run, "_path string, _block long, pieces array<string>, _before long")
    splits = read.groupBy(*SPLIT).agg(F.sum(F.size("pieces")).alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = inside.join(splits.select(*SPLIT, above.alias("_above")), SPLIT).select("_path", (F.col("_above") + F.col("_before")).alias("_first"), F.posexplode("pieces").alias("_at", "value"))
    return rows.select(F.element_at(F.split("_path", "/"), -1).alias("file"), (F.col("_first") + F.col("_at") + 1).alias("line"), "value")


def read_where(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of JSON lines with ``_where`` (``file:line``); a line that can't be read has its text in ``_corrupt``, blank lines are no rows."""
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    lines = numbered(spark, path).where(F.trim(F.regexp_replace("value", r"(?U)\s+", " ")) != "")
    return lines.select(F.from_json("value", full, {"columnNameOfCorruptRecord": CORRUPT}).alias("r"), F.concat_ws(":", "file", F.col("line").cast("string")).alias("_where")).select("r.*", "_where")


def read_split(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows of a split's ``*.jsonl`` files; a split without any is an error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.jsonl")
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    rows = read_where(spark, f"{folder}/*.jsonl", schema) if there else None
    if rows is None or rows.isEmpty():
        raise BadRows(f"{folder} has no *.jsonl rows")
    return rows


def all_or_nothing(rows: DataFrame, reason: Column, where: str = "_where", shown: int = 3) -> DataFrame:
    """``rows``, if none of them has a ``reason``; else an error with their number and the first ones, by file and line."""
    bad = rows.select(F.col(where).alias("w"), reason.cast("string").alias("r")).where("r is not null")
    n = bad.count()
    if n:
        place = [F.regexp_extract("w", "^(.*):", 1), F.regexp_extract("w", r":(\d+)$", 1).try_cast("long")]
        first = bad.orderBy(*place, "w", "r").limit(shown).collect()
        raise BadRows(f"{n} invalid rows: " + "; ".join(f"{b['w']}: {b['r']}" for b in first))
    return rows
