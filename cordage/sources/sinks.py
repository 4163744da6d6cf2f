"""Sinks: partitioned Parquet, canonical JSON lines, documents, and publishing a whole dataset by a pointer."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Rows go together by the partition columns, which bounds the number of files; Spark splits values that hold very many."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_document(df: DataFrame, path: str) -> None:
    """The one row as one JSON document, keys in name order, nulls written out; anything but one row is an error."""
    n = df.limit(2).count()
    if n != 1:
        raise ValueError(f"a document is one row, not {'none' if not n else 'more'}")
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def canonical_json(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One line a row with the columns in name order, rows ordered by id: equal data, equal bytes."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.orderBy(id_col).select(line.alias("value"))


def write_chunked_json(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).json(path)


POINTER, KEEP, MANIFEST = "CURRENT", 2, "_manifest.json"


def digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(name, bytes, sha256)`` of the files below a folder, hashed by the executors (files of up to 2 GB each)."""
    root = _fs(spark, path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    inside = F.substring(F.col("path"), F.lit(len(root[0].makeQualified(root[1]).toString()) + 2), F.length("path"))
    return found.select(inside.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def inputs_digest(spark: SparkSession, path: str, glob: str = "*.jsonl") -> dict:
    """How many files there are below a folder, their bytes, and one digest over names and contents in name order.

    Equal names and bytes, equal digest, wherever they lie. A folder without such a file is an error.
    """
    each = digests(spark, path, glob)
    lines = F.array_sort(F.collect_list(F.concat("name", F.lit("\u0000"), "sha256")))
    r = each.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha256")).first()
    if not r["files"]:
        raise FileNotFoundError(f"{path} has no {glob} files")
    return r.asDict()


def content_digest(df: DataFrame) -> dict:
    """``rows`` and a digest that equal rows have in any order, number of files and partitioning."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    each = [F.conv(F.substring(F.sha2(line, 256), i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 16)]
    r = df.agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(x), F.lit(0)).alias(f"d{i}") for i, x in enumerate(each))).first()
    return {"rows": r["rows"], "content": hashlib.sha256(f"{r['rows']}:{r['d0']}:{r['d1']}".encode()).hexdigest()}


def publish(df: DataFrame, path: str, replace: bool = True, manifest: dict | None = None, inputs: str | None = None) -> str:
    """Write a new version beside the others, then point to it by one atomic rename.

    A reader (``read_published``) sees the old dataset or the whole new one, and a crash leaves the old one as it
    was. The last ``KEEP`` versions stay for readers that began before. Gives the version's folder.

    The version holds its manifest, so that the pointer publishes both: what ``manifest`` says, the rows and content's digest
    as read back from what was written, the digest of the ``inputs`` folder, and, in ``_files``, every file with its size and hash.
    """
    spark = df.sparkSession
    fs, pointer = _fs(spark, f"{path.rstrip('/')}/{POINTER}")
    if fs.exists(pointer) and not replace:
        raise FileExistsError(path)
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path.rstrip('/')}/{version}"
    df.write.parquet(folder)
    digests(spark, folder, "*.parquet").write.json(f"{folder}/_files")
    told = {"schema_version": 1, **(manifest or {}), **content_digest(spark.read.schema(df.schema).parquet(folder))}
    _write_text(spark, f"{folder}/{MANIFEST}", json.dumps(told | ({"inputs": inputs_digest(spark, inputs)} if inputs else {}), indent=2, ensure_ascii=False, sort_keys=True) + "\n")
    beside = _fs(spark, f"{path.rstrip('/')}/.{version}.pointer")[1]
    _write_text(spark, beside.toString(), version)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(beside), fs.makeQualified(pointer), how)
    old = sorted(s.getPath().getName() for s in fs.listStatus(pointer.getParent()) if s.getPath().getName().startswith("v-"))
    for name in old[:-KEEP]:
        fs.delete(_fs(spark, f"{path.rstrip('/')}/{name}")[1], True)
    return folder


def is_published(spark: SparkSession, path: str) -> bool:
    fs, pointer = _fs(spark, f"{path.rstrip('/')}/{POINTER}")
    return fs.exists(pointer)


def published_folder(spark: SparkSession, path: str) -> str:
    """The version that the pointer names now."""
    return f"{path.rstrip('/')}/{_read_text(spark, f'{path.rstrip("/")}/{POINTER}')}"


def read_published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(published_folder(spark, path))


def published_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of the version that the pointer names now; a version without one is an error."""
    return json.loads(_read_text(spark, f"{published_folder(spark, path)}/{MANIFEST}"))


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """``(name, problem)``: files of the published version that are gone, changed, or not in its manifest."""
    folder = published_folder(spark, path)
    listed = spark.read.schema("name string, bytes long, sha256 string").json(f"{folder}/_files").withColumnRenamed("sha256", "listed")
    both = listed.select("name", "listed").join(digests(spark, folder, "*.parquet").select("name", "sha256"), "name", "full")
    problem = F.when(F.col("sha256").isNull(), "gone").when(F.col("listed").isNull(), "unlisted").when(F.col("sha256") != F.col("listed"), "changed")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def _read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    text = bytes(stream.readAllBytes()).decode()
    stream.close()
    return text


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
