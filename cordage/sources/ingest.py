"""Bringing pinned sources into an append-only store of files: ``<bronze>/<name>/ingest_date=<day>/{files,manifest}``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INSIDE = r"(?:/ingest_date=[^/]*|/\.staging/[0-9a-f]+)/files/(.*)$"  # a file's path below its partition
SPEC = "name string, kind string, url string, sha256 string, repo_id string, revision string, license string, purpose string, verified boolean"


def source_problems(specs: DataFrame) -> DataFrame:
    """``(name, problem)``: everything wrong with each spec (columns as in ``SPEC``); specs without problems give no row."""
    lacks = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    unlike = lambda c, p: ~F.coalesce(F.col(c), F.lit("")).rlike(p)
    url, hub = F.col("kind").eqNullSafe("url"), F.col("kind").eqNullSafe("hf_dataset")
    found = F.array(
        F.when(unlike("name", r"^[a-z0-9_]+\z"), "name"), F.when(~url & ~hub, "kind"), F.when(url & lacks("url"), "url"),
        F.when(url & unlike("sha256", r"^[0-9a-f]{64}\z"), "sha256"), F.when(hub & lacks("repo_id"), "repo_id"), F.when(hub & unlike("revision", r"^[0-9a-f]{40}\z"), "revision"),
        F.when(lacks("license"), "license"), F.when(lacks("purpose"), "purpose"), F.when(F.col("verified").isNull(), "verified"),
    )
    return specs.select("name", F.explode(F.array_compact(found)).alias("problem"))


def checked(specs: DataFrame) -> DataFrame:
    """``specs`` with their ``pin``; one error names every problem (specs are settings, so they are few)."""
    wrong = source_problems(specs).orderBy("name", "problem").collect()
    if wrong:
        raise ValueError("invalid sources: " + ", ".join(f"{r['name']}: {r['problem']}" for r in wrong))
    return specs.withColumn("pin", F.when(F.col("kind") == "url", F.col("sha256")).otherwise(F.col("revision")))


def verified(specs: DataFrame) -> DataFrame:
    """The checked sources whose licence a person has verified; only these are to be ingested (see ``unverified``)."""
    return checked(specs).where("verified")


def unverified(specs: DataFrame) -> DataFrame:
    """``(name, license)`` of the checked sources that ``verified`` leaves out, to be reported."""
    return checked(specs).where("not verified").select("name", "license")


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, bytes, sha256)`` of all files below a partition's folder ``files``, hashed by the executors (a file: up to 2 GB)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.regexp_extract("path", INSIDE, 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def find_existing(spark: SparkSession, name: str, pin: str, bronze: str) -> str | None:
    """The first partition of this pin whose every file is there with its size (contents are hashed at ingest only)."""
    fs, glob = _fs(spark, f"{bronze}/{name}/ingest_date=*/manifest")
    for status in sorted(fs.globStatus(glob) or [], key=lambda s: s.getPath().toString()):
        folder = status.getPath().getParent().toString()
        manifest = spark.read.schema("pin string, file string, bytes long, sha256 string").json(f"{folder}/manifest").where(F.col("pin") == pin)
        there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/files")
        there = there.select(F.regexp_extract("path", INSIDE, 1).alias("file"), F.col("length").alias("bytes"), F.lit(1).alias("hit"))
        state = manifest.join(there, ["file", "bytes"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
        if state["n"] and state["n"] == state["hits"]:
            return folder
    return None


def ingest(spark: SparkSession, source: dict, bronze: str, day: str, fetch: Callable[[dict, str], None]) -> str:
    """The partition that holds the source: the one there was, or a new one that ``fetch(source, folder)`` filled.

    A source without a verified licence is refused; a day that holds another pin is never overwritten; a failed fetch or a wrong
    checksum leaves nothing. ``source`` has the columns of ``SPEC`` and its ``pin``.
    """
    if not source["verified"]:
        raise PermissionError(f"{source['name']}: its licence is not verified")
    if old := find_existing(spark, source["name"], source["pin"], bronze):
        return old
    fs, target = _fs(spark, f"{bronze}/{source['name']}/ingest_date={day}")
    if fs.exists(target):
        raise FileExistsError(f"{target} holds another pin")
    _, beside = _fs(spark, f"{bronze}/.staging/{uuid.uuid4().hex}")
    try:
        fs.mkdirs(_fs(spark, f"{beside}/files")[1])
        fetch(source, f"{beside}/files")
        found = contents(spark, f"{beside}/files").select(F.lit(source["pin"]).alias("pin"), F.lit(source["license"]).alias("license"), "*")
        found.coalesce(1).write.json(f"{beside}/manifest")
        seen = spark.read.schema("file string, sha256 string").json(f"{beside}/manifest").agg(F.count("*").alias("n"), F.max("sha256").alias("sha256")).first()
        if not seen["n"]:
            raise RuntimeError(f"{source['name']}: no files")
        if source["kind"] == "url" and (seen["n"], seen["sha256"]) != (1, source["sha256"]):
            raise ValueError(f"{source['name']}: checksum differs")
        fs.mkdirs(target.getParent())
        if not fs.rename(beside, target):
            raise OSError(f"could not publish {target}")
    finally:
        fs.delete(beside, True)
    return fs.makeQualified(target).toString()
