"""Helpers that the training-data operators share: cutting lineage, folds, bit tables, components."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests), a folder of it is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Later steps read columns of that table, not the plan behind it, and a lost executor costs
    a reread. The files go with ``forget``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, system = _target(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def _target(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def forget(*tables: DataFrame) -> None:
    """Delete the files behind tables that ``cut`` gave, when all that is made of them is itself cut."""
    for df in tables:
        target, system = _target(df.sparkSession, df._cut)
        system.delete(target, True)


def releasing(run):
    """``run`` for ``mapInArrow``; when it ends, what Arrow's pool keeps goes back to the machine, as Python workers live on."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return tidy


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIN_BITS, MAX_BITS, PROBES = 1 << 20, 1 << 27, 4


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and step of each key, from the two halves of its mixed value: probe k is at first + k * step."""
    mixed = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    return (mixed >> np.uint64(32)).astype(np.int64), (mixed & np.uint64(0xFFFFFFFF)).astype(np.int64) | 1


class BitTable:
    """A Bloom filter over 64-bit keys; its size is set by their number, within ``MAX_BITS``.

    A wrong hit costs work, never a result. Beyond what MAX_BITS holds it fills up and lets more pass.
    """

    def __init__(self, expected: int):
        wanted = 1 << math.ceil(math.log2(max(1, expected) * 32))
        self.bits = min(MAX_BITS, max(MIN_BITS, wanted))
        self.table = np.zeros(self.bits // 8, np.uint8)

    def add(self, keys: np.ndarray) -> None:
        first, step = _places(keys)
        for k in range(PROBES):
            at = (first + k * step) & (self.bits - 1)
            np.bitwise_or.at(self.table, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        """For each key whether it may be in the table."""
        left, (first, step) = np.arange(len(keys)), _places(keys)
        for k in range(PROBES):
            at = (first[left] + k * step[left]) & (self.bits - 1)
            left = left[(self.table[at >> 3] >> (at & 7)) & 1 == 1]
            if not len(left):
                break
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out


def bit_table(keys: DataFrame, expected: int) -> BitTable:
    """The table of all ``keys`` (one long column): set in each task, joined by OR in small steps."""
    made = BitTable(expected)
    bits, size, slices = made.bits, made.bits // 8, max(1, made.bits // 8 >> 16)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BitTable.__new__(BitTable)
        own.bits, own.table = bits, np.zeros(size, np.uint8)
        for b in batches:
            own.add(b.column(0).to_numpy().view(np.uint64))
        at = np.flatnonzero(own.table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.table[at].astype(np.int32))], ["at", "bits"])

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        out = np.zeros(size // slices, np.uint8)
        out[rows.column("at").to_numpy() % len(out)] = rows.column("bits").to_numpy().astype(np.uint8)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    filled = keys.mapInArrow(releasing(fill), "at long, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    parts = filled.withColumn("slice", F.floor(F.col("at") / (size // slices)).cast("long")).groupBy("slice").applyInArrow(join, "slice long, bits binary").collect()
    for r in parts:  # MAX_BITS / 8 bytes at most
        made.table[r["slice"] * (size // slices) : (r["slice"] + 1) * (size // slices)] = np.frombuffer(r["bits"], np.uint8)
    return made


def may_hold(table: BitTable, key: Column) -> Column:
    """Whether a long key may be in the table (null: no)."""

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        return pd.Series(table.has(keys.to_numpy().view(np.uint64)))

    return key.isNotNull() & hit(F.coalesce(key, F.lit(0).cast("long")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if a column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def deal_blocks(rows: DataFrame, keys: list[str], spread: str, block: int) -> DataFrame:
    """``rows`` with ``own`` and ``pair``: groups of ``keys`` whose rows are to be compared all with all.

    A group of up to ``block`` rows is one pair. A larger one is dealt to blocks by a hash of
    ``spread``; every two blocks (and each with itself) make a pair, to which their rows go, so a
    task holds two blocks at a time whatever the group's size.
    """
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    rows = rows.join(large, keys, "left")
    blocks = F.when(F.col("_n").isNull(), F.lit(1)).otherwise(F.ceil(F.col("_n") * 2 / block)).cast("int")
    rows = rows.withColumn("_blocks", blocks).drop("_n")
    rows = rows.withColumn("own", F.pmod(F.xxhash64(spread), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pair = F.least("own", "_other").cast("long") * F.lit(1 << 31) + F.greatest("own", "_other")
    return rows.withColumn("pair", pair).drop("_blocks", "_other")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until nothing changes.
    Minima are partial aggregates and joined back, so that a node with very many neighbours
    is summed before the shuffle and its join can be split; each round is cut.
    """
    e = cut(_oriented(edges))
    state = _state(e)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        old, e = e, cut(_small_star(_large_star(e)))
        forget(old)
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
