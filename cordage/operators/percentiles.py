"""Exact discrete percentiles of groups, whatever their size.

A sketch's rank may be off by its share of the rows, so its value differs from the exact one on large groups. Here values
are counted first; a group's distinct values are dealt to ranges, whose edges only set how evenly; counts of the ranges
tell in which one a rank falls, and only that one's values are summed up in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle

PARTS = 128  # ranges of a group's distinct values


def percentiles(rows: DataFrame, by: list[str], columns: list[str], ps: tuple[int, ...] = (50, 95)) -> DataFrame:
    """``by``, ``rows`` and for each column and p ``<column>_p<p>``: the least value that p hundredths of the column's values do not exceed.

    Null values are left out, a group without values has nulls; null keys are a group. ``rows`` counts the group's rows.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("v")) for c in columns)))
    told = rows.select(F.struct(F.lit(0).alias("_"), *by).alias("k"), each.alias("x")).select("k", "x.*")
    counts = settle(told.groupBy("k", "of", "v").agg(F.count("*").alias("n")))
    known, key = counts.where("v is not null"), ["k", "of"]
    edges = known.groupBy(*key).agg(F.sum("n").alias("total"), F.percentile_approx("v", [i / PARTS for i in range(1, PARTS)], 10 * PARTS).alias("edges"))
    known = known.join(edges, key).select(*key, "v", "n", "total", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("part"))
    sums = known.groupBy(*key, "total", "part").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("part")))
    want = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.expr(f"total - (total * {100 - p}) div 100").alias("rank")) for p in ps)))
    hit = sums.select("*", want.alias("w")).where("w.rank <= upto AND w.rank > upto - n").select(*key, "part", "w.p", (F.col("w.rank") - F.col("upto") + F.col("n")).alias("rank"))
    inside = known.join(hit, [*key, "part"]).withColumn("upto", F.sum("n").over(Window.partitionBy(*key, "p").orderBy("v")))
    found = inside.where("rank <= upto AND rank > upto - n").select("k", *(F.when((F.col("of") == c) & (F.col("p") == p), F.col("v")).alias(f"{c}_p{p}") for c in columns for p in ps))
    names = [f"{c}_p{p}" for c in columns for p in ps]
    size = counts.where(F.col("of") == columns[0]).groupBy("k").agg(F.sum("n").alias("rows"))
    values = found.groupBy("k").agg(*(F.max(c).alias(c) for c in names))
    return size.join(values, "k", "left").select(*(F.col(f"k.{c}").alias(c) for c in by), "rows", *names)
