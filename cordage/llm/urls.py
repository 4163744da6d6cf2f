"""URL filter: a sort-merge range join of urls with nested rules, in DataFrame functions only.

A rule has a host and a path and fits the host and its subdomains where the url's path starts with
the rule's. On canonical keys, the reversed host followed by the path, a rule is the interval of
keys that start with its own. A url of host a.b.c is one point for each of c, b.c and a.b.c that has
rules (a rule with a path is no single interval over a host's subdomains, but is over one host).

Sweep. Starts and ends of intervals and the points are sorted by key over range partitions. The
number of open intervals is a running sum; the interval opened last at the current depth is the top
of the stack there. Each partition is swept alone, and what lies open where it begins (depth and the
last start at each depth of the partitions before) is joined to it: two passes, no task sees all
rows. Equal urls are one point, so a host or url with a third of the pages is a row or a sorted run.

The longest rule wins (host and path together; then the longer host, then block). Urls that no rule
fits get ``default``.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule.
Without rules every url gets the default. Repeated pages are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

GAP = "\u0001"  # between host and path in a key; sorts before every character of a url
LAST = "\U0010ffff"  # after every key that goes on from a rule's


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def sweep(points: DataFrame, rules: DataFrame, partitions: int) -> DataFrame:
    """``(key, rule_id)``: for each of ``points(key)`` inside an interval, the innermost.

    ``rules(key, rule_id)``: intervals of the keys that start with ``key``, which is unique.
    """
    start = rules.select("key", F.lit(0).alias("order"), F.lit(1).alias("step"), "rule_id")
    stop = rules.select(F.concat("key", F.lit(LAST)).alias("key"), F.lit(2).alias("order"), F.lit(-1).alias("step"), F.lit(None).cast("long").alias("rule_id"))
    point = points.select("key", F.lit(1).alias("order"), F.lit(0).alias("step"), F.lit(None).cast("long").alias("rule_id"))
    events = start.unionByName(stop).unionByName(point).repartitionByRange(partitions, "key", "order")
    events = cut(events.withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("key", "order")
    depth = F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    local = events.withColumn("depth", depth)
    # what is open where a partition begins: a row for each partition, and for each partition and depth
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opened = events.groupBy("part").agg(F.sum("step").alias("net")).select("part", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("base"))
    local = local.join(opened, "part").withColumn("depth", F.col("depth") + F.col("base"))
    starts = local.where("step = 1").groupBy("part", "depth").agg(F.max_by("rule_id", "key").alias("last"))
    final = events.agg(F.max("part").alias("part")).first()["part"] or 0
    following = F.coalesce(F.lead("part").over(Window.partitionBy("depth").orderBy("part")), F.lit(final))
    starts = starts.withColumn("until", following).where("until > part")
    carried = starts.select("depth", F.col("last").alias("carried"), F.explode(F.sequence(F.col("part") + 1, F.col("until"))).alias("part"))
    level = Window.partitionBy("part", "depth").orderBy("key", "order").rowsBetween(Window.unboundedPreceding, 0)
    top = local.withColumn("own", F.last("rule_id", ignorenulls=True).over(level)).where("order = 1 and depth > 0")
    return top.join(carried, ["part", "depth"], "left").select("key", F.coalesce("own", "carried").alias("rule_id"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", partitions: int | None = None, id_col: str = "page_id") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per page; ``rules(action, host, path)``."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col(id_col), F.col("url").cast("string").alias("url")).select(id_col, host.alias("host"), path.alias("path"))
    # the same host and path twice: block stays
    known = rules.groupBy("host", "path").agg(F.min_by("action", F.when(F.col("action") == "block", 0).otherwise(1)).alias("action"))
    known = known.withColumn("key", F.concat(reversed_host(F.col("host")), F.lit(GAP), "path")).withColumn("rule_id", F.xxhash64("key"))
    known = cut(known)
    labels = F.split("host", r"\.", -1)
    size = F.size(labels)
    ancestors = F.transform(F.sequence(F.lit(1), size), lambda i: F.array_join(F.slice(labels, i, size - i + 1), "."))
    urls = parsed.where("host <> ''").groupBy("host", "path").agg(F.lit(1).alias("one")).drop("one")
    points = urls.select("host", "path", F.explode(ancestors).alias("at"))
    points = points.join(known.select(F.col("host").alias("at")).distinct(), "at", "left_semi")
    points = cut(points.select("host", "path", F.concat(reversed_host(F.col("at")), F.lit(GAP), "path").alias("key")))
    found = sweep(points.select("key").distinct(), known.select("key", "rule_id"), partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = found.join(known.select("rule_id", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action"), "rule_id")
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(rule), F.length("rule_host"), (F.col("action") == "block").cast("int"))
    best = points.join(named, "key").groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), "action"), rank).alias("best"))
    out = parsed.join(best, ["host", "path"], "left")
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
