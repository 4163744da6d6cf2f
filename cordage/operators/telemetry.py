"""Events to silver, star schema and KPIs. ``events``: event_id, ts, user_id, event_type, value, props.

A user stands for a call, the event type for its discriminator, value for a latency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle

E2E_BUDGET, LLM_BUDGET = 80.0, 50.0
ACCURACY = 1_000_000


def flatten(events: DataFrame) -> DataFrame:
    """Valid rows with their payload's fields; a payload that can't be read is null."""
    parsed = F.from_json("props", "k BIGINT")
    valid = events.where("event_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL")
    return valid.select("event_id", "user_id", "event_type", "ts", "value", parsed["k"].alias("k"))


def dedup(events: DataFrame, keys: list, order: list) -> DataFrame:
    """One row for each key: the first by ``order``, in one shuffle with a partial aggregate."""
    first = F.min_by(F.struct(*events.columns), F.struct(*order))
    return events.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(keys))).agg(first.alias("r")).select("r.*")


def accounting(events: DataFrame, keys: list, order: list) -> DataFrame:
    """Rows read, invalid, duplicate and written."""
    valid = F.col("event_id").isNotNull() & F.col("event_type").isNotNull()
    total = events.agg(F.count("*").alias("rows_read"), F.count_if(~valid).alias("rows_invalid"))
    kept = dedup(events.where(valid), keys, order).agg(F.count("*").alias("rows_written"))
    both = total.join(kept)  # one row each
    return both.select("rows_read", "rows_invalid", (F.col("rows_read") - F.col("rows_invalid") - F.col("rows_written")).alias("rows_duplicate"), "rows_written")


def dim_call(events: DataFrame) -> DataFrame:
    """A row per call: started ⟕ ended ⟕ counters, nulls of counters filled."""
    at = events.groupBy("user_id")
    started = at.agg(F.min("ts").alias("started_at"))
    ended = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("ended_at"), F.max_by("value", F.struct("ts", "event_id")).alias("outcome"))
    barge = events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("barge_ins"), F.sum((F.col("value") > E2E_BUDGET).cast("long")).alias("interruptions"))
    joined = started.join(ended, "user_id", "left").join(barge, "user_id", "left").fillna(0, ["barge_ins", "interruptions"])
    seconds = (F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")).alias("duration_s")
    return joined.select("user_id", "started_at", "ended_at", F.round("outcome", 4).alias("outcome"), "barge_ins", "interruptions", seconds, F.date_trunc("hour", "started_at").alias("started_hour"))


def kpi_hourly(events: DataFrame) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("started_hour")
    k = F.get_json_object("props", "$.k").cast("long")
    rate = F.round(F.avg((k >= 50).cast("double")), 6).alias("valid_rate")
    rest = events.groupBy(hour).agg(F.count("*").alias("turns"), F.percentile_approx("value", 0.5, ACCURACY).alias("value_p50"), F.percentile_approx("value", 0.95, ACCURACY).alias("value_p95"), rate)
    # calls are counted apart: beside a distinct count, Spark would keep and merge the percentiles' sketches for each call
    calls = events.groupBy(hour.alias("_hour")).agg(F.countDistinct("user_id").alias("calls"))
    return rest.join(calls, F.col("started_hour").eqNullSafe(F.col("_hour"))).select("started_hour", "calls", "turns", "value_p50", "value_p95", "valid_rate")


def kpi_by(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("turns"), F.percentile_approx("value", 0.5, ACCURACY).alias("value_p50"), F.percentile_approx("value", 0.95, ACCURACY).alias("value_p95"))


def summary(events: DataFrame) -> DataFrame:
    share = lambda t: F.round(F.try_divide(F.count_if(F.col("event_type") == t), F.count("*")), 6).alias(f"{t}_rate")
    ratio = F.round(F.try_divide(F.sum(F.when(F.col("event_type") == "error", F.col("value"))), F.sum("value")), 6).alias("error_value_share")
    rest = events.agg(F.count("*").alias("turns"), share("purchase"), share("error"), share("signup"), F.percentile_approx("value", 0.5, ACCURACY).alias("value_p50"), F.percentile_approx("value", 0.95, ACCURACY).alias("value_p95"), ratio)
    # calls are counted apart, as in ``kpi_hourly``
    calls = events.agg(F.countDistinct("user_id").alias("calls"))
    return rest.join(calls).select("turns", "calls", "purchase_rate", "error_rate", "signup_rate", "value_p50", "value_p95", "error_value_share")  # one row each


def sequence_numbers(events: DataFrame) -> DataFrame:
    """Place in the call, the call's running value, and whether the type changed."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        "event_id", (F.row_number().over(w) - 1).cast("long").alias("seq"),
        F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running_value"),
        F.coalesce(F.lag("event_type").over(w) != F.col("event_type"), F.lit(False)).alias("switched"),
    )


def topic_of(kind: Column) -> Column:
    # Types and their topics.
    return F.when(kind == "view", "calls.transcripts").when(kind == "click", "model.inferences").otherwise("calls.events")


def topic(events: DataFrame) -> DataFrame:
    return events.select(topic_of(F.col("event_type")).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


def turn_numbers(events: DataFrame, kind: str, key: list[str], order: list[str]) -> DataFrame:
    """``events`` with ``turn``: how many events of ``kind`` its call has had up to then."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("turn", F.sum((F.col("event_type") == kind).cast("long")).over(w))


def call_switches(events: DataFrame, call: str, order: list[str]) -> DataFrame:
    """``(switches)``: how often the next event in order belongs to another call.

    Range partitions are compared inside, and each one's first event with the last before it: a row a
    partition. An order that is not unique is settled by the call.
    """
    rows = settle(events.select(*order, F.col(call).alias("_c")).repartitionByRange(*order, "_c").withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part").orderBy(*order, "_c")
    inside = rows.withColumn("_hit", (F.lag("_c").over(w) != F.col("_c")).cast("long")).agg(F.coalesce(F.sum("_hit"), F.lit(0)).alias("n"))
    at = F.struct(*order, "_c")
    ends = rows.groupBy("_part").agg(F.min_by("_c", at).alias("first"), F.max_by("_c", at).alias("last"))
    over = Window.orderBy("_part")  # a row a partition
    between = ends.withColumn("_hit", (F.lag("last").over(over) != F.col("first")).cast("long")).agg(F.coalesce(F.sum("_hit"), F.lit(0)).alias("m"))
    return inside.join(between).select((F.col("n") + F.col("m")).alias("switches"))  # one row each


def upper_median(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """``(*keys, median, n)``: of n values in order the one at place n // 2, counted from 0; nulls don't count.

    A group without values has a null median. Values are counted by value before they meet, so repeats cost nothing.
    """
    middle = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")
    return rows.groupBy(*keys).agg(middle.alias("median"), F.count(value).alias("n"))
