"""Calls as sessions over streams: the start of a call meets its end and what happened between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL = ["call_id", "flow", "contact_id", "model_version", "prompt_hash", "synthetic", "started_at", "outcome", "turns", "ended_at"]


def stream_dim_call(events: DataFrame, longest: str, delay: str = "0 seconds") -> DataFrame:
    """A row for each started call, as ``warehouse.dim_call`` has it, written once when time has passed it.

    ``events`` are silver events as a stream, one of each id. Starts, ends and what is counted meet under one
    watermark: a call that has not ended ``longest`` after its start (an interval, such as ``30 minutes``) is given without an
    end, and its state goes. An event later than the watermark's ``delay``, or outside its call's interval, is not counted.
    """
    kind = dict(events.dtypes)["event_ts"]  # event time has a zone in Spark; what comes out is of the type that came in
    seen = events.withColumn("event_ts", F.col("event_ts").cast("timestamp")).where("call_id is not null and event_ts is not null").withWatermark("event_ts", delay)
    # a filter that looks at the event time stays behind the watermark, so that events of every type move time on
    of = lambda *types: seen.where(F.when(F.col("event_ts").isNotNull(), F.col("type")).isin(*types))
    started = of("call_started").select("call_id", "flow", "contact_id", "model_version", "prompt_hash", "synthetic", F.col("event_ts").alias("started_at"))
    ended = of("call_ended").select(F.col("call_id").alias("_call"), "outcome", "turns", F.col("event_ts").alias("ended_at"))
    inside = of("barge_in", "tool_invoked").select(F.col("call_id").alias("_call"), F.col("event_ts").alias("_at"), F.col("type").alias("_type"), "interrupted", "tool")
    within = lambda at: F.expr(f"call_id = _call AND {at} >= started_at AND {at} <= started_at + INTERVAL {longest}")
    calls = started.join(ended, within("ended_at"), "left").drop("_call")
    calls = calls.withColumn("ended_at", F.expr("ended_at + INTERVAL 0 seconds"))  # one event time goes on: the start
    told = calls.join(inside, within("_at"), "left").withColumn("_barge", F.col("_type") == "barge_in")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    per_call = told.groupBy(*CALL).agg(
        count(F.col("_barge"))("barge_ins"), count(F.col("_barge") & F.col("interrupted"))("interruptions"),
        count(F.col("tool") == "update_contact")("fields_validated"), count(F.col("tool") == "mark_unvalidated")("fields_unvalidated"),
    )
    took = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6
    told = per_call.withColumn("duration_s", took).withColumn("started_hour", F.date_trunc("hour", "started_at"))
    return told.withColumns({c: F.col(c).cast(kind) for c in ("started_at", "ended_at", "started_hour")})
