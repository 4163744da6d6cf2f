"""Queries over call events that Spark makes from the given conversations, and the SQL that checks them.

Each turn of a conversation is told as the events of a call, in JSON lines: some are malformed, of another
schema version, without an id, or written twice. The SQL makes the same events without JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_millis
from ..operators import warehouse as W
from ..sources.tables import settle, spread, table
from .registry import query

START_MS = 1_709_251_200_000  # 2024-03-01, midnight UTC
# What a number picks.
INTENTS = ["confirmed", "cannot_attend", "out_of_scope", "call_rejected"]
OUTCOMES = ["completed", "partial", "rejected", "failed"]


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def call_lines(spark, d) -> DataFrame:
    """``value``: JSON lines of call events."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("person"), text.alias("text"), (F.col("conv_id") * 31 + F.col("turn") * 7 + F.length(text)).alias("n"))
    n, turn, call = F.col("n"), F.col("turn").cast("int").alias("turn_idx"), F.concat(F.lit("call-"), "conv_id")
    event = lambda kind, offset, *payload, k=0: F.struct(F.lit(kind).alias("type"), F.lit(offset).cast("long").alias("offset"), F.lit(k).cast("long").alias("k"), F.to_json(F.struct(*payload)).alias("payload"))
    ratio = lambda base, name: (n % base / base).alias(name)
    ms = lambda base, name: (n % base).cast("double").alias(name)
    output = F.struct(_pick(INTENTS, n).alias("intent"), ratio(64, "confidence")).alias("output")
    said = [
        event("turn_started", 0, turn, F.lit("person").alias("speaker")),
        event("asr_final", 1000, turn, "text", ratio(128, "asr_confidence")),
        F.when(n % 5 != 0, event("decision", 1030, turn, F.lit("classify_intent").alias("task"), output, ms(60, "latency_ms"))),
        F.when(n % 4 != 3, event("llm_response", 1300, turn, F.lit("extract_entity").alias("task"), F.lit(1).alias("prompt_version"), (n % 6 != 0).alias("json_valid"), ms(700, "latency_ms"))),
        event("latency", 1400, turn, ms(1200, "end_to_end_ms"), ms(200, "endpointing_ms")),
        F.when(n % 5 == 1, event("tool_invoked", 1500, turn, F.lit("update_contact").alias("tool"), F.lit("phone").alias("field"))),
        F.when(n % 10 == 1, event("tool_invoked", 1501, turn, F.lit("mark_unvalidated").alias("tool"), F.lit("email").alias("field"), k=1)),
        F.when(n % 7 == 0, event("barge_in", 1600, turn, (n % 2 == 0).alias("interrupted"), ratio(32, "p_real"))),
    ]
    partials = F.transform(F.sequence(F.lit(0).cast("long"), n % 3), lambda k: F.struct(F.lit("asr_partial").alias("type"), (k + 100).alias("offset"), k.alias("k"), F.to_json(F.struct(turn, F.col("text"))).alias("payload")))
    heard = [event("turn_started", 0, turn, F.lit("agent").alias("speaker")), event("tts_done", 500, turn, "text", ms(900, "duration_ms"))]
    each = F.when(F.col("person"), F.concat(F.array(*said), F.filter(partials, lambda x: x["k"] < n % 3))).otherwise(F.array(*heard))
    told = spread(rows, "conv_id", "turn").select("conv_id", "turn", "n", F.explode(each).alias("e")).where("e is not null").select("conv_id", "turn", "n", "e.*")
    whole = rows.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.count("*").cast("int").alias("turns"), F.min("turn").alias("first"))
    c = F.col("conv_id")
    started = event("call_started", -1000, F.when(c % 2 == 0, "validate_contact").otherwise("confirm_appointment").alias("flow"), F.concat(F.lit("c"), c % 50).alias("contact_id"), F.concat(F.lit("m"), c % 3).alias("model_version"), F.substring(F.sha2(c.cast("string"), 256), 1, 12).alias("prompt_hash"), F.lit(True).alias("synthetic"))
    ended = event("call_ended", 5000, _pick(OUTCOMES, c).alias("outcome"), F.col("turns"))
    told = told.unionByName(whole.select("conv_id", F.col("first").alias("turn"), F.lit(0).cast("long").alias("n"), started.alias("e")).select("conv_id", "turn", "n", "e.*"))
    told = told.unionByName(whole.where(c % 9 != 0).select("conv_id", "turn", F.lit(0).cast("long").alias("n"), ended.alias("e")).select("conv_id", "turn", "n", "e.*"))
    is_ = lambda kind, base: (F.col("type") == kind) & (F.col("n") % base == 0)
    id_ = F.when(~is_("tts_done", 23), F.concat_ws("-", call, F.col("turn"), F.col("type"), F.col("k")))
    at = iso_millis(F.timestamp_millis(F.lit(START_MS) + c * 97_000 + F.col("turn") * 11_000 + F.col("offset")))
    head = F.to_json(F.struct(F.when(is_("decision", 17), 2).otherwise(1).alias("schema_version"), id_.alias("event_id"), call.alias("call_id"), (F.col("turn") * 100 + F.col("k")).alias("seq"), at.alias("ts"), "type"))
    line = F.concat(F.expr("substring({0}, 1, length({0}) - 1)".format("head")), F.lit(', "payload": '), F.col("payload"), F.lit("}"))
    lines = told.withColumn("head", head).withColumn("value", line)
    lines = lines.withColumn("value", F.when((F.col("type") == "turn_started") & (F.col("n") % 19 == 0) & F.col("payload").contains("agent"), F.substring("value", 1, 10)).otherwise(F.col("value")))
    return lines.select(F.explode(F.array_repeat("value", F.when(is_("latency", 13), 2).otherwise(1))).alias("value"))


def _silver(spark, d) -> DataFrame:
    return W.silver(W.parse(call_lines(spark, d)))


def _star(spark, d) -> tuple[DataFrame, DataFrame]:
    events = settle(_silver(spark, d), "type")  # parsed once; each part of the star reads its types and columns
    return W.dim_call(events), W.fact_turn(events)


_AT = "epoch_ms(1709251200000 + conv_id * 97000 + turn * 11000 + {0})"
_ID = "'call-' || conv_id AS call_id, turn * 100 + {1} AS seq, " + _AT + " AS event_ts, 'call-' || conv_id || '-' || turn || '-{2}-' || {1} AS event_id, '{2}' AS type"


def _of(kind: str, offset: object, payload: str, where: str, k: object = 0, source: str = "t") -> str:
    return f"SELECT {_ID.format(offset, k, kind)}, {payload} FROM {source} WHERE {where}"


SILVER_SQL = (
    """WITH t AS (SELECT conv_id, turn, role = 'user' AS person, coalesce(text, '') AS text, conv_id * 31 + turn * 7 + length(coalesce(text, '')) AS n FROM conversations),
w AS (SELECT conv_id, min(turn) AS turn, max(turn) AS last, CAST(count(*) AS INTEGER) AS turns FROM t GROUP BY 1), l AS (SELECT conv_id, last AS turn, turns FROM w),
p AS (SELECT *, unnest(range(0, n % 3)) AS k FROM t WHERE person), ev AS ("""
    + " UNION ALL BY NAME ".join(
        [
            _of("turn_started", 0, "CAST(turn AS INTEGER) AS turn_idx, 'person' AS speaker", "person"),
            _of("turn_started", 0, "CAST(turn AS INTEGER) AS turn_idx, 'agent' AS speaker", "NOT person AND n % 19 <> 0"),
            _of("tts_done", 500, "CAST(turn AS INTEGER) AS turn_idx, text, CAST(n % 900 AS DOUBLE) AS duration_ms", "NOT person AND n % 23 <> 0"),
            _of("asr_partial", "100 + k", "CAST(turn AS INTEGER) AS turn_idx, text", "true", "k", "p"),
            _of("asr_final", 1000, "CAST(turn AS INTEGER) AS turn_idx, text, n % 128 / 128 AS asr_confidence", "person"),
            _of("decision", 1030, "CAST(turn AS INTEGER) AS turn_idx, 'classify_intent' AS task, ['confirmed', 'cannot_attend', 'out_of_scope', 'call_rejected'][n % 4 + 1] AS output_intent, n % 64 / 64 AS output_confidence, CAST(n % 60 AS DOUBLE) AS latency_ms", "person AND n % 5 <> 0 AND n % 17 <> 0"),
            _of("llm_response", 1300, "CAST(turn AS INTEGER) AS turn_idx, 'extract_entity' AS task, 1 AS prompt_version, n % 6 <> 0 AS json_valid, CAST(n % 700 AS DOUBLE) AS latency_ms", "person AND n % 4 <> 3"),
            _of("latency", 1400, "CAST(turn AS INTEGER) AS turn_idx, CAST(n % 1200 AS DOUBLE) AS end_to_end_ms, CAST(n % 200 AS DOUBLE) AS endpointing_ms", "person"),
            _of("tool_invoked", 1500, "CAST(turn AS INTEGER) AS turn_idx, 'update_contact' AS tool, 'phone' AS field", "person AND n % 5 = 1"),
            _of("tool_invoked", 1501, "CAST(turn AS INTEGER) AS turn_idx, 'mark_unvalidated' AS tool, 'email' AS field", "person AND n % 10 = 1", 1),
            _of("barge_in", 1600, "CAST(turn AS INTEGER) AS turn_idx, n % 2 = 0 AS interrupted, n % 32 / 32 AS p_real", "person AND n % 7 = 0"),
            _of("call_started", -1000, "CASE WHEN conv_id % 2 = 0 THEN 'validate_contact' ELSE 'confirm_appointment' END AS flow, 'c' || conv_id % 50 AS contact_id, 'm' || conv_id % 3 AS model_version, substr(sha256(CAST(conv_id AS VARCHAR)), 1, 12) AS prompt_hash, true AS synthetic", "true", 0, "w"),
            _of("call_ended", 5000, "['completed', 'partial', 'rejected', 'failed'][conv_id % 4 + 1] AS outcome, turns", "conv_id % 9 <> 0", 0, "l"),
        ]
    )
    + ")"
)

SILVER_COLUMNS = "event_id, call_id, seq, event_ts, CAST(event_ts AS DATE) AS event_date, type, turn_idx, speaker, text, asr_confidence, task, latency_ms, json_valid, prompt_version, tool, field, duration_ms, end_to_end_ms, endpointing_ms, interrupted, p_real, outcome, turns, flow, contact_id, model_version, prompt_hash, synthetic, output_intent, output_confidence, CAST(NULL AS BOOLEAN) AS output_interruption, CAST(NULL AS VARCHAR) AS output_kind"
STAR_SQL = SILVER_SQL + """, b AS (SELECT call_id, count(*) AS barge_ins, CAST(sum(CAST(interrupted AS INTEGER)) AS BIGINT) AS interruptions FROM ev WHERE type = 'barge_in' GROUP BY 1),
f AS (SELECT call_id, count(*) FILTER (tool = 'update_contact') AS fields_validated, count(*) FILTER (tool = 'mark_unvalidated') AS fields_unvalidated FROM ev WHERE type = 'tool_invoked' GROUP BY 1),
calls AS (SELECT s.call_id, s.flow, s.contact_id, s.model_version, s.prompt_hash, s.synthetic, s.event_ts AS started_at, e.outcome, e.turns, e.event_ts AS ended_at, coalesce(barge_ins, 0) AS barge_ins, coalesce(interruptions, 0) AS interruptions,
 coalesce(fields_validated, 0) AS fields_validated, coalesce(fields_unvalidated, 0) AS fields_unvalidated, (epoch_us(e.event_ts) - epoch_us(s.event_ts)) / 1e6 AS duration_s, date_trunc('hour', s.event_ts) AS started_hour
 FROM (SELECT * FROM ev WHERE type = 'call_started') s LEFT JOIN (SELECT * FROM ev WHERE type = 'call_ended') e ON s.call_id = e.call_id LEFT JOIN b ON s.call_id = b.call_id LEFT JOIN f ON s.call_id = f.call_id),
q AS (SELECT call_id, turn_idx, count(*) AS asr_partials FROM ev WHERE type = 'asr_partial' GROUP BY 1, 2),
turns AS (SELECT u.call_id, u.turn_idx, u.event_ts AS turn_started_at, CAST(u.event_ts AS DATE) AS event_date, a.asr_confidence, CAST(length(a.text) AS INTEGER) AS transcript_chars, asr_partials, d.output_intent AS intent, d.output_confidence AS intent_confidence, d.latency_ms AS decision_ms,
 m.json_valid, m.task AS llm_task, m.latency_ms AS llm_ms, y.end_to_end_ms, y.endpointing_ms, o.tool, o.field AS tool_field, y.end_to_end_ms <= 800 AS within_e2e_budget, m.latency_ms <= 500 AS within_llm_budget
 FROM (SELECT * FROM ev WHERE type = 'turn_started' AND speaker = 'person') u LEFT JOIN (SELECT * FROM ev WHERE type = 'asr_final') a ON u.call_id = a.call_id AND u.turn_idx = a.turn_idx LEFT JOIN q ON u.call_id = q.call_id AND u.turn_idx = q.turn_idx
 LEFT JOIN (SELECT * FROM ev WHERE type = 'decision') d ON u.call_id = d.call_id AND u.turn_idx = d.turn_idx LEFT JOIN (SELECT * FROM ev WHERE type = 'llm_response') m ON u.call_id = m.call_id AND u.turn_idx = m.turn_idx
 LEFT JOIN (SELECT * FROM ev WHERE type = 'latency') y ON u.call_id = y.call_id AND u.turn_idx = y.turn_idx LEFT JOIN (SELECT * FROM ev WHERE type = 'tool_invoked') o ON u.call_id = o.call_id AND u.turn_idx = o.turn_idx)"""
_P = "round(quantile_disc({0}, 0.5), 4) AS {0}_p50, round(quantile_disc({0}, 0.95), 4) AS {0}_p95"
_RATE = "round(avg(CAST({0} AS DOUBLE)), 4) AS {1}"


@query(SILVER_SQL + f" SELECT {SILVER_COLUMNS} FROM ev")
def silver_call_events(spark, d):
    return _silver(spark, d)


@query(SILVER_SQL + """, x AS (SELECT count(*) FILTER (person AND n % 5 <> 0 AND n % 17 = 0) + count(*) FILTER (NOT person AND n % 19 = 0) + count(*) FILTER (NOT person AND n % 23 = 0) AS bad, count(*) FILTER (person AND n % 13 = 0) AS twice FROM t), g AS (SELECT count(*) AS good FROM ev)
SELECT good + bad + twice AS rows_read, bad AS rows_invalid, twice AS rows_duplicate, good AS rows_written FROM x, g""")
def call_event_accounting(spark, d):
    return W.accounting(W.parse(call_lines(spark, d)))


@query(STAR_SQL + " SELECT * FROM calls")
def dim_call_full(spark, d):
    return _star(spark, d)[0]


@query(STAR_SQL + " SELECT * FROM turns")
def fact_turn_six_joins(spark, d):
    return _star(spark, d)[1]


@query(
    STAR_SQL + ", x AS (SELECT count(*) AS calls, " + ", ".join(f"round(avg(CAST(outcome = '{o}' AS DOUBLE)), 4) AS {o}_rate" for o in ("completed", "partial", "rejected"))
    + ", round(avg(duration_s), 4) AS call_duration_s_mean, round(avg(turns), 4) AS turns_mean, round(sum(interruptions) / nullif(sum(barge_ins), 0), 4) AS barge_in_stop_rate, round(sum(fields_validated) / nullif(sum(fields_validated) + sum(fields_unvalidated), 0), 4) AS field_validation_rate FROM calls), "
    + "y AS (SELECT count(*) AS caller_turns, " + ", ".join([*(_P.format(c) for c in ("end_to_end_ms", "decision_ms", "llm_ms")), *(_RATE.format(*c) for c in (("within_e2e_budget", "e2e_budget_rate"), ("within_llm_budget", "llm_budget_rate"), ("json_valid", "json_valid_rate"), ("asr_confidence", "asr_confidence_mean")))]) + " FROM turns) SELECT * FROM x, y"
)
def kpi_summary_full(spark, d):
    return W.kpi_summary(*_star(spark, d))


@query(STAR_SQL + f" SELECT started_hour, count(DISTINCT turns.call_id) AS calls, count(*) AS caller_turns, {_P.format('end_to_end_ms')}, {_RATE.format('json_valid', 'json_valid_rate')} FROM turns JOIN calls ON turns.call_id = calls.call_id GROUP BY 1")
def kpi_hourly_full(spark, d):
    return W.kpi_hourly(*_star(spark, d))


@query(STAR_SQL + f" SELECT intent, count(*) AS turns, {_P.format('end_to_end_ms')} FROM turns GROUP BY 1")
def kpi_intent_full(spark, d):
    return W.kpi_intent(_star(spark, d)[1])


@query(STAR_SQL + " SELECT outcome, quantile_disc(end_to_end_ms, 0.95) AS p95_ms, count(*) AS turns FROM turns JOIN calls USING (call_id) GROUP BY 1")
def p95_latency_by_outcome(spark, d):
    return W.dashboard("p95_latency_by_outcome", *_star(spark, d))


@query(STAR_SQL + " SELECT started_hour, round(avg(CASE WHEN outcome = 'rejected' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM calls GROUP BY 1")
def rejections_by_hour(spark, d):
    return W.dashboard("rejections_by_hour", *_star(spark, d))


@query(STAR_SQL + " SELECT tool_field, round(avg(CASE WHEN json_valid THEN 0.0 ELSE 1.0 END), 6) AS invalid_rate, count(*) AS n FROM turns WHERE llm_task IS NOT NULL GROUP BY 1")
def invalid_json_by_field(spark, d):
    return W.dashboard("invalid_json_by_field", *_star(spark, d))
