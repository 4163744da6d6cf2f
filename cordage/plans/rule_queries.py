"""Queries over lines, calls, labels and settings that Spark makes from the given tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment as A
from ..operators import checks, dialogue
from ..operators import telemetry as E
from ..sources import ingest
from ..sources.tables import spread, table
from .registry import query


@query("""WITH e AS (SELECT event_id AS i FROM events), p AS (SELECT unnest(CASE WHEN i % 29 = 0 THEN ['not_json'] WHEN i % 31 = 0 THEN ['not_object'] ELSE list_filter([
CASE WHEN i % 7 = 0 THEN 'extra_keys' END, CASE WHEN i % 5 = 0 THEN 'missing:call_id' END, CASE WHEN i % 6 = 0 THEN 'version' END, CASE WHEN i % 9 = 0 THEN 'value:event_id' END, CASE i % 11 WHEN 0 THEN 'type:seq' WHEN 1 THEN 'value:seq' END,
CASE WHEN i % 13 IN (0, 1) THEN 'value:ts' END, CASE WHEN i % 8 = 0 THEN 'type:payload' END, CASE WHEN i % 8 <> 0 AND i % 10 = 0 THEN 'payload_type:interrupted' END, CASE WHEN i % 8 <> 0 AND i % 4 = 1 THEN 'out_of_bounds:p_real' END,
CASE WHEN i % 8 <> 0 AND i % 3 = 0 THEN 'missing:turn_idx' END, CASE WHEN i % 8 <> 0 AND i % 10 = 0 THEN 'not_allowed:interrupted' END], lambda x: x IS NOT NULL) END) AS problem FROM e) SELECT problem, count(*) AS n FROM p GROUP BY 1""")
def event_line_check(spark, d):
    """A line of JSON for every event, wrong in ways its number tells."""
    i = F.col("event_id")
    is_ = lambda base, rest=0: i % base == rest
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    sha = F.sha2(i.cast("string"), 256)
    uuid = F.concat_ws("-", *(F.substring(sha, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    payload = F.concat(
        F.lit('{"interrupted": '), F.when(is_(10), '"yes"').otherwise("true"), F.lit(', "p_real": '), F.when(is_(4, 1), "1.25").otherwise("0.5"),
        F.when(is_(3), "").otherwise(', "turn_idx": 2'), F.lit("}"),
    )
    parts = [
        F.concat(F.lit('"schema_version": '), F.when(is_(6), "2").otherwise("1")), F.concat(F.lit('"event_id": '), quoted(F.when(is_(9), F.lit("e-1")).otherwise(uuid))),
        F.when(~is_(5), F.lit('"call_id": "call-1"')), F.concat(F.lit('"seq": '), F.when(is_(11), '"3"').when(is_(11, 1), "-1").otherwise("3.0")),
        F.concat(F.lit('"ts": '), quoted(F.when(is_(13), "yesterday").when(is_(13, 1), "2024-02-30T10:00:00Z").otherwise("2024-02-29T10:00:00.250Z"))),
        F.lit('"type": "barge_in"'), F.concat(F.lit('"payload": '), F.when(is_(8), F.lit("[1]")).otherwise(payload)), F.when(is_(7), '"note": null'),
    ]
    line = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    line = F.when(is_(29), F.lit('{"type": ')).when(is_(31), F.lit("[]")).otherwise(line)
    rows = spread(table(spark, d, "events"), "event_id").select(line.alias("line"))
    return rows.select(F.explode(checks.event_problems(F.col("line"))).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN i % 17 = 0 THEN 'not_json' WHEN i % 19 = 0 THEN 'extra_keys' WHEN i % 7 = 0 THEN 'missing:group' WHEN i % 6 = 0 THEN 'version' WHEN i % 11 = 0 THEN 'type:input' WHEN i % 5 = 0 THEN 'meta' WHEN i % 4 = 0 THEN 'source'
WHEN i % 9 = 0 THEN 'schema' ELSE 'ok' END AS problem, count(*) AS n FROM (SELECT doc_id AS i FROM documents) GROUP BY 1""")
def example_line_check(spark, d):
    """A line of JSON for every document, its text the evidence of an answer, wrong in ways its number tells."""
    i = F.col("doc_id")
    is_ = lambda base: i % base == 0
    quoted = lambda c: F.to_json(F.struct(c.alias("evidence")))
    answer = F.concat(F.lit('{"intent": "confirmed", "confidence": '), F.when(is_(9), "1.5").otherwise("0.5"), F.lit(", "), F.substr(quoted(F.coalesce("text", F.lit(""))), F.lit(2)))
    parts = [
        F.concat(F.lit('"schema_version": '), F.when(is_(6), "2").otherwise("1")), F.concat(F.lit('"id": "x'), i.cast("string"), F.lit('"')), F.when(~is_(7), F.lit('"group": "g"')), F.lit('"task": "classify_intent"'),
        F.concat(F.lit('"source": '), F.when(is_(4), '"replay"').otherwise('"carrier"')), F.concat(F.lit('"input": '), F.when(is_(11), '"said"').otherwise("{}")), F.concat(F.lit('"output": '), answer),
        F.when(is_(5), '"meta": {"wer": 2}').when(is_(3), '"meta": {"seed": 7}'), F.when(is_(19), '"more": 1'),
    ]
    line = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.when(is_(17), "").otherwise("}"))
    rows = table(spark, d, "documents").select(line.alias("line"))
    return rows.groupBy(F.coalesce(checks.example_line_problem(F.col("line")), F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT conv_id AS call_id, turn AS seq, ['name', 'phone', 'email'][(conv_id + turn) % 3 + 1] AS field, CASE WHEN (conv_id * 7 + turn * 3) % 5 < 3 THEN 'validated' ELSE 'unvalidated' END AS result FROM conversations WHERE role = 'user'),
l AS (SELECT call_id, field, min(seq) AS first, max((seq, result)) AS last FROM a GROUP BY 1, 2),
s AS (SELECT call_id, count(*) AS asked, list(CASE field WHEN 'name' THEN 'su nombre' WHEN 'phone' THEN 'su teléfono' ELSE 'su correo' END ORDER BY first, field) FILTER (last[2] = 'validated') AS good FROM l GROUP BY 1)
SELECT call_id, CASE coalesce(len(good), 0) WHEN 0 THEN 'Revisaremos sus datos por otro medio.' ELSE 'Listo, ' || CASE len(good) WHEN 1 THEN 'quedó confirmado ' || good[1] WHEN 2 THEN 'quedaron confirmados ' || good[1] || ' y ' || good[2]
ELSE 'quedaron confirmados ' || good[1] || ', ' || good[2] || ' y ' || good[3] END || '.' || CASE WHEN len(good) < asked THEN ' Lo demás lo revisaremos por otro medio.' ELSE '' END END || ' Gracias por su tiempo, que tenga buen día.' AS said FROM s""")
def closing_sentences(spark, d):
    """What the agent says at the end of each conversation; a person's turns stand for fields asked."""
    call, seq = F.col("conv_id"), F.col("turn")
    field = F.element_at(F.array(*map(F.lit, ("name", "phone", "email"))), ((call + seq) % 3 + 1).cast("int"))
    result = F.when((call * 7 + seq * 3) % 5 < 3, "validated").otherwise("unvalidated")
    asked = table(spark, d, "conversations").where("role = 'user'").select(call.alias("call_id"), seq.alias("seq"), field.alias("field"), result.alias("result"))
    return dialogue.results_of_calls(asked).select("call_id", dialogue.closing(F.col("results")).alias("said"))


@query("""WITH l AS (SELECT DISTINCT p_brand AS flow, p_type AS label FROM part), c AS (SELECT DISTINCT p_brand AS flow, p_size AS place, 'talla ' || p_size AS line FROM part),
x AS (SELECT label, line, row_number() OVER (PARTITION BY label ORDER BY flow, place, line) - 1 AS turn, count(*) OVER (PARTITION BY label) AS n FROM l JOIN c USING (flow))
SELECT p_partkey AS i, p.p_type AS label, x.line AS context FROM part p LEFT JOIN x ON x.label = p.p_type AND x.turn = p.p_partkey % x.n""")
def label_context_turns(spark, d):
    """Each part asks for phrases of its type; the lines of the brands that have the type take turns."""
    part = table(spark, d, "part")
    labels = part.select(F.col("p_brand").alias("flow"), F.col("p_type").alias("label"))
    lines = part.select(F.col("p_brand").alias("flow"), F.col("p_size").alias("place"), F.concat(F.lit("talla "), "p_size").alias("line"))
    asked = part.select(F.col("p_partkey").alias("i"), F.col("p_type").alias("label"))
    return dialogue.with_context(asked, dialogue.label_contexts(labels, lines)).select("i", "label", "context")


@query("""WITH m AS (SELECT 't' || l_linenumber % 3 AS task, ['kept', 'heard', 'unresolved', 'dropped'][l_orderkey % 4 + 1] AS outcome, l_tax * 2 AS target, l_discount AS wer FROM lineitem)
SELECT 'labels' AS kind, task AS name, outcome, count(*) AS n, NULL::DOUBLE AS value FROM m GROUP BY 2, 3 UNION ALL SELECT 'wer_applied_mean', CAST(CAST(target AS DOUBLE) AS VARCHAR), NULL, count(*), round(avg(CAST(wer AS DOUBLE)), 4) FROM m WHERE outcome <> 'dropped' GROUP BY 2""")
def label_outcomes(spark, d):
    outcome = F.element_at(F.array(*map(F.lit, ("kept", "heard", "unresolved", "dropped"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    made = table(spark, d, "lineitem").select(F.concat(F.lit("t"), F.col("l_linenumber") % 3).alias("task"), outcome.alias("outcome"), (F.col("l_tax") * 2).cast("double").alias("wer_target"), F.col("l_discount").cast("double").alias("wer"))
    return A.outcomes(made)


@query("SELECT user_id, event_type, list_sort(list(value))[count(value) // 2 + 1] AS median, count(value) AS n FROM events GROUP BY 1, 2")
def median_of_repeats(spark, d):
    """The upper median of each user's values, as repeats of one measurement are summed up."""
    return E.upper_median(table(spark, d, "events"), "value", "user_id", "event_type")


@query("SELECT 'src_' || c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN 'MIT' ELSE 'CC-BY-4.0' END AS license, c_custkey % 4 <> 0 AS verified FROM customer")
def verified_sources(spark, d):
    """The sources that may be ingested and, beside them, those to be reported."""
    i = F.col("c_custkey")
    specs = table(spark, d, "customer").select(
        F.concat(F.lit("src_"), i.cast("string")).alias("name"), F.lit("url").alias("kind"), F.lit("https://a/b").alias("url"), F.sha2("c_name", 256).alias("sha256"), F.lit("").alias("repo_id"), F.lit("").alias("revision"),
        F.when(i % 3 == 0, "MIT").otherwise("CC-BY-4.0").alias("license"), F.lit("test").alias("purpose"), (i % 4 != 0).alias("verified"),
    )
    return ingest.verified(specs).select("name", "license", "verified").unionByName(ingest.unverified(specs).withColumn("verified", F.lit(False)))
