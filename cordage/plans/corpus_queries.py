"""Queries over training examples, answers and evaluations that Spark makes from the given tables, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import dates, decisions, structured
from ..functions import probability as P
from ..functions import spoken
from ..functions import text as T
from ..operators import augment as A
from ..operators import calibration as K
from ..operators import corpus as C
from ..operators import curation as U
from ..operators import evaluation as V
from ..operators import examples as X
from ..operators import gold as G
from ..operators import review
from ..sources import lines, sinks
from ..sources.tables import shared_folder, spread, table
from .queries import FOLD, SCORED
from .registry import query

# The gold set of the queries and what a number picks.
SIZE, TEMPLATE, REPLAY = 60, 0.7, 0.15
INTENTS = ["confirmed", "cannot_attend", "ambiguous", "call_rejected", "out_of_scope"]


def example_rows(spark, d) -> DataFrame:
    """An example of every document; some outputs do not fit their schema."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    task = F.element_at(F.array(*map(F.lit, ("classify_intent", "extract_entity", "is_real_interruption", "replay"))), (i % 4 + 1).cast("int"))
    source = F.when(i % 4 == 3, "replay").when(i % 3 == 0, "carrier").otherwise("template")
    js = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    entity = js(F.lit("phone").alias("field"), F.lit(None).cast("string").alias("normalized_value"), F.lit(0.5).alias("confidence"), F.lit(True).alias("needs_reprompt"))
    answer = js(F.element_at(F.array(*map(F.lit, INTENTS)), (i % 5 + 1).cast("int")).alias("intent"), F.lit(0.95).alias("confidence"))
    cut_in = js(F.lit(True).alias("interruption"), F.lit(0.9).alias("confidence"), F.when(i % 7 == 0, "shout").otherwise("objection").alias("kind"))
    output = F.when(i % 4 == 0, answer).when(i % 4 == 1, entity).when(i % 4 == 2, cut_in).otherwise(js(text.alias("response")))
    inputs = F.when(i % 4 == 3, js(text.alias("instruction"))).otherwise(js(F.lit("phone").alias("field"), text.alias("transcript")))
    group = F.concat(F.lit("g"), (i % 97).cast("string"))
    return table(spark, d, "documents").select(F.concat(F.lit("ex-"), i).alias("id"), group.alias("group"), task.alias("task"), source.alias("source"), inputs.alias("input"), output.alias("output"))


_EXAMPLES = """WITH e AS (SELECT doc_id, coalesce(text, '') AS text, 'ex-' || doc_id AS id, 'g' || doc_id % 97 AS grp, ['classify_intent', 'extract_entity', 'is_real_interruption', 'replay'][doc_id % 4 + 1] AS task,
CASE WHEN doc_id % 4 = 3 THEN 'replay' WHEN doc_id % 3 = 0 THEN 'carrier' ELSE 'template' END AS source FROM documents),
q AS (SELECT * FROM (VALUES ('replay', 'replay', 9), ('classify_intent', 'template', 12), ('classify_intent', 'carrier', 5), ('extract_entity', 'template', 12), ('extract_entity', 'carrier', 5), ('is_real_interruption', 'template', 12), ('is_real_interruption', 'carrier', 5)) v(task, source, need))"""
_GOLD = _EXAMPLES + """, r AS (SELECT e.*, need, row_number() OVER (PARTITION BY e.task, e.source ORDER BY substr(sha256('42:' || e.task || ':' || e.source || ':' || id), 1, 15), id) AS rank FROM e JOIN q ON e.task = q.task AND e.source = q.source),
f AS (SELECT *, CAST(('0x' || substr(sha256('42:' || grp), 1, 8)) AS BIGINT) / 4294967295.0 AS pos FROM r WHERE rank <= need), g AS (SELECT *, CASE WHEN pos <= 0.8 THEN 'train' WHEN pos <= 0.9 THEN 'val' ELSE 'test' END AS split FROM f)"""


def _gold(spark, d) -> DataFrame:
    return G.build(example_rows(spark, d), SIZE, TEMPLATE, REPLAY)


@query(_EXAMPLES + " SELECT q.task, q.source, CAST(need AS BIGINT) AS need, count(id) AS have FROM q LEFT JOIN e ON e.task = q.task AND e.source = q.source GROUP BY 1, 2, 3")
def gold_quotas(spark, d):
    return G.pools(example_rows(spark, d), G.quotas(["extract_entity", "classify_intent", "is_real_interruption"], SIZE, TEMPLATE, REPLAY))


@query(_GOLD + " SELECT id, task, source, split FROM g")
def gold_sample(spark, d):
    return _gold(spark, d).select("id", "task", "source", "split")


@query(_GOLD + " SELECT split, kind, value, count(*) AS n FROM (SELECT split, 'rows' AS kind, 'all' AS value FROM g UNION ALL SELECT split, 'task', task FROM g UNION ALL SELECT split, 'source', source FROM g) GROUP BY 1, 2, 3")
def gold_counts(spark, d):
    return G.counts(_gold(spark, d))


_HELD = f"""h AS (SELECT DISTINCT t FROM (SELECT {FOLD} AS t FROM benchmark UNION ALL SELECT {FOLD} FROM documents WHERE doc_id % 5 = 0) WHERE len(string_split(t, ' ')) >= 3)"""


@query(
    _GOLD + ", " + _HELD + """, n AS (SELECT count(*) AS n, count(DISTINCT split) AS splits, count(*) FILTER ((task = 'is_real_interruption' AND doc_id % 7 = 0) OR (task = 'replay' AND text = '')) AS invalid, count(*) - count(DISTINCT id) AS repeated,
count(*) FILTER (task = 'replay') / count(*) AS replay, count(*) FILTER (source = 'template') / count(*) FILTER (task <> 'replay') AS template FROM g),
l AS (SELECT count(*) FILTER (s > 1) AS leaks FROM (SELECT count(DISTINCT split) AS s FROM g GROUP BY grp)), m AS (SELECT count(*) FILTER (s < 3) AS missing FROM (SELECT count(DISTINCT split) AS s FROM g WHERE task <> 'replay' GROUP BY task)),"""
    + f" o AS (SELECT count(DISTINCT id) AS overlap FROM (SELECT id, {FOLD} AS t FROM g WHERE trim(text) <> '') WHERE t IN (SELECT t FROM h))"
    + """ SELECT 'splits_present' AS name, splits = 3 AS passed, CAST(splits AS VARCHAR) AS detail FROM n UNION ALL SELECT 'row_count', n = 60, CAST(n AS VARCHAR) FROM n UNION ALL SELECT 'rows_valid', invalid = 0, CAST(invalid AS VARCHAR) FROM n
UNION ALL SELECT 'ids_unique', repeated = 0, CAST(repeated AS VARCHAR) FROM n UNION ALL SELECT 'no_group_leakage', leaks = 0, CAST(leaks AS VARCHAR) FROM l UNION ALL SELECT 'replay_share', abs(replay - 0.15) <= 0.005, printf('%.4f', replay) FROM n
UNION ALL SELECT 'manifest_present', true, CAST(n AS VARCHAR) FROM n UNION ALL SELECT 'template_share', abs(template - 0.7) <= 0.005, printf('%.4f', template) FROM n UNION ALL SELECT 'tasks_in_every_split', missing = 0, CAST(missing AS VARCHAR) FROM m UNION ALL SELECT 'no_held_out_overlap', overlap = 0, CAST(overlap AS VARCHAR) FROM o
UNION ALL SELECT 'expect:table_row_count', n = 60, CAST(abs(n - 60) AS VARCHAR) FROM n UNION ALL SELECT 'expect:id_unique', repeated = 0, CAST(repeated AS VARCHAR) FROM n
UNION ALL SELECT unnest(['expect:group_not_null', 'expect:task_in_set', 'expect:source_in_set', 'expect:split_in_set']), true, '0'"""
)
def gold_gate(spark, d):
    path = f"{shared_folder(spark)}/gold-{uuid.uuid4().hex}"
    sinks.publish(_gold(spark, d), path, manifest={"params": {"size": SIZE, "template_ratio": TEMPLATE, "replay_ratio": REPLAY}})
    gold, manifest = sinks.read_published(spark, path), sinks.published_manifest(spark, path)
    docs = table(spark, d, "documents").where("doc_id % 5 = 0").select("text")
    reference = table(spark, d, "benchmark").select("text").unionByName(docs).select(F.to_json(F.struct(F.col("text").alias("transcript"))).alias("input"))
    return G.structural_checks(gold, SIZE, REPLAY, TEMPLATE, G.held_out_texts(reference, "input"), manifest).unionByName(G.expectations(gold, SIZE))


@query("""WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events),
p AS (SELECT event_id, CASE event_type WHEN 'view' THEN CASE WHEN event_id % 7 = 0 THEN 'extra' END WHEN 'click' THEN CASE WHEN k > 10 THEN 'value:confidence' END WHEN 'signup' THEN 'not_json' WHEN 'purchase' THEN 'not_object'
ELSE CASE event_id % 3 WHEN 0 THEN 'value:intent' WHEN 1 THEN 'missing:confidence' ELSE 'type:intent' END END AS error FROM e)
SELECT event_id, CASE WHEN error IS NULL THEN 'confirmed' ELSE 'ambiguous' END AS intent, error IS NULL AS valid, error FROM p""")
def parse_structured(spark, d):
    k, i = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    js = lambda *columns: F.to_json(F.struct(*columns))
    intent = F.lit("confirmed").alias("intent")
    raw = (
        F.when(F.col("event_type") == "view", F.when(i % 7 == 0, js(intent, F.lit(0.5).alias("confidence"), F.lit(1).alias("more"))).otherwise(js(intent, F.lit(1).alias("confidence"))))
        .when(F.col("event_type") == "click", js(intent, (k / 10).alias("confidence"))).when(F.col("event_type") == "signup", F.concat(F.lit("Sure: "), js(intent)))
        .when(F.col("event_type") == "purchase", '["confirmed"]').when(i % 3 == 0, '{"intent": "maybe", "confidence": 0.5}').when(i % 3 == 1, '{"intent": "confirmed"}').otherwise('{"intent": null, "confidence": 0.5}')
    )
    told = table(spark, d, "events").select("event_id", structured.parse_structured(raw, "classify_intent").alias("p"))
    return told.select("event_id", F.get_json_object("p.value", "$.intent").alias("intent"), "p.valid", "p.error")


@query("""WITH c AS (SELECT doc_id, lang, coalesce(text, '') AS a, CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 10 = 1 THEN 'write to a@b.co' ELSE 'answer ' || doc_id % 40 END AS b, FOLD AS key FROM documents),
r AS (SELECT *, CASE WHEN lang IS DISTINCT FROM 'es' THEN 'other_language' WHEN trim(regexp_replace(a, '\\s+', ' ', 'g')) = '' OR b = '' THEN 'empty' WHEN len(string_split(trim(regexp_replace(a, '\\s+', ' ', 'g')), ' ')) > 400 THEN 'too_long'
WHEN regexp_matches(a, '\\S+@\\S+\\.\\w+') THEN 'email' WHEN regexp_matches(a, '(?i)https?://|www\\.') THEN 'link' WHEN len(list_filter(regexp_extract_all(a, '\\+?[0-9][0-9 ().-]{7,}[0-9]'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) >= 9)) > 0 THEN 'phone' WHEN doc_id % 10 = 1 THEN 'email' END AS reason FROM c),
o AS (SELECT *, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason IS NULL, key, b ORDER BY doc_id) = 1 THEN 'kept' ELSE 'duplicate' END) AS outcome FROM r)
SELECT name, count(*) AS n FROM (SELECT unnest(list_filter(['read', CASE WHEN outcome <> 'other_language' THEN 'in_language' END, CASE WHEN outcome <> 'other_language' THEN outcome END], lambda x: x IS NOT NULL)) AS name FROM o) GROUP BY 1""".replace("FOLD", FOLD))
def curate_pairs(spark, d):
    i = F.col("doc_id")
    answer = F.when(i % 6 == 0, "").when(i % 10 == 1, "write to a@b.co").otherwise(F.concat(F.lit("answer "), (i % 40).cast("string")))
    rows = table(spark, d, "documents").select(F.col("lang").alias("language"), F.col("text").alias("inputs"), answer.alias("targets"), i.alias("place"))
    return U.counters(U.outcomes(rows, "es", 400))


_ZERO = SCORED + """, a AS (SELECT vec_id, gold, CASE WHEN vec_id % 2 = 0 THEN 'classify_intent' ELSE 'is_real_interruption' END AS task, p, list_position(p, list_max(p)) - 1 AS guess, vec_id % 83 AS ms FROM s)"""


def _scored_answers(spark, d) -> DataFrame:
    rows = C.scored(table(spark, d, "embeddings"))
    labels = F.array(*(F.lit(f"l{k}") for k in range(5)))
    task = F.when(F.col("vec_id") % 2 == 0, "classify_intent").otherwise("is_real_interruption")
    return rows.select("vec_id", task.alias("task"), "p", labels.alias("labels"), F.concat(F.lit("l"), F.col("gold")).alias("gold"), (F.col("vec_id") % 83).cast("double").alias("latency_ms"))


@query(_ZERO + """, g AS (SELECT task, gold, guess, count(*) AS n FROM a GROUP BY 1, 2, 3), u AS (SELECT task, gold AS label, sum(n) AS golds, sum(CASE WHEN gold = guess THEN n ELSE 0 END) AS tp FROM g GROUP BY 1, 2), w AS (SELECT task, guess AS label, sum(n) AS preds FROM g GROUP BY 1, 2),
f AS (SELECT u.task, round(avg(2 * tp / (golds + coalesce(preds, 0))), 4) AS macro_f1 FROM u LEFT JOIN w ON u.task = w.task AND u.label = w.label GROUP BY 1),
b AS (SELECT task, least(floor(list_max(p) * 15), 14) AS bin, count(*) AS n, sum(CASE WHEN gold = guess THEN 1.0 ELSE 0.0 END) AS hits, sum(list_max(p)) AS confs FROM a GROUP BY 1, 2), x AS (SELECT task, round(sum(abs(hits - confs)) / sum(n), 4) AS ece_raw FROM b GROUP BY 1)
SELECT a.task, count(*) AS n, round(avg(CASE WHEN gold = guess THEN 1.0 ELSE 0.0 END), 4) AS accuracy, macro_f1, ece_raw, round(quantile_disc(CAST(ms AS DOUBLE), 0.5), 1) AS latency_p50 FROM a JOIN f ON a.task = f.task JOIN x ON a.task = x.task GROUP BY a.task, macro_f1, ece_raw""")
def zero_shot(spark, d):
    return V.zero_shot(_scored_answers(spark, d))


@query(_ZERO + " SELECT task, 'l' || guess AS predicted, count(*) AS n FROM a GROUP BY 1, 2")
def predicted_histogram(spark, d):
    return V.histogram(_scored_answers(spark, d))


@query("""WITH c AS (SELECT c_custkey AS i, '+5255' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS y FROM customer), p AS (SELECT i, CASE WHEN i % 9 = 0 THEN NULL ELSE y END AS y, CASE WHEN i % 4 = 0 THEN NULL WHEN i % 9 = 0 THEN y ELSE y END AS p, [0.0, 0.05, 0.15][CAST(i % 3 + 1 AS INTEGER)] AS w FROM c),
b AS (SELECT y, p, unnest(['all', 'phone', 'wer_' || CAST(CAST(w AS DOUBLE) AS VARCHAR)]) AS bucket FROM p)
SELECT bucket, count(*) AS n, round(avg(CASE WHEN p IS NOT DISTINCT FROM y THEN 1.0 ELSE 0.0 END), 4) AS exact_match, round(avg(CASE WHEN p IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS coverage, round(avg(CASE WHEN p IS NOT NULL AND p IS DISTINCT FROM y THEN 1.0 ELSE 0.0 END), 4) AS wrong_value_rate FROM b GROUP BY 1""")
def rule_baseline(spark, d):
    i = F.col("c_custkey")
    digits = F.concat(F.lit("55"), F.lpad(i.cast("string"), 8, "0"))
    said = F.when(i % 4 == 0, F.concat(spoken.say_phone(digits), F.lit(" no perdón"))).otherwise(spoken.say_phone(digits))
    rows = table(spark, d, "customer").select(said.alias("said"), F.when(i % 9 != 0, F.concat(F.lit("+52"), digits)).alias("y"), F.element_at(F.array(*map(F.lit, (0.0, 0.05, 0.15))), (i % 3 + 1).cast("int")).alias("w"))
    return V.rule_baseline(rows.withColumn("p", spoken.read_phones("said")), F.col("p"), F.col("y"), F.lit("phone"), F.col("w"))


@query("SELECT count(*) AS n, (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, min(doc_id) LIMIT 1) AS majority_label, round((SELECT max(c) FROM (SELECT count(*) AS c FROM documents WHERE lang IS NOT NULL GROUP BY lang)) / count(*), 4) AS accuracy FROM documents WHERE lang IS NOT NULL")
def majority_baseline(spark, d):
    return V.majority_baseline(table(spark, d, "documents"), "lang", "doc_id")


@query("SELECT c_custkey, 'score:' || CASE WHEN c_custkey % 13 <= 2 THEN '2' WHEN c_custkey % 13 <= 5 THEN '3-5' WHEN c_custkey % 13 <= 10 THEN '6-10' ELSE '11+' END AS bucket FROM customer")
def bucket_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", K.bucket(F.lit("score"), F.col("c_custkey") % 13).alias("bucket"))


@query(SCORED + ", b AS (SELECT gold, least(floor(list_max(p) * 15), 14) AS bin, count(*) AS n, sum(CASE WHEN list_position(p, list_max(p)) - 1 = gold THEN 1.0 ELSE 0.0 END) AS hits, sum(list_max(p)) AS confs FROM s GROUP BY 1, 2) SELECT 'b' || gold AS bucket, CAST(sum(n) AS BIGINT) AS n, round(sum(abs(hits - confs)) / sum(n), 4) AS ece_raw FROM b GROUP BY 1")
def calibration_raw(spark, d):
    rows = C.scored(table(spark, d, "embeddings")).withColumn("bucket", F.concat(F.lit("b"), F.col("gold")))
    return K.ece_by(rows, "bucket", F.col("p")).select("bucket", "n", F.round("ece", 4).alias("ece_raw"))


@query(None)
def calibration_report(spark, d):
    rows = C.scored(table(spark, d, "embeddings")).withColumn("bucket", F.concat(F.lit("b"), F.col("gold") % 2))
    return K.bucket_report(rows, "vec_id")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS good FROM orders")
def offset_times(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.when(F.col("o_orderkey") % 4 == 0, F.concat(day, F.lit("T10:30:00Z"))).when(F.col("o_orderkey") % 4 == 1, F.concat(day, F.lit("T23:59:59.125-06:00"))).when(F.col("o_orderkey") % 4 == 2, F.concat(day, F.lit("T10:30:00"))).otherwise(F.concat(day, F.lit("T25:30:00+00:00")))
    return table(spark, d, "orders").select("o_orderkey", dates.has_offset(said).alias("good"))


@query("""WITH p AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS k FROM events), q AS (SELECT event_id, k, round(1 - k, 4) AS r FROM p)
SELECT event_id, CASE WHEN k >= 0.4 THEN 'call_rejected' WHEN r > k THEN 'confirmed' ELSE 'call_rejected' END AS intent FROM q""")
def rejection_decision(spark, d):
    k = F.get_json_object("props", "$.k").cast("double") / 100
    p = F.create_map(F.lit("confirmed"), F.round(1 - k, 4), F.lit("call_rejected"), k)
    return table(spark, d, "events").select("event_id", decisions.intent(p, ["confirmed", "call_rejected"], "call_rejected", 0.4).alias("intent"))


@query("""WITH c AS (SELECT c_custkey AS i, c_custkey % 4 AS m FROM customer)
SELECT i AS c_custkey, CASE m WHEN 0 THEN '+52' || CAST(5500000000 + i AS VARCHAR) WHEN 2 THEN 'cliente' || i || '@mail.mx' END AS canonical, (m = 0 OR m = 2) AND i % 5 <> 0 AND i % 10 >= 3 AS acceptable FROM c""")
def acceptable_values(spark, d):
    i = F.col("c_custkey")
    field = F.when(i % 4 <= 1, "phone").otherwise("email")
    value = F.when(i % 4 == 0, F.concat(F.lit("+52"), (F.lit(5_500_000_000) + i).cast("string"))).when(i % 4 == 1, F.concat(F.lit("+52 "), i)).when(i % 4 == 2, F.concat(F.lit(" Cliente"), i, F.lit("@MAIL.mx "))).otherwise("nobody")
    good = decisions.acceptable(field, value, (i % 10) / 10, i % 5 == 0, 0.3)
    return table(spark, d, "customer").select("c_custkey", T.canonical(field, value).alias("canonical"), good.alias("acceptable"))


FLOWS = [("validate_contact", "¿Es correcto?", ["ECONOMY", "PROMO"]), ("confirm_appointment", "¿Nos confirma?", ["ECONOMY", "STANDARD"])]


@query("""WITH b AS (SELECT 'cp-' || p_partkey AS carrier_id, p_type AS intent, p_name AS transcript FROM part WHERE p_partkey % 2 = 0 AND len(string_split(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), ' ')) BETWEEN 1 AND 25 AND NOT regexp_matches(p_name, '[0-9]|@')),
f AS (SELECT * FROM (VALUES ('validate_contact', '¿Es correcto?', 'ECONOMY'), ('validate_contact', '¿Es correcto?', 'PROMO'), ('confirm_appointment', '¿Nos confirma?', 'ECONOMY'), ('confirm_appointment', '¿Nos confirma?', 'STANDARD')) t(flow, context, intent)),
c AS (SELECT flow, context, transcript, intent, carrier_id, 'carrier' AS source FROM f JOIN b USING (intent)), t AS (SELECT DISTINCT flow, context, p_brand AS transcript, intent FROM f JOIN part ON p_type = intent)
SELECT flow, context, transcript, intent, carrier_id, source FROM c UNION ALL SELECT flow, context, transcript, intent, NULL, 'template' FROM t""")
def carrier_examples(spark, d):
    part = table(spark, d, "part")
    bank = part.select(F.concat(F.lit("cp-"), "p_partkey").alias("id"), F.lit("classify_intent").alias("task"), F.col("p_type").alias("label"), F.col("p_name").alias("text"), F.when(F.col("p_partkey") % 2 == 0, "approved").otherwise("pending").alias("status"))
    template = X.intent_examples(part.select(F.col("p_type").alias("label"), F.col("p_brand").alias("text")), FLOWS)
    return X.with_carriers(template, X.carrier_intents(bank, FLOWS)).select("flow", "context", "transcript", "intent", "carrier_id", "source")


@query("SELECT c_custkey, row_number() OVER (ORDER BY sha256('7:' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1 AS rank FROM customer QUALIFY rank < 100")
def capped_space(spark, d):
    return X.capped(table(spark, d, "customer").select("c_custkey"), 100, "7", "c_custkey").select("c_custkey", F.col("rank").cast("long").alias("rank"))


@query(_EXAMPLES + " SELECT task, kind, value, count(*) AS n FROM (SELECT task, 'rows' AS kind, 'all' AS value FROM e UNION ALL SELECT task, 'source', source FROM e UNION ALL SELECT task, 'group', grp FROM e) GROUP BY 1, 2, 3")
def corpus_summary(spark, d):
    return X.summary(example_rows(spark, d), source="source", group="group")


@query("""SELECT DISTINCT problem, value FROM (SELECT 'persona_without_template' AS problem, c_mktsegment AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'interruption_without_kind', p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 3 <> 0)
UNION ALL SELECT 'kind_not_allowed', p_brand FROM part WHERE p_partkey % 3 <> 0 AND p_brand NOT IN ('Brand#11', 'Brand#12') UNION ALL SELECT 'intent_not_allowed', o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT' UNION ALL SELECT 'intent_without_phrases', l_shipmode FROM (SELECT DISTINCT o_orderstatus AS l_shipmode FROM orders))""")
def template_checks(spark, d):
    part, orders = table(spark, d, "part"), table(spark, d, "orders")
    written = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "name string")
    return X.template_problems(
        table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct(), written, part.select(F.col("p_name").alias("phrase")).distinct(),
        part.where("p_partkey % 3 <> 0").select(F.col("p_name").alias("phrase"), F.col("p_brand").alias("kind")), orders.select(F.col("o_orderstatus").alias("label")).distinct(),
        orders.select(F.col("o_orderpriority").alias("label")).distinct(), ["Brand#11", "Brand#12"], ["1-URGENT"],
    )


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 4 THEN NULL ELSE '+5255' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone, 'cliente_' || c_custkey || '@' || lower(c_mktsegment) || '.com.mx' AS email FROM customer")
def spoken_styles_all(spark, d):
    i = F.col("c_custkey")
    digits = F.concat(F.lit("55"), F.lpad(i.cast("string"), 8, "0"))
    email = F.concat(F.lit("cliente_"), i.cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".com.mx"))
    phone = F.lit(None).cast("string")
    for k, style in enumerate(("digits", "pairs", "triples", "mixed", "correction")):
        phone = F.when(i % 5 == k, spoken.say_phone(digits, style)).otherwise(phone)
    mail = F.when(i % 3 == 0, spoken.say_email(email)).when(i % 3 == 1, spoken.say_email(email, "spelled")).otherwise(spoken.say_email(email, "mixed"))
    said = spread(table(spark, d, "customer"), "c_custkey").select("c_custkey", phone.alias("p"), mail.alias("e"))
    return said.select("c_custkey", spoken.read_phones("p").alias("phone"), spoken.read_emails("e").alias("email"))


@query("""WITH c AS (SELECT c_custkey, 'ana' || lower(c_mktsegment) || '@lago.mx' AS truth, c_custkey % 4 AS m FROM customer)
SELECT c_custkey, CASE m WHEN 0 THEN 'kept' WHEN 1 THEN 'heard' WHEN 2 THEN 'unresolved' ELSE 'unresolved' END AS outcome, CASE m WHEN 0 THEN truth WHEN 1 THEN replace(truth, 'ana', 'eva') END AS label FROM c""")
def relabel_email(spark, d):
    i = F.col("c_custkey")
    part = lambda text, original, kind: F.struct(text.alias("text"), original.alias("original"), F.lit(kind).cast("string").alias("kind"), F.lit(True).alias("in_value"))
    name, rest = F.concat(F.lit("ana"), F.lower("c_mktsegment")), [part(F.lit(w), F.lit(w), None) for w in ("arroba", "lago", "punto", "mx")]
    other = F.replace(name, F.lit("ana"), F.lit("eva"))
    first = F.when(i % 4 == 0, part(F.concat(name, F.lit(" eh")), name, "filler")).when(i % 4 == 1, part(other, name, "mishearing")).when(i % 4 == 2, part(F.lit("punto"), name, "mishearing")).otherwise(part(other, name, "respelled"))
    rows = table(spark, d, "customer").select("c_custkey", F.concat(name, F.lit("@lago.mx")).alias("truth"), F.array(first, *rest).alias("tokens"))
    return A.relabel(rows, "truth", F.lit("email")).select("c_custkey", "outcome", "label")


@query("WITH k AS (SELECT c_custkey, unnest(range(4)) AS k FROM customer) SELECT k, [0.0, 0.05, 0.15, 0.25][k + 1]::DOUBLE AS wer_target, count(*) AS n, count(DISTINCT 'x' || c_custkey || '-v0' || k) AS ids, true AS spans, true AS confident FROM k GROUP BY 1, 2")
def variant_rows(spark, d):
    digits = F.concat(F.lit("55"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    said = spoken.say_phone(digits)
    rows = spread(table(spark, d, "customer"), "c_custkey").select(F.concat(F.lit("x"), "c_custkey").alias("id"), F.col("c_name").alias("group"), F.lit("phone").alias("field"), F.lit("pairs").alias("style"), F.concat(F.lit("mi número es "), said).alias("transcript"), F.lit(13).alias("start"), (F.length(said) + 13).alias("stop"), F.concat(F.lit("+52"), digits).alias("truth"))
    made = A.make_variants(rows, 4)
    sound = F.substring("transcript", F.col("start") + 1, F.col("stop") - F.col("start")) == F.col("raw_span")
    clean = (F.col("wer_target") > 0) | ((F.col("outcome") == "kept") & (F.col("wer") == 0))
    told = made.select(F.substring_index("id", "-v", -1).cast("long").alias("k"), "wer_target", "id", (sound & clean).alias("ok"), F.col("asr_confidence").between(0.3, 0.99).alias("sure"))
    return told.groupBy("k", "wer_target").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.every("ok").alias("spans"), F.every("sure").alias("confident"))


_DECIDED = """d AS (SELECT user_id % (SELECT count(*) FROM part) + 1 AS id, ts, event_id, CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'reject' WHEN 'purchase' THEN 'edit' ELSE 'skip' END AS decision, CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'una frase nueva' ELSE 'frase 5' END END AS text FROM events),
l AS (SELECT * FROM d WHERE decision IN ('approve', 'reject') OR text = 'una frase nueva' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, 'r' || event_id DESC) = 1)"""


@query(f"""WITH {_DECIDED} SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN decision = 'edit' THEN l.text ELSE p_name END AS text, CASE decision WHEN 'reject' THEN 'rejected' WHEN 'approve' THEN 'approved' WHEN 'edit' THEN 'approved' ELSE 'pending' END AS status,
CASE WHEN decision = 'edit' THEN p_name END AS original_text, 'r' || event_id AS reviewed_by FROM part LEFT JOIN l ON l.id = p_partkey""")
def bank_review(spark, d):
    """A bank of names of parts after the decisions that events stand for."""
    parts = table(spark, d, "part")
    bank = parts.select(F.col("p_partkey").cast("string").alias("id"), F.lit("classify_intent").alias("task"), F.lit("confirmed").alias("label"), F.col("p_name").alias("text"), F.lit("pending").alias("status"))
    kind = F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "view", "reject").when(F.col("event_type") == "purchase", "edit").otherwise("skip")
    text = F.when(kind == "edit", F.when(F.col("event_id") % 2 == 0, "una frase nueva").otherwise("frase 5"))
    id_ = (F.col("user_id") % parts.count() + 1).cast("string")
    said = table(spark, d, "events").select(id_.alias("id"), F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("r"), "event_id").alias("reviewer"), kind.alias("decision"), text.alias("text"))
    return review.reviewed(bank, said).select("id", "text", "status", "original_text", "reviewed_by")


@query("""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, text FROM conversations), f AS (SELECT conv_id % 3 AS part, conv_id, n FROM c WHERE n <= 2)
SELECT 'p' || part || '.jsonl:' || row_number() OVER (PARTITION BY part ORDER BY conv_id, n) AS place, conv_id, n AS turn FROM f""")
def lines_with_place(spark, d):
    """Rows written as JSON lines, three files of them, and read with their file and line."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = table(spark, d, "conversations").select("conv_id", place.cast("long").alias("turn"), (F.col("conv_id") % 3).alias("part")).where("turn <= 2")
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    for part in range(3):  # a file each, as a dataset's splits are
        rows.where(F.col("part") == part).coalesce(1).sortWithinPartitions("conv_id", "turn").select(F.to_json(F.struct("conv_id", "turn"))).write.text(f"{folder}/{part}")
        fs, at = sinks._fs(spark, f"{folder}/{part}")
        for status in fs.listStatus(at):
            if status.getPath().getName().startswith("part-"):
                fs.rename(status.getPath(), sinks._fs(spark, f"{folder}/p{part}.jsonl")[1])
    return lines.read_where(spark, f"{folder}/p*.jsonl", StructType.fromDDL("conv_id long, turn long")).select(F.col("_where").alias("place"), "conv_id", "turn")
