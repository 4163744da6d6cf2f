"""The driver's queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decisions
from ..functions import probability as P
from ..functions import spoken
from ..functions import text as T
from ..operators import augment as A
from ..operators import calls, checks
from ..operators import corpus as C
from ..operators import examples as X
from ..operators import phrases as B
from ..operators import telemetry as E
from ..sources import ingest
from ..sources.tables import shared_folder, spread, table
from ..streaming import events as S
from .registry import QUERIES, SQL, query  # noqa: F401

def _event_keys() -> list:
    return [F.col("user_id"), F.to_date("ts"), F.col("event_type")]


@query("SELECT event_id, user_id, event_type, ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL")
def silver_flatten(spark, d):
    return E.flatten(table(spark, d, "events"))


@query("SELECT event_id, user_id, event_type, ts, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts, event_id) = 1")
def silver_dedup(spark, d):
    return E.dedup(table(spark, d, "events"), _event_keys(), ["ts", "event_id"]).select("event_id", "user_id", "event_type", "ts", "value", "props")


@query("SELECT count(*) AS rows_read, count(*) FILTER (event_id IS NULL OR event_type IS NULL) AS rows_invalid, count(*) - count(*) FILTER (event_id IS NULL OR event_type IS NULL) - count(DISTINCT (user_id, CAST(ts AS DATE), event_type)) AS rows_duplicate, count(DISTINCT (user_id, CAST(ts AS DATE), event_type)) AS rows_written FROM events")
def silver_accounting(spark, d):
    return E.accounting(table(spark, d, "events"), _event_keys(), ["ts", "event_id"])


@query("SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def type_subrelations(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""
WITH s AS (SELECT user_id, min(ts) AS started_at FROM events GROUP BY 1),
e AS (SELECT user_id, max(ts) AS ended_at, arg_max(value, (ts, event_id)) AS outcome FROM events WHERE event_type = 'purchase' GROUP BY 1),
b AS (SELECT user_id, count(*) AS barge_ins, CAST(sum(CASE WHEN value > 80 THEN 1 ELSE 0 END) AS BIGINT) AS interruptions FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT user_id, started_at, ended_at, round(outcome, 4) AS outcome, coalesce(barge_ins, 0) AS barge_ins, coalesce(interruptions, 0) AS interruptions,
CAST(epoch(date_trunc('second', ended_at)) - epoch(date_trunc('second', started_at)) AS BIGINT) AS duration_s, date_trunc('hour', started_at) AS started_hour
FROM s LEFT JOIN e USING (user_id) LEFT JOIN b USING (user_id)""")
def dim_call(spark, d):
    return E.dim_call(table(spark, d, "events")).withColumn("started_hour", F.col("started_hour").cast("timestamp_ntz"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, o_orderpriority, c_mktsegment, n_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def fact_turn_fanout(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "o_orderpriority", "c_mktsegment", "n_name")


@query("SELECT o_orderkey, o_orderstatus, coalesce(n, 0) AS n, round(coalesce(price, 0), 2) AS price FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def fact_turn_preagg_join(spark, d):
    pre = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("price"))
    j = table(spark, d, "orders").join(pre, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("price", F.lit(0.0)), 2).alias("price"))


@query("SELECT event_id, value <= 80 AS within_e2e_budget, CASE WHEN event_type = 'click' THEN value <= 50 END AS within_llm_budget FROM events")
def budget_flags(spark, d):
    llm = F.when(F.col("event_type") == "click", F.col("value") <= E.LLM_BUDGET)
    return table(spark, d, "events").select("event_id", (F.col("value") <= E.E2E_BUDGET).alias("within_e2e_budget"), llm.alias("within_llm_budget"))


@query("""SELECT count(*) AS turns, count(DISTINCT user_id) AS calls, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS purchase_rate, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate,
round(count(*) FILTER (event_type = 'signup') / count(*), 6) AS signup_rate, quantile_disc(value, 0.5) AS value_p50, quantile_disc(value, 0.95) AS value_p95, round(sum(value) FILTER (event_type = 'error') / sum(value), 6) AS error_value_share FROM events""")
def kpi_summary(spark, d):
    return E.summary(table(spark, d, "events"))


@query("SELECT date_trunc('hour', ts) AS started_hour, count(DISTINCT user_id) AS calls, count(*) AS turns, quantile_disc(value, 0.5) AS value_p50, quantile_disc(value, 0.95) AS value_p95, round(avg(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 THEN 1.0 ELSE 0.0 END), 6) AS valid_rate FROM events GROUP BY 1")
def kpi_hourly(spark, d):
    return E.kpi_hourly(table(spark, d, "events"))


@query("SELECT event_type, count(*) AS turns, quantile_disc(value, 0.5) AS value_p50, quantile_disc(value, 0.95) AS value_p95 FROM events GROUP BY 1")
def kpi_intent(spark, d):
    return E.kpi_by(table(spark, d, "events"), "event_type")


@query("SELECT o_orderstatus, count(*) AS turns, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def p95_by_outcome(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderstatus").agg(F.count("*").alias("turns"), F.percentile_approx("l_extendedprice", 0.95, E.ACCURACY).alias("p95"))


@query("SELECT date_trunc('hour', ts) AS hour, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY 1")
def rate_by_hour(spark, d):
    return spark.sql("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS hour, round(avg(CASE WHEN event_type = 'error' THEN 1D ELSE 0D END), 6) AS rate FROM {events} GROUP BY 1", events=table(spark, d, "events"))


@query("SELECT event_type, count(*) AS n, round(avg(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 10 THEN 1.0 ELSE 0.0 END), 6) AS invalid_rate FROM events WHERE props IS NOT NULL GROUP BY 1")
def invalid_rate_by_field(spark, d):
    return spark.sql("SELECT event_type, count(*) AS n, round(avg(CASE WHEN CAST(get_json_object(props, '$.k') AS BIGINT) < 10 THEN 1D ELSE 0D END), 6) AS invalid_rate FROM {events} WHERE props IS NOT NULL GROUP BY 1", events=table(spark, d, "events"))


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def inner_join_projection(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_new_keys(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


# DuckDB's own removal of accents; the n with tilde is kept by a sign in its place.
FOLD = "trim(regexp_replace(replace(strip_accents(replace(lower(text), 'ñ', chr(1))), chr(1), 'ñ'), '[^\\p{L}\\p{N}_]+', ' ', 'g'))"


@query(f"SELECT DISTINCT l.doc_id FROM (SELECT doc_id, {FOLD} AS t FROM documents) l JOIN (SELECT {FOLD} AS t FROM benchmark UNION SELECT {FOLD} FROM documents WHERE lang = 'es') r USING (t)")
def semi_contamination(spark, d):
    docs = table(spark, d, "documents")
    key = F.sha2(T.normalize_text(F.col("text")), 256).alias("t")
    held = table(spark, d, "benchmark").select(key).unionByName(docs.where("lang = 'es'").select(key)).distinct()
    return docs.select("doc_id", key).join(held, "t", "left_semi").select("doc_id").distinct()


# Written out here, so that a wrong pattern of the library can't pass on both sides.
def _reason_sql(*texts: str, max_words: int = 400) -> str:
    words = lambda t: f"len(list_filter(string_split_regex(coalesce({t}, ''), '[ \\t\\n\\r]+'), lambda w: w <> ''))"
    own = " ".join(
        f"WHEN regexp_matches({t}, '[^ \\t\\n\\r]@[^ \\t\\n\\r]+[.][\\p{{L}}\\p{{N}}_]') THEN 'email' WHEN contains(lower({t}), 'http://') OR contains(lower({t}), 'https://') OR contains(lower({t}), 'www.') THEN 'link' "
        f"WHEN len(list_filter(regexp_extract_all({t}, '[+]?[0-9][0-9 \\t\\n\\r().-]{{7,}}[0-9]'), lambda m: length(translate(m, '+ ().-' || chr(9) || chr(10) || chr(13), '')) >= 9)) > 0 THEN 'phone'"
        for t in texts
    )
    return f"CASE WHEN {' OR '.join(words(t) + ' = 0' for t in texts)} THEN 'empty' WHEN {' OR '.join(words(t) + f' > {max_words}' for t in texts)} THEN 'too_long' {own} ELSE 'kept' END"


REASON = _reason_sql("text")
_SHOUTED = "replace(replace(upper(text), ' ', chr(10)), 'HTTPS', 'hTTp')"


@query(f"SELECT doc_id, {REASON} AS reason FROM documents")
def drop_reason(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(T.drop_reason(400, F.col("text")), F.lit("kept")).alias("reason"))


@query(f"SELECT doc_id, {_reason_sql(_SHOUTED, 'text')} AS reason FROM documents")
def drop_reason_of_pairs(spark, d):
    """Each text and the same in capitals over line feeds."""
    shouted = F.replace(F.translate(F.upper("text"), " ", "\n"), F.lit("HTTPS"), F.lit("hTTp"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(T.drop_reason(400, shouted, F.col("text")), F.lit("kept")).alias("reason"))


@query(f"SELECT {REASON} AS reason, count(*) AS n FROM documents WHERE lang = 'es' GROUP BY 1")
def curate_counters(spark, d):
    return C.curate_counters(table(spark, d, "documents"), "es", 400)


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY {FOLD}")
def curate_dedup(spark, d):
    return C.first_wins(table(spark, d, "documents")).select("doc_id", "copies")


@query(f"SELECT doc_id, {FOLD} AS normalized, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS words FROM documents")
def normalize_text(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.normalize_text(t).alias("normalized"), T.word_count(t).alias("words"))


@query(f"SELECT doc_id, {FOLD} AS normalized, strip_accents(lower(text)) AS plain FROM documents")
def normalize_decomposed(spark, d):
    """Texts whose accents are written as marks behind their letters fold like those with accented letters."""
    t = F.col("text")
    for letter, base, mark in [("é", "e", "\u0301"), ("á", "a", "\u0301"), ("í", "i", "\u0301"), ("ó", "o", "\u0301"), ("è", "e", "\u0300"), ("ê", "e", "\u0302"), ("ü", "u", "\u0308"), ("ö", "o", "\u0308"), ("ä", "a", "\u0308"), ("ç", "c", "\u0327")]:
        t = F.replace(t, F.lit(letter), F.lit(base + mark))
    return table(spark, d, "documents").select("doc_id", T.normalize_text(t).alias("normalized"), T.ascii_fold(t).alias("plain"))


@query("SELECT c_custkey, 'cp-' || substr(sha256(c_name || chr(0) || c_mktsegment), 1, 12) AS id, trim(regexp_replace(lpad(CAST(c_custkey AS VARCHAR), 10, '0'), '(..)', '\\1 ', 'g')) AS spoken, CASE WHEN c_name IS NOT NULL THEN '[redacted]' END AS name, substr(c_name, 1, 8) AS head FROM customer")
def scalars(spark, d):
    digits = F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    return table(spark, d, "customer").select("c_custkey", T.hash_id("cp-", F.col("c_name"), F.col("c_mktsegment")).alias("id"), T.read_back(digits).alias("spoken"), T.redact(F.col("c_name")).alias("name"), T.slice_span(F.col("c_name"), F.lit(0), F.lit(8)).alias("head"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(CASE WHEN event_id % 7 = 0 THEN '[1]' ELSE props END, '$.k') AS BIGINT), -1) AS k, event_id % 7 <> 0 AS valid FROM events")
def json_parse_or_fallback(spark, d):
    raw = F.when(F.col("event_id") % 7 == 0, "[1]").otherwise(F.col("props"))
    k = F.get_json_object(raw, "$.k").try_cast("long")
    return table(spark, d, "events").select("event_id", F.coalesce(k, F.lit(-1)).alias("k"), k.isNotNull().alias("valid"))


SPLIT = "CAST(('0x' || substr(sha256('42:' || CAST(conv_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967295.0"


@query(f"SELECT conv_id, CASE WHEN {SPLIT} <= 0.8 THEN 'train' WHEN {SPLIT} <= 0.9 THEN 'val' ELSE 'test' END AS split, count(*) AS turns FROM conversations GROUP BY 1, 2")
def hash_split(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return c.select("conv_id", C.split_of(F.col("conv_id")).alias("split"), "turns")


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY substr(sha256('42:' || lang || ':' || CAST(doc_id AS VARCHAR)), 1, 15), doc_id) AS rank FROM documents QUALIFY rank <= 50")
def stratified_sample(spark, d):
    return C.stratified(table(spark, d, "documents"), "lang", 50)


@query("SELECT source, count(*) AS have, 60 - count(*) AS short FROM documents GROUP BY 1 HAVING count(*) < 60")
def quota_shortfall(spark, d):
    return C.shortfall(table(spark, d, "documents"), "source", 60)


@query("""WITH c AS (SELECT 'ids_unique' AS name, count(doc_id) - count(DISTINCT doc_id) AS detail FROM documents UNION ALL SELECT 'text_present', count(*) FILTER (text IS NULL) FROM documents
UNION ALL SELECT 'lang_known', count(*) FILTER (lang IS NULL OR lang NOT IN ('de', 'en', 'es', 'fr')) FROM documents UNION ALL SELECT 'n_chars_right', count(*) FILTER (length(text) <> n_chars) FROM documents
UNION ALL SELECT 'toxic_binary', count(*) FILTER (toxic NOT IN (0, 1)) FROM labels UNION ALL SELECT 'quality_binary', count(*) FILTER (quality NOT IN (0, 1)) FROM labels
UNION ALL SELECT 'labels_known', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) SELECT name, detail = 0 AS passed, detail FROM c""")
def gate_checks(spark, d):
    return C.gate(table(spark, d, "documents"), table(spark, d, "labels"))


@query("SELECT coalesce(lang, 'all') AS lang, coalesce(CAST(quality AS VARCHAR), 'all') AS quality, count(*) AS n, round(avg(toxic), 4) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (quality))")
def grouping_sets_baseline(spark, d):
    return C.levels(table(spark, d, "documents"), table(spark, d, "labels"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, min(doc_id) LIMIT 1")
def majority(spark, d):
    return C.majority(table(spark, d, "documents"), "lang", "doc_id")


@query("""WITH p AS (SELECT quality AS g, 1 - toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2), g AS (SELECT g AS label, sum(n) AS golds, sum(CASE WHEN g = p THEN n ELSE 0 END) AS tp FROM p GROUP BY 1), q AS (SELECT p AS label, sum(n) AS preds FROM p GROUP BY 1)
SELECT round(avg(2 * tp / (golds + coalesce(preds, 0))), 4) AS macro_f1, count(*) AS labels FROM g LEFT JOIN q USING (label)""")
def macro_f1(spark, d):
    return C.macro_f1(table(spark, d, "labels").withColumn("guess", 1 - F.col("toxic")), "quality", "guess")


SCORED = """WITH z AS (SELECT vec_id, CAST(label % 5 AS INTEGER) AS gold, list_transform(embedding[1:5], lambda x: CAST(x AS DOUBLE) * 10) AS z FROM embeddings),
e AS (SELECT vec_id, gold, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z), s AS (SELECT vec_id, gold, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"""
TEMPERED = SCORED + """, l AS (SELECT vec_id, gold, list_transform(p, lambda x: ln(greatest(x, 0.0001)) / 2) AS l FROM s), f AS (SELECT vec_id, gold, list_transform(l, lambda x: exp(x - list_max(l))) AS f FROM l),
t AS (SELECT vec_id, gold, list_transform(f, lambda x: x / list_sum(f)) AS q FROM f)"""


@query(SCORED + ", c AS (SELECT list_max(p) AS conf, CASE WHEN list_position(p, list_max(p)) - 1 = gold THEN 1.0 ELSE 0.0 END AS hit FROM s), b AS (SELECT least(floor(conf * 15), 14) AS b, count(*) AS n, sum(hit) AS hits, sum(conf) AS confs FROM c GROUP BY 1) SELECT round(sum(abs(hits - confs)) / sum(n), 4) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b")
def ece(spark, d):
    return C.calibration_error(C.scored(table(spark, d, "embeddings")))


@query(TEMPERED + " SELECT vec_id, round(q[1], 4) AS q1, round(list_max(q), 4) AS top, CAST(list_position(q, list_max(q)) - 1 AS INTEGER) AS answer FROM t")
def temper_argmax(spark, d):
    q = P.temper(F.col("p"), 2.0)
    rows = C.scored(table(spark, d, "embeddings")).select("vec_id", q.alias("q"))
    return rows.select("vec_id", F.round(F.col("q")[0], 4).alias("q1"), F.round(F.array_max("q"), 4).alias("top"), P.argmax_first(F.col("q")).alias("answer"))


@query(TEMPERED + " SELECT round(avg(-ln(greatest(q[gold + 1], 1e-12))), 4) AS nll, count(*) AS n FROM t")
def nll_at_t(spark, d):
    return C.nll(C.scored(table(spark, d, "embeddings")), 2.0)


@query("""WITH p AS (SELECT value FROM events WHERE event_type = 'error'), t AS (SELECT value AS threshold FROM p ORDER BY value DESC LIMIT 1 OFFSET (SELECT CAST(ceil(count(*) * 95 / 100.0) - 1 AS BIGINT) FROM p))
SELECT round(threshold, 6) AS threshold, round(count(*) FILTER (event_type = 'error') / (SELECT count(*) FROM p), 4) AS recall, round(count(*) FILTER (event_type = 'error') / count(*), 4) AS precision FROM events, t WHERE value >= threshold GROUP BY threshold""")
def rejection_threshold(spark, d):
    return C.threshold_at_recall(table(spark, d, "events"), "value", "event_type = 'error'")


@query(None)
def fit_temperature(spark, d):
    return C.fit_temperature(C.scored(table(spark, d, "embeddings")))


@query("SELECT event_id, row_number() OVER w - 1 AS seq, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running_value, coalesce(lag(event_type) OVER w <> event_type, false) AS switched FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def seq_numbers(spark, d):
    return E.sequence_numbers(table(spark, d, "events"))


@query("SELECT conv_id, turn, k, array_to_string(string_split(text, ' ')[1:k], ' ') AS partial FROM (SELECT conv_id, turn, text, unnest(range(1, 1 + len(string_split(text, ' ')))) AS k FROM conversations WHERE role = 'user' AND text <> '')")
def asr_partials(spark, d):
    # Every prefix, k = 1..n, and none of an empty or null text.
    words = F.split("text", " ")
    rows = table(spark, d, "conversations").where("role = 'user' AND text <> ''").withColumn("k", F.explode(F.sequence(F.lit(1), F.size(words))))
    return rows.select("conv_id", "turn", F.col("k").cast("long").alias("k"), F.array_join(F.slice(words, 1, F.col("k")), " ").alias("partial"))


@query("SELECT CASE event_type WHEN 'view' THEN 'calls.transcripts' WHEN 'click' THEN 'model.inferences' ELSE 'calls.events' END AS topic, count(*) AS n FROM events GROUP BY 1")
def topic_route(spark, d):
    return E.topic(table(spark, d, "events"))


@query("SELECT doc_id, CAST(quality AS VARCHAR) AS tag FROM labels UNION ALL SELECT doc_id, NULL FROM documents")
def union_passthrough(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("tag"))
    return labels.unionByName(table(spark, d, "documents").select("doc_id"), allowMissingColumns=True)


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersection(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("SELECT o_orderkey, k, CAST(CASE WHEN k = 0 THEN 0.0 ELSE [0.05, 0.15, 0.25][CAST((k - 1) % 3 + 1 AS INTEGER)] END AS DOUBLE) AS wer FROM orders, range(5) t(k)")
def variant_levels(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("k"))
    level = F.element_at(F.array(*map(F.lit, (0.05, 0.15, 0.25))), ((F.col("k") - 1) % 3 + 1).cast("int"))
    return rows.select("o_orderkey", "k", F.when(F.col("k") == 0, 0.0).otherwise(level).alias("wer"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, d):
    return S.drain(S.dedup(S.event_stream(spark, f"{d}/events.parquet"), ["event_id"], _span(spark, d)).select("event_id", "user_id", "event_type"), shared_folder(spark))


@query("SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events")
def stream_dedup_repeats(spark, d):
    stream = S.event_stream(spark, f"{d}/events.parquet").withColumn("day", F.to_date("ts"))
    return S.drain(S.dedup(stream, ["user_id", "day", "event_type"], _span(spark, d)).select("user_id", "day", "event_type"), shared_folder(spark))


def _span(spark, d) -> str:
    """A delay that covers the table's whole disorder, so no row comes late."""
    r = table(spark, d, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return f"{int((r['b'] - r['a']).total_seconds()) + 1 if r['a'] else 1} seconds"


@query("SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM events")
def turn_numbers(spark, d):
    return E.turn_numbers(table(spark, d, "events"), "click", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "turn")


@query("SELECT count(*) AS switches FROM (SELECT user_id <> lag(user_id) OVER (ORDER BY ts, event_id) AS hit FROM events) WHERE hit")
def call_switches(spark, d):
    return E.call_switches(table(spark, d, "events"), "user_id", ["ts", "event_id"])


@query("SELECT c_custkey, '+5255' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS phone FROM customer")
def spoken_phone_roundtrip(spark, d):
    digits = F.concat(F.lit("55"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    said = table(spark, d, "customer").select("c_custkey", spoken.say_phone(digits).alias("said"))
    return said.select("c_custkey", spoken.read_phones("said").alias("phone"))


@query("SELECT c_custkey, '+5255' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS phone FROM customer")
def spoken_phone_styles(spark, d):
    digits = F.concat(F.lit("55"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    said = F.when(F.col("c_custkey") % 2 == 0, spoken.say_phone(digits, "digits")).otherwise(spoken.say_phone(digits, "triples"))
    return table(spark, d, "customer").select("c_custkey", said.alias("said")).select("c_custkey", spoken.read_phones("said").alias("phone"))


@query("SELECT c_custkey, 'cliente_' || c_custkey || '@' || lower(c_mktsegment) || '.com.mx' AS email FROM customer")
def spoken_email_roundtrip(spark, d):
    email = F.concat(F.lit("cliente_"), F.col("c_custkey").cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".com.mx"))
    said = F.when(F.col("c_custkey") % 2 == 0, spoken.say_email(email)).otherwise(spoken.say_email(email, "spelled"))
    return table(spark, d, "customer").select("c_custkey", said.alias("said")).select("c_custkey", spoken.read_emails("said").alias("email"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN 'De la ' || array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') END AS name FROM part")
def normalize_name(spark, d):
    raw = F.concat(F.lit(" DE  la "), F.col("p_name"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey").cast("string")).otherwise(""))
    return table(spark, d, "part").select("p_partkey", T.normalize_name(raw).alias("name"))


def _sound_sql(word: str) -> str:
    for pattern, sound in [("ch", "C"), ("ll", "y"), ("qu", "k"), ("gu([ei])", "G\\1"), ("c([ei])", "s\\1"), ("c", "k"), ("z", "s"), ("g([ei])", "j\\1"), ("^x", "j"), ("x", "ks"), ("h", ""), ("v", "b"), ("w", "u")] + [("y([^aeiou]|$)", "i\\1")] * 2:
        word = f"regexp_replace({word}, '{pattern}', '{sound}', 'g')"
    return f"replace(replace(array_to_string(list_filter(string_split({word}, ''), lambda x, i: i = 1 OR x <> string_split({word}, '')[i - 1]), ''), 'C', 'ch'), 'G', 'g')"


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split({FOLD}, ' ')) AS w FROM documents), k AS (SELECT w, {_sound_sql("w")} AS key FROM w WHERE regexp_full_match(w, '[a-zñ]+'))
SELECT key, count(*) AS spellings, min(w) AS first FROM k GROUP BY 1 HAVING count(*) > 1""")
def ambiguous_spellings(spark, d):
    return C.ambiguous_spellings(table(spark, d, "documents"))


DOC_SPLIT = SPLIT.replace("conv_id", "doc_id")


@query(f"SELECT source, count(DISTINCT CASE WHEN {DOC_SPLIT} <= 0.8 THEN 'train' WHEN {DOC_SPLIT} <= 0.9 THEN 'val' ELSE 'test' END) AS splits FROM documents GROUP BY 1 HAVING splits > 1")
def split_leakage(spark, d):
    return C.split_leaks(table(spark, d, "documents").select("source", C.split_of(F.col("doc_id")).alias("split")), "source", "split")


@query("SELECT DISTINCT r_name, n_name, c_mktsegment, k FROM (SELECT DISTINCT c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), range(1, 5) t(k)")
def cross_space(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("c_mktsegment", "n_name", "r_name").distinct().select("*", F.explode(F.sequence(F.lit(1), F.lit(4)).cast("array<long>")).alias("k"))


@query(None)
def greedy_dedup(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("place"), F.struct("user_id", F.to_date("ts")).alias("id"), F.struct("event_type", F.date_trunc("hour", "ts")).alias("content"))
    return C.greedy_two_key(rows)


@query(None)
def cv_ece(spark, d):
    return C.held_out_ece(C.scored(table(spark, d, "embeddings")), "vec_id")


@query("SELECT lang, count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(doc_id || chr(31) || lang || chr(31) || n_chars), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM documents GROUP BY 1")
def table_digest(spark, d):
    return C.table_digest(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "lang")


CALL_STATE = """WITH RECURSIVE t AS (SELECT user_id AS call, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_type = 'signup' THEN 'confirmed' WHEN event_type = 'error' THEN 'out_of_scope' WHEN event_type = 'purchase' AND value > 60 THEN 'call_rejected' ELSE 'gives_value' END AS intent,
least(1.0, 0.5::DOUBLE + CAST(json_extract_string(props, '$.k') AS BIGINT) / 100) >= 0.75 AS sure, event_type IN ('view', 'click') AND json_extract_string(props, '$.k') IS NOT NULL AS said FROM events),
s AS (SELECT DISTINCT call, 0::BIGINT AS n, 0::BIGINT AS turns, 0 AS field, false AS reading, 0 AS failed, 0::BIGINT AS failures, 0::BIGINT AS clarified, 0::BIGINT AS w0, 0::BIGINT AS w1, NULL::VARCHAR AS outcome FROM t
UNION ALL SELECT call, n + 1, CASE WHEN outcome IS NULL THEN turns + 1 ELSE turns END, CASE WHEN kind IN ('write', 'mark') THEN field + 1 ELSE field END, CASE WHEN kind IN ('write', 'mark') THEN false WHEN kind = 'talk' THEN usable ELSE reading END,
CASE WHEN kind IN ('write', 'mark') THEN 0 WHEN kind = 'talk' AND fails THEN failed + 1 ELSE failed END, CASE WHEN kind = 'talk' AND fails THEN failures + 1 ELSE failures END, CASE WHEN kind = 'clarify' THEN clarified + 1 ELSE clarified END,
CASE WHEN kind = 'write' THEN w0 + 1 ELSE w0 END, CASE WHEN kind = 'mark' THEN w1 + 1 ELSE w1 END, CASE WHEN kind = 'reject' THEN 'rejected' WHEN kind IN ('write', 'mark') AND field = 2 THEN 'completed' ELSE outcome END
FROM (SELECT *, CASE WHEN outcome IS NOT NULL THEN 'none' WHEN intent = 'call_rejected' THEN 'reject' WHEN intent = 'out_of_scope' AND clarified < 2 THEN 'clarify' WHEN confirmed THEN 'write' WHEN fails AND failed >= 2 THEN 'mark' ELSE 'talk' END AS kind
FROM (SELECT *, NOT confirmed AND (reading OR NOT usable) AS fails FROM (SELECT s.*, t.intent, s.reading AND t.intent = 'confirmed' AND t.sure AS confirmed, t.said AND t.sure AS usable FROM s JOIN t ON t.call = s.call AND t.n = s.n + 1))))
SELECT call, turns, coalesce(outcome, 'open') AS outcome, w0 AS validated, w1 AS unvalidated, clarified AS clarifications, failures FROM s QUALIFY row_number() OVER (PARTITION BY call ORDER BY n DESC) = 1"""


@query(CALL_STATE)
def call_state_fold(spark, d):
    return calls.fold_calls(call_turns(spark, d))


def call_turns(spark, d):
    """Turns of calls, told from events."""
    # What each type of event stands for.
    intent = F.when(F.col("event_type") == "signup", "confirmed").when(F.col("event_type") == "error", "out_of_scope").when((F.col("event_type") == "purchase") & (F.col("value") > 60), "call_rejected").otherwise("gives_value")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        F.col("user_id").alias("call"), F.struct("ts", "event_id").alias("seq"), intent.alias("intent"), F.least(F.lit(1.0), F.lit(0.5) + k / 100).alias("confidence"),
        F.when(F.col("event_type").isin("view", "click"), k.cast("string")).alias("value"), "ts",
    )


@query("""WITH p AS (SELECT CASE event_type WHEN 'click' THEN 'barge_in' WHEN 'signup' THEN 'signup' ELSE 'latency' END AS kind, * FROM events)
SELECT kind, problem, count(*) AS n FROM (SELECT kind, unnest(CASE kind WHEN 'barge_in' THEN CASE WHEN value > 100 THEN ['out_of_bounds:p_real'] ELSE [] END WHEN 'signup' THEN ['unknown_type']
ELSE list_filter([CASE WHEN event_id % 11 = 0 THEN 'missing:endpointing_ms' END, CASE WHEN event_id % 13 = 0 AND value > 0 THEN 'out_of_bounds:end_to_end_ms' END], lambda x: x IS NOT NULL) END) AS problem FROM p) GROUP BY 1, 2""")
def event_schema_check(spark, d):
    e = table(spark, d, "events").withColumn("turn_idx", F.get_json_object("props", "$.k").cast("int"))
    barge = F.to_json(F.struct("turn_idx", (F.col("value") / 100).alias("p_real"), (F.col("event_id") % 3 == 0).alias("interrupted")))
    late = F.to_json(F.struct("turn_idx", F.when(F.col("event_id") % 13 == 0, -F.col("value")).otherwise(F.col("value")).alias("end_to_end_ms"), F.when(F.col("event_id") % 11 != 0, 1.5).alias("endpointing_ms")))
    kind = F.when(F.col("event_type") == "click", "barge_in").when(F.col("event_type") == "signup", "signup").otherwise("latency")
    rows = e.select(kind.alias("kind"), F.when(F.col("event_type") == "click", barge).otherwise(late).alias("payload"))
    return rows.select("kind", F.explode(checks.problems(F.col("payload"), F.col("kind"), checks.EVENTS)).alias("problem")).groupBy("kind", "problem").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(CASE WHEN (toxic = 1) <> (quality = 1) THEN 'source' WHEN toxic = 1 AND trim(text) = '' THEN 'response' WHEN toxic <> 1 AND doc_id % 7 = 0 THEN 'field' END, 'ok') AS problem, count(*) AS n
FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def example_schema_check(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    task, source = F.when(F.col("toxic") == 1, "replay").otherwise("extract_entity"), F.when(F.col("quality") == 1, "replay").otherwise("template")
    inputs = F.to_json(F.struct(F.lit("phone").alias("field"), F.col("text").alias("transcript")))
    outputs = F.to_json(F.struct(F.when(F.col("doc_id") % 7 == 0, "name").otherwise("phone").alias("field"), F.trim("text").alias("response")))
    id = F.col("doc_id").cast("string")
    problem = checks.example_problem(task, source, id, id, inputs, outputs)
    return rows.groupBy(F.coalesce(problem, F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


def _noised(spark, d):
    digits = F.concat(F.lit("55"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    said = spread(table(spark, d, "customer"), "c_custkey").select("c_custkey", F.concat(F.lit("+52"), digits).alias("phone"), spoken.say_phone(digits).alias("said"))
    rows = said.select("c_custkey", "phone", F.concat(F.lit("mi número es "), "said").alias("text"), F.lit(13).alias("start"), (F.length("said") + 13).alias("end"))
    return A.add_noise(A.variants(rows, 4), "text", F.col("wer"), F.concat_ws(":", "c_custkey", "k"), "start", "end")


@query(None)
def augment_variants(spark, d):
    return A.relabel_phone(_noised(spark, d), "phone").select("c_custkey", "k", "wer", "noised", "label", "outcome", F.round("measured", 6).alias("measured"))


@query(None)
def wer_mean(spark, d):
    return _noised(spark, d).groupBy("k", "wer").agg(F.count("*").alias("n"), F.round(F.avg("measured"), 4).alias("measured"))


# What the phrase queries make of a part: its task by key, its label, its phrases as a model would reply.
TASK_SQL = "CASE p_partkey % 3 WHEN 0 THEN 'extract_entity' WHEN 1 THEN 'classify_intent' ELSE 'is_real_interruption' END"
PHRASES_SQL = f"""WITH r AS (SELECT p_partkey AS place, {TASK_SQL} AS task, p_type AS label, unnest([p_name, p_name || ' {{value}}', p_brand, p_name || ' ' || repeat(p_type || ' ', p_size)]) AS text, unnest([0, 1, 2, 3]) AS nr FROM part),
c AS (SELECT place, nr, task, label, trim(text) AS text, len(string_split(replace(trim(text), '{{value}}', 'x'), ' ')) AS words, contains(text, '{{value}}') AS framed FROM r),
j AS (SELECT *, task || '|' || label || '|' || lower(replace(text, '{{value}}', 'valor')) AS key, CASE WHEN framed <> (task = 'extract_entity') THEN 'value' WHEN regexp_matches(text, '[0-9]') THEN 'forbidden'
WHEN words > CASE task WHEN 'extract_entity' THEN 30 WHEN 'classify_intent' THEN 25 ELSE 8 END THEN 'words' END AS reason FROM c),
b AS (SELECT DISTINCT {TASK_SQL} || '|' || p_type || '|' || lower(p_name) AS key FROM part WHERE p_size > 45),
k AS (SELECT key, min(place * 4 + nr) AS first, count(*) AS n FROM j WHERE reason IS NULL AND key NOT IN (SELECT key FROM b) GROUP BY key)"""


def _phrases(spark, d):
    k = F.col("p_partkey") % 3
    task = F.when(k == 0, "extract_entity").when(k == 1, "classify_intent").otherwise("is_real_interruption")
    long = F.concat_ws(" ", "p_name", F.expr("repeat(p_type || ' ', p_size)"))
    quoted = F.concat(F.lit('"'), "p_name", F.lit(' {value}"'))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(F.col("p_name"), quoted, F.col("p_brand"), long).alias("phrases"))), F.lit("\n```"))
    part = spread(table(spark, d, "part"), "p_partkey").withColumn("task", task)
    bank = part.where("p_size > 45").select("task", F.col("p_type").alias("label"), F.col("p_name").alias("text"))
    found = B.candidates(part.select("task", F.col("p_type").alias("label"), reply.alias("reply"), F.col("p_partkey").alias("place")))
    return found, B.new_phrases(found, bank)


@query(PHRASES_SQL + " SELECT 'cp-' || substr(sha256(k.key), 1, 12) AS id, task, label, text, 'pending' AS status, n FROM k JOIN j ON j.key = k.key AND place * 4 + nr = first")
def phrase_bank(spark, d):
    return _phrases(spark, d)[1]


@query(PHRASES_SQL + ", p AS (SELECT coalesce(reason, 'duplicate') AS reason, count(*) AS n FROM j GROUP BY 1) SELECT reason, n - CASE WHEN reason = 'duplicate' THEN (SELECT count(*) FROM k) ELSE 0 END AS n FROM p")
def phrase_rejections(spark, d):
    return B.rejections(*_phrases(spark, d))


@query(f"""WITH l AS (SELECT DISTINCT {TASK_SQL} AS task, p_brand AS label FROM part), c AS (SELECT task, count(*) AS labels, CASE task WHEN 'extract_entity' THEN 0.5 WHEN 'classify_intent' THEN 0.3 ELSE 0.2 END AS share FROM l GROUP BY 1),
r AS (SELECT task, label, unnest(range(0, CAST(ceil(4000.0::DOUBLE * share * 1.5 / labels / 8) AS BIGINT))) AS i FROM l JOIN c USING (task))
SELECT task, label, CAST(i AS INTEGER) AS i, CASE i % 3 WHEN 0 THEN 'cooperative' WHEN 1 THEN 'rushed' ELSE 'distracted' END AS persona, 8 AS n, CAST('0x' || substr(sha256(task || ':' || label || ':' || i), 1, 8) AS BIGINT) AS seed,
CASE WHEN task = 'classify_intent' THEN CASE i % 2 WHEN 0 THEN '¿Es correcto?' ELSE '¿Podrá asistir?' END END AS context FROM r""")
def phrase_requests(spark, d):
    k = F.col("p_partkey") % 3
    task = F.when(k == 0, "extract_entity").when(k == 1, "classify_intent").otherwise("is_real_interruption")
    share = F.when(k == 0, 0.5).when(k == 1, 0.3).otherwise(0.2)
    contexts = F.when(k == 1, F.array(F.lit("¿Es correcto?"), F.lit("¿Podrá asistir?")))
    labels = table(spark, d, "part").select(task.alias("task"), F.col("p_brand").alias("label"), share.alias("share"), contexts.alias("contexts"))
    return B.requests(labels, 4000, 1.5, 8, ["cooperative", "rushed", "distracted"])


# A few settings for the example queries.
FLOWS = [("validate_contact", "Tengo 81 82 34 56 78. ¿Es correcto?", ["ECONOMY", "PROMO"]), ("confirm_appointment", "¿Nos confirma su asistencia?", ["ECONOMY", "STANDARD"])]
UTTERANCES = ["Le llamo para confirmar su cita de mañana", "¿Es correcto?", "Perfecto"]


@query("""WITH f AS (SELECT * FROM (VALUES ('validate_contact', 'Tengo 81 82 34 56 78. ¿Es correcto?', 'ECONOMY'), ('validate_contact', 'Tengo 81 82 34 56 78. ¿Es correcto?', 'PROMO'), ('confirm_appointment', '¿Nos confirma su asistencia?', 'ECONOMY'),
('confirm_appointment', '¿Nos confirma su asistencia?', 'STANDARD')) t(flow, context, intent)), p AS (SELECT DISTINCT p_type AS intent, p_name AS transcript FROM part)
SELECT 'syn-classify_intent-' || substr(sha256(flow || chr(0) || context || chr(0) || transcript || chr(0) || intent), 1, 12) AS id, flow, context, transcript, intent, 0.95::DOUBLE AS confidence FROM f JOIN p USING (intent)""")
def intent_examples(spark, d):
    return X.intent_examples(table(spark, d, "part").select(F.col("p_type").alias("label"), F.col("p_name").alias("text")), FLOWS)


@query("""WITH u AS (SELECT u, string_split(u, ' ') AS w FROM (VALUES ('Le llamo para confirmar su cita de mañana'), ('¿Es correcto?'), ('Perfecto')) t(u)), s AS (SELECT u, w, unnest(range(1, len(w))) AS pos FROM u),
p AS (SELECT DISTINCT p_name AS transcript, CASE WHEN p_size % 2 = 0 THEN 'backchannel' ELSE 'objection' END AS kind FROM part)
SELECT 'syn-is_real_interruption-' || substr(sha256(u || chr(0) || pos || chr(0) || transcript || chr(0) || kind), 1, 12) AS id, u AS agent_utterance, CAST(pos AS INTEGER) AS position, array_to_string(w[1:pos], ' ') AS agent_said,
transcript, kind, kind <> 'backchannel' AS interruption, 0.95::DOUBLE AS confidence FROM s, p""")
def interruption_examples(spark, d):
    kind = F.when(F.col("p_size") % 2 == 0, "backchannel").otherwise("objection")
    return X.interruption_examples(table(spark, d, "part").select(kind.alias("kind"), F.col("p_name").alias("text")), UTTERANCES)


def entity_people(spark, d):
    digits = F.concat(F.lit("55"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    email = F.concat(F.lit("cliente_"), F.col("c_custkey").cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".com.mx"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.regexp_replace(F.translate("n_name", "_0123456789", " "), r"\\s+$", ""), F.lit(" Ybarra")).alias("name"))
    return table(spark, d, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("id"), "name", digits.alias("phone"), email.alias("email"))


ENTITY = {"frames": ["{value}", "claro, {value}", "{value}, ¿ya?"], "refusals": {"name": ["prefiero no decirle"], "phone": ["luego se lo paso"], "email": ["no tengo correo"]}, "unclear": ["ybarra"]}


@query(None)
def entity_examples(spark, d):
    return X.entity_examples(entity_people(spark, d), **ENTITY)


@query("""WITH o AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS c, value FROM events),
p AS (SELECT event_id, event_type, CASE event_type WHEN 'view' THEN c WHEN 'click' THEN 1 - c WHEN 'signup' THEN 1 - c WHEN 'purchase' THEN CASE WHEN value BETWEEN 0 AND 100 THEN round(value / 100, 4) ELSE 0.5 END ELSE 0.5 END AS p FROM o)
SELECT event_id, round(p, 6) AS p_real, p >= 0.35 OR event_type = 'signup' AS interrupts FROM p""")
def interruption_decisions(spark, d):
    c = F.get_json_object("props", "$.k").cast("double") / 100
    of = lambda yes, confidence, **more: F.to_json(F.struct(F.lit(yes).alias("interruption"), confidence.alias("confidence"), *(F.lit(v).alias(k) for k, v in more.items())))
    output = (
        F.when(F.col("event_type") == "view", of(True, c)).when(F.col("event_type") == "click", of(False, c, kind="backchannel"))
        .when(F.col("event_type") == "signup", of(False, c, kind="rejection")).when(F.col("event_type") == "purchase", of(True, F.round(F.col("value") / 100, 4))).otherwise("no answer")
    )
    p_real, interrupts = decisions.interruption(output, 0.35)
    return table(spark, d, "events").select("event_id", F.round(p_real, 6).alias("p_real"), interrupts.alias("interrupts"))


@query("""WITH s AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE 'src_' || c_custkey END AS name, c_custkey % 3 AS k, c_custkey AS i FROM customer)
SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN i % 5 = 0 THEN 'name' END, CASE WHEN k = 2 THEN 'kind' END, CASE WHEN k = 0 AND i % 4 = 0 THEN 'sha256' END, CASE WHEN k = 1 AND i % 7 <> 0 THEN 'revision' END,
CASE WHEN i % 11 = 0 THEN 'license' END, CASE WHEN i % 13 = 0 THEN 'verified' END], lambda x: x IS NOT NULL)) AS problem FROM s) GROUP BY 1""")
def source_problems(spark, d):
    i, sha = F.col("c_custkey"), F.sha2("c_name", 256)
    specs = table(spark, d, "customer").select(
        F.when(i % 5 == 0, F.col("c_name")).otherwise(F.concat(F.lit("src_"), i.cast("string"))).alias("name"), F.element_at(F.array(F.lit("url"), F.lit("hf_dataset"), F.lit("ftp")), (i % 3 + 1).cast("int")).alias("kind"),
        F.lit("https://a/b").alias("url"), F.when(i % 4 != 0, sha).alias("sha256"), F.lit("a/b").alias("repo_id"), F.when(i % 7 == 0, F.substring(sha, 1, 40)).otherwise("main").alias("revision"),
        F.when(i % 11 != 0, "MIT").alias("license"), F.lit("test").alias("purpose"), F.when(i % 13 != 0, i % 2 == 0).alias("verified"),
    )
    return ingest.source_problems(specs).groupBy("problem").agg(F.count("*").alias("n"))
