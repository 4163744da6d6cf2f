"""Queries that run as streams to their end; their SQL is that of the batch result."""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import calls
from ..operators import warehouse as W
from ..sources import sinks
from ..sources.tables import shared_folder, spread, table
from ..streaming import actions, delivery, ordered, sessions, topic_log
from ..streaming import events as S
from .call_queries import SILVER_SQL, STAR_SQL, _silver, call_lines
from .queries import CALL_STATE, _span, call_turns
from .registry import query

PARTS = 4  # batches of a stream
FILE_ROWS = 50_000  # a batch of more rows has more files


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _files(spark: SparkSession, folder: str) -> int:
    fs, files = sinks._fs(spark, f"{folder}/*.parquet")
    return len(fs.globStatus(files))


def _dealt(rows: DataFrame, part, folder: str, *then: DataFrame) -> DataFrame:
    """``rows`` as a stream of files, a batch of files each, in order of ``part``; ``then`` come after them.

    A batch has as many files as the input asks for, at most one a core, so that all cores write and read it.
    """
    spark = rows.sparkSession
    rows.withColumn("_part", part.cast("int")).write.partitionBy("_part").parquet(f"{folder}-dealt")
    dealt = spark.read.schema(f"{rows._jdf.schema().toDDL()}, _part int").parquet(f"{folder}-dealt")
    each = max(1, min(spark.sparkContext.defaultParallelism, dealt.count() // (PARTS * FILE_ROWS)))
    parts = [dealt.where(F.col("_part") == k).drop("_part").coalesce(each) for k in range(PARTS)]
    for k, batch in enumerate([*parts, *(more.coalesce(1) for more in then)]):  # one after the other: files are read in the order of their times
        batch.write.mode("append").parquet(folder)
        for _ in range((k + 1) * each - _files(spark, folder)):  # a batch of fewer files is filled with empty ones
            batch.limit(0).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(folder)


def _shuffled_turns(spark: SparkSession, d: str, folder: str) -> tuple[DataFrame, str]:
    """Turns numbered in their calls, in batches that know nothing of that order, and the disorder they have."""
    place = F.row_number().over(Window.partitionBy("call").orderBy("seq")) - 1
    turns = call_turns(spark, d).withColumn("seq", place.cast("long"))
    return _dealt(turns, F.pmod(F.xxhash64("call", "seq"), F.lit(PARTS)), folder), _span(spark, d)


@query(f"SELECT *, 0::BIGINT AS late, 0::BIGINT AS skipped FROM ({CALL_STATE})")
def stream_call_state(spark, d):
    """Calls whose turns are dealt over batches in any order end as those whose turns are read in order."""
    folder = _folder(spark)
    turns, span = _shuffled_turns(spark, d, f"{folder}/in")
    moved = ordered.ordered_calls(turns, "1 hour", span)
    write = lambda rows, batch: rows.drop("actions").write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
    with ordered.keyed_state(spark):
        moved.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    names = ["turns", "outcome", "validated", "unvalidated", "clarifications", "failures", "late", "skipped"]
    return rows.groupBy("call").agg(F.max_by(F.struct(*names), F.struct("next", "batch")).alias("r")).select("call", "r.*")


CONTACTS = """WITH RECURSIVE t AS (SELECT user_id AS call, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_type = 'signup' THEN 'confirmed' WHEN event_type = 'error' THEN 'out_of_scope' WHEN event_type = 'purchase' AND value > 60 THEN 'call_rejected' ELSE 'gives_value' END AS intent,
least(1.0, 0.5::DOUBLE + CAST(json_extract_string(props, '$.k') AS BIGINT) / 100) >= 0.75 AS sure, CASE WHEN event_type IN ('view', 'click') THEN json_extract_string(props, '$.k') END AS k FROM events),
s AS (SELECT DISTINCT call, 0::BIGINT AS n, 0 AS field, NULL::VARCHAR AS candidate, 0 AS failed, 0 AS clarified, false AS ended, NULL::VARCHAR AS tool, NULL::INTEGER AS told, NULL::VARCHAR AS value, NULL::TIMESTAMP AS done FROM t
UNION ALL SELECT call, n + 1, CASE WHEN kind IN ('write', 'mark') THEN field + 1 ELSE field END, CASE WHEN kind IN ('write', 'mark') THEN NULL WHEN kind = 'talk' THEN CASE WHEN usable THEN k END ELSE candidate END,
CASE WHEN kind IN ('write', 'mark') THEN 0 WHEN kind = 'talk' AND fails THEN failed + 1 ELSE failed END, CASE WHEN kind = 'clarify' THEN clarified + 1 ELSE clarified END, ended OR kind = 'reject' OR (kind IN ('write', 'mark') AND field = 2),
CASE kind WHEN 'write' THEN 'update_contact' WHEN 'mark' THEN 'mark_unvalidated' END, field, CASE WHEN kind = 'write' THEN candidate END, CAST(ts AS TIMESTAMP)
FROM (SELECT *, CASE WHEN ended THEN 'none' WHEN intent = 'call_rejected' THEN 'reject' WHEN intent = 'out_of_scope' AND clarified < 2 THEN 'clarify' WHEN confirmed THEN 'write' WHEN fails AND failed >= 2 THEN 'mark' ELSE 'talk' END AS kind
FROM (SELECT *, NOT confirmed AND (candidate IS NOT NULL OR NOT usable) AS fails FROM (SELECT s.*, t.intent, t.k, t.ts, s.candidate IS NOT NULL AND t.intent = 'confirmed' AND t.sure AS confirmed, t.k IS NOT NULL AND t.sure AS usable FROM s JOIN t ON t.call = s.call AND t.n = s.n + 1)))),
a AS (SELECT CAST(call % 20 AS VARCHAR) AS contact, ['name', 'phone', 'email'][told + 1] AS field, tool, value, done, call FROM s WHERE tool IS NOT NULL),
v AS (SELECT contact, field, value FROM a WHERE tool = 'update_contact' QUALIFY row_number() OVER (PARTITION BY contact, field ORDER BY done DESC, call DESC) = 1),
l AS (SELECT contact, field, tool = 'update_contact' AS validated FROM a QUALIFY row_number() OVER (PARTITION BY contact, field ORDER BY done DESC, call DESC) = 1)
SELECT l.contact, l.field, v.value, l.validated FROM l LEFT JOIN v ON l.contact = v.contact AND l.field = v.field"""


@query(CONTACTS)
def contacts_by_field(spark, d):
    return actions.contacts_of(calls.call_actions(call_turns(spark, d)).withColumn("contact", (F.col("call") % 20).cast("string")))


@query(CONTACTS)
def stream_contacts(spark, d):
    """The same from a stream whose batches are written twice, some of them again after the store was compacted."""
    folder = _folder(spark)
    turns, span = _shuffled_turns(spark, d, f"{folder}/in")
    write = actions.writer(f"{folder}/contacts", F.col("call") % 20)

    def twice(moved: DataFrame, batch: int) -> None:
        moved = moved.persist()  # calls are moved on once, however often that is written
        write(moved, batch), write(moved, batch)
        if batch == 1:
            actions.compact(spark, f"{folder}/contacts")
            write(moved, batch)
        moved.unpersist()

    with ordered.keyed_state(spark):
        ordered.ordered_calls(turns, "1 hour", span).writeStream.outputMode("update").foreachBatch(twice).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return actions.contacts(spark, f"{folder}/contacts")


@query(STAR_SQL + " SELECT * FROM calls")
def stream_dim_call(spark, d):
    """The dimension of calls from a stream; a last row a day later lets time pass the calls without an end."""
    folder = _folder(spark)
    events = _silver(spark, d).select("event_id", "call_id", "event_ts", "type", "interrupted", "tool", "outcome", "turns", "flow", "contact_id", "model_version", "prompt_hash", "synthetic")
    events.write.parquet(f"{folder}/silver")
    events = spark.read.schema(events.schema).parquet(f"{folder}/silver")
    edge = events.agg(F.percentile_approx("event_ts", [k / PARTS for k in range(1, PARTS)]).alias("at")).first()["at"] or []
    part = sum(((F.col("event_ts") > F.lit(x)).cast("int") for x in edge), F.lit(0))
    ticks = [events.agg(F.max("event_ts").alias("t")).select(*(F.lit("tick").alias(c) if c in ("event_id", "call_id", "type") else (F.col("t") + F.expr(f"INTERVAL {k} days")).alias(c) if c == "event_ts" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes)) for k in (1, 2)]
    stream = _dealt(events, part, f"{folder}/in", *ticks)
    return S.drain(sessions.stream_dim_call(stream, "6 hours", "1 minute"), folder)


class _Picky:
    """Fails for good on keys that 7 divides, and the first time on those that 5 divides."""

    def __init__(self):
        self.tried = set()

    def send(self, topic, key, value):
        if int(key) % 7 == 0 or (int(key) % 5 == 0 and value not in self.tried):
            self.tried.add(value)
            raise ConnectionError(topic)

    def flush(self):
        return Counter()


@query("""SELECT CASE WHEN event_type = 'view' THEN 'calls.transcripts' WHEN event_type = 'click' THEN 'model.inferences' ELSE 'calls.events' END AS topic, count(*) FILTER (user_id % 7 <> 0) AS sent, count(*) FILTER (user_id % 7 = 0) AS dropped FROM events GROUP BY 1""")
def topic_delivery(spark, d):
    """Events sent to their topics by a transport that fails."""
    folder = _folder(spark)
    delivery.send_stream(S.kafka_rows(S.event_stream(spark, f"{d}/events.parquet")), _Picky, f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    counts = spark.read.schema(delivery.COUNTS).parquet(f"{folder}/counts")
    return counts.groupBy("topic").agg(F.sum("sent").alias("sent"), F.sum("dropped").alias("dropped"))


@query(SILVER_SQL + """, x AS (SELECT count(*) FILTER (person AND n % 5 <> 0 AND n % 17 = 0) + count(*) FILTER (NOT person AND n % 19 = 0) + count(*) FILTER (NOT person AND n % 23 = 0) AS bad, count(*) FILTER (person AND n % 13 = 0) AS twice FROM t), g AS (SELECT count(*) AS good FROM ev)
SELECT good + bad + twice AS rows_read, bad AS rows_invalid, twice AS rows_duplicate, good AS rows_written FROM x, g""")
def silver_written(spark, d):
    """What one job that writes silver counts on the way."""
    return spark.createDataFrame([W.write_silver(call_lines(spark, d), f"{_folder(spark)}/silver")], "rows_read long, rows_invalid long, rows_duplicate long, rows_written long")


@query("SELECT count(*) AS rows, 0::BIGINT AS changed, true AS same FROM documents")
def published_manifest(spark, d):
    """Documents published twice, in other files: the manifests' digests are equal, and no file differs from its hash."""
    folder, docs = _folder(spark), table(spark, d, "documents")
    sinks.publish(docs, f"{folder}/a", manifest={"source": "documents"}), sinks.publish(spread(docs, "doc_id"), f"{folder}/b")
    a, b = (sinks.published_manifest(spark, f"{folder}/{x}") for x in "ab")
    changed = sinks.changed_files(spark, f"{folder}/a").unionByName(sinks.changed_files(spark, f"{folder}/b"))
    return changed.agg(F.lit(a["rows"]).cast("long").alias("rows"), F.count("*").alias("changed"), F.lit(a["content"] == b["content"]).alias("same"))


@query("""SELECT CASE WHEN event_type = 'view' THEN 'calls.transcripts' WHEN event_type = 'click' THEN 'model.inferences' ELSE 'calls.events' END AS topic, count(*) AS rows, count(DISTINCT event_id) AS events, count(DISTINCT user_id) AS keys, true AS gapless, true AS ordered FROM events GROUP BY 1""")
def topic_log_bronze(spark, d):
    """Events appended to a log of topics, a third at a time, and brought to bronze by a stream that starts again after each."""
    folder = _folder(spark)
    spark.dataSource.register(topic_log.TopicLog)
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sent = S.kafka_rows(rows.select("event_id", "user_id", "event_type", "ts")).withColumn("at", F.get_json_object("value", "$.ts").cast("timestamp"))
    third = F.pmod(F.xxhash64("value"), F.lit(3))
    for k in range(3):
        topic_log.append(sent.where(third == k), f"{folder}/log")
        stream = spark.readStream.format("topic_log").load(f"{folder}/log").withColumnRenamed("at", "ts")
        S.to_bronze(stream, f"{folder}/bronze", f"{folder}/checkpoint").awaitTermination()
    bronze = spark.read.parquet(f"{folder}/bronze").withColumn("event_id", F.get_json_object("value", "$.event_id")).withColumn("third", third)
    place = Window.partitionBy("topic", "partition", "key", "third").orderBy("offset")
    behind = bronze.withColumn("behind", F.lag("ts").over(place) > F.col("ts"))
    parts = behind.groupBy("topic", "partition").agg((F.max("offset") - F.min("offset") + 1 == F.count("*")).alias("whole"), F.min("offset").alias("low"), F.max("behind").alias("behind"))
    told = parts.groupBy("topic").agg(F.min(F.col("whole") & (F.col("low") == 0)).alias("gapless"), F.min(~F.coalesce("behind", F.lit(False))).alias("ordered"))
    counts = bronze.groupBy("topic").agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("events"), F.countDistinct("key").alias("keys"))
    return counts.join(told, "topic").select("topic", "rows", "events", "keys", "gapless", "ordered")
