"""The log of topics: offsets, restarts after any batch, appends that were not finished."""

import datetime as dt

from pyspark.sql import functions as F

from cordage.sources import sinks
from cordage.streaming import topic_log

SENT = "topic string, key string, value string, at timestamp"


def sent(n, lo=0, hot=None):
    start = dt.datetime(2024, 1, 1)
    return [(hot or f"t{i % 3}", None if i % 11 == 0 else f"k{i % 5}", f"v{i}", start + dt.timedelta(minutes=i)) for i in range(lo, lo + n)]


def read(spark, path, **options):
    spark.dataSource.register(topic_log.TopicLog)
    return spark.read.format("topic_log").options(**options).load(path)


def test_offsets_are_gapless_and_in_order(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert [topic_log.append(spark.createDataFrame(rows, SENT), path) for rows in (sent(90), [], sent(200, 90, "t1"))] == [0, 1, 2]
    rows = read(spark, path).collect()
    assert sorted(r.value for r in rows) == sorted(v for _, _, v, _ in sent(290))
    by = {}
    for r in rows:
        by.setdefault((r.topic, r.partition), []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(range(len(own))) and [r.at for r in own] == sorted(r.at for r in own)
    assert len({(r.key, r.topic) for r in rows if r.key}) == len({(r.key, r.topic, r.partition) for r in rows if r.key})
    assert {(r.topic, r.partition): r.end for r in topic_log.ends(spark, path).collect()} == {k: len(v) for k, v in by.items()}
    assert {r.topic for r in read(spark, path, topics="t0,t2").collect()} == {"t0", "t2"} and read(spark, path, topics="no").count() == 0
    assert rows[0].at.year == 2024 and read(spark, path).where("value = 'v7'").first().at == dt.datetime(2024, 1, 1, 0, 7)


def test_a_stream_stopped_after_any_batch_reads_each_row_once(spark, tmp_path):
    path, out = f"{tmp_path}/log", f"{tmp_path}/out"
    spark.dataSource.register(topic_log.TopicLog)
    for k in range(3):
        topic_log.append(spark.createDataFrame(sent(20, 20 * k), SENT), path)
        for _ in range(1 + k % 2):  # again with nothing new
            stream = spark.readStream.format("topic_log").load(path)
            stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(out).awaitTermination()
        got = spark.read.parquet(out)
        assert got.count() == got.select("value").distinct().count() == 20 * (k + 1)


def test_a_batch_that_failed_is_read_again(spark, tmp_path):
    path, seen = f"{tmp_path}/log", []
    spark.dataSource.register(topic_log.TopicLog)
    topic_log.append(spark.createDataFrame(sent(10), SENT), path)

    def once(rows, batch):
        got = sorted(r.value for r in rows.collect())
        seen.append((batch, got))
        if len(seen) == 1:
            raise OSError("lost")

    def go():
        q = spark.readStream.format("topic_log").load(path).writeStream.foreachBatch(once).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception as e:  # noqa: BLE001
            assert "lost" in str(e)

    go()
    topic_log.append(spark.createDataFrame(sent(5, 10), SENT), path)
    go(), go()  # a run that begins with a failed batch may end with it
    assert seen[0] == seen[1] and [v for _, vs in seen[1:] for v in vs] == sorted(f"v{i}" for i in range(10)) + sorted(f"v{i}" for i in range(10, 15))


def test_an_unfinished_append_is_not_read_and_replaced(spark, tmp_path):
    path = f"{tmp_path}/log"
    topic_log.append(spark.createDataFrame(sent(10), SENT), path)
    topic_log.append(spark.createDataFrame(sent(10, 10), SENT), path)
    fs, done = sinks._fs(spark, f"{path}/append=0000000001/ends/_SUCCESS")
    fs.delete(done, True)
    assert read(spark, path).count() == 10
    assert topic_log.append(spark.createDataFrame(sent(7, 50), SENT), path) == 1
    assert read(spark, path).count() == 17 and read(spark, path).where("value = 'v12'").count() == 0
    assert read(spark, path).groupBy("topic", "partition").agg((F.max("offset") + 1 == F.count("*")).alias("whole")).where("not whole").count() == 0


def test_an_empty_log(spark, tmp_path):
    assert topic_log.append(spark.createDataFrame([], SENT), f"{tmp_path}/log") == 0
    assert read(spark, f"{tmp_path}/log").count() == 0 and topic_log.ends(spark, f"{tmp_path}/log").count() == 0
    assert read(spark, f"file://{tmp_path}/none").count() == 0
