"""Streams: turns in any order, calls as sessions, writes that are not repeated, sending that drops and counts, manifests."""

import itertools
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cordage.operators import calls
from cordage.operators import warehouse as W
from cordage.plans import call_queries, stream_queries
from cordage.sources import sinks
from cordage.streaming import actions, delivery, ordered, sessions

TURN = "call long, seq long, ts timestamp, intent string, confidence double, value string"


def batches(spark, folder, *each, schema=TURN):
    """A stream of the given lists of rows, a batch each."""
    for rows in each:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(spark, folder, moved, on_batch=None):
    out = []

    def each(rows, batch):
        out.extend(r.asDict(True) for r in rows.collect())
        if on_batch:
            on_batch(rows, batch)

    with ordered.keyed_state(spark):
        q = moved.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return out, q


def at(minute):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


def turn(call, seq, minute, intent="gives", confidence=0.9, value="v"):
    import datetime as dt

    return call, seq, dt.datetime.fromisoformat(at(minute)), intent, confidence, value


def test_turns_in_any_order_end_as_in_order(spark, tmp_path):
    rng = random.Random(1)
    turns = [turn(c, k, k, rng.choice(["gives", "confirmed", "confirmed", "out_of_scope", "call_rejected"][: 5 if c % 3 else 4]), rng.choice([0.5, 0.9]), rng.choice(["v", "w", None])) for c in range(12) for k in range(rng.randrange(1, 15))]
    parts = [[] for _ in range(3)]
    for t in turns:
        parts[rng.randrange(3)].append(t)
    for p in parts:
        rng.shuffle(p)
    parts[2] += parts[2][:4]  # repeats
    moved, _ = run(spark, tmp_path, ordered.ordered_calls(batches(spark, tmp_path, *parts), "1 hour", "1 hour"))
    last = {}
    for r in moved:
        if r["call"] not in last or r["next"] >= last[r["call"]]["next"]:
            last[r["call"]] = r
    batch = spark.createDataFrame(turns, TURN)
    names = ["turns", "outcome", "validated", "unvalidated", "clarifications", "failures"]
    assert {c: tuple(r[n] for n in names) for c, r in last.items()} == {r.call: tuple(r[n] for n in names) for r in calls.fold_calls(batch).collect()}
    assert all(r["held"] == 0 and r["skipped"] == 0 for r in last.values()) and sum(r["late"] for r in last.values()) == 4
    wrote = sorted((r["call"], a["tool"], a["field"], a["value"]) for r in moved for a in r["actions"])
    assert wrote == sorted(tuple(r) for r in calls.call_actions(batch).select("call", "tool", "field", "value").collect()) and wrote


def test_a_gap_is_waited_for_then_skipped_and_late_turns_counted(spark, tmp_path):
    stream = batches(
        spark, tmp_path,
        [turn(1, 0, 0), turn(1, 2, 2), turn(1, 3, 3), turn(2, 1, 1), (None, 0, None, "x", 0.9, "v"), (3, None, None, "x", 0.9, "v")],
        [turn(2, 0, 5), turn(9, 0, 8)],  # call 2's gap is filled in time
        [turn(9, 1, 40)],  # time passes call 1's patience
        [turn(9, 2, 41)],
        [turn(1, 1, 42), turn(1, 4, 43)],  # too late, and the next one
    )
    moved, _ = run(spark, tmp_path, ordered.ordered_calls(stream, "10 minutes", "1 minute"))
    one = [r for r in moved if r["call"] == 1]
    assert (one[0]["next"], one[0]["turns"], one[0]["held"]) == (1, 1, 2)
    assert (one[1]["next"], one[1]["turns"], one[1]["held"], one[1]["skipped"], one[1]["late"]) == (4, 3, 0, 1, 0)
    assert (one[-1]["next"], one[-1]["turns"], one[-1]["late"], one[-1]["skipped"]) == (5, 4, 1, 1)
    two = [r for r in moved if r["call"] == 2]
    assert (two[-1]["next"], two[-1]["turns"], two[-1]["held"], two[-1]["skipped"], two[-1]["late"]) == (2, 2, 0, 0, 0)
    assert {r["call"] for r in moved} == {1, 2, 9}


class Kept:
    """A state store in memory that counts what is asked of it."""

    def __init__(self):
        self.value, self.entries, self.timers, self.asked = None, {}, set(), 0

    def getValueState(self, name, *schema):  # noqa: N802
        return self

    getMapState = getValueState

    def _ask(self, out=None):
        self.asked += 1
        return out

    exists = lambda self: self._ask(self.value is not None)
    get = lambda self: self._ask(self.value)
    containsKey = lambda self, k: self._ask(k in self.entries)  # noqa: E731, N815
    getValue = lambda self, k: self._ask(self.entries[k])  # noqa: E731, N815
    removeKey = lambda self, k: self._ask(self.entries.pop(k))  # noqa: E731, N815
    keys = lambda self: self._ask(list(self.entries))
    values = lambda self: self._ask(list(self.entries.values()))
    listTimers = lambda self: self._ask(list(self.timers))  # noqa: E731, N815
    registerTimer = lambda self, t: self._ask(self.timers.add(t))  # noqa: E731, N815
    deleteTimer = lambda self, t: self._ask(self.timers.remove(t))  # noqa: E731, N815

    def update(self, value):
        self.value = self._ask(value)

    def updateValue(self, k, value):  # noqa: N802
        self.entries[k] = self._ask(value)


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def moves(batches, patience=60_000, expired=()):
    """What a call gives for each batch of ``(seq, ts, intent, confidence, value)``, and its store."""
    from pyspark.sql import Row

    store, of, out = Kept(), ordered.OrderedCalls(patience), []
    of.init(store)
    turn = Row("call", "seq", "ts", "intent", "confidence", "value")
    for rows in batches:
        out += of.handleInputRows((7,), iter([turn(7, *r) for r in rows]), At(0))
    for t in expired:
        out += of.handleExpiredTimer((7,), At(t), None)
    return out, store


def said(n, rng):
    import datetime as dt

    return [(k, dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=k), rng.choice(["gives", "confirmed", "out_of_scope"]), rng.choice([0.5, 0.9]), rng.choice(["v", "w", None])) for k in range(n)]


def test_early_turns_cost_the_state_store_few_messages():
    turns = said(600, random.Random(2))[::-1]
    out, store = moves([turns[:-1], turns[-1:]])
    assert [(r["next"], r["held"]) for r in out] == [(0, 599), (600, 0)] and not store.entries and not store.timers
    assert store.asked < 30


def test_held_turns_of_any_number_end_as_in_order(monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 4), monkeypatch.setattr(ordered, "CHUNK", 7), monkeypatch.setattr(ordered, "OPEN", 2)
    for seed in range(40):
        rng = random.Random(seed)
        turns = said(rng.randrange(1, 90), rng)
        parts = [[] for _ in range(4)]
        for t in turns:
            parts[rng.randrange(4)].append(t)
        for p in parts:
            rng.shuffle(p)
        gap = seed % 2 and len(turns) > 1
        parts = [[t for t in p if not gap or t[0]] for p in parts]  # the first turn never comes
        parts[3] += parts[0]  # repeats
        out, store = moves([p for p in parts if p])
        taken = 0
        for p, r in zip([p for p in parts if p], out, strict=True):
            taken += len({t[0] for t in p}) if p is not parts[3] else len({t[0] for t in p} - {t[0] for t in parts[0]})
            assert r["next"] + r["held"] == taken
        if gap:
            assert store.timers == {min(int(t[1].timestamp() * 1000) for t in turns[1:]) + 60_000} and out[-1]["next"] == 0
            out, store = moves([p for p in parts if p], expired=sorted(store.timers))
        state, wrote = calls.begin(), []
        for t in turns[1 if gap else 0 :]:
            state = calls.step(state, t[2], t[3], t[4])
            wrote += [(t[1], *state["action"])] if state["action"] else []
        last = out[-1]
        assert (last["next"], last["held"], last["skipped"], last["late"]) == (len(turns), 0, int(gap), len(parts[0])) and not store.entries
        assert tuple(last[:8]) == (7, len(turns), *calls._row(7, state)[1:]) and [tuple(a) for r in out for a in r["actions"]] == wrote


def test_batches_of_many_files_hold_one_part_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 10)
    rows, seen = spark.range(1000).repartition(8), []
    few = spark.range(5000, 5001)  # a batch of one row comes alone too
    stream = stream_queries._dealt(rows, F.when(F.col("id") < 3, 0).otherwise(1 + F.col("id") % 3), f"{tmp_path}/in", few, few)
    stream.writeStream.foreachBatch(lambda b, k: seen.append(sorted(r.id for r in b.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert seen == [[0, 1, 2], *([i for i in range(3, 1000) if i % 3 == k] for k in range(3)), [5000], [5000]]
    assert stream_queries._files(spark, f"{tmp_path}/in") == 6 * 4  # as many as there are cores


def test_a_batch_that_is_written_again_is_not_computed_again(spark, monkeypatch):
    kept, writer = [], actions.writer

    def spy(path, contact):
        write = writer(path, contact)
        return lambda moved, batch: (kept.append(moved.storageLevel.useMemory), write(moved, batch))

    monkeypatch.setattr(actions, "writer", spy)
    stream_queries.stream_contacts(spark, "/root/testdata/sf0.001")
    assert len(kept) > 8 and all(kept)


EVENT = "event_id string, call_id string, event_ts timestamp_ntz, type string, interrupted boolean, tool string, outcome string, turns int, flow string, contact_id string, model_version string, prompt_hash string, synthetic boolean"


def event(call, minute, kind, interrupted=None, tool=None, outcome=None, turns=None):
    import datetime as dt

    return f"{call}-{minute}-{kind}", call, dt.datetime.fromisoformat(at(minute)), kind, interrupted, tool, outcome, turns, "flow" if kind == "call_started" else None, None, None, None, None


def test_calls_from_streams_equal_the_batch_and_state_goes(spark, tmp_path):
    told = [
        [event("a", 0, "call_started"), event("b", 1, "call_started"), event("a", 2, "barge_in", interrupted=True)],
        [event("a", 3, "tool_invoked", tool="update_contact"), event("b", 4, "barge_in", interrupted=False), event("a", 5, "call_ended", outcome="completed", turns=3)],
        [event("c", 60, "call_started"), event("c", 61, "call_ended", outcome="failed", turns=0), event("d", 62, "call_ended", outcome="lost", turns=1)],  # b never ends, d never began
        [event("z", 600, "tick")], [event("z", 900, "tick")],
    ]
    stream = sessions.stream_dim_call(batches(spark, tmp_path, *told, schema=EVENT), "30 minutes", "1 minute")
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) == 0  # nothing is kept of what time has passed
    assert max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress) > 0
    got = spark.read.parquet(f"{tmp_path}/out")
    want = W.dim_call(spark.createDataFrame([e for b in told for e in b], EVENT))
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(map(tuple, got.select(want.columns).collect()), key=str)
    assert rows == sorted(map(tuple, want.collect()), key=str) and [r[0] for r in rows] == ["a", "b", "c"]


ACTED = actions.ACTIONS


def acted(minute, call, tool, field, value, contact):
    import datetime as dt

    return call, dt.datetime.fromisoformat(at(minute)), tool, field, value, contact


def test_batches_of_actions_count_once(spark, tmp_path):
    path = str(tmp_path / "contacts")
    rows = [
        [acted(1, 1, "update_contact", "phone", "+1", "x"), acted(2, 1, "mark_unvalidated", "email", None, "x"), acted(1, 1, "update_contact", "name", "A", None)],
        [acted(5, 2, "mark_unvalidated", "phone", None, "x"), acted(4, 2, "update_contact", "email", "e", "y")],
        [acted(3, 3, "update_contact", "phone", "+0", "x"), acted(4, 3, "update_contact", "email", "f", "y")],
    ]
    dfs = [spark.createDataFrame(r, ACTED) for r in rows]
    want = sorted(map(tuple, actions.contacts_of(dfs[0].unionByName(dfs[1]).unionByName(dfs[2])).collect()))
    assert want == [("x", "email", None, False), ("x", "phone", "+0", False), ("y", "email", "f", True)]
    now = lambda: sorted(map(tuple, actions.contacts(spark, path).collect()))
    assert now() == [] and actions.compact(spark, path) == -1
    assert actions.append(dfs[0], 0, path) and actions.append(dfs[1], 1, path) and actions.append(dfs[1], 1, path)
    before = now()
    assert actions.compact(spark, path) == 1 and now() == before and actions.compact(spark, path) == 1
    assert not actions.append(dfs[0], 0, path) and now() == before  # a batch that the base has is not taken again
    assert actions.append(dfs[2], 2, path) and now() == want
    fs, torn = sinks._fs(spark, f"{path}/log/batch=3")  # a folder that was not written to its end is not read
    fs.mkdirs(torn)
    dfs[0].withColumn("value", F.lit("torn")).write.mode("overwrite").parquet(f"{path}/log/batch=3")
    fs.delete(sinks._fs(spark, f"{path}/log/batch=3/_SUCCESS")[1], True)
    assert now() == want and actions.compact(spark, path) == 2 and now() == want


def failing(how):
    """A transport that fails so; made here, so that tasks need not find this module."""
    import json
    from collections import Counter

    class Failing:
        def __init__(self):
            if how == "make":
                raise OSError("down")
            self.sent = []

        def send(self, topic, key, value):
            self.sent.append(topic)
            if how == "all" or (how == "some" and json.loads(value)["event_id"] % 3 == 0):
                raise BufferError("full")

        def flush(self):
            if how == "flush":
                raise TimeoutError
            return Counter({self.sent[-1]: 1}) if how == "unflushed" and self.sent else Counter()

    return Failing


@pytest.mark.parametrize("how", ["make", "all", "some", "flush", "unflushed", "none"])
def test_sending_never_fails_and_counts_every_row(spark, tmp_path, how):
    rows = spark.range(30).select(F.col("id").cast("string").alias("key"), F.to_json(F.struct(F.col("id").alias("event_id"))).alias("value"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("topic"))
    got = delivery.deliver(rows.coalesce(1), failing(how)).collect()
    sent, dropped = sum(r.sent for r in got), sum(r.dropped for r in got)
    assert sent + dropped == 30 and dropped == {"make": 30, "all": 30, "some": 10, "flush": 30, "unflushed": 1, "none": 0}[how]
    assert {r.topic for r in got} == {"a", "b"}


def test_sending_a_stream_tells_a_listener(spark, tmp_path):
    listener = delivery.DeliveryListener()
    spark.streams.addListener(listener)
    try:
        for _ in range(2):
            spark.range(20).select(F.lit("k").alias("key"), F.to_json(F.struct(F.col("id").alias("event_id"))).alias("value"), F.lit("t").alias("topic")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = lambda: spark.readStream.schema("key string, value string, topic string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        for _ in range(2):  # a restart sends nothing again
            q = delivery.send_stream(stream(), failing("some"), f"{tmp_path}/counts", f"{tmp_path}/checkpoint")
            q.awaitTermination()
            assert q.exception() is None
        total = spark.read.parquet(f"{tmp_path}/counts").agg(F.sum("sent"), F.sum("dropped")).first()
        assert tuple(total) == (26, 14)
        for _ in range(100):
            if listener.rows == 40:
                break
            import time

            time.sleep(0.1)
        assert (listener.sent, listener.dropped, listener.rows) == (26, 14, 40)
    finally:
        spark.streams.removeListener(listener)


def test_silver_is_counted_in_the_job_that_writes_it(spark, tmp_path):
    lines = call_queries.call_lines(spark, "/root/testdata/sf0.001")
    got = W.write_silver(lines, f"{tmp_path}/silver")
    assert got == W.accounting(W.parse(lines)).first().asDict() and got["rows_duplicate"] > 0 and got["rows_invalid"] > 0
    assert spark.read.parquet(f"{tmp_path}/silver").count() == got["rows_written"]
    assert any(p.name.startswith("event_date=") and (p / "type=latency").exists() for p in (tmp_path / "silver").iterdir())
    assert W.write_silver(lines.limit(0), f"{tmp_path}/none") == {"rows_read": 0, "rows_invalid": 0, "rows_duplicate": 0, "rows_written": 0}


def test_manifests_and_digests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.jsonl").write_text("{}\n"), (tmp_path / "in" / "a.jsonl").write_text("1\n"), (tmp_path / "in" / "c.txt").write_text("no")
    first = sinks.inputs_digest(spark, f"{tmp_path}/in")
    assert (first["files"], first["bytes"]) == (2, 5)
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "a.jsonl").write_text("1\n"), (tmp_path / "again" / "b.jsonl").write_text("{}\n")
    assert sinks.inputs_digest(spark, f"{tmp_path}/again") == first
    (tmp_path / "again" / "b.jsonl").write_text("[]\n")
    assert sinks.inputs_digest(spark, f"{tmp_path}/again")["sha256"] != first["sha256"]
    with pytest.raises(FileNotFoundError):
        sinks.inputs_digest(spark, f"{tmp_path}/in", "*.csv")
    df, path = spark.createDataFrame([(i % 5, None if i % 3 else "x") for i in range(50)], "a int, b string"), f"{tmp_path}/data"
    folder = sinks.publish(df, path, manifest={"params": {"seed": 3}}, inputs=f"{tmp_path}/in")
    told = sinks.published_manifest(spark, path)
    assert told["params"] == {"seed": 3} and told["rows"] == 50 and told["inputs"] == first and sinks.changed_files(spark, path).count() == 0
    assert sinks.content_digest(df.repartition(7)) == {k: told[k] for k in ("rows", "content")} == sinks.content_digest(df.orderBy("a"))
    assert sinks.content_digest(df.limit(49))["content"] != told["content"] != sinks.content_digest(df.withColumn("b", F.lit("x")))["content"]
    assert sinks.read_published(spark, path).count() == 50
    files = [p for p in __import__("pathlib").Path(folder).iterdir() if p.name.endswith(".parquet")]
    (files[0].parent / f".{files[0].name}.crc").unlink()
    files[0].write_bytes(b"other"), files[1].unlink()
    (files[0].parent / "more.parquet").write_bytes(b"x")
    assert dict(map(tuple, sinks.changed_files(spark, path).collect())) == {files[0].name: "changed", files[1].name: "gone", "more.parquet": "unlisted"}
    assert list(itertools.chain(sinks.digests(spark, f"{tmp_path}/in", "c.txt").collect()))[0].name == "c.txt"
