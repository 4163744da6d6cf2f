"""Calls whose turns arrive in any order: a buffer in state puts them back in order of ``seq``.

Each call's turns are numbered 0, 1, 2, ... Those that are due move the call on at once; those that are early
are held until the missing one comes or event time has passed the first of them by ``patience``. Then the gap is skipped
and counted. What comes after its place was passed, or a second time, is counted as late.

A message to the state store costs more than a turn. So a call's rows are put in order ``CHUNK`` at a time, and held turns are
read and written by blocks of ``BLOCK`` places: one block lies with the call, the others are map entries. A call of any size in a
batch or in state is not gathered.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.calls import _row, begin, step

ACTION = "struct<at: timestamp, tool: string, field: string, value: string>"
OUT = f"call long, next long, turns long, outcome string, validated long, unvalidated long, clarifications long, failures long, held long, late long, skipped long, actions array<{ACTION}>"
NAMES = "call next turns outcome validated unvalidated clarifications failures held late skipped actions".split()
# Places of a block of held turns, rows put in order at a time, blocks in memory.
BLOCK, CHUNK, OPEN = 256, 16_384, 64
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which state with timers and maps needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _pack(turns: dict) -> str:
    return json.dumps([(*t[:4], t[4].isoformat()) for t in turns.values()])


def _unpack(block: str) -> dict:
    return {t[0]: (*t[:4], dt.datetime.fromisoformat(t[4])) for t in json.loads(block)}


class OrderedCalls(StatefulProcessor):
    """State of one call: how far it is, its timer, and the turns that wait; with the call is the earliest time of each block of these."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", "state string, next long, held long, late long, skipped long, timer long, oldest string, near string")
        self.early = handle.getMapState("early", "block long", "turns string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        at, actions, rows = self._load(), [], iter(rows)
        while turns := [(seq, intent, confidence, value, ts) for _, seq, ts, intent, confidence, value in islice(rows, CHUNK)]:
            for t in sorted(turns, key=itemgetter(0)):  # of one place the first to come stays the first
                self._drain(at, actions)
                seq = t[0]
                if seq == at["next"]:
                    self._apply(at, actions, t)
                elif seq < at["next"] or seq in (waits := self._block(at, seq)):
                    at["late"] += 1
                else:
                    waits[seq] = t
                    at["changed"].add(seq // BLOCK)
                    at["held"] += 1
            self._drain(at, actions)
        yield self._save(key, at, actions, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at, actions = self._load(), []
        at["timer"] = None  # Spark deletes a timer that has run
        if at["held"]:
            first = min(self._block(at, min(at["oldest"]) * BLOCK))
            at["skipped"], at["next"] = at["skipped"] + first - at["next"], first
            self._drain(at, actions)
            yield self._save(key, at, actions, timerValues)

    def _load(self) -> dict:
        """``oldest`` has the earliest time of each block as it was last put away, ``open`` the blocks in memory, ``changed`` those of them to be put away."""
        at = {"state": begin(), "next": 0, "held": 0, "late": 0, "skipped": 0, "timer": None, "oldest": {}, "open": {}, "changed": set(), "stored": set()}
        if self.call.exists():
            state, *counts, oldest, near = self.call.get()
            at |= dict(zip(("next", "held", "late", "skipped", "timer"), counts, strict=True))
            at["state"], at["oldest"] = json.loads(state), dict(json.loads(oldest))
            at["stored"] = set(at["oldest"])
            if near:
                turns = _unpack(near)
                b = min(turns) // BLOCK
                at["open"][b] = turns
                at["changed"].add(b)
                at["stored"].discard(b)
        return at

    def _apply(self, at: dict, actions: list, turn: tuple) -> None:
        _, intent, confidence, value, ts = turn
        at["state"] = step(at["state"], intent, 0.0 if confidence is None else confidence, value)
        at["next"] += 1
        if at["state"]["action"]:
            actions.append((ts, *at["state"]["action"]))

    def _block(self, at: dict, seq: int) -> dict:
        """The held turns of the block of ``seq``."""
        b = seq // BLOCK
        if b not in at["open"]:
            if len(at["open"]) == OPEN:
                self._put(at)
            at["open"][b] = _unpack(self.early.getValue((b,))[0]) if b in at["stored"] else {}
        return at["open"][b]

    def _put(self, at: dict, near: int | None = None) -> None:
        """Put away what has changed of the open blocks, all but ``near`` as map entries, and let them go."""
        for b in at["changed"]:
            turns = at["open"][b]
            if turns:
                at["oldest"][b] = min(int(t[4].timestamp() * 1000) for t in turns.values())
            else:
                at["oldest"].pop(b, None)
            if turns and b != near:
                self.early.updateValue((b,), (_pack(turns),))
                at["stored"].add(b)
            elif b in at["stored"]:
                self.early.removeKey((b,))
                at["stored"].discard(b)
        at["open"], at["changed"] = {}, set()

    def _drain(self, at: dict, actions: list) -> None:
        while at["held"] and ((b := at["next"] // BLOCK) in at["open"] or b in at["stored"]):
            turn = self._block(at, at["next"]).pop(at["next"], None)
            if turn is None:
                return
            at["changed"].add(b)
            at["held"] -= 1
            self._apply(at, actions, turn)

    def _save(self, key, at: dict, actions: list, timer) -> Row:
        near = min((b for b in at["changed"] if at["open"][b]), default=None)
        packed = None if near is None else _pack(at["open"][near])
        self._put(at, near)
        due = max(min(at["oldest"].values()) + self.patience_ms, timer.getCurrentWatermarkInMs() + 1) if at["held"] else None
        if due != at["timer"]:
            if at["timer"] is not None:
                self.handle.deleteTimer(at["timer"])
            if due is not None:
                self.handle.registerTimer(due)
        self.call.update((json.dumps(at["state"]), at["next"], at["held"], at["late"], at["skipped"], due, json.dumps(list(at["oldest"].items())), packed))
        told = _row(key[0], at["state"])[1:]
        return Row(*NAMES)(key[0], at["next"], *told, at["held"], at["late"], at["skipped"], [Row("at", "tool", "field", "value")(*a) for a in actions])

    def close(self) -> None:
        pass


def ordered_calls(turns: DataFrame, patience: str, delay: str = "0 seconds") -> DataFrame:
    """A row for each call and batch in which it moved: where it is, and the writes that followed.

    ``turns``: call, seq, ts, intent, confidence, value. ``patience`` is how long, in event time, a turn waits for those
    before it, on top of the watermark's ``delay``. Turns without a call, a seq or a time are left out.
    """
    timed = turns.withColumn("ts", F.col("ts").cast("timestamp"))
    known = timed.where("call is not null and seq is not null and ts is not null").withWatermark("ts", delay)
    waits = int(pd.Timedelta(patience).total_seconds() * 1000)
    rows = known.select(F.col("call").cast("long").alias("call"), F.col("seq").cast("long").alias("seq"), "ts", "intent", F.col("confidence").cast("double").alias("confidence"), "value")
    return rows.groupBy("call").transformWithState(OrderedCalls(waits), OUT, "Update", "EventTime")
