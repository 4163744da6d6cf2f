"""Calls as keyed state: each turn moves its call on, in batch and as a stream.

A turn has ``call, seq, intent, confidence, value`` (value: what was understood, null if nothing usable).
The call asks for each field, reads a value back, and writes it when the caller confirms. Fields that fail too
often are marked unvalidated; one rejection ends the call.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The fields asked for in order, and the limits.
FIELDS = ("name", "phone", "email")
CONFIDENCE, REPROMPTS, CLARIFICATIONS = 0.75, 2, 2
ROW = "call long, turns long, outcome string, validated long, unvalidated long, clarifications long, failures long"


def begin() -> dict:
    return {"turns": 0, "field": 0, "reading": False, "failed": 0, "failures": 0, "clarified": 0, "written": [0, 0], "outcome": None, "candidate": None, "action": None}


def step(s: dict, intent: str | None, confidence: float, value: str | None) -> dict:
    """The state after one turn, with the ``action`` it leads to: (tool, field, value), or none. An ended call stays as it is."""
    s["action"] = None
    if s["outcome"]:
        return s
    s["turns"] += 1
    if intent == "call_rejected":
        s["outcome"] = "rejected"
        return s
    if intent == "out_of_scope" and s["clarified"] < CLARIFICATIONS:
        s["clarified"] += 1
        return s
    confirmed = s["reading"] and intent == "confirmed" and confidence >= CONFIDENCE
    usable = value is not None and confidence >= CONFIDENCE
    fails = not confirmed and (s["reading"] or not usable)
    if confirmed or (fails and s["failed"] >= REPROMPTS):
        s["written"][0 if confirmed else 1] += 1
        s["action"] = ("update_contact" if confirmed else "mark_unvalidated", FIELDS[s["field"]], s["candidate"] if confirmed else None)
        s["field"], s["failed"], s["reading"] = s["field"] + 1, 0, False
        if s["field"] == len(FIELDS):
            s["outcome"] = "completed"
        return s
    s["failed"] += fails
    s["failures"] += fails
    s["reading"], s["candidate"] = usable, value if usable else None
    return s


def _row(call: int, s: dict) -> tuple:
    return call, s["turns"], s["outcome"] or "open", s["written"][0], s["written"][1], s["clarified"], s["failures"]


def _turns(pdf: pd.DataFrame) -> Iterator[tuple]:
    for call, intent, confidence, value in zip(pdf.call, pdf.intent, pdf.confidence, pdf.value):
        yield call, intent if isinstance(intent, str) else None, 0.0 if pd.isna(confidence) else float(confidence), value if isinstance(value, str) else None


def fold_calls(turns: DataFrame) -> DataFrame:
    """A row per call after its turns in order of ``seq``.

    Calls are sorted inside their partitions and read as a stream of batches with one call's state carried along,
    so that a call of any length never lies in memory. Rows with a null call are left out.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, state, names = None, begin(), [x.split()[0] for x in ROW.split(", ")]
        for pdf in batches:
            done = []
            for c, *turn in _turns(pdf):
                if c != call:
                    done += [] if call is None else [_row(call, state)]
                    call, state = c, begin()
                state = step(state, *turn)
            yield pd.DataFrame(done, columns=names)
        if call is not None:
            yield pd.DataFrame([_row(call, state)], columns=names)

    keyed = turns.where("call is not null").select("call", "seq", "intent", "confidence", "value")
    return keyed.repartition("call").sortWithinPartitions("call", "seq", "intent", "confidence", "value").mapInPandas(walk, ROW)


def call_actions(turns: DataFrame) -> DataFrame:
    """``(call, at, tool, field, value)``: the writes that calls' turns lead to; ``turns`` has ``ts`` too.

    update_contact writes the value that the caller confirmed, mark_unvalidated leaves a field for review. Calls are walked
    as in ``fold_calls``.
    """
    names = ["call", "at", "tool", "field", "value"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, state = None, begin()
        for pdf in batches:
            done = []
            for (c, *turn), at in zip(_turns(pdf), pdf.ts, strict=True):
                if c != call:
                    call, state = c, begin()
                state = step(state, *turn)
                done += [(c, at, *state["action"])] if state["action"] else []
            yield pd.DataFrame(done, columns=names)

    keyed = turns.where("call is not null").select("call", "seq", "intent", "confidence", "value", "ts")
    return keyed.repartition("call").sortWithinPartitions("call", "seq", "intent", "confidence", "value").mapInPandas(walk, "call long, at timestamp, tool string, field string, value string")


def stream_calls(turns: DataFrame, idle: str | None = None) -> DataFrame:
    """The same state kept across micro-batches; a row per call and batch in which it moved.

    Turns of a call must arrive in order of ``seq`` from batch to batch (``streaming.ordered`` takes any order). With ``idle`` (``30 minutes``) a call that is
    silent for so long ends as ``partial`` and its state goes; such a stream never runs dry, so it can't use ``availableNow``.
    """
    limit = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def move(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ROW.split(", ")]
        if state.hasTimedOut:
            s = json.loads(state.get[0])
            state.remove()
            yield pd.DataFrame([_row(key[0], s | {"outcome": s["outcome"] or "partial"})], columns=names)
            return
        s = json.loads(state.get[0]) if state.exists else begin()
        for _, *turn in _turns(pd.concat(list(pdfs)).sort_values("seq")):  # one call's turns of one micro-batch
            s = step(s, *turn)
        state.update((json.dumps(s),))
        if limit:
            state.setTimeoutDuration(limit)
        yield pd.DataFrame([_row(key[0], s)], columns=names)

    return turns.groupBy("call").applyInPandasWithState(move, ROW, "state string", "update", timeout)
