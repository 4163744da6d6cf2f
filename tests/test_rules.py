import json

import pytest
from pyspark.sql import functions as F

from cordage.operators import augment, checks, dialogue, telemetry
from cordage.sources import ingest

EVENT = {"schema_version": 1, "event_id": "0b7e3f0a-6a53-4a39-9f0e-1d5c2b7a9c11", "call_id": "c", "seq": 0, "ts": "2024-02-29T10:00:00.250+00:00", "type": "turn_started", "payload": {"turn_idx": 0, "speaker": "agent"}}
EXAMPLE = {"schema_version": 1, "id": "x", "group": "g", "task": "replay", "source": "replay", "input": {"instruction": "di"}, "output": {"response": "ya"}, "meta": {"wer": 0.1}}


def told(spark, lines, check):
    rows = spark.createDataFrame([(i, x if x is None or isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)], "i int, line string")
    return [r.p for r in rows.select("i", check(F.col("line")).alias("p")).orderBy("i").collect()]


def test_event_lines(spark):
    payload = lambda kind, **p: EVENT | {"type": kind, "payload": p}
    cases = [
        (EVENT, []), (None, ["not_json"]), ("", ["not_json"]), ("{", ["not_json"]), ("7", ["not_object"]), (EVENT | {"x": None}, ["extra_keys"]),
        ({k: v for k, v in EVENT.items() if k != "ts"}, ["missing:ts"]), (EVENT | {"schema_version": "1"}, ["version"]), (EVENT | {"schema_version": 1.0}, []), (EVENT | {"event_id": 5}, ["type:event_id"]),
        (EVENT | {"event_id": "e-1"}, ["value:event_id"]), (EVENT | {"call_id": ""}, ["value:call_id"]), (EVENT | {"seq": -1}, ["value:seq"]), (EVENT | {"seq": 1.5}, ["type:seq"]), (EVENT | {"seq": None}, ["type:seq"]),
        (EVENT | {"ts": "2023-02-29T10:00:00Z"}, ["value:ts"]), (EVENT | {"ts": "2024-02-29T10:00:00"}, ["value:ts"]), (EVENT | {"payload": [1]}, ["type:payload"]), (EVENT | {"type": "other"}, ["unknown_type"]), (EVENT | {"type": 3}, ["unknown_type"]),
        (payload("asr_final", turn_idx=0, text="a", asr_confidence=None), []), (payload("asr_final", turn_idx=0, text=7), ["payload_type:text"]), (payload("asr_final", turn_idx=0.5, text="a"), ["payload_type:turn_idx"]),
        (payload("tts_done", turn_idx="a", text=7, duration_ms=-1), ["out_of_bounds:duration_ms"]), (payload("call_ended", outcome="gone", turns=2), ["not_allowed:outcome"]), (payload("turn_started", speaker="agent", turn_idx=0, more=1), []),
        (payload("barge_in", turn_idx=0, interrupted="true", p_real=0.5), ["payload_type:interrupted"]), (payload("latency", turn_idx=0, end_to_end_ms=3), ["missing:endpointing_ms"]),
    ]
    assert told(spark, [c for c, _ in cases], checks.event_problems) == [w for _, w in cases]


def test_example_lines(spark):
    intent = {"task": "classify_intent", "source": "carrier", "output": {"intent": "confirmed", "confidence": 1}}
    cases = [
        (EXAMPLE, None), ({k: v for k, v in EXAMPLE.items() if k != "meta"}, None), (None, "not_json"), ("[]", "not_object"), (EXAMPLE | {"x": 1}, "extra_keys"), (EXAMPLE | {"schema_version": 2}, "version"),
        ({k: v for k, v in EXAMPLE.items() if k != "input"}, "missing:input"), (EXAMPLE | {"id": 4}, "type:id"), (EXAMPLE | {"group": ""}, "group"), (EXAMPLE | {"input": "a"}, "type:input"), (EXAMPLE | {"meta": 1}, "meta"), (EXAMPLE | {"meta": {"wer": 1.5}}, "meta"),
        (EXAMPLE | {"meta": {"wer": "0"}}, "meta"), (EXAMPLE | {"meta": {"wer": None}}, "meta"), (EXAMPLE | {"meta": {"seed": 1}}, None), (EXAMPLE | {"output": {"response": ""}}, "response"), (EXAMPLE | {"source": "carrier"}, "source"), (EXAMPLE | intent, None),
        (EXAMPLE | intent | {"output": {"intent": "maybe", "confidence": 1}}, "schema"), (EXAMPLE | {"task": "other"}, "task"),
    ]
    assert told(spark, [c for c, _ in cases], checks.example_line_problem) == [w for _, w in cases]


def test_closing_sentences(spark):
    asked = [("a", 1, "phone", "unvalidated"), ("a", 2, "name", "validated"), ("a", 5, "phone", "validated"), ("a", 6, "email", "validated"), ("b", 1, "email", "validated"), ("b", 2, "name", "gone"), ("c", 1, "name", None), (None, 1, None, "validated"), (None, 2, "city", "validated"), ("a", 5, "phone", "validated")]
    rows = spark.createDataFrame(asked, "call_id string, seq int, field string, result string")
    got = {r.call_id: r.s for r in dialogue.results_of_calls(rows).select("call_id", dialogue.closing(F.col("results")).alias("s")).collect()}
    bye = " Gracias por su tiempo, que tenga buen día."
    assert got == {
        "a": "Listo, quedaron confirmados su teléfono, su nombre y su correo." + bye, "b": "Listo, quedó confirmado su correo. Lo demás lo revisaremos por otro medio." + bye,
        "c": "Revisaremos sus datos por otro medio." + bye, None: "Listo, quedó confirmado city." + bye,
    }
    assert dialogue.results_of_calls(rows.where("false")).count() == 0


def test_contexts_take_turns(spark):
    labels = spark.createDataFrame([("f", "yes"), ("g", "yes"), ("g", "no"), ("g", "no"), ("h", "none")], "flow string, label string")
    lines = spark.createDataFrame([("g", 0, "three"), ("f", 1, "two"), ("f", 0, "one"), ("f", 0, "one")], "flow string, place int, line string")
    contexts = dialogue.label_contexts(labels, lines)
    assert sorted(map(tuple, contexts.collect())) == [("no", 0, "three", 1), ("yes", 0, "one", 3), ("yes", 1, "two", 3), ("yes", 2, "three", 3)]
    asked = spark.createDataFrame([("yes", 4), ("yes", 2), ("no", 7), ("none", 0)], "label string, i int")
    assert sorted((r.label, r.i, r.context) for r in dialogue.with_context(asked, contexts).collect()) == [("no", 7, "three"), ("none", 0, None), ("yes", 2, "three"), ("yes", 4, "two")]
    told = spark.createDataFrame([("t", "yes", 1, "old"), ("t", "yes", 2, " says \n\tyes "), ("t", "no", 1, None)], "task string, label string, version int, description string")
    assert sorted(map(tuple, dialogue.descriptions(told).collect())) == [("t", "no", None), ("t", "yes", "says yes")]


def test_outcomes_count_what_is_dropped(spark):
    rows = [(f"x{i}", "g", "phone", "pairs", "bueno no está", None, None, None) for i in range(40)]
    rows += [(f"y{i}", "g", "phone", "pairs", "es cincuenta y cinco doce treinta y cuatro cincuenta y seis setenta y ocho", 3, 76, "+525512345678") for i in range(40)]
    made = augment.all_variants(spark.createDataFrame(rows, "id string, group string, field string, style string, transcript string, start int, stop int, truth string"), 4).withColumn("task", F.lit("t")).cache()
    want = {(r.outcome): r["count"] for r in made.groupBy("outcome").count().collect()}
    got = augment.outcomes(made).collect()
    assert {r.outcome: r.n for r in got if r.kind == "labels"} == want and sum(want.values()) == 320
    level = {r.name: (r.n, r.value) for r in got if r.kind == "wer_applied_mean"}
    assert set(level) == {"0.0", "0.05", "0.15", "0.25"} and level["0.0"] == (80 - made.where("outcome = 'dropped' AND wer_target = 0").count(), 0.0)
    assert augment.outcomes(made.where("false")).count() == 0


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", None), ("b", 4.0), ("b", 2.0), ("b", 2.0), ("c", None)], "k string, v double")
    assert sorted(map(tuple, telemetry.upper_median(rows, "v", "k").collect())) == [("a", 3.0, 2), ("b", 2.0, 3), ("c", None, 0)]


def test_verified_sources(spark):
    spec = lambda name, ok: (name, "url", "https://a", "0" * 64, None, None, "MIT", "test", ok)
    specs = spark.createDataFrame([spec("a", True), spec("b", False)], ingest.SPEC)
    assert [r.name for r in ingest.verified(specs).collect()] == ["a"] and list(map(tuple, ingest.unverified(specs).collect())) == [("b", "MIT")]
    with pytest.raises(ValueError, match="c: verified"):
        ingest.verified(spark.createDataFrame([spec("c", None)], ingest.SPEC))
