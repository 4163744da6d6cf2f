"""Checks of JSON objects against rules by type: what must be there, closed vocabularies and bounds, all problems at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import structured
from ..functions.once import once


@dataclass(frozen=True)
class Rule:
    required: tuple[str, ...] = ()
    vocabulary: dict[str, tuple[str, ...]] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    texts: tuple[str, ...] = ()  # keys that hold a string

    def kind(self, name: str) -> str:
        """The JSON type of a key's value, as its other rules imply."""
        if name in self.vocabulary:
            return "boolean" if self.vocabulary[name] == ("true", "false") else "string"
        if name in self.bounds:
            return "integer" if name in WHOLE else "number|null" if name in NULLABLE else "number"
        return "string" if name in self.texts else "any"


# Bounded keys whose numbers are whole, and those that may be null.
WHOLE, NULLABLE = ("turn_idx", "turns"), ("asr_confidence",)
NUMBER = r"BIGINT|DECIMAL.*|DOUBLE|FLOAT"
KINDS = {"string": "STRING", "boolean": "BOOLEAN", "integer": NUMBER, "number": NUMBER, "number|null": NUMBER + "|VOID", "object": "OBJECT.*"}

TURN, UP = {"turn_idx": (0, float("inf"))}, (0.0, float("inf"))
# The payload of each type of call event.
EVENTS = {
    "call_started": Rule(("flow", "contact_id", "model_version", "prompt_hash", "synthetic"), {"flow": ("validate_contact", "confirm_appointment"), "synthetic": ("true", "false")}),
    "turn_started": Rule(("turn_idx", "speaker"), {"speaker": ("agent", "person")}, TURN),
    "asr_partial": Rule(("turn_idx", "text"), {}, TURN | {"asr_confidence": (0, 1)}, ("text",)),
    "asr_final": Rule(("turn_idx", "text"), {}, TURN | {"asr_confidence": (0, 1)}, ("text",)),
    "decision": Rule(("turn_idx", "task", "output", "latency_ms"), {"task": ("classify_intent", "is_real_interruption")}, {"latency_ms": UP}),
    "llm_response": Rule(
        ("turn_idx", "task", "prompt_version", "prompt_sha256", "json_valid", "latency_ms"),
        {"task": ("extract_entity", "parse_datetime", "classify_intent"), "json_valid": ("true", "false")}, {"latency_ms": UP},
    ),
    "tool_invoked": Rule(("turn_idx", "tool"), {"tool": ("update_contact", "mark_unvalidated", "mark_confirmed", "reschedule")}),
    "tts_done": Rule(("turn_idx", "text", "duration_ms"), {}, {"duration_ms": UP}),
    "latency": Rule(("turn_idx", "end_to_end_ms", "endpointing_ms"), {}, {"end_to_end_ms": UP, "endpointing_ms": UP}),
    "barge_in": Rule(("turn_idx", "interrupted", "p_real"), {"interrupted": ("true", "false")}, {"p_real": (0, 1)}),
    "call_ended": Rule(("outcome", "turns"), {"outcome": ("completed", "rejected", "partial", "failed")}, {"turns": UP}),
}
# Tasks of training examples and the sources each may have.
TASKS = ("extract_entity", "parse_datetime", "classify_intent", "is_real_interruption")


def problems(payload: Column, kind: Column, rules: dict[str, Rule]) -> Column:
    """Names of what is wrong, in order: ``not_an_object``, ``unknown_type``, ``missing:x``, ``not_allowed:x``, ``out_of_bounds:x``."""
    parts = F.struct(payload.alias("payload"), F.json_object_keys(payload).alias("keys"), kind.alias("kind"))
    return once(parts, lambda x: _problems(x["payload"], x["keys"], x["kind"], rules))


def _problems(payload: Column, keys: Column, kind: Column, rules: dict[str, Rule]) -> Column:
    get = lambda name: F.get_json_object(payload, f"$.{name}")
    found = [F.when(keys.isNull(), "not_an_object"), F.when(kind.isNull() | ~kind.isin(*rules), "unknown_type")]
    of = lambda what: {n: [t for t, r in rules.items() if n in getattr(r, what)] for r in rules.values() for n in getattr(r, what)}
    for name, types in of("required").items():
        found.append(F.when(kind.isin(*types) & keys.isNotNull() & ~F.array_contains(keys, name), f"missing:{name}"))
    for what, label in (("vocabulary", "not_allowed"), ("bounds", "out_of_bounds")):
        for name, types in of(what).items():
            value = get(name)
            for t in types:
                limit = getattr(rules[t], what)[name]
                good = value.isin(*limit) if what == "vocabulary" else value.try_cast("double").between(*limit)
                found.append(F.when((kind == t) & value.isNotNull() & ~F.coalesce(good, F.lit(False)), f"{label}:{name}"))
    return F.array_compact(F.array(*found))


def example_problem(task: Column, source: Column, id: Column, group: Column, inputs: Column, outputs: Column) -> Column:
    """The first thing wrong with a training example, or null."""
    response = F.get_json_object(outputs, "$.response")
    both_field = F.get_json_object(inputs, "$.field").eqNullSafe(F.get_json_object(outputs, "$.field"))
    return (
        F.when(F.coalesce(id, F.lit("")) == "", "id").when(F.coalesce(group, F.lit("")) == "", "group")
        .when(task.isNull() | ~task.isin(*TASKS, "replay"), "task")
        .when(source.isNull() | ((task == "replay") != (source == "replay")) | ~source.isin("template", "carrier", "replay"), "source")
        .when(F.json_object_keys(inputs).isNull(), "input").when(F.json_object_keys(outputs).isNull(), "output")
        .when((task == "replay") & (F.coalesce(response, F.lit("")) == ""), "response")
        .when((task == "extract_entity") & ~both_field, "field")
    )


def _wrong_kind(v: Column, name: str, kind: str) -> Column:
    """Whether the key is there with a value of another JSON type than ``kind``."""
    found = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    right = found.rlike(f"^({KINDS[kind]})$")
    if kind == "integer":
        number = F.try_variant_get(v, f"$.{name}", "double")
        right = right & (number == F.floor(number))
    return ~F.coalesce(right, F.lit(kind == "number|null"))


def _parsed(line: Column) -> Column:
    part = lambda name: F.get_json_object(line, f"$.{name}").alias(name)
    return F.struct(F.try_parse_json(line).alias("v"), F.json_object_keys(line).alias("keys"), part("payload"), part("input"), part("output"), part("meta"))


def _others(keys: Column, known: tuple[str, ...]) -> Column:
    return F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0


# The keys of an event's envelope, all required, and of an example; ``meta`` alone may be missing.
ENVELOPE = ("schema_version", "event_id", "call_id", "seq", "ts", "type", "payload")
EXAMPLE = ("schema_version", "id", "group", "task", "source", "input", "output", "meta")
VERSION = 1
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"
TIME = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z"


def event_problems(line: Column, rules: dict[str, Rule] | None = None) -> Column:
    """Names of all that is wrong with a line of JSON as a call event: its envelope is strict, its payload goes by type.

    ``not_json`` or ``not_object`` alone; else ``extra_keys``, ``missing:k``, ``version``, ``type:k`` (of another JSON type),
    ``value:k``, then the payload's ``payload_type:k`` and ``problems``. Null and empty lines are ``not_json``. Numbers such as
    1.0 are whole, as JSON Schema has it.
    """
    return once(_parsed(line), lambda x: _event_problems(x, EVENTS if rules is None else rules))


def _event_problems(x: Column, rules: dict[str, Rule]) -> Column:
    v, keys, payload = x["v"], x["keys"], x["payload"]
    of = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    there = lambda name: F.array_contains(keys, name)
    number = lambda name: F.try_variant_get(v, f"$.{name}", "double")
    kinds = {"event_id": "string", "call_id": "string", "seq": "integer", "ts": "string", "payload": "object"}
    bad = {
        "event_id": ~of("event_id").rlike(UUID), "call_id": of("call_id") == "", "seq": number("seq") < 0,
        "ts": ~of("ts").rlike(TIME) | F.try_to_timestamp(F.translate(of("ts"), "tz", "TZ")).isNull(),
    }
    found = [F.when(_others(keys, ENVELOPE), "extra_keys"), *(F.when(~there(k), f"missing:{k}") for k in ENVELOPE)]
    found.append(F.when(there("schema_version") & (_wrong_kind(v, "schema_version", "integer") | (number("schema_version") != VERSION)), "version"))
    for k, kind in kinds.items():
        wrong = _wrong_kind(v, k, kind)
        found.append(F.when(there(k) & wrong, f"type:{k}").when(there(k) & bad.get(k, F.lit(False)), f"value:{k}"))
    kind = F.when(~_wrong_kind(v, "type", "string"), of("type"))
    parts = F.struct(kind.alias("kind"), F.try_variant_get(v, "$.payload", "variant").alias("inner"), F.json_object_keys(payload).alias("inside"))
    told = once(parts, lambda p: _payload_problems(p, payload, keys, rules))
    whole = F.concat(F.array_compact(F.array(*found)), told)
    return F.when(v.isNull(), F.array(F.lit("not_json"))).when(keys.isNull(), F.array(F.lit("not_object"))).otherwise(whole)


def _payload_problems(p: Column, payload: Column, keys: Column, rules: dict[str, Rule]) -> Column:
    kind, inner, inside, found = p["kind"], p["inner"], p["inside"], []
    named = {(n, r.kind(n)) for r in rules.values() for n in (*r.required, *r.vocabulary, *r.bounds)}
    for name, k in sorted((n, k) for n, k in named if k != "any"):
        types = [t for t, r in rules.items() if name in (*r.required, *r.vocabulary, *r.bounds) and r.kind(name) == k]
        found.append(F.when(kind.isin(*types) & F.array_contains(inside, name) & _wrong_kind(inner, name, k), f"payload_type:{name}"))
    # a payload that is no object is told once, by its type; an event without a type by what is missing
    within = F.when(inside.isNotNull() & F.array_contains(keys, "type"), _problems(payload, inside, kind, rules)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_compact(F.array(*found)), within)


def example_line_problem(line: Column) -> Column:
    """The first thing wrong with a line of JSON as a training example, or null.

    ``not_json``, ``not_object``, ``extra_keys``, ``missing:k``, ``version``, ``type:k``, ``meta`` (no object, or its ``wer``
    not a number from 0 to 1), then ``row_problem``. Null and empty lines are ``not_json``.
    """
    return once(_parsed(line), _example_problem)


def _example_problem(x: Column) -> Column:
    v, keys = x["v"], x["keys"]
    of = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    number = lambda name: F.try_variant_get(v, f"$.{name}", "double")
    found = F.when(v.isNull(), "not_json").when(keys.isNull(), "not_object").when(_others(keys, EXAMPLE), "extra_keys")
    for k in EXAMPLE[:-1]:
        found = found.when(~F.array_contains(keys, k), f"missing:{k}")
    found = found.when(_wrong_kind(v, "schema_version", "integer") | (number("schema_version") != VERSION), "version")
    for k, kind in (("id", "string"), ("group", "string"), ("task", "string"), ("source", "string"), ("input", "object"), ("output", "object")):
        found = found.when(_wrong_kind(v, k, kind), f"type:{k}")
    meta = F.try_variant_get(v, "$.meta", "variant")
    wer = F.array_contains(F.json_object_keys(x["meta"]), "wer")
    outside = _wrong_kind(meta, "wer", "number") | ~number("meta.wer").between(0, 1)
    found = found.when(F.array_contains(keys, "meta") & (_wrong_kind(v, "meta", "object") | F.coalesce(wer & outside, F.lit(False))), "meta")
    rest = row_problem(of("task"), of("source"), of("id"), of("group"), x["input"], x["output"])
    return F.coalesce(found, rest)


def row_problem(task: Column, source: Column, id: Column, group: Column, inputs: Column, outputs: Column) -> Column:
    """``example_problem`` with the answer's own schema (``schema``) before the comparison of fields."""
    found = example_problem(task, source, id, group, inputs, outputs)
    schema = F.when(structured.any_problem(outputs, task).isNotNull(), "schema")
    return F.coalesce(F.when(found != "field", found), schema, found)
