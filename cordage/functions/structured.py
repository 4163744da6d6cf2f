"""A model's JSON answers checked against the schema of their task, with a safe fallback, as columns.

JSON inside prose or code fences is refused, not repaired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import has_offset

# For each task its keys: whether required, the types allowed, the values allowed (a list) or their bounds (a pair).
SCHEMAS: dict[str, dict[str, tuple[bool, str, list | tuple | None]]] = {
    "extract_entity": {
        "field": (True, "string", ["name", "phone", "email"]),
        "normalized_value": (True, "string|null", None),
        "raw_span": (False, "string|null", None),
        "confidence": (True, "number", (0, 1)),
        "needs_reprompt": (True, "boolean", None),
        "reprompt_reason": (False, "string|null", ["low_confidence", "invalid_format", "partial", "not_provided"]),
    },
    "classify_intent": {
        "intent": (True, "string", ["confirmed", "cannot_attend", "ambiguous", "call_rejected", "out_of_scope"]),
        "confidence": (True, "number", (0, 1)),
        "evidence": (False, "string|null", None),
    },
    "is_real_interruption": {
        "interruption": (True, "boolean", None),
        "confidence": (True, "number", (0, 1)),
        "kind": (False, "string", ["backchannel", "correction", "objection", "rejection", "unclear"]),
    },
    "parse_datetime": {
        "datetime_iso": (True, "time|null", None),
        "precision": (True, "string", ["exact", "day", "half_day", "week", "unresolved"]),
        "alternatives": (False, "times", (0, 3)),
        "excluded": (False, "strings", None),
        "confidence": (True, "number", (0, 1)),
    },
}
TYPES = {"string": "STRING", "time": "STRING", "null": "VOID", "boolean": "BOOLEAN", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "times": "ARRAY<(STRING|VOID)>", "strings": "ARRAY<(STRING|VOID)>"}


def _key_problem(v: Column, keys: Column, name: str, required: bool, types: str, values: list | tuple | None) -> Column:
    there = F.array_contains(keys, name)
    of = lambda kind: F.try_variant_get(v, f"$.{name}", kind)
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    right = F.coalesce(kind, F.lit("VOID")).rlike("^(" + "|".join(TYPES[t] for t in types.split("|")) + ")$")
    wrong_value = F.lit(False)
    if types == "times":
        each = of("array<string>")
        wrong_value = (F.size(each) > values[1]) | F.exists(each, lambda x: x.isNull() | ~has_offset(x))
    elif types == "strings":
        wrong_value = F.exists(of("array<string>"), lambda x: x.isNull())
    elif types.startswith("time"):
        wrong_value = ~has_offset(of("string"))
    elif isinstance(values, tuple):
        wrong_value = ~of("double").between(*values)
    elif values:
        wrong_value = ~of("string").isin(values)
    tested = F.when(~right, f"type:{name}").when(wrong_value, f"value:{name}")
    return F.when(there, tested).otherwise(F.lit(f"missing:{name}") if required else F.lit(None))


def problem(raw: Column, task: str, field: Column | None = None) -> Column:
    """The first thing wrong with an answer, or null: not_json, not_object, extra, missing:k, type:k, value:k, other_field."""
    v, keys = F.try_parse_json(raw), F.json_object_keys(raw)
    found = F.when(v.isNull(), "not_json").when(keys.isNull(), "not_object")
    found = found.when(F.size(F.array_except(keys, F.array(*map(F.lit, SCHEMAS[task])))) > 0, "extra")
    found = F.coalesce(found, *(_key_problem(v, keys, name, *spec) for name, spec in SCHEMAS[task].items()))
    return found if field is None else F.coalesce(found, F.when(~F.try_variant_get(v, "$.field", "string").eqNullSafe(field), "other_field"))


def any_problem(raw: Column, task: Column, field: Column | None = None) -> Column:
    """``problem`` for a task that differs by row; tasks without a schema have none."""
    return reduce(lambda out, t: out.when(task == t, problem(raw, t, field if t == "extract_entity" else None)), SCHEMAS, F.when(task.isNull(), F.lit(None)))


def fallback(task: str, field: Column | None = None) -> Column:
    """What stands for an answer that can't be used, as JSON."""
    if task == "classify_intent":
        parts = [F.lit("ambiguous").alias("intent"), F.lit(0.0).alias("confidence")]
    elif task == "extract_entity":
        if field is None:
            raise ValueError("extract_entity needs the field that is asked for")
        null = F.lit(None).cast("string").alias("normalized_value")
        parts = [field.alias("field"), null, F.lit(0.0).alias("confidence"), F.lit(True).alias("needs_reprompt"), F.lit("low_confidence").alias("reprompt_reason")]
    elif task == "parse_datetime":
        parts = [F.lit(None).cast("string").alias("datetime_iso"), F.lit("unresolved").alias("precision"), F.lit(0.0).alias("confidence")]
    else:
        raise ValueError(f"no fallback for task {task!r}")
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def parse_structured(raw: Column, task: str, field: Column | None = None) -> Column:
    """``struct(value, valid, error)``: the answer as it came, or the task's fallback and what was wrong."""
    otherwise, error = fallback(task, field), F.coalesce(problem(raw, task, field), F.when(raw.isNull(), "not_json"))
    return F.struct(F.when(error.isNull(), raw).otherwise(otherwise).alias("value"), error.isNull().alias("valid"), error.alias("error"))
