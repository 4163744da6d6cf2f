"""Decisions on a model's JSON output, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical

# Kinds of what a caller says over the agent, and the confidence of an output that can't be used.
KINDS = ("backchannel", "correction", "objection", "rejection", "unclear")
UNSURE = 0.5


def interruption(output: Column, threshold: float) -> tuple[Column, Column]:
    """``(p_real, interrupts)`` of an output ``{"interruption", "confidence", "kind"}``.

    An output that is null, no such object, has other keys or values out of bounds counts as unsure, which interrupts, as the
    threshold must be below one half. A rejection always interrupts.
    """
    if threshold >= UNSURE:
        raise ValueError(f"the threshold must be below {UNSURE}, got {threshold}")
    v, keys = F.try_parse_json(output), F.json_object_keys(output)
    kind_of = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit(""))
    yes, confidence, kind = (F.try_variant_get(v, f"$.{n}", t) for n, t in (("interruption", "boolean"), ("confidence", "double"), ("kind", "string")))
    valid = (
        (F.size(F.array_except(keys, F.array(*map(F.lit, ("interruption", "confidence", "kind"))))) == 0) & (kind_of("interruption") == "BOOLEAN")
        & kind_of("confidence").rlike("^(BIGINT|DECIMAL|DOUBLE)") & confidence.between(0, 1)
        & (~F.array_contains(keys, "kind") | ((kind_of("kind") == "STRING") & kind.isin(*KINDS)))
    )
    valid = F.coalesce(valid, F.lit(False))
    p_real = F.when(~valid, F.lit(UNSURE)).when(yes, confidence).otherwise(1 - confidence)
    return p_real, (valid & F.coalesce(kind == "rejection", F.lit(False))) | (p_real >= threshold)


def acceptable(field: Column, value: Column, confidence: Column, needs_reprompt: Column, threshold: float) -> Column:
    """Whether an extraction may be read back: confident, not flagged by the model, and well formed."""
    return F.coalesce((confidence >= threshold) & ~needs_reprompt & canonical(field, value).isNotNull(), F.lit(False))


def intent(probabilities: Column, labels: list[str], rejection: str, threshold: float) -> Column:
    """The likeliest of ``labels`` (the first of equals), or the rejection if its probability reaches the threshold."""
    p = F.array(*(F.coalesce(F.element_at(probabilities, x), F.lit(0.0)) for x in labels))
    likeliest = F.element_at(F.array(*map(F.lit, labels)), F.array_position(p, F.array_max(p)).cast("int"))
    return F.when(F.element_at(probabilities, rejection) >= threshold, F.lit(rejection)).otherwise(likeliest)


# What a decision model calls the inputs of each task.
STATE = {"classify_intent": {"flow": "flujo", "context": "contexto", "transcript": "transcripción"}, "is_real_interruption": {"agent_utterance": "agente_dice", "transcript": "transcripción"}}


def model_state(task: str, inputs: Column) -> Column:
    """A task's inputs (a struct) under the names that the decision model knows."""
    return F.struct(*(inputs[old].alias(new) for old, new in STATE[task].items()))


def speech_confidence(words: Column) -> Column:
    """exp of the mean log probability of ``array<struct<type, logprob>>``; only words count, null without any."""
    heard = F.filter(words, lambda w: (w["type"] == "word") & w["logprob"].isNotNull())
    return F.when(F.size(heard) > 0, F.exp(F.aggregate(heard, F.lit(0.0), lambda a, w: a + w["logprob"]) / F.size(heard)))
