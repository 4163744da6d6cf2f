"""Arrays of probabilities as columns: softmax, temperature, argmax, likelihood, calibration bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    d = logits.cast("array<double>")
    e = F.transform(d, lambda x: F.exp(x - F.array_max(d)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def temper(p: Column, t: float | Column, floor: float = 1e-4) -> Column:
    """softmax(log p / t), with a floor under p."""
    return softmax(F.transform(p, lambda x: F.log(F.greatest(x, F.lit(floor))) / t))


def argmax_first(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def likelihood(p: Column, gold: Column) -> Column:
    return -F.log(F.greatest(F.element_at(p, gold + 1), F.lit(1e-12)))


def bin_of(confidence: Column, bins: int = 15) -> Column:
    return F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")
