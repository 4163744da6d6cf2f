"""What a model, or rules without one, get right: by field and noise level, majorities, and zero-shot metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import calibration, corpus


def rule_baseline(rows: DataFrame, read: Column, label: Column, field: Column, level: Column) -> DataFrame:
    """``(bucket, n, exact_match, coverage, wrong_value_rate)`` for all rows, each field and each noise level (null: 0.0).

    ``read`` is what the rules make of a row's text, null where they refuse. One pass, summed before the shuffle.
    """
    told = rows.select(read.alias("p"), label.alias("y"), F.array(F.lit("all"), field, F.concat(F.lit("wer_"), F.coalesce(level, F.lit(0.0)).cast("string"))).alias("of"))
    each = told.select("p", "y", F.explode("of").alias("bucket"))
    share = lambda c, name: F.round(F.avg(c.cast("double")), 4).alias(name)
    answered, right = F.col("p").isNotNull(), F.col("p").eqNullSafe(F.col("y"))
    return each.groupBy("bucket").agg(F.count("*").alias("n"), share(right, "exact_match"), share(answered, "coverage"), share(answered & ~right, "wrong_value_rate"))


def majority_baseline(rows: DataFrame, label: str, order: str) -> DataFrame:
    """``(n, majority_label, accuracy)`` of always saying the commonest label; equals go to the one seen first."""
    by = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("majority_label")).agg(F.count("*").alias("c"), F.min(order).alias("first"))
    total = by.agg(F.sum("c").alias("n"), F.max_by("majority_label", F.struct("c", -F.col("first"))).alias("majority_label"), F.max("c").alias("c"))
    return total.where("n > 0").select("n", "majority_label", F.round(F.col("c") / F.col("n"), 4).alias("accuracy"))


def bundle(**parts: DataFrame) -> DataFrame:
    """Several evaluations as one table: ``(part, metrics)``, a row's metrics as JSON."""
    out = None
    for name, part in sorted(parts.items()):
        told = part.select(F.lit(name).alias("part"), F.to_json(F.struct(*sorted(part.columns))).alias("metrics"))
        out = told if out is None else out.unionByName(told)
    return out


def zero_shot(rows: DataFrame) -> DataFrame:
    """``(task, n, accuracy, macro_f1, ece_raw, latency_p50)`` of ``rows(task, gold, p, labels, latency_ms)``: labels in the order of p."""
    told = predicted(rows)
    hit = F.col("predicted") == F.col("gold")
    base = told.groupBy("task").agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 4).alias("accuracy"), F.round(F.percentile_approx("latency_ms", 0.5), 1).alias("latency_p50"))
    pairs = told.groupBy("task", "gold", "predicted").agg(F.count("*").alias("n"))
    by_gold = pairs.groupBy("task", F.col("gold").alias("label")).agg(F.sum("n").alias("golds"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = pairs.groupBy("task", F.col("predicted").alias("label")).agg(F.sum("n").alias("preds"))
    f1 = 2 * F.col("tp") / (F.col("golds") + F.coalesce("preds", F.lit(0)))
    f1s = by_gold.join(by_pred, ["task", "label"], "left").groupBy("task").agg(F.round(F.avg(f1), 4).alias("macro_f1"))
    at = F.array_position("labels", F.col("gold")).cast("int") - 1
    errors = calibration.ece_by(rows.withColumn("gold", at), "task", F.col("p")).select("task", F.round("ece", 4).alias("ece_raw"))
    return base.join(f1s, "task").join(errors, "task")


def predicted(rows: DataFrame) -> DataFrame:
    """``rows`` with the likeliest label, the first of equals."""
    return rows.withColumn("predicted", F.element_at("labels", F.array_position("p", F.array_max("p")).cast("int")))


def histogram(rows: DataFrame) -> DataFrame:
    return predicted(rows).groupBy("task", "predicted").agg(F.count("*").alias("n"))


def per_task_sample(rows: DataFrame, per_task: int, seed: str = "7") -> DataFrame:
    """``per_task`` rows of each task, or all it has, by a hash of seed, task and id."""
    return corpus.stratified(rows.withColumnRenamed("id", "doc_id"), "task", per_task, seed).withColumnRenamed("doc_id", "id")
