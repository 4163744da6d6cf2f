"""Calibration of annotated answers: temperatures by bucket, held-out error, the rejection threshold, and the gate.

``answers``: bucket, p (array of probabilities), gold (place of the right option), and what else a caller needs.
Buckets are kinds of questions with numbers of options, so there are few; answers may be any number.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import probability as P
from ..functions import text as T
from ..sources.tables import settle

# The range of temperatures, the floors under probabilities, the number of bins.
T_RANGE, FLOOR, LEAST, BINS = (0.5, 5.0), 1e-4, 1e-12, 15
POINTS, PASSES = 61, 4  # places on a grid, and grids, each over two steps of the one before: a last step of two millionths


class CalibrationError(RuntimeError):
    """Answers that can't be calibrated as asked."""


def bucket(kind: Column, options: Column) -> Column:
    """The kind of question and the class of its number of options."""
    size = F.when(options <= 2, "2").when(options <= 5, "3-5").when(options <= 10, "6-10").otherwise("11+")
    return F.concat_ws(":", kind, size)


def pair_with_labels(rows: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each label of a row with its question's options: ``(id, questions, qid, bucket, options, gold)`` and ``(id, qid, problem)``.

    ``rows``: id, questions (name and version of a question file), labels (map of question to label).
    ``questions``: questions, qid, kind, options. The label of a score is a place, others are an option.
    """
    each = rows.select("id", "questions", F.explode("labels").alias("qid", "label"))
    known = each.join(questions.select("questions", "qid", "kind", "options"), ["questions", "qid"], "left")
    place = F.col("label").try_cast("int")
    at = F.array_position("options", F.col("label")).cast("int") - 1
    gold = F.when(at >= 0, at).when((F.col("kind") == "score") & place.between(0, F.size("options") - 1), place)
    told = known.withColumn("gold", F.when(F.col("kind") == "score", F.coalesce(F.when(place.between(0, F.size("options") - 1), place), at)).otherwise(gold))
    problem = F.when(F.col("options").isNull(), "no such question").when(F.col("gold").isNull() | (F.col("gold") < 0), "no such option")
    wrong = told.where(problem.isNotNull()).select("id", "qid", problem.alias("problem"))
    good = told.where(problem.isNull()).select("id", "questions", "qid", bucket(F.col("kind"), F.size("options")).alias("bucket"), "options", "gold")
    return good, wrong


def answer_probs(kind: Column, options: Column, answer: Column) -> Column:
    """Probabilities in the options' order: of a yes-or-no question from its one number, else from a map by option."""
    yes = F.element_at(answer, "yes")
    return F.when(kind == "yes_no", F.array(1 - yes, yes)).otherwise(F.transform(options, lambda o: F.element_at(answer, o)))


def _losses(p: np.ndarray, gold: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Loss of each answer (rows) at each of its temperatures (columns)."""
    z = np.log(np.maximum(p, FLOOR))[:, None, :] / t[:, :, None]
    z -= z.max(2, keepdims=True)
    e = np.exp(z)
    return -np.log(np.maximum(np.take_along_axis(e, gold[:, None, None], 2)[:, :, 0] / e.sum(2), LEAST))


def temperatures(answers: DataFrame, by: str, fold: str | None = None, folds: int = 0) -> dict[tuple, float]:
    """The temperature of least mean loss for each value of ``by``; with folds, also for the answers outside of each fold.

    Keys are ``(value, None)`` and ``(value, f)``. The loss is summed in tasks on a grid (even in the
    logarithm), which is then narrowed around the least place: the loss has one minimum. No answer leaves
    its task. Rounded to four digits.
    """
    low, high = map(float, np.log(T_RANGE))
    centres: dict[tuple, float] = {}
    step, targets = (high - low) / (POINTS - 1), [None, *range(folds)]
    rows = answers.select(F.col(by).alias("by"), "p", "gold", (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))
    for turn in range(PASSES):
        at = np.linspace(low, high, POINTS) if not turn else np.linspace(-step, step, POINTS)
        if turn:
            step = 2 * step / (POINTS - 1)
        known = dict(centres)

        def sums(batches: Iterator[pd.DataFrame], at=at, known=known) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for (key, own, size), part in pdf.groupby(["by", "fold", pdf.p.str.len()], sort=False):
                    p, gold = np.stack(part.p.to_numpy()), part.gold.to_numpy().astype(np.int64)
                    for f in targets:
                        if f is None or f != own:
                            grid = np.exp(np.clip(known.get((key, f), 0.0) + at, low, high))
                            loss = _losses(p, gold, np.broadcast_to(grid, (len(p), POINTS))).sum(0)
                            yield pd.DataFrame({"by": key, "f": -1 if f is None else f, "i": np.arange(POINTS), "loss": loss, "n": len(p)})

        kind = dict(rows.dtypes)["by"]
        total = rows.where("by IS NOT NULL AND p IS NOT NULL AND gold IS NOT NULL").mapInPandas(sums, f"by {kind}, f int, i int, loss double, n long")
        least = total.groupBy("by", "f", "i").agg(F.sum("loss").alias("loss")).groupBy("by", "f").agg(F.min_by("i", F.struct("loss", "i")).alias("i"))
        for r in least.collect():  # a row for each bucket and fold
            key = (r["by"], None if r["f"] < 0 else r["f"])
            centres[key] = float(np.clip(known.get(key, 0.0) + at[r["i"]], low, high))
    return {k: round(float(np.exp(c)), 4) for k, c in centres.items()}


def _by_key(found: dict[tuple, float], key: Column, fold: Column | None = None) -> Column:
    """The temperature found for a row's bucket, and fold if given, as an expression."""
    out = F.lit(None).cast("double")
    for (value, f), t in found.items():
        if (f is None) == (fold is None):
            out = F.when(key.eqNullSafe(F.lit(value)) & (F.lit(True) if fold is None else fold == f), t).otherwise(out)
    return out


def ece_by(answers: DataFrame, by: str, p: Column) -> DataFrame:
    """``(by, n, ece)``: the calibration error of the top answers of ``p`` in equal bins."""
    rows = answers.select(F.col(by), p.alias("_p"), "gold").where("_p IS NOT NULL")
    hit = (P.argmax_first(F.col("_p")) == F.col("gold")).cast("double")
    top = rows.select(by, F.array_max("_p").alias("conf"), hit.alias("hit"))
    bins = top.groupBy(by, P.bin_of(F.col("conf"), BINS).alias("bin")).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum("conf").alias("confs"))
    return bins.groupBy(by).agg(F.sum("n").alias("n"), (F.sum(F.abs(F.col("hits") - F.col("confs"))) / F.sum("n")).alias("ece"))


def folded(answers: DataFrame, key: str, folds: int = 5, seed: str = "42") -> DataFrame:
    """A fold for each answer by a hash of its key."""
    return answers.withColumn("fold", F.least(F.floor(T.hash_fraction(seed, F.col(key)) * folds), F.lit(folds - 1)).cast("int"))


def bucket_report(answers: DataFrame, key: str, folds: int = 5, min_per_bucket: int = 50, seed: str = "42") -> DataFrame:
    """``(bucket, n, temperature, ece_raw, ece_calibrated_cv)``; buckets under the floor have their number only.

    Every answer is scored at the temperature of the answers outside of its fold.
    """
    rows = folded(answers, key, folds, seed)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    enough = [r["bucket"] for r in sizes.where(F.col("n") >= min_per_bucket).collect()]  # a row a bucket
    fit_on = rows.where(F.col("bucket").isin(enough))
    found = temperatures(fit_on, "bucket", "fold", folds)
    calibrated = P.temper(F.col("p"), _by_key(found, F.col("bucket"), F.col("fold")), FLOOR)
    raw = ece_by(fit_on, "bucket", P.temper(F.col("p"), 1.0, FLOOR)).select("bucket", F.round("ece", 4).alias("ece_raw"))
    cv = ece_by(fit_on, "bucket", calibrated).select("bucket", F.round("ece", 4).alias("ece_calibrated_cv"))
    out = sizes.join(raw, "bucket", "left").join(cv, "bucket", "left")
    return out.select("bucket", "n", _by_key(found, F.col("bucket")).alias("temperature"), "ece_raw", "ece_calibrated_cv")


def kth_largest(rows: DataFrame, score: str, place: int) -> float:
    """The score at a place from the largest, ties counted: range partitions are summed, one of them is looked into."""
    counted = rows.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("c")).repartitionByRange(F.desc("s")).withColumn("part", F.spark_partition_id())
    counted = settle(counted)
    before = 0
    for r in counted.groupBy("part").agg(F.sum("c").alias("c")).orderBy("part").collect():  # a row a partition
        if before + r["c"] >= place:
            run = F.sum("c").over(Window.partitionBy("part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0))
            inside = counted.where(F.col("part") == r["part"]).withColumn("upto", run + before)
            return inside.where(F.col("upto") >= place).agg(F.max("s").alias("s")).first()["s"]
        before += r["c"]
    raise CalibrationError(f"fewer than {place} rows")


def rejection_threshold(rows: DataFrame, score: str, positive: str, recall: Fraction = Fraction(95, 100)) -> dict:
    """The largest threshold whose recall over the positives reaches ``recall``, with the recall and precision it has (ties fire)."""
    n = rows.where(positive).count()
    if not n:
        raise CalibrationError("no positive rows: the threshold can't be derived")
    t = kth_largest(rows.where(positive), score, -(-n * recall.numerator // recall.denominator))
    fired = rows.where(F.col(score) >= t).agg(F.count("*").alias("n"), F.count_if(F.expr(positive)).alias("hits")).first()
    return {"threshold": round(t, 6), "recall": round(fired["hits"] / n, 4), "precision": round(fired["hits"] / fired["n"], 4), "positives": n}


def calibrate(answers: DataFrame, key: str, rejection: tuple[str, int], max_ece: float = 0.10, recall: Fraction = Fraction(95, 100), folds: int = 5, min_per_bucket: int = 50, seed: str = "42") -> dict:
    """The whole fit: buckets, failures of all of them, and the threshold of option ``rejection[1]`` in bucket ``rejection[0]``."""
    report = {r["bucket"]: {k: r[k] for k in ("n", "temperature", "ece_raw", "ece_calibrated_cv")} for r in bucket_report(answers, key, folds, min_per_bucket, seed).collect()}
    failures = []
    for name, r in sorted(report.items()):
        if r["temperature"] is None:
            failures.append(f"{name}: {r['n']} answers < {min_per_bucket}")
        elif r["ece_calibrated_cv"] > max_ece:
            failures.append(f"{name}: held-out error {r['ece_calibrated_cv']} > {max_ece}")
    where, index = rejection
    t, cut = report.get(where, {}).get("temperature"), {}
    if t is None:
        failures.append(f"{where}: not calibrated, so no threshold")
    else:
        own = answers.where(F.col("bucket") == where)
        scored = own.select(F.element_at(P.temper(F.col("p"), t, FLOOR), index + 1).alias("score"), (F.col("gold") == index).alias("hit"))
        cut = rejection_threshold(scored, "score", "hit", recall)
    return {"passed": not failures, "failures": failures, "buckets": report, "temperatures": {k: r["temperature"] for k, r in report.items() if r["temperature"] is not None}, "rejection": cut}


def publish_calibration(found: dict, run: str, digest: str, write: callable) -> str | None:
    """Write the report always and, only if it passed, the calibration; its id depends on the run, the data and what was fitted."""
    write("report", json.dumps(found, sort_keys=True))
    if not found["passed"]:
        return None
    told = json.dumps([run, digest, found["temperatures"], found["rejection"].get("threshold")], sort_keys=True)
    name = f"{run}-cal-{hashlib.sha256(told.encode()).hexdigest()[:8]}"
    write("calibration", json.dumps({"run_id": name, "temperatures": found["temperatures"], "threshold": found["rejection"].get("threshold")}, sort_keys=True))
    return name
