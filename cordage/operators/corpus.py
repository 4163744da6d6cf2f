"""Corpus rows: curation, first-wins and greedy dedup, split, exact stratified sampling, gates, scores."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import probability as P
from ..functions import text as T
from ..sources.tables import drop, settle
from . import calibration


def curate_counters(docs: DataFrame, lang: str, max_words: int) -> DataFrame:
    """How many rows of the language go for each reason or stay."""
    reason = F.coalesce(T.drop_reason(max_words, F.col("text")), F.lit("kept"))
    own = docs.where(F.col("lang") == lang)
    return own.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def first_wins(docs: DataFrame) -> DataFrame:
    """One row of each normalised text, the smallest id; only the key's digest is shuffled."""
    return docs.groupBy(F.sha2(T.normalize_text(F.col("text")), 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def split_of(group: Column, seed: str = "42", edges: tuple[tuple[str, float], ...] = (("train", 0.8), ("val", 0.9))) -> Column:
    at, out = T.hash_fraction(seed, group), F.lit("test")
    for name, edge in reversed(edges):
        out = F.when(at <= edge, name).otherwise(out)
    return out


def quotas(total: int, names: list[str]) -> dict[str, int]:
    """Even shares in name order; the first names take what is left over."""
    share, rest = divmod(total, max(1, len(names)))
    return {n: share + (k < rest) for k, n in enumerate(sorted(names))}


def stratified(docs: DataFrame, key: str, quota: int, seed: str = "42") -> DataFrame:
    """Exactly ``quota`` rows of each stratum (all if fewer), by a hash of seed, stratum and id.

    A stratum's choice does not depend on the others. Spark keeps only the first rows of each
    stratum in every task before the shuffle (a rank filter), so a large stratum stays small.
    """
    head = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key), F.col("doc_id").cast("string")), 256), 1, 15)
    ranked = docs.select("doc_id", key, head.alias("h"))
    w = Window.partitionBy(key).orderBy("h", "doc_id")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota).select("doc_id", key, F.col("rank").cast("long").alias("rank"))


def shortfall(docs: DataFrame, key: str, quota: int) -> DataFrame:
    return docs.groupBy(key).agg(F.count("*").alias("have")).where(F.col("have") < quota).select(key, "have", (F.lit(quota) - F.col("have")).cast("long").alias("short"))


def greedy_two_key(rows: DataFrame) -> DataFrame:
    """The places kept when rows go in order of ``place`` and one goes if its id or its content is already kept.

    ``rows(place, id, content)`` with unique places; a null id or content is a value like others. In each round the
    rows that come first for both of their keys are kept, and all rows that share a key with them leave; so no group
    is ever gathered, and rounds number as the longest chain of rows that block each other (a few in practice).
    """
    left, kept = settle(rows.select("place", F.struct("id").alias("id"), F.struct("content").alias("content"))), None
    while not left.isEmpty():
        first = left
        for key in ("id", "content"):
            first = first.join(left.groupBy(key).agg(F.min("place").alias(f"first_{key}")), key)
        won = settle(first.where("place = first_id AND place = first_content").select("place", "id", "content"))
        kept = won if kept is None else kept.unionByName(won)
        old, left = left, settle(left.join(won.select("id"), "id", "left_anti").join(won.select("content"), "content", "left_anti"))
        drop(old)
    return (left if kept is None else kept).select("place")


def ambiguous_spellings(docs: DataFrame) -> DataFrame:
    """Words of which another spelling sounds the same: key, spellings, the first of them."""
    words = docs.select(F.explode(F.array_distinct(F.split(T.normalize_text(F.col("text")), " "))).alias("w")).where(F.col("w").rlike("^[a-zñ]+$")).distinct()
    return words.groupBy(T.name_key(F.col("w")).alias("key")).agg(F.count("*").alias("spellings"), F.min("w").alias("first")).where("spellings > 1")


def split_leaks(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that lie in more than one split."""
    return rows.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def folds(rows: DataFrame, key: str, k: int = 5, seed: str = "42") -> DataFrame:
    """A fold from 0 to k-1 for each row, by hash, so that it does not depend on other rows."""
    return rows.withColumn("fold", F.least(F.floor(T.hash_fraction(seed, F.col(key)) * k), F.lit(k - 1)).cast("int"))


def held_out_ece(rows: DataFrame, key: str, k: int = 5) -> DataFrame:
    """``(fold, ece, n)``: each fold's calibration error at the temperature fitted on the other folds."""
    rows = folds(rows, key, k).withColumn("_all", F.lit(0))
    found = calibration.temperatures(rows, "_all", "fold", k)
    t = F.coalesce(*(F.when(F.col("fold") == f, found[0, f]) for f in range(k) if (0, f) in found))
    return calibration.ece_by(rows, "fold", P.temper(F.col("p"), t)).select("fold", F.round("ece", 4).alias("ece"), "n")


def table_digest(rows: DataFrame, *by: str) -> DataFrame:
    """Rows and a digest of their contents that does not depend on order, for each group."""
    line = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(rows.columns)))
    head = F.conv(F.substring(F.sha2(line, 256), 1, 8), 16, 10).cast("long")
    return rows.withColumn("_head", head).groupBy(*by).agg(F.count("*").alias("n"), F.sum("_head").alias("digest"))


def gate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Checks as rows: name, passed, detail (the number of rows against it)."""
    langs = F.col("lang").isin("de", "en", "es", "fr")
    d = docs.agg(
        (F.count("doc_id") - F.countDistinct("doc_id")).alias("ids_unique"), F.count_if(F.col("text").isNull()).alias("text_present"),
        F.count_if(~langs | F.col("lang").isNull()).alias("lang_known"), F.count_if(F.length("text") != F.col("n_chars")).alias("n_chars_right"),
    )
    lab = labels.agg(F.count_if(~F.col("toxic").isin(0, 1)).alias("toxic_binary"), F.count_if(~F.col("quality").isin(0, 1)).alias("quality_binary"))
    orphan = labels.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("labels_known"))
    each = [f.select(F.lit(c).alias("name"), F.col(c).cast("long").alias("detail")) for f in (d, lab, orphan) for c in f.columns]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.select("name", (F.col("detail") == 0).alias("passed"), "detail")


def levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rates for all rows, each language and each quality, in one pass of grouping sets."""
    joined = labels.join(docs.select("doc_id", "lang"), "doc_id")
    return docs.sparkSession.sql(
        "SELECT coalesce(lang, 'all') AS lang, coalesce(CAST(quality AS STRING), 'all') AS quality, count(*) AS n, round(avg(CAST(toxic AS DOUBLE)), 4) AS rate "
        "FROM {rows} GROUP BY GROUPING SETS ((), (lang), (quality))", rows=joined,
    )


def majority(rows: DataFrame, label: str, order: str) -> DataFrame:
    """The commonest label; of equals the one seen first."""
    return rows.groupBy(label).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(1).select(label, "n")


def macro_f1(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Mean over gold labels of 2tp / (2tp + fp + fn), from one table of confusions."""
    pairs = rows.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    by_gold = pairs.groupBy(F.col("g").alias("label")).agg(F.sum("n").alias("golds"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = pairs.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("preds"))
    f1 = 2 * F.col("tp") / (F.col("golds") + F.coalesce("preds", F.lit(0)))
    return by_gold.join(by_pred, "label", "left").agg(F.round(F.avg(f1), 4).alias("macro_f1"), F.count("*").alias("labels"))


def scored(vectors: DataFrame, options: int = 5) -> DataFrame:
    """Vectors read as logits of ``options`` answers, label mod options as the gold one."""
    p = P.softmax(F.transform(F.slice("embedding", 1, options), lambda x: x.cast("double") * 10))
    return vectors.select("vec_id", p.alias("p"), (F.col("label") % options).cast("int").alias("gold"))


def calibration_error(rows: DataFrame, bins: int = 15) -> DataFrame:
    hit = (P.argmax_first(F.col("p")) == F.col("gold")).cast("double")
    by = rows.select(F.array_max("p").alias("conf"), hit.alias("hit")).groupBy(P.bin_of(F.col("conf"), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum("conf").alias("confs"))
    return by.agg(F.round(F.sum(F.abs(F.col("hits") - F.col("confs"))) / F.sum("n"), 4).alias("ece"), F.sum("n").alias("n"))


def nll(rows: DataFrame, t: float) -> DataFrame:
    return rows.agg(F.round(F.avg(P.likelihood(P.temper(F.col("p"), t), F.col("gold"))), 4).alias("nll"), F.count("*").alias("n"))


def threshold_at_recall(rows: DataFrame, score: str, positive: str, recall: Fraction = Fraction(95, 100)) -> DataFrame:
    """The score of the positive at place ceil(recall * positives), then recall and precision from there; no positives: no row."""
    try:
        found = [calibration.rejection_threshold(rows, score, positive, recall)]
    except calibration.CalibrationError:
        found = []
    return rows.sparkSession.createDataFrame([(r["threshold"], r["recall"], r["precision"]) for r in found], "threshold double, recall double, precision double")


def fit_temperature(rows: DataFrame, by: str = "gold") -> DataFrame:
    """``(by, t, n)``: the temperature with the least mean loss for each bucket's rows."""
    found = calibration.temperatures(rows, by)
    t = F.coalesce(*(F.when(F.col(by) == value, t) for (value, _), t in found.items()), F.lit(None).cast("double"))
    return rows.groupBy(by).agg(F.count("*").alias("n")).select(by, t.alias("t"), "n")
