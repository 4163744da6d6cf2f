"""The corpus pipeline: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which ``run`` writes as Parquet and
reads again as the next stage's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordage.llm import decontaminate, jaccard, packing, secrets
from cordage.llm import toxicity as tox
from cordage.llm.common import bit_table, cut, fold, forget, free_name, may_hold, table


BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def _small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python ``ROWS`` at a time, not ten thousand, unless the session says otherwise: either side holds a batch."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at ``REJECT`` or more go.

    Null and empty texts get the score of a text without terms. Repeated rows are scored each; without
    labels of both kinds every text has the labels' share. An empty table gives no rows.
    """
    _small_batches(spark)
    model = tox.fit(*tox.training_rows(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1))
    score = free_name(docs, "score")
    return tox.with_scores(docs, model, score_col=score).where(F.col(score) < tox.REJECT).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id.

    Candidates come from SimHash fingerprints of five-word shingles and from shared shingles; texts are
    linked whose sets have a Jaccard similarity of 4/5 or more. Null and wordless texts are copies of each
    other. Of rows of one component that share its smallest id, one stays (the smallest by content);
    different texts under one id stay if nothing links them. Rows with a null id all stay. An empty table
    gives no rows. Only rows that a bit table takes for ones to drop are shuffled.
    """
    _small_batches(spark)
    found = jaccard.near_duplicates(docs)
    keys = cut(found.where("doc_id is not null").groupBy("doc_id", "text_hash", "component", "component_id").agg(F.count("*").alias("n")))
    first = keys.where("doc_id = component_id")
    several = first.groupBy("component").agg(F.sum("n").alias("n")).where("n > 1").select("component")
    gone = keys.where("doc_id <> component_id").withColumn("one", F.lit(False))
    change = cut(gone.unionByName(first.join(several, "component", "left_semi").withColumn("one", F.lit(True))).select("doc_id", "text_hash", "component", "one"))
    hits = bit_table(change.select(F.xxhash64("doc_id", "text_hash")), change.count())
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    rows = rows.withColumn("hit", may_hold(hits, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text_hash"))))
    told = rows.where("hit").join(change, ["doc_id", "text_hash"], "left")
    one = told.where("one").groupBy("component").agg(F.min_by("row", F.to_json("row")).alias("row"))
    kept = rows.where("not hit").select("row").unionByName(told.where("one is null").select("row")).unionByName(one.select("row"))
    forget(found, keys)
    return kept.select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of which a benchmark item's words are covered by tiles to ``COVERAGE`` or more go, with all their copies.

    Null and wordless texts stay. Repeated rows stay or go together. An empty table gives no rows; with
    an empty benchmark all stay. Only rows that a bit table takes for leaks are shuffled.
    """
    _small_batches(spark)
    leaked = cut(decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select("text_key").distinct())
    hits = bit_table(leaked.select(F.xxhash64("text_key")), leaked.count())
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.sha2(F.col("text").cast("string"), 256).alias("text_key"))
    rows = rows.withColumn("hit", may_hold(hits, F.when(F.col("text_key").isNotNull(), F.xxhash64("text_key"))))
    kept = rows.where("not hit").unionByName(rows.where("hit").join(leaked, "text_key", "left_anti").select(*rows.columns))
    return kept.select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span in a text is replaced by a mark; all documents stay, and n_chars is the new length.

    Null and empty texts have no spans. Repeated rows are redacted alike. An empty table gives no rows.
    """
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and place; null and empty texts have no tokens and are packed like any other.

    Repeated rows are packed each; a text over the budget is a batch of its own. An empty table gives no rows.
    """
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_batches),
]

#: The model's scores can't be had in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
