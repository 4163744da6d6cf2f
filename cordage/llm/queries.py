"""The driver's queries of this subpackage; ``SQL`` holds those that DuckDB can check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embeddings, language, lexical, packing, quality, secrets, simhash, spelling, sql, urls
from . import html as pages_html
from . import toxicity as tox
from .common import fold, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = tox.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    predicted = (F.col("score") >= tox.REJECT).cast("int").alias("predicted")
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", predicted)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles", "longest")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.by_document(table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


# Fixed values of op7: (action, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.classify(docs, language.train(docs, fold("doc_id", 5) != 0))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages_html.extract(pages, pages_html.train(pages))


# Fixed value of op10: a text made of control strings, said by both sides of conversation -1.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    more = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    more = more.select(*(F.col(c).cast(t).alias(c) for c, t in turns.dtypes))
    return chat.read_back(chat.windows(turns.unionByName(more)))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op")}


SQL: dict[str, str] = {"op5_secrets": sql.SECRETS, "op7_urls": sql.URLS, "op10_chat": sql.chat_sql(CONTROL_TEXT), "op11_search": sql.SEARCH, "op12_spelling": sql.SPELLING}
