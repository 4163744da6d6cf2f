"""A bank of phrases: replies of a language model are read, filtered and keyed; what is new is kept as pending.

A phrase has ``task, label, text``. For ``extract_entity`` it is a frame with ``{value}`` once, for other tasks plain text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.once import once

# The place of a value, the most words of a phrase by task, and what none may hold.
VALUE = "{value}"
MAX_WORDS = {"extract_entity": 30, "classify_intent": 25, "is_real_interruption": 8}
FORBIDDEN = r"(?U)\d|@|https?://|www\."
QUOTES = "\"'«»“”"


def requests(labels: DataFrame, target: int, overgenerate: float, per_request: int, personas: list[str]) -> DataFrame:
    """Requests that ask for more than each label's part of ``target``: ``(task, label, i, persona, n, seed, context)``.

    ``labels(task, label, share, contexts)``: a task's share is divided evenly among its labels; personas and contexts (an array,
    may be null or empty) take turns. The seed is the first eight hex digits of sha256(task:label:i). Labels are settings.
    """
    counts = labels.groupBy("task").agg(F.count_distinct("label").alias("_labels"))
    times = F.ceil(F.lit(float(target)) * F.col("share") * overgenerate / F.col("_labels") / per_request).cast("int")
    turns = F.filter(F.sequence(F.lit(0), F.greatest(times - 1, F.lit(0))), lambda i: i < times)
    rows = labels.dropDuplicates(["task", "label"]).join(counts, "task").select("task", "label", "contexts", F.explode(turns).alias("i"))
    seed = F.conv(F.substring(F.sha2(F.concat_ws(":", "task", "label", F.col("i").cast("string")), 256), 1, 8), 16, 10).cast("long")
    turn = lambda xs: F.when(F.size(xs) > 0, F.get(xs, F.pmod(F.col("i"), F.greatest(F.size(xs), F.lit(1)))))
    return rows.select("task", "label", "i", turn(F.array(*map(F.lit, personas))).alias("persona"), F.lit(per_request).alias("n"), seed.alias("seed"), turn(F.col("contexts")).alias("context"))


def read_reply(reply: Column) -> Column:
    """The strings under ``phrases`` of the JSON object in a reply, fenced or not; none where there is no such list."""
    found = F.try_variant_get(F.try_parse_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0)), "$.phrases", "array<variant>")
    strings = F.filter(found, lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.transform(strings, lambda x: F.variant_get(x, "$", "string")), F.array().cast("array<string>"))


def clean(c: Column) -> Column:
    """Without quotes around it, white space squeezed."""
    return T.squeeze(F.regexp_replace(T.squeeze(c), f"^[{QUOTES}]+|[{QUOTES}]+$", ""))


def reject_reason(task: Column, c: Column) -> Column:
    """The first reason in order, or null: value (once for a frame, never else), forbidden, words."""
    bare = F.replace(c, F.lit(VALUE), F.lit(""))
    values = (F.length(c) - F.length(bare)) / len(VALUE)
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in MAX_WORDS.items() for x in pair)), task)
    words = T.word_count(F.replace(c, F.lit(VALUE), F.lit("x")))
    return (
        F.when(limit.isNull(), "task").when(values != F.when(task == "extract_entity", 1).otherwise(0), "value")
        .when(bare.rlike(FORBIDDEN), "forbidden").when(~once(words, lambda n: n.between(1, limit)), "words")
    )


def key(task: Column, label: Column, c: Column) -> Column:
    return F.concat_ws("|", task, label, T.normalize_text(F.replace(c, F.lit(VALUE), F.lit("VALOR"))))


def candidates(replies: DataFrame) -> DataFrame:
    """A row per phrase of ``replies(task, label, reply, place)``, with its place in the reply, key and reason."""
    task = F.col("task")
    # cleaned and judged before they are rows: a filter on the reason would compute the text anew wherever its rules name it
    told = lambda c: once(clean(c), lambda x: F.struct(x.alias("text"), reject_reason(task, x).alias("reason")))
    # an inner explode would have Spark test the array for rows first, and so compute it again
    rows = replies.select("task", "label", "place", F.posexplode_outer(F.transform(read_reply(F.col("reply")), told)).alias("at", "_p")).where("at is not null")
    return rows.select("task", "label", "place", "at", "_p.text", key(task, F.col("label"), F.col("_p.text")).alias("key"), "_p.reason")


def new_phrases(found: DataFrame, bank: DataFrame) -> DataFrame:
    """The first of each key that passed, unless the bank has the key; ``n`` is how many there were.

    The smallest place is a partial aggregate, so a phrase that very many replies hold is summed before the shuffle.
    """
    first = found.where("reason is null").groupBy("key").agg(F.min(F.struct("place", "at", "task", "label", "text")).alias("f"), F.count("*").alias("n"))
    known = bank.select(key(F.col("task"), F.col("label"), F.col("text")).alias("key")).distinct()
    return first.join(known, "key", "left_anti").select(T.hash_id("cp-", F.col("key")).alias("id"), "f.task", "f.label", "f.text", F.lit("pending").alias("status"), "n")


def rejections(found: DataFrame, new: DataFrame) -> DataFrame:
    """How many phrases each reason kept out; ``duplicate`` is what passed but was there before."""
    reasons = found.groupBy(F.coalesce("reason", F.lit("duplicate")).alias("reason")).agg(F.count("*").alias("n"))
    kept = new.agg(F.count("*").alias("kept"))
    return reasons.crossJoin(kept).select("reason", (F.col("n") - F.when(F.col("reason") == "duplicate", F.col("kept")).otherwise(0)).alias("n"))  # kept is one row


def approved(bank: DataFrame) -> DataFrame:
    """What examples may be made of: approved by a person and still passing the filter."""
    return bank.where((F.col("status") == "approved") & reject_reason(F.col("task"), F.col("text")).isNull())
