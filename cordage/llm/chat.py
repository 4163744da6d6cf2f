"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``\\`` is written
``\\b`` and ``<|`` is written ``<\\p|``, so no text can hold a control string, and reading back is exact.

Windows are spans of whole turns. With prefix sums of the turns' tokens, a new span begins where
the sum passes a multiple of half the room, and around a turn of more than that, so a span keeps to
the room unless one turn alone is longer; such a turn is a window of its own, whole. The room is the
budget less the first turn, if it is the system's, and less the history. Every window repeats the
system turn and those last turns of the span before that fit in the history. The loss mask covers
the texts of the assistant's new turns only, so each is a target once.

Window functions run over one conversation's turns in order and hold no group in memory; only a
window's own turns, bounded by the budget, are gathered into a row.

Defined cases: null texts and roles are empty. Turns are ordered by turn, then role and text; repeated
rows are turns of their own. Null conversation ids are one conversation. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 1024, 256
TARGET = "assistant"


def tokens(text: Column) -> Column:
    """About four bytes a token, and four for the marks."""
    return (F.ceil(F.octet_length(text) / 4) + 4).cast("long")


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\p|"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\l"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\l"), F.lit("\n")))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Column | None = None) -> DataFrame:
    """``(conv_id, window, formatted, loss, n_repeated, n_new)``; loss: spans of code points."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"))
    rows = rows.withColumn("tokens", count if count is not None else tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("system", (F.col("place") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("kept", F.first(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(up_to))
    half = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("kept")) / 2)).cast("long")
    rows = rows.withColumn("half", half)
    cost = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    rows = rows.withColumn("until", F.sum(cost).over(up_to)).withColumn("since", F.col("until") - cost)
    rows = rows.withColumn("bin", F.floor((F.col("until") - 1) / F.col("half"))).withColumn("long", ~F.col("system") & (F.col("tokens") > F.col("half")))
    first = F.lag("system").over(order)  # the turn after the system's begins the first span
    begins = F.col("long") | F.lag("long").over(order) | (F.col("bin") != F.lag("bin").over(order))
    begins = F.when(F.col("system") | first.isNull() | first, 0).otherwise(F.coalesce(begins, F.lit(False)).cast("int"))
    rows = rows.withColumn("begins", begins).withColumn("span", F.sum("begins").over(up_to))
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("spans", F.max("span").over(whole)).withColumn("ends", F.max("until").over(Window.partitionBy("conv_id", "span")))
    again = (F.col("span") < F.col("spans")) & (F.col("ends") - F.col("since") <= history)
    of = F.when(F.col("system"), F.sequence(F.lit(0).cast("long"), "spans")).when(again, F.array(F.col("span"), F.col("span") + 1)).otherwise(F.array("span"))
    dealt = rows.withColumn("window", F.explode(of)).withColumn("new", F.col("window") == F.when(F.col("system"), 0).otherwise(F.col("span")))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    dealt = dealt.withColumn("head", head).withColumn("body", escape(F.col("text")))
    dealt = dealt.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    within = Window.partitionBy("conv_id", "window").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum(F.length("piece")).over(within) - F.length("piece") + F.length("head")
    dealt = dealt.withColumn("start", at).withColumn("stop", F.col("start") + F.length("body"))
    target = F.when(F.col("new") & (F.col("role") == TARGET), F.struct("start", "stop"))
    gathered = dealt.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(target)).alias("loss"),
        F.sum((~F.col("new")).cast("long")).alias("n_repeated"),
        F.sum(F.col("new").cast("long")).alias("n_new"),
    )
    return gathered.select("conv_id", "window", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), "loss", "n_repeated", "n_new")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, told from windows alone: turns and targets, each once and in order."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.col("n_repeated").cast("int") + 2, F.greatest(F.col("n_new").cast("int"), F.lit(1)))
    role = lambda p: F.substring_index(p, "\n", 1)
    text = lambda p: F.substring(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - F.lit(len(END) + 2))
    told = F.array_join(F.transform(pieces, lambda p: F.concat(unescape_role(role(p)), F.lit("\n"), unescape(text(p)), F.lit("\n"))), "")
    aim = F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), (x["stop"] - x["start"]).cast("int")))), "")
    part = F.struct("window", F.when(F.col("n_new") > 0, told).otherwise("").alias("told"), aim.alias("aim"))
    lists = formatted.groupBy("conv_id").agg(F.sum("n_new").alias("n_turns"), F.sort_array(F.collect_list(part)).alias("parts"), F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    joined = lambda f: F.array_join(F.transform("parts", lambda x: x[f]), "")
    lists = lists.withColumn("aims", joined("aim"))
    return lists.select("conv_id", "n_turns", F.sha2(joined("told"), 256).alias("turns_sha256"), F.length("aims").cast("long").alias("loss_chars"), F.sha2("aims", 256).alias("loss_sha256"), "formatted_chars")
