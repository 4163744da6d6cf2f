"""What an agent says at a call's end, and what prompts are told about a label: its description and the lines it can answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How fields are named aloud and the sentences that close a call.
SPOKEN_FIELDS = {"name": "su nombre", "phone": "su teléfono", "email": "su correo"}
GOODBYE = "Gracias por su tiempo, que tenga buen día."
NOTHING = "Revisaremos sus datos por otro medio."
REST = " Lo demás lo revisaremos por otro medio."
ONE, MANY = "quedó confirmado", "quedaron confirmados"


def closing(results: Column) -> Column:
    """The closing sentence for ``results``, an array of ``struct(field, result)`` in the order of asking.

    Fields without a spoken name are said as they are written. A null or empty array has nothing validated.
    """
    spoken = F.create_map(*(F.lit(x) for pair in SPOKEN_FIELDS.items() for x in pair))
    good = F.filter(results, lambda r: r["result"].eqNullSafe("validated"))
    names = F.transform(good, lambda r: F.coalesce(F.try_element_at(spoken, r["field"]), r["field"]))
    n = F.size(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    listed = F.when(n > 1, F.concat(head, F.lit(" y "), F.get(names, n - 1))).otherwise(F.get(names, n - 1))
    rest = F.when(n < F.size(results), REST).otherwise("")
    told = F.concat(F.lit("Listo, "), F.when(n > 1, MANY).otherwise(ONE), F.lit(" "), listed, F.lit("."), rest, F.lit(" " + GOODBYE))
    return F.when(n > 0, told).otherwise(f"{NOTHING} {GOODBYE}")


def results_of_calls(asked: DataFrame) -> DataFrame:
    """``(call_id, results)`` of ``asked(call_id, seq, field, result)``: each field once, in the order first asked, with its last result.

    Fields are summed before they are gathered, so a call's array is as long as it has different fields. Equal ``seq`` of one
    field: the greater result counts. A null call is one call; rows without a field are left out.
    """
    last = asked.where("field is not null").groupBy("call_id", "field").agg(F.min("seq").alias("first"), F.max(F.struct("seq", "result")).alias("last"))
    each = F.array_sort(F.collect_list(F.struct("first", "field", F.col("last.result").alias("result"))))
    return last.groupBy("call_id").agg(F.transform(each, lambda r: F.struct(r["field"].alias("field"), r["result"].alias("result"))).alias("results"))


def label_contexts(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """``(label, turn, line, n)``: the lines each label can answer, numbered from 0 in order of flow and place.

    ``labels(flow, label)`` tells which labels a flow has, ``lines(flow, place, line)`` what its agent says there. A label of
    several flows has the lines of each; repeated rows count once; labels whose flow has no line give no row. Lines stay
    rows, so no label's lines must fit into one array.
    """
    rows = labels.distinct().join(lines.distinct(), "flow")
    at = Window.partitionBy("label").orderBy("flow", "place", "line")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    return rows.select("label", (F.row_number().over(at) - 1).alias("turn"), "line").join(counts, "label")


def with_context(requests: DataFrame, contexts: DataFrame) -> DataFrame:
    """``requests(label, i, ...)`` with ``context``: a label's lines take turns; null where it has none."""
    counts = contexts.select("label", "n").distinct()
    asked = requests.join(counts, "label", "left").withColumn("turn", F.pmod(F.col("i"), F.col("n")))
    of = contexts.select("label", "turn", F.col("line").alias("context"))
    return asked.join(of, ["label", "turn"], "left").drop("turn", "n")


def descriptions(described: DataFrame) -> DataFrame:
    """``(task, label, description)`` with white space squeezed; a label that is told twice has its last by ``version``."""
    squeezed = F.trim(F.regexp_replace("d.description", r"(?U)\s+", " "))
    return described.groupBy("task", "label").agg(F.max(F.struct("version", "description")).alias("d")).select("task", "label", squeezed.alias("description"))
