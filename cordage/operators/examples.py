"""Training examples made from labels: every combination of a finite space once, and spoken values in frames.

Templates (flows, utterances, frames) are settings of bounded size, exploded from literal arrays, so no join is needed. Ids and
draws are hashes of what an example is made of: growing the input leaves the examples there were as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spoken
from ..functions import text as T
from . import phrases as bank_of

# The confidence an example is labelled with, the share without a usable value.
CLEAR, AMBIGUOUS, ABSENT, NEGATIVES = 0.95, 0.5, 0.9, 0.15
FIELDS = ("name", "phone", "email")


def intent_examples(phrases: DataFrame, flows: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Each of ``phrases(label, text)`` in every ``(flow, context, labels)`` that takes its label; equal ones once."""
    settings = F.array(*(F.struct(F.lit(f).alias("flow"), F.lit(c).alias("context"), F.array(*map(F.lit, ls)).alias("labels")) for f, c, ls in flows))
    rows = phrases.select(F.col("label").alias("intent"), F.col("text").alias("transcript")).distinct()
    rows = rows.withColumn("s", F.explode(F.filter(settings, lambda s: F.array_contains(s["labels"], F.col("intent")))))
    rows = rows.select("s.flow", "s.context", "transcript", "intent", F.lit(CLEAR).alias("confidence"))
    return rows.select(T.hash_id("syn-classify_intent-", *(F.col(c) for c in ("flow", "context", "transcript", "intent"))).alias("id"), "*")


def interruption_examples(phrases: DataFrame, utterances: list[str]) -> DataFrame:
    """Each of ``phrases(kind, text)`` after every number of words of each utterance; all but backchannels interrupt."""
    rows = phrases.select("kind", F.col("text").alias("transcript")).distinct()
    rows = rows.withColumn("agent_utterance", F.explode(F.array(*map(F.lit, dict.fromkeys(utterances))).cast("array<string>")))
    words = F.split(T.squeeze(F.col("agent_utterance")), " ")
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda p: p < F.size(words))
    rows = rows.withColumn("position", F.explode(places))
    said = F.array_join(F.slice(words, F.lit(1), F.col("position")), " ")
    rows = rows.select("agent_utterance", "position", said.alias("agent_said"), "transcript", "kind", (F.col("kind") != "backchannel").alias("interruption"), F.lit(CLEAR).alias("confidence"))
    return rows.select(T.hash_id("syn-is_real_interruption-", F.col("agent_utterance"), F.col("position").cast("string"), F.col("transcript"), F.col("kind")).alias("id"), "*")


def _pick(values: list, draw: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.least(F.floor(draw * len(values)).cast("int") + 1, F.lit(len(values))))


def entity_examples(people: DataFrame, frames: list[str], refusals: dict[str, list[str]], unclear: list[str], seed: str = "7", negatives: float = NEGATIVES) -> DataFrame:
    """One example per row of ``people(id, name, phone, email)``: the value of a field, said in a frame.

    The field goes by the id modulo three (id: a long). A share has no usable value: refused, or cut short (a name's first word,
    a number without its last pair, an address without what follows its host's first point). A name with a word of ``unclear``
    (small letters) is spelled in half of the cases, else its spelling can't be known and the value is null. A person whose
    value is null gives no example. ``start`` and ``stop`` are the value's place in the transcript, null for refusals.
    """
    draw = lambda what: T.hash_fraction(f"{seed}:{what}", F.col("id"))
    name, phone, email = F.col("name"), F.col("phone"), F.col("email")
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (F.pmod(F.col("id"), F.lit(3)) + 1).cast("int"))
    rows = people.select("id", "name", "phone", "email", field.alias("field"), (draw("negative") < negatives).alias("negative"), (draw("reason") < 0.5).alias("refused"))
    is_field = lambda x: F.col("field") == x
    words = F.split(T.squeeze(F.lower("name")), " ")
    doubtful = F.filter(words, lambda w: w.isin(*unclear) if unclear else F.lit(False))
    spelled = is_field("name") & (F.size(doubtful) > 0) & (draw("spelled") < 0.5)
    said_name = F.when(spelled, F.concat(T.squeeze(F.lower("name")), F.lit(", "), doubtful[0], F.lit(" se escribe "), spoken.spell(doubtful[0]))).otherwise(T.squeeze(F.lower("name")))
    phone_style, email_style = _pick(["digits", "pairs", "triples"], draw("style")), _pick(["words", "spelled"], draw("style"))
    said_phone = F.when(phone_style == "digits", spoken.say_phone(phone, "digits")).when(phone_style == "pairs", spoken.say_phone(phone)).otherwise(spoken.say_phone(phone, "triples"))
    said_email = F.when(email_style == "words", spoken.say_email(email)).otherwise(spoken.say_email(email, "spelled"))
    whole = F.when(is_field("name"), said_name).when(is_field("phone"), said_phone).otherwise(said_email)
    digits = F.array_join(F.transform(F.filter(F.split(F.substring("phone", 1, 8), ""), lambda x: x != ""), lambda x: _pick(spoken.SMALL[:10], x.cast("int") / 10 + 0.05)), " ")
    short = F.when(is_field("name"), words[0]).when(is_field("phone"), digits).otherwise(F.regexp_replace(said_email, "(?s)( arroba .*?) punto .*$", "$1"))
    rows = rows.withColumn("raw", F.when(~F.col("negative"), whole).when(~F.col("refused"), short))
    frame, refusal = _pick(frames, draw("frame")), F.element_at(F.create_map(*(x for f in FIELDS for x in (F.lit(f), _pick(refusals[f], draw("refusal"))))), F.col("field"))
    unknown = is_field("name") & (F.size(doubtful) > 0) & ~spelled
    value = F.when(F.col("negative") | unknown, F.lit(None)).when(is_field("name"), T.normalize_name(name)).when(is_field("phone"), F.concat(F.lit("+52"), phone)).otherwise(F.lower(email))
    reason = F.when(F.col("negative"), F.when(F.col("refused"), "not_provided").otherwise("incomplete")).when(unknown, "low_confidence")
    start = F.when(F.col("raw").isNotNull(), F.instr(frame, "{value}") - 1)
    given = F.when(is_field("name"), name).when(is_field("phone"), phone).otherwise(email)
    return rows.where(given.isNotNull()).select(
        T.hash_id("syn-extract_entity-", F.lit(seed), F.col("id").cast("string")).alias("example_id"), "id", "field",
        F.coalesce(F.replace(frame, F.lit("{value}"), F.col("raw")), refusal).alias("transcript"), F.col("raw").alias("raw_span"), start.alias("start"), (start + F.length("raw")).alias("stop"),
        value.alias("normalized_value"), reason.isNotNull().alias("needs_reprompt"), reason.alias("reprompt_reason"),
        F.when(F.col("negative"), ABSENT).when(unknown, AMBIGUOUS).otherwise(CLEAR).alias("confidence"),
    )


def carrier_intents(bank: DataFrame, flows: list[tuple[str, str, list[str]]]) -> DataFrame:
    """``intent_examples`` of a bank's approved phrases (``bank(id, task, label, text, status)``), each with its ``carrier_id``."""
    good = bank_of.approved(bank).where("task = 'classify_intent'").select("label", "text", F.col("id").alias("carrier_id"))
    rows = intent_examples(good.select("label", "text"), flows)
    return rows.join(good.withColumnsRenamed({"label": "intent", "text": "transcript"}), ["intent", "transcript"])


def carrier_interruptions(bank: DataFrame, utterances: list[str]) -> DataFrame:
    """``interruption_examples`` of a bank's approved phrases, each with its ``carrier_id``."""
    good = bank_of.approved(bank).where("task = 'is_real_interruption'").select(F.col("label").alias("kind"), "text", F.col("id").alias("carrier_id"))
    rows = interruption_examples(good.select("kind", "text"), utterances)
    return rows.join(good.withColumnRenamed("text", "transcript"), ["kind", "transcript"])


def with_carriers(template: DataFrame, carrier: DataFrame) -> DataFrame:
    """Template and carrier examples together, with their source; what one side lacks is null."""
    return template.withColumn("source", F.lit("template")).unionByName(carrier.withColumn("source", F.lit("carrier")), allowMissingColumns=True)


def capacity(space: DataFrame) -> int:
    """How many distinct examples a finite space holds."""
    return space.distinct().count()


def capped(space: DataFrame, wanted: int, seed: str, id_col: str = "id") -> DataFrame:
    """At most ``wanted`` examples of a finite space, in an order that depends on seed and id alone (``rank`` from 0)."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")), 256)
    first = space.distinct().withColumn("_order", order).orderBy("_order", id_col).limit(wanted)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("_order", id_col)) - 1).drop("_order")  # ``wanted`` rows


def summary(rows: DataFrame, **kinds: str) -> DataFrame:
    """``(task, kind, value, n)``: rows of each task, and of each value of what is counted for it (null: None)."""
    each = [F.struct(F.lit("rows").alias("kind"), F.lit("all").alias("value"))]
    each += [F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value")) for k, c in sorted(kinds.items())]
    return rows.select("task", F.explode(F.array(*each)).alias("k")).groupBy("task", "k.kind", "k.value").agg(F.count("*").alias("n"))


def template_problems(personas: DataFrame, known_personas: DataFrame, interruptions: DataFrame, kinds: DataFrame, flow_labels: DataFrame, intents: DataFrame, allowed_kinds: list[str], allowed_intents: list[str]) -> DataFrame:
    """``(problem, value)``: everything in which settings and templates disagree, at once, by anti joins.

    ``personas(name)`` wanted and ``known_personas(name)`` written; ``interruptions(phrase)`` and ``kinds(phrase, kind)``;
    ``flow_labels(label)`` and ``intents(label)``.
    """
    told = lambda name, df, column: df.select(F.lit(name).alias("problem"), F.col(column).alias("value"))
    parts = [
        told("persona_without_template", personas.join(known_personas, "name", "left_anti"), "name"),
        told("interruption_without_kind", interruptions.join(kinds, "phrase", "left_anti"), "phrase"),
        told("kind_not_allowed", kinds.where(~F.col("kind").isin(allowed_kinds) | (F.col("kind") == "backchannel")), "kind"),
        told("intent_not_allowed", intents.where(~F.col("label").isin(allowed_intents)), "label"),
        told("intent_without_phrases", flow_labels.join(intents, "label", "left_anti"), "label"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
