"""Speech-recognition noise at a target word error rate, and labels that stay true under it.

All draws are hashes of a seed, the row's id and the place, so a row's noise depends on nothing else. The
whole operator is array functions; only reading a noised number back is a Python function.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spoken
from ..functions.once import once

#: Spellings of one sound, by which a word is written as another would hear it.
SPELLINGS = [("v", "b"), ("b", "v"), ("z", "s"), ("ce", "se"), ("ci", "si"), ("ll", "y"), ("qu", "k"), ("ge", "je"), ("gi", "ji"), ("á", "a"), ("é", "e"), ("í", "i"), ("ó", "o"), ("ú", "u")]
VALUE_WEIGHT = 3.0


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i, *(0 for _ in b)]
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return row[-1]


def _said_words() -> list[str]:
    """Words that values are said with: numbers, tens, names of letters and signs."""
    return sorted({w for w in (*spoken.SMALL, *spoken.TENS.values(), *spoken.LETTERS, *spoken.WORD_LETTERS, *spoken.SIGNS) if w.isalpha() and len(w) > 1})


def homophones() -> dict[str, list[str]]:
    """For each word that values are said with, how it can be spelt with the same sound."""
    found = {w: [w.replace(a, b, 1) for a, b in SPELLINGS if a in w] for w in _said_words()}
    return {w: v for w, v in found.items() if v}


def mishearings() -> dict[str, list[str]]:
    """For each word that values are said with, others that one letter tells apart, or two if the words are longer and begin or end alike."""
    words = _said_words()
    short = lambda a, b: min(len(a), len(b)) < 4 and _distance(a, b) == 1
    long = lambda a, b: min(len(a), len(b)) >= 4 and 1 <= _distance(a, b) <= 2 and (a[:2] == b[:2] or a[-2:] == b[-2:])
    near = lambda a, b: short(a, b) or long(a, b)
    found = {a: [b for b in words if near(a, b)] for a in words}
    return {a: v for a, v in found.items() if v}


@dataclass(frozen=True)
class Confusions:
    """What noise may do: words of one sound, words taken for others, spellings, words that may be lost, words never touched, hesitations, shares."""

    homophones: dict[str, list[str]] = field(default_factory=homophones)
    mishearings: dict[str, list[str]] = field(default_factory=mishearings)
    spellings: list[tuple[str, str]] = field(default_factory=lambda: SPELLINGS)
    deletable: tuple[str, ...] = ("a", "de", "del", "el", "en", "es", "la", "las", "le", "lo", "los", "mi", "que", "su", "un", "una", "y")
    protected: tuple[str, ...] = ("no", "sí", "si", "ni", "nunca", "tampoco", "cancelar", "correcto", "perdón", "ya")
    fillers: tuple[str, ...] = ("eh", "em", "este", "mmm", "bueno", "o sea")
    substitute: float = 0.6
    delete: float = 0.2


# Edits after which a value can still be read, by field.
RECOVERABLE = {"phone": ["homophone", "respelled", "filler", "deleted"], "email": ["homophone", "filler"], "name": ["filler"]}
# Ways of saying a value that can't be read back by rule.
UNREADABLE = ("correction", "said_spelled")
MARKS = r"^[,.;:¿?¡!…]+|[,.;:¿?¡!…]+$"


def draw(*parts: Column) -> Column:
    """An even number in [0, 1) that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(2**53)


def _table(words: dict[str, list[str]]) -> Column:
    return F.from_json(F.lit(str(words).replace("'", '"')), "map<string,array<string>>")


def _pick(options: Column, u: Column) -> Column:
    return F.element_at(options, (F.floor(u * F.size(options)) + 1).cast("int"))


def _count_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, " "), lambda x: x != ""))


def add_noise(rows: DataFrame, text: str, wer: Column, key: Column, start: str | None = None, end: str | None = None, confusions: Confusions | None = None) -> DataFrame:
    """Adds ``tokens`` (text, original, kind, in_value), ``noised`` (the text) and ``measured`` (edits over words).

    ``start`` and ``end`` name the columns with the value's span; its words are edited three times as often. The
    number of edits is ``wer`` times the words, rounded up or down by a draw; which words, by weighted draws without
    replacement. Null texts give null; empty ones no edits.

    An edit is one of substitution, deletion and filler, by the shares of ``confusions``. What a word does not allow is not
    replaced by what it does: the word is drawn as much less often, as if it were put back and drawn again.
    """
    by = confusions or Confusions()
    words = F.filter(F.split(text, " "), lambda x: x != "")
    df = rows.withColumn("_words", words).withColumn("_key", key)
    before = upto = F.lit(0)
    if start is not None:
        before, upto = (_count_words(F.substring(text, F.lit(1), F.col(c))) for c in (start, end))
    span = F.struct(before.alias("from"), upto.alias("to"))
    u = lambda what, i: draw(F.lit(what), F.col("_key"), i)
    core = lambda w: F.lower(F.regexp_replace(w, MARKS, ""))
    rules = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in by.spellings))
    df = df.withColumn("_homophones", _table(by.homophones)).withColumn("_mishearings", _table(by.mishearings)).withColumn("_rules", rules)

    def token(x: Column, at: Column) -> Column:
        w, c, i = x["w"], x["core"], x["i"]
        inside = (i >= at["from"]) & (i < at["to"])
        free = (c != "") & ~c.isin(*by.protected)
        known = F.map_contains_key("_homophones", c) | F.map_contains_key("_mishearings", c) | F.exists("_rules", lambda r: F.instr(c, r["a"]) > 0)
        share = lambda may, of: F.when(may, of).otherwise(0.0)
        return F.struct(w.alias("w"), c.alias("core"), i.alias("i"), inside.alias("in_value"), free.alias("free"), share(free & known, by.substitute).alias("sub"), share(free & c.isin(*by.deletable), by.delete).alias("del"))

    cores = F.transform("_words", lambda w, i: F.struct(w.alias("w"), core(w).alias("core"), i.alias("i")))
    df = df.withColumn("_tokens", once(span, lambda at: F.transform(cores, lambda x: token(x, at))))
    filler_share = 1.0 - by.substitute - by.delete
    weight = lambda t: F.when(t["in_value"], VALUE_WEIGHT).otherwise(1.0) * (t["sub"] + t["del"] + filler_share)
    order = lambda t: F.when(t["free"], -F.log(u("order", t["i"]) + 1e-18) / weight(t))
    df = df.withColumn("_wanted", F.floor(wer * F.size("_words") + draw(F.lit("round"), F.col("_key"))).cast("int"))
    df = df.withColumn("_order", F.when(F.col("_wanted") > 0, F.transform("_tokens", order)))  # rows without an edit need no draws of their words
    sorted_order = F.array_sort(F.filter("_order", lambda x: x.isNotNull()))
    able = F.least(F.col("_wanted"), F.size(sorted_order))
    cut = F.when(able > 0, F.element_at(sorted_order, F.greatest(able, F.lit(1)))).otherwise(-1.0)

    def edit(t: Column, o: Column, cut: Column) -> Column:
        c, w, pick, which = t["core"], t["w"], u("pick", t["i"]), u("table", t["i"])
        op = u("op", t["i"]) * (t["sub"] + t["del"] + filler_share)
        same, other = F.element_at("_homophones", c), F.element_at("_mishearings", c)
        fits = F.filter("_rules", lambda r: F.instr(c, r["a"]) > 0)
        rule = _pick(fits, pick)
        at = F.instr(c, rule["a"])
        respelled = F.concat(F.substring(c, F.lit(1), at - 1), rule["b"], F.substring(c, at + F.length(rule["a"]), F.length(c)))
        put = lambda new: F.replace(F.lower(w), c, new)
        made = lambda new, kind: _edited(t, new, kind)
        filler = F.concat(w, F.lit(" "), _pick(F.array(*map(F.lit, by.fillers)), pick))
        return (
            F.when(o.isNull() | (o > cut), made(w, None))
            .when((op < t["sub"]) & same.isNotNull() & (other.isNull() | (which < 0.5)), made(put(_pick(same, pick)), "homophone"))
            .when((op < t["sub"]) & other.isNotNull(), made(put(_pick(other, pick)), "mishearing"))
            .when(op < t["sub"], made(put(respelled), "respelled"))
            .when(op < t["sub"] + t["del"], made(w, "deleted"))
            .otherwise(made(filler, "filler"))
        )

    drawn = F.transform("_tokens", lambda t, i: F.struct(t.alias("t"), F.get("_order", i).alias("o")))
    tokens = once(cut, lambda most: F.transform(drawn, lambda z: edit(z["t"], z["o"], most)))
    df = df.withColumn("tokens", F.when(F.col("_wanted") > 0, tokens).otherwise(F.transform("_tokens", lambda t: _edited(t, t["w"], None))))
    edits = F.size(F.filter("tokens", lambda t: t["kind"].isNotNull()))
    df = df.withColumn("noised", shown(F.col("tokens"))).withColumn("measured", F.when(F.size("_words") > 0, edits / F.size("_words")).otherwise(0.0))
    return df.drop("_words", "_key", "_tokens", "_wanted", "_order", "_homophones", "_mishearings", "_rules")


def _edited(token: Column, new: Column, kind: str | None) -> Column:
    return F.struct(new.alias("text"), token["w"].alias("original"), F.lit(kind).cast("string").alias("kind"), token["in_value"].alias("in_value"))


def shown(tokens: Column) -> Column:
    return F.array_join(F.transform(F.filter(tokens, lambda t: ~t["kind"].eqNullSafe("deleted")), lambda t: t["text"]), " ")


def relabel(rows: DataFrame, truth: str, field: Column, style: Column | None = None) -> DataFrame:
    """Adds ``label`` and ``outcome``: kept (still readable), heard (another value now), unresolved, dropped.

    Edits that leave a field's value readable are undone before it is read again; what remains was heard. Names, addresses with
    respelled words and values said with a correction can't be read again: they are unresolved. A row without a value never
    gains one: it is dropped if its noise reads as one.
    """
    recoverable = F.element_at(F.create_map(*(x for k, v in RECOVERABLE.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("_field"))
    lost = lambda t: t["kind"].isNotNull() & ~F.array_contains(F.col("_fine"), t["kind"])
    value = F.filter("tokens", lambda t: t["in_value"])
    df = rows.withColumn("_field", field).withColumn("_fine", recoverable)
    heard = F.array_join(F.transform(value, lambda t: F.when(lost(t), t["text"]).otherwise(F.coalesce(t["original"], t["text"]))), " ")
    closed = (F.col("_field") == "name") | F.coalesce((F.lit(None).cast("string") if style is None else style).isin(*UNREADABLE), F.lit(False))
    closed = closed | ((F.col("_field") == "email") & F.exists(value, lambda t: t["kind"].eqNullSafe("respelled")))
    df = df.withColumn("_hit", F.exists(value, lost)).withColumn("_closed", closed).withColumn("_said", heard)
    said = lambda name: F.when(F.col("_hit") & ~F.col("_closed") & (F.col("_field") == name), F.col("_said"))
    df = df.withColumn("_phone", said("phone")).withColumn("_email", said("email"))
    # each read once, and not moved into filters or conditions above
    df = df.withColumn("_phone", spoken.read_phones.asNondeterministic()("_phone")).withColumn("_email", spoken.read_emails.asNondeterministic()("_email"))
    df = df.withColumn("_heard", F.coalesce("_phone", "_email"))
    same = ~F.col("_hit") | (F.col("_closed") & F.col(truth).isNull()) | (~F.col("_closed") & F.col("_heard").eqNullSafe(F.col(truth)))
    outcome = F.when(same, "kept").when(F.col(truth).isNull(), "dropped").when(F.col("_heard").isNull(), "unresolved").otherwise("heard")
    return df.withColumn("outcome", outcome).withColumn("label", F.when(same, F.col(truth)).otherwise(F.col("_heard"))).drop("_field", "_fine", "_hit", "_closed", "_said", "_phone", "_email", "_heard")


def relabel_phone(rows: DataFrame, truth: str) -> DataFrame:
    return relabel(rows, truth, F.lit("phone"))


def asr_confidence(wer: Column, *key: Column) -> Column:
    """What a recogniser might say of itself: falls with the error rate, with noise that depends on the key alone."""
    noise = F.sqrt(-2 * F.log(draw(F.lit("a"), *key) + 1e-18)) * F.cos(2 * math.pi * draw(F.lit("b"), *key))
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.30), 1.0 - 1.4 * wer + 0.03 * noise)), 3)


def make_variants(examples: DataFrame, k: int, seed: str = "7", levels: tuple[float, ...] = (0.05, 0.15, 0.25)) -> DataFrame:
    """``k`` variants of each of ``examples(id, group, field, style, transcript, start, stop, truth)`` that have a true label.

    Gives id (with the variant's number), group, transcript, wer_target, wer, start, stop, raw_span, asr_confidence, label,
    outcome. The span is the value's place in the noised text, null if nothing of it is left.
    """
    return all_variants(examples, k, seed, levels).where("outcome <> 'dropped'")


def all_variants(examples: DataFrame, k: int, seed: str = "7", levels: tuple[float, ...] = (0.05, 0.15, 0.25)) -> DataFrame:
    """``make_variants`` with those that are dropped, so that ``outcomes`` can count them."""
    key = lambda: F.concat_ws(":", F.lit(seed), "id", F.col("k").cast("string"))
    rows = add_noise(variants(examples, k, levels), "transcript", F.col("wer"), key(), "start", "stop")
    seen = F.filter("tokens", lambda t: ~t["kind"].eqNullSafe("deleted"))
    told = relabel(rows, "truth", F.col("field"), F.col("style")).withColumn("_seen", seen)
    first = F.array_position(F.transform("_seen", lambda t: t["in_value"]), True).cast("int")
    text = lambda ts: F.array_join(F.transform(ts, lambda t: t["text"]), " ")
    told = told.withColumn("_first", F.when((first > 0) & F.col("start").isNotNull(), first))
    before = F.when(F.col("_first") > 1, F.length(text(F.slice("_seen", F.lit(1), F.greatest(F.col("_first") - 1, F.lit(1))))) + 1).otherwise(0)
    span = F.when(F.col("_first").isNotNull(), text(F.filter("_seen", lambda t: t["in_value"])))
    begin = F.when(F.col("_first").isNotNull(), before)
    return told.select(
        F.concat("id", F.lit("-v"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("id"), "group", "field", F.col("noised").alias("transcript"), F.col("wer").alias("wer_target"), F.least(F.col("measured"), F.lit(1.0)).alias("wer"),
        begin.alias("start"), (begin + F.length(span)).alias("stop"), span.alias("raw_span"), asr_confidence(F.col("measured"), key()).alias("asr_confidence"), "label", "outcome",
    )


def outcomes(made: DataFrame) -> DataFrame:
    """``(kind, name, outcome, n, value)`` of ``made(task, outcome, wer_target, wer)`` as ``all_variants`` gives it.

    ``labels``: how many variants of each task had each outcome, dropped ones too. ``wer_applied_mean``: the mean error rate of
    what was kept at each target, to four digits. Sums are partial aggregates of one pass; an empty table gives no rows.
    """
    kept = F.col("outcome") != "dropped"
    each = made.groupBy("task", "outcome", "wer_target").agg(F.count("*").alias("n"), F.sum(F.when(kept, F.col("wer"))).alias("s"), F.count(F.when(kept, F.col("wer"))).alias("m"))
    sets = each.groupingSets([["task", "outcome"], ["wer_target"]], "task", "outcome", "wer_target")
    rows = sets.agg(F.grouping("wer_target").alias("g"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("m").alias("m")).where("g = 1 OR m > 0")
    label = F.col("g") == 1
    return rows.select(
        F.when(label, "labels").otherwise("wer_applied_mean").alias("kind"), F.when(label, F.col("task")).otherwise(F.col("wer_target").cast("string")).alias("name"), "outcome",
        F.when(label, F.col("n")).otherwise(F.col("m")).alias("n"), F.when(~label, F.round(F.try_divide("s", "m"), 4)).alias("value"),
    )


def variants(rows: DataFrame, k: int, levels: tuple[float, ...] = (0.05, 0.15, 0.25)) -> DataFrame:
    """Each row ``k`` times: the clean one (0), then the levels in turn."""
    n = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    level = F.element_at(F.array(*map(F.lit, levels)), F.pmod(F.col("k") - 1, F.lit(len(levels))) + 1)
    return rows.withColumn("k", n).withColumn("wer", F.when(F.col("k") == 0, 0.0).otherwise(level))
