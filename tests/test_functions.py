import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cordage.functions import spoken
from cordage.functions import text as T
from cordage.operators import augment as A
from cordage.operators import calls, checks
from cordage.operators import corpus as C
from cordage.sources import tables


@pytest.mark.parametrize(
    ("said", "phone"),
    [
        ("cincuenta y cinco doce treinta y cuatro cero cinco veintidós", "+525512340522"), ("doble cinco uno dos tres cuatro triple seis siete", "+525512346667"),
        ("cincuenta y dos cincuenta y cinco doce treinta y cuatro cero cinco veintidós", "+525512340522"), ("cincuenta y cinco perdón doce", None), ("uno dos tres", None), ("", None), (None, None),
    ],
)
def test_read_phone(said, phone):
    assert spoken.read_phone(said) == phone


def test_every_pair_reads_back():
    for n in range(100):
        assert spoken.read_phone(f"{spoken.say_pair(55)} {spoken.say_pair(n)} " + "uno dos tres cuatro cinco seis") == f"+5255{n:02d}123456"


def test_text_functions(spark):
    rows = [(None,), ("",), ("  ¡Mañana,  NIÑO! Café ",), ("mail a@b.co http://x",), ("call 55 1234 5678 9",), ("w " * 500,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(T.normalize_text(F.col("t")), T.drop_reason(400, F.col("t")), T.word_count(F.col("t"))).collect()
    assert [tuple(r) for r in got[:3]] == [(None, "empty", None), ("", "empty", 0), ("mañana niño cafe", None, 3)]
    assert [r[1] for r in got[3:]] == ["email", "phone", "too_long"]


def test_greedy_two_key(spark):
    import random

    rng = random.Random(3)
    rows = [(p, str(rng.randrange(40)), rng.choice([None, *"abcdefghijklmnopqrstuvwxyz"])) for p in range(120)] + [(200, "7", "x"), (201, "7", "y"), (202, "8", "y")]
    ids, contents, kept = set(), set(), []
    for p, i, c in rows:
        if i not in ids and c not in contents:
            ids.add(i), contents.add(c), kept.append(p)
    df = spark.createDataFrame(rows, "place long, id string, content string")
    assert sorted(r.place for r in C.greedy_two_key(df).collect()) == kept
    assert C.greedy_two_key(df.limit(0)).count() == 0


def test_quotas_and_empty_tables(spark):
    assert C.quotas(10, ["b", "a", "c"]) == {"a": 4, "b": 3, "c": 3}
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert C.stratified(docs, "lang", 5).count() == C.first_wins(docs).count() == C.shortfall(docs, "lang", 5).count() == 0
    assert pd.DataFrame(C.curate_counters(docs, "es", 10).collect()).empty


@pytest.mark.parametrize(
    ("said", "phone"),
    [
        ("siete siete, 41, veintidós, nueve cero, 63", "+527741229063"), ("más 52 1 77 41 22 90 63", "+527741229063"), ("es el setecientos setenta y cuatro ciento veintidós 90 63", "+527741229063"),
        ("siete uno lobo dos tres cuatro cinco seis siete ocho", None), ("quién sabe", None), ("cero siete cuatro uno dos dos nueve cero seis tres", None),
    ],
)
def test_read_phone_among_other_words(said, phone):
    assert spoken.read_phone(said) == phone


@pytest.mark.parametrize(
    ("said", "email"),
    [
        ("zeta o e arroba mail punto net", "zoe@mail.net"), ("su correo es rita guion bajo sol pegado arroba casa punto org", "rita_sol@casa.org"), ("pepe doce arroba correo punto com", "pepe12@correo.com"),
        ("doble u e be arroba sitio punto com", "web@sitio.com"), ("i griega o guion medio equis arroba lago punto es", "yo-x@lago.es"), ("ANA.SOL@LAGO.ES", "ana.sol@lago.es"),
        ("ana de la paz arroba lago punto com punto mx", "anadelapaz@lago.com.mx"), ("nube treinta y uno arroba lago punto es", "nube31@lago.es"),
        ("rita punto sol arroba lago", None), ("rita arroba sol arroba lago punto es", None), ("punto rita arroba lago punto es", None), ("rita punto punto sol arroba lago punto es", None),
        ("eñe o arroba lago punto es", None), ("sol punto te punto rita arroba lago punto es", None), ("", None), (None, None),
    ],
)
def test_read_email(said, email):
    assert spoken.read_email(said) == email


def test_spoken_forms_read_back(spark):
    emails = ["rita.sol@lago.com", "sol_paz77@monte.org", "ana-luz@taller.com.mx", "q.rios03@lago.com.mx", "pepe1999@nube.net", "triple.letra@guion.com"]
    df = spark.createDataFrame([(e,) for e in emails], "e string")
    for style in ("words", "spelled"):
        for e, said in df.select("e", spoken.say_email(F.col("e"), style)).collect():
            assert spoken.read_email(said) == e, (style, said)
    phones = ["7300415926", "6600000000", "4410020003", "2222222222", "9007060500"]
    df = spark.createDataFrame([(p,) for p in phones], "p string")
    for style in ("digits", "pairs", "triples"):
        for p, said in df.select("p", spoken.say_phone(F.col("p"), style)).collect():
            assert spoken.read_phone(said) == f"+52{p}", (style, said)


def test_names(spark):
    raw = ["  rosa   de los ríos  ", "ANA PAULA NÚÑEZ-SOTO", "del monte aguirre", "d'angelo", "", "   ", "eva 7", "eva+sol", None]
    df = spark.createDataFrame([(r,) for r in raw], "n string")
    assert [r[0] for r in df.select(T.normalize_name(F.col("n"))).collect()] == ["Rosa de los Ríos", "Ana Paula Núñez-Soto", "Del Monte Aguirre", "D'Angelo"] + [None] * 5
    key = lambda *names: [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.name_key(F.col("n"))).collect()]
    alike = [("Vidal", "Bidal"), ("Zoila", "Soila"), ("Hilda", "Ilda"), ("Queta", "Keta"), ("Llanos", "Yanos"), ("Gema", "Jema"), ("Celia", "Selia"), ("Xavi", "Javi")]
    assert key(*(a for a, _ in alike)) == key(*(b for _, b in alike))
    assert len(set(key("Rosa", "Rosario", "Pablo", "Paula", "Elena", "Elenor"))) == 6


def test_noise(spark):
    text = " ".join(["no", "cinco", "sesenta", "vaca", "de", "ocho,", "ya", "zeta"] * 5)
    df = spark.range(400).withColumn("t", F.lit(text)).withColumn("wer", F.lit(0.15))
    noised = A.add_noise(df, "t", F.col("wer"), F.col("id"))
    rows = noised.collect()
    assert abs(sum(r.measured for r in rows) / 400 - 0.15) < 0.01
    assert all(r.noised.split().count("no") == 5 and r.noised.split().count("ya") == 5 for r in rows)
    assert {t.kind for r in rows for t in r.tokens} == {None, "homophone", "mishearing", "respelled", "filler", "deleted"}
    assert sorted(rows) == sorted(A.add_noise(df.repartition(7), "t", F.col("wer"), F.col("id")).collect())
    odd = spark.createDataFrame([(None, 0.5), ("", 0.5), ("no ya", 0.9), (", ,", 0.9)], "t string, wer double")
    assert [r.noised for r in A.add_noise(odd, "t", F.col("wer"), F.lit(1)).collect()] == [None, "", "no ya", ", ,"]


def test_relabel(spark):
    tokens = "array<struct<text:string,original:string,kind:string,in_value:boolean>>"
    said = "ochenta y uno ochenta y dos treinta y cuatro sesenta y cinco setenta y ocho".split()
    edited = lambda **e: [(e[w][0], w, e[w][1], True) if w in e else (w, w, None, True) for w in said]
    full, rows = "+528182346578", [
        (edited(cinco=("sinco", "respelled")), "+528182346578"), (edited(sesenta=("setenta", "mishearing")), "+528182346578"),
        (edited(dos=("trece cuatro", "mishearing")), "+528182346578"), (edited(sesenta=("setenta", "mishearing")), None),
    ]
    got = A.relabel_phone(spark.createDataFrame(rows, f"tokens {tokens}, truth string"), "truth").collect()
    assert [(r.outcome, r.label) for r in got[:3]] == [("kept", full), ("heard", "+528182347578"), ("unresolved", None)] and got[3].outcome == "dropped"


TURNS = {
    1: [("gives", 0.9, "Ana"), ("confirmed", 0.9, None), ("gives", 0.9, "+52"), ("confirmed", 0.9, None), ("gives", 0.9, "a@b"), ("confirmed", 0.8, None), ("gives", 0.9, "late")],
    2: [("gives", 0.9, "Ana"), ("call_rejected", 0.9, None), ("gives", 0.9, "Ana")],
    3: [("out_of_scope", 0.9, None)] * 3 + [("gives", 0.9, None)] * 2 + [("gives", 0.9, "x"), ("denied", 0.9, "y"), ("confirmed", 0.5, None)],
    4: [(None, None, None)],
}
ENDED = {1: (6, "completed", 3, 0, 0, 0), 2: (2, "rejected", 0, 0, 0, 0), 3: (8, "open", 0, 1, 2, 4), 4: (1, "open", 0, 0, 0, 1)}


def _turn_rows(spark):
    rows = [(c, k, *t) for c, ts in TURNS.items() for k, t in enumerate(ts)] + [(None, 0, "gives", 0.9, "x")]
    return spark.createDataFrame(rows[::-1], "call long, seq long, intent string, confidence double, value string")


def test_call_state(spark, tmp_path):
    turns = _turn_rows(spark)
    assert {r[0]: tuple(r[1:]) for r in calls.fold_calls(turns).collect()} == ENDED
    assert calls.fold_calls(turns.limit(0)).count() == 0
    for part in (0, 1):
        turns.where(f"call is not null and seq % 100 >= 3 = {part == 1}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = calls.stream_calls(spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 10).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("calls_out").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r[0]: tuple(r[1:]) for r in spark.table("calls_out").collect()} == ENDED


def test_checks(spark):
    rows = [("call_ended", '{"outcome":"completed","turns":3}'), ("call_ended", '{"outcome":"lost","turns":-1}'), ("nothing", "{}"), ("latency", "[1]"), ("latency", None), (None, "{}"), ("barge_in", '{"turn_idx":0,"interrupted":true,"p_real":2}')]
    got = spark.createDataFrame(rows, "kind string, payload string").select(checks.problems(F.col("payload"), F.col("kind"), checks.EVENTS)).collect()
    assert [sorted(r[0]) for r in got] == [[], ["not_allowed:outcome", "out_of_bounds:turns"], ["unknown_type"], ["not_an_object"], ["not_an_object"], ["unknown_type"], ["out_of_bounds:p_real"]]


def test_intact(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"12"), (tmp_path / "b").write_bytes(b"123")
    manifest = spark.createDataFrame([("s", "a", 2), ("s", "b", 3), ("t", "a", 2), ("t", "c", 1), ("u", "a", 9)], "source string, name string, bytes long")
    found = tables.intact(manifest, tables.files(spark, str(tmp_path)))
    assert {r.source: r.intact for r in found.collect()} == {"s": True, "t": False, "u": False}


def plain_normal(text):
    kept = text.lower().replace("ñ", "\1")
    bare = "".join(c for c in unicodedata.normalize("NFD", kept) if unicodedata.category(c) != "Mn").replace("\1", "ñ")
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in bare).split())


def test_folding_is_that_of_the_character_database(spark):
    letters = "".join(chr(i) for i in (*range(0xA1, 0x600), *range(0x1E00, 0x2000)) if unicodedata.category(chr(i))[0] in "LNM")
    texts = ["El CAFE\u0301, e\u0301l café", "Škoda ý ő Ǘ ḝ ñ Ñ n\u0303", "a\x1cb\u00a0c\u2003d", "¿Qué? ¡sí!", "", "ΐ ό Ж ё й", *(letters[i : i + 200] for i in range(0, len(letters), 200))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.n, r.a) for r in df.select("i", T.normalize_text(F.col("t")).alias("n"), T.ascii_fold(F.col("t")).alias("a")).collect()}
    assert [got[i][0] for i in range(6)] == [plain_normal(t) for t in texts[:6]]
    for i in range(6, len(texts)):
        assert got[i][0] == plain_normal(texts[i]), texts[i]
    assert got[0][0] == "el cafe el cafe" and got[1][0] == "skoda y o u e ñ ñ n" and got[1][1] == "skoda y o u e n n n"
    assert len(T.base_letters()[0]) == len(T.base_letters()[1]) > 800


def test_drop_reasons_in_any_case_and_white_space(spark):
    said = [("HTTP://x.y", "link"), ("see WWW.A.B", "link"), ("55\n12\t34 56\u00a078 9", "phone"), ("1914-1918 was", None), ("ñandú@casa.mx", "email"), ("a @ b.c", None), ("\u2003\t", "empty"), (None, "empty"), ("w " * 401, "too_long"), ("w " * 400, None), ("(55) 1234-5678 9", "phone"), ("x" * 50_000, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)], "i int, t string")
    got = {r.i: tuple(r)[1:] for r in df.select("i", T.drop_reason(400, F.col("t")).alias("a"), T.drop_reason(400, F.lit("fine"), F.col("t")).alias("b"), T.drop_reason(400, F.col("t"), F.lit("me@x.mx")).alias("c")).collect()}
    for i, (_, want) in enumerate(said):
        assert got[i] == (want, want, want or "email"), said[i]


def test_noise_keeps_the_shares_of_its_edits(spark):
    """On texts whose every word allows every edit the shares are those set; elsewhere no edit stands in for another."""
    from collections import Counter

    df = spark.createDataFrame([(i, " ".join(["de"] * 40), " ".join(["nueve"] * 40), " ".join(["hotel"] * 40)) for i in range(400)], "id int, all string, sub string, none string")
    told = {c: Counter(t.kind for r in A.add_noise(df, c, F.lit(0.25), F.col("id")).collect() for t in r.tokens if t.kind) for c in ("all", "sub", "none")}
    share = {c: {k: n / sum(v.values()) for k, n in v.items()} for c, v in told.items()}
    assert sum(told["all"].values()) == 4000
    assert abs(share["all"]["deleted"] - 0.2) < 0.02 and abs(share["all"]["filler"] - 0.2) < 0.02
    assert abs(share["sub"]["filler"] - 0.25) < 0.02 and "deleted" not in share["sub"] and share["none"] == {"filler": 1.0}
    own = A.Confusions(homophones={"hotel": ["otel"]}, mishearings={}, spellings=[("zz", "s")], deletable=("hotel",), fillers=("em",), substitute=0.5, delete=0.3)
    kinds = Counter(t.kind for r in A.add_noise(df, "none", F.lit(0.25), F.col("id"), confusions=own).collect() for t in r.tokens if t.kind)
    assert abs(kinds["homophone"] / 4000 - 0.5) < 0.03 and abs(kinds["deleted"] / 4000 - 0.3) < 0.03 and kinds.keys() == {"homophone", "deleted", "filler"}
    mixed = " ".join("mi número es cincuenta y cinco doce treinta y cuatro de la casa".split() * 3)
    more = Counter(t.kind for r in A.add_noise(df.select("id", F.lit(mixed).alias("t")), "t", F.lit(0.25), F.col("id")).collect() for t in r.tokens if t.kind)
    by = A.Confusions()
    allowed = [(0.6 * (w in by.homophones or w in by.mishearings or any(a in w for a, _ in by.spellings)), 0.2 * (w in by.deletable)) for w in mixed.split()]
    drawn = sum(s + d + 0.2 for s, d in allowed)  # as if each draw of a word and an edit that does not fit were put back
    assert abs(more["filler"] / sum(more.values()) - 0.2 * len(allowed) / drawn) < 0.05 and abs(more["deleted"] / sum(more.values()) - sum(d for _, d in allowed) / drawn) < 0.05


def test_confusions_are_of_the_words_that_values_are_said_with():
    assert "setenta" in A.mishearings()["sesenta"] and "ene" in A.mishearings()["eme"] and "sero" in A.homophones()["cero"]
    assert A._distance("kitten", "sitting") == 3 and A._distance("", "ab") == 2 and A._distance("x", "x") == 0
