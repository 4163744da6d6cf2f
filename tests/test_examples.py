import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cordage.functions import decisions, spoken
from cordage.operators import examples as X
from cordage.operators import phrases as B
from cordage.plans import queries as Q
from cordage.sources import ingest as I

SF = "/root/testdata/sf0.001"


def test_replies(spark):
    rows = ['ok ```{"phrases": ["a", 1, null, {"b": 2}, "c"]}``` end', "{}", '{"phrases": "a"}', "[1]", "{broken}", None, "", '{"phrases": []}']
    got = spark.createDataFrame([(r,) for r in rows], "r string").select(B.read_reply(F.col("r"))).collect()
    assert [r[0] for r in got] == [["a", "c"]] + [[]] * 7


def test_reject_reasons(spark):
    rows = [
        ("extract_entity", "mi número es {value}", None), ("extract_entity", "mi número", "value"), ("extract_entity", "{value} {value}", "value"), ("classify_intent", "sí {value}", "value"), ("classify_intent", "a las 3", "forbidden"),
        ("classify_intent", "vea www.x", "forbidden"), ("is_real_interruption", "uno " * 9, "words"), ("is_real_interruption", "", "words"), ("is_real_interruption", "a ver", None), ("other", "x", "task"),
    ]
    got = spark.createDataFrame(rows, "task string, text string, want string").select(B.reject_reason(F.col("task"), F.col("text")), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_bank_keeps_the_first_and_nothing_known(spark):
    replies = [("classify_intent", "yes", '{"phrases": ["«Sí, claro»", "sí claro!", "no"]}', 1), ("classify_intent", "yes", '{"phrases": ["SI CLARO", "bueno", "7"]}', 0)]
    found = B.candidates(spark.createDataFrame(replies, "task string, label string, reply string, place long"))
    bank = spark.createDataFrame([("classify_intent", "yes", "Bueno.", "approved"), ("classify_intent", "yes", "8", "approved"), ("classify_intent", "yes", "va", "pending")], "task string, label string, text string, status string")
    new = B.new_phrases(found, bank)
    assert {(r["text"], r["n"]) for r in new.collect()} == {("SI CLARO", 3), ("no", 1)}
    assert {tuple(r) for r in B.rejections(found, new).collect()} == {("forbidden", 1), ("duplicate", 3)}
    assert [r["text"] for r in B.approved(bank).collect()] == ["Bueno."]


def test_requests(spark):
    labels = spark.createDataFrame([("a", "x", 0.5, ["p", "q"]), ("a", "y", 0.5, []), ("b", "z", 0.0, None)], "task string, label string, share double, contexts array<string>")
    got = sorted((r["label"], r["i"], r["persona"], r["context"]) for r in B.requests(labels, 20, 2.0, 4, ["m", "n"]).collect())
    assert got == [("x", 0, "m", "p"), ("x", 1, "n", "q"), ("x", 2, "m", "p"), ("y", 0, "m", None), ("y", 1, "n", None), ("y", 2, "m", None)]


def test_interruption(spark):
    rows = [
        ('{"interruption": true, "confidence": 0.4}', 0.4, True), ('{"interruption": true, "confidence": 0.3}', 0.3, False), ('{"interruption": false, "confidence": 0.9, "kind": "backchannel"}', 0.1, False),
        ('{"interruption": false, "confidence": 0.9, "kind": "rejection"}', 0.1, True), ('{"interruption": false, "confidence": 0.5}', 0.5, True), ('{"interruption": false, "confidence": 1}', 0.0, False),
    ]
    bad = [None, "", "x", "[]", '{"interruption": false}', '{"interruption": "false", "confidence": 1}', '{"interruption": false, "confidence": "1"}', '{"interruption": false, "confidence": 1.1}']
    bad += ['{"interruption": false, "confidence": 1, "more": 1}', '{"interruption": false, "confidence": 1, "kind": "x"}', '{"interruption": false, "confidence": 1, "kind": null}', '{"interruption": false, "confidence": true}']
    rows += [(b, 0.5, True) for b in bad]
    got = spark.createDataFrame(rows, "o string, p double, i boolean").select(F.round(decisions.interruption(F.col("o"), 0.35)[0], 9), "p", decisions.interruption(F.col("o"), 0.35)[1], "i", "o").collect()
    assert [r["o"] for r in got if (r[0], r[2]) != (r["p"], r["i"])] == []
    with pytest.raises(ValueError):
        decisions.interruption(F.lit(""), 0.5)


def test_interruption_space_of_short_utterances(spark):
    got = X.interruption_examples(spark.createDataFrame([("objection", "no"), ("objection", "no")], "kind string, text string"), ["uno", "uno dos tres", ""])
    assert sorted(r["agent_said"] for r in got.collect()) == ["uno", "uno dos"]


def test_entity_examples_read_back(spark):
    people = Q.entity_people(spark, SF)
    rows = X.entity_examples(people, **Q.ENTITY).collect()
    assert len(rows) == people.count() and len({r["example_id"] for r in rows}) == len(rows)
    read = {"phone": spoken.read_phone, "email": spoken.read_email}
    for r in rows:
        if r["raw_span"] is not None:
            assert r["transcript"][r["start"] : r["stop"]] == r["raw_span"]
        else:
            assert r["start"] is None and r["reprompt_reason"] == "not_provided" and r["transcript"]
        assert r["needs_reprompt"] == (r["normalized_value"] is None)
        if r["field"] in read and r["raw_span"] is not None:
            assert read[r["field"]](r["raw_span"]) == r["normalized_value"], r
        if r["field"] == "name" and r["normalized_value"]:
            assert "se escribe" in r["raw_span"]
    share = sum(r["reprompt_reason"] in ("not_provided", "incomplete") for r in rows) / len(rows)
    assert 0.05 < share < 0.3
    some = X.entity_examples(spark.createDataFrame([(0, None, None, None), (1, "Ana", None, None), (2, "Ana", "5512345678", "a.b@c.mx")], "id long, name string, phone string, email string"), **Q.ENTITY).collect()
    assert [r["field"] for r in some] == ["email"]


def test_ingest(spark, tmp_path):
    text, bronze = b"a,b\n1,2\n", str(tmp_path / "bronze")
    pin = hashlib.sha256(text).hexdigest()
    specs = spark.createDataFrame([("calls", "url", "https://x/y", pin, None, None, "MIT", "test", True)], I.SPEC)
    source = I.checked(specs).first().asDict()

    def fetch(_, folder):
        Path(folder.removeprefix("file:")).joinpath("y.csv").write_bytes(text)

    def never(*_):
        raise AssertionError("fetched twice")

    at = I.ingest(spark, source, bronze, "2024-01-01", fetch)
    assert I.ingest(spark, source, bronze, "2024-01-02", never) == at
    with pytest.raises(FileExistsError):
        I.ingest(spark, source | {"pin": "0" * 64, "sha256": "0" * 64}, bronze, "2024-01-01", never)
    with pytest.raises(ValueError, match="checksum"):
        I.ingest(spark, source | {"pin": "0" * 64, "sha256": "0" * 64}, bronze, "2024-01-03", fetch)
    with pytest.raises(RuntimeError, match="no files"):
        I.ingest(spark, source | {"pin": "1" * 64}, bronze, "2024-01-03", lambda *_: None)
    with pytest.raises(PermissionError):
        I.ingest(spark, source | {"verified": False}, bronze, "2024-01-03", never)
    assert [p.name for p in (tmp_path / "bronze" / "calls").iterdir()] == ["ingest_date=2024-01-01"]
    Path(at.removeprefix("file:")).joinpath("files", "y.csv").write_bytes(b"short")
    assert I.find_existing(spark, "calls", pin, bronze) is None
    with pytest.raises(ValueError, match="Calls: name"):
        I.checked(specs.withColumn("name", F.lit("Calls")))
