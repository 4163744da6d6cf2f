"""Rows that know their file and line, stages that stop on bad rows, and the review of a bank."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cordage.operators import review
from cordage.sources import lines, sinks

SCHEMA = StructType([StructField("a", LongType()), StructField("b", StringType())])


def plain(folder):
    """What a plain reader gives: every line that is not blank, with its file and number."""
    return {f"{p.name}:{n}": x for p in sorted(folder.glob("*.jsonl")) for n, x in enumerate(p.read_text(newline="").splitlines(), 1) if x.strip()}


def written(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, newline="")


ODD = '{"a":1}\n\n{"a":2}\r\n{"a":3}\r   \n{"a":4,"b":"x"} {"a":5} \x85{"a":6}\x0b{"a":7}\x0c\x1c\x1d\x1e{"a":8}\nbroken\n{"a":9}'


@pytest.mark.parametrize("end", ["", "\n", " ", "\r\n", "\n\n"])
def test_numbers_are_those_of_a_plain_reader(spark, tmp_path, end):
    written(tmp_path / "in", "a.jsonl", ODD + end), written(tmp_path / "in", "b.jsonl", '{"a":10}' + end), written(tmp_path / "in", "c.jsonl", "")
    got = {f"{r.file}:{r.line}": r.value for r in lines.numbered(spark, f"{tmp_path}/in/*.jsonl").collect() if r.value.strip()}
    assert got == plain(tmp_path / "in")
    rows = {r._where: (r.a, r.b, r._corrupt) for r in lines.read_where(spark, f"{tmp_path}/in/*.jsonl", SCHEMA).collect()}
    assert rows.keys() == got.keys() and sum(c is not None for *_, c in rows.values()) == 1
    assert all(json.loads(got[w])["a"] == a for w, (a, _, c) in rows.items() if c is None)


def test_numbers_go_on_across_splits(spark, tmp_path):
    text = "".join(json.dumps({"a": i, "b": " " if i % 7 == 0 else "x" * (i % 50)}, ensure_ascii=False) + ("\r\n" if i % 3 else "\n") for i in range(4000))
    written(tmp_path / "in", "a.jsonl", text), written(tmp_path / "in", "b.jsonl", text[: len(text) // 2] + "\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for size, batch in (("5000", "17"), ("64000", "10000")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size), spark.conf.set("spark.sql.files.openCostInBytes", "1"), spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            df = lines.numbered(spark, f"{tmp_path}/in/*.jsonl")
            assert spark.read.text(f"{tmp_path}/in/*.jsonl").rdd.getNumPartitions() > 2
            assert {f"{r.file}:{r.line}": r.value for r in df.collect() if r.value.strip()} == plain(tmp_path / "in")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_an_empty_split_and_bad_rows_stop(spark, tmp_path):
    (tmp_path / "none").mkdir()
    written(tmp_path / "blank", "a.jsonl", "\n \n")
    for name in ("none", "blank", "missing"):
        with pytest.raises(lines.BadRows, match=name):
            lines.read_split(spark, f"{tmp_path}/{name}", SCHEMA)
    written(tmp_path / "in", "b.jsonl", '{"a":1}\nno\n{"b":"x"}\n'), written(tmp_path / "in", "a.jsonl", "".join('{"a":1}\n' if i != 10 else "no\n" for i in range(12)) + "no\n")
    rows = lines.read_split(spark, f"{tmp_path}/in", SCHEMA)
    reason = F.when(F.col("_corrupt").isNotNull(), "not_json").when(F.col("a").isNull(), "missing:a")
    with pytest.raises(lines.BadRows, match="^4 invalid rows: a.jsonl:11: not_json; a.jsonl:13: not_json; b.jsonl:2: not_json$"):
        lines.all_or_nothing(rows, reason)
    good = rows.where("a is not null")
    assert lines.all_or_nothing(good, reason) is good


BANK = [("1", "classify_intent", "confirmed", "sí claro", "pending"), ("2", "classify_intent", "confirmed", "va que va", "pending"), ("3", "extract_entity", "phone", "mi número es {value}", "pending"), ("4", "classify_intent", "confirmed", "ya", "approved")]


def said(minute, id_, decision, text=None, who="ana"):
    return id_, dt.datetime(2024, 1, 1, 0, minute), who, decision, text


def test_review_goes_on_where_it_stopped(spark, tmp_path):
    bank = spark.createDataFrame(BANK, "id string, task string, label string, text string, status string")
    first = [said(1, "1", "approve"), said(2, "3", "edit", "sin lugar"), said(2, "9", "approve"), said(3, "2", "skip")]
    then = [said(4, "3", "edit", " «apunte {value}» "), said(5, "1", "reject", who="eva"), said(6, "4", "what"), said(0, "1", "approve")]
    path = f"{tmp_path}/decisions"
    assert review.decided(spark, path).count() == 0
    review.decide(spark.createDataFrame(first, review.DECISIONS), path)
    seen = {r.id: r for r in review.reviewed(bank, review.decided(spark, path)).collect()}
    assert seen["1"].status == "approved" and seen["3"].status == "pending" and sorted(r.id for r in review.pending(bank, review.decided(spark, path)).collect()) == ["2", "3"]
    review.decide(spark.createDataFrame(then, review.DECISIONS), path)
    once = review.reviewed(bank, spark.createDataFrame(first + then, review.DECISIONS))
    resumed = review.reviewed(bank, review.decided(spark, path))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, resumed.collect()))
    seen = {r.id: r for r in resumed.collect()}
    assert (seen["1"].status, seen["1"].reviewed_by) == ("rejected", "eva") and seen["2"].status == "pending" and seen["4"].status == "approved"
    assert (seen["3"].text, seen["3"].original_text, seen["3"].status) == ("apunte {value}", "mi número es {value}", "approved")
    review.publish_reviewed(bank, review.decided(spark, path), f"{tmp_path}/bank")
    assert sinks.read_published(spark, f"{tmp_path}/bank").count() == 4 and sinks.published_manifest(spark, f"{tmp_path}/bank")["decisions"] == 8
    assert review.reviewed(bank.limit(0), review.decided(spark, path)).count() == 0
