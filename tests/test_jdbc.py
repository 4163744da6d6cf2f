"""Tables of a database: ranges that hold every row once, pushed filters, writes that replace by key and are all or none."""

import uuid

import pytest
from pyspark.sql import functions as F

from cordage.sources import jdbc

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path_factory.mktemp("derby") / "derby.log"))
    at = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    jdbc._execute(
        spark, at, DRIVER,
        "CREATE TABLE company (id INT PRIMARY KEY, name VARCHAR(100) NOT NULL, sector VARCHAR(100))",
        "CREATE TABLE contact (id VARCHAR(36) PRIMARY KEY, company_id INT REFERENCES company(id), name VARCHAR(100), phone VARCHAR(40))",
        "CREATE TABLE turn (id VARCHAR(36), call_id BIGINT, idx INT NOT NULL, created_at TIMESTAMP, latency_ms DOUBLE)",
    )
    return at


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tables_round_trip(spark, url):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    # no null texts: Spark binds them as CLOB to Derby, whose VARCHAR columns refuse that
    company = read("nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"), F.lit("trade").alias("sector"))
    contact = read("customer").select(F.md5(F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").cast("int").alias("company_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("phone"))
    turn = read("events").select(F.sha2(F.col("event_id").cast("string"), 224).substr(1, 36).alias("id"), F.col("user_id").cast("long").alias("call_id"), F.lit(0).alias("idx"), F.col("ts").cast("timestamp").alias("created_at"), F.col("value").cast("double").alias("latency_ms"))
    for name, df, key in [("company", company, "id"), ("contact", contact, "id"), ("turn", turn, "id")]:
        jdbc.write_rows(df, url, name, key, parts=3, **DRIVER)
        got = jdbc.read_rows(spark, url, name, key, parts=5, **DRIVER)
        got = got.toDF(*(c.lower() for c in got.columns)).select(df.columns)
        assert rows(got) == rows(df)
        assert got.rdd.getNumPartitions() == 5
    timed = jdbc.read_rows(spark, url, "turn", "CREATED_AT", parts=4, **DRIVER)
    assert timed.count() == turn.count() and timed.rdd.getNumPartitions() == 4
    assert jdbc.read_rows(spark, url, "turn", "IDX", parts=4, **DRIVER).count() == turn.count()  # one value of the key


def test_filters_and_columns_reach_the_database(spark, url, capsys):
    jdbc.read_rows(spark, url, "turn", "CALL_ID", parts=4, **DRIVER).where("LATENCY_MS > 10").select("ID").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(LATENCY_MS,10.0)" in plan and "ReadSchema: struct<ID:string>" in plan


def test_a_write_replaces_by_key_and_is_all_or_none(spark, url):
    kind = "id int, name string, sector string"
    now = lambda: {r.ID: r.NAME for r in jdbc.read_rows(spark, url, "company", "ID", **DRIVER).where("ID >= 900").collect()}
    write = lambda *each: jdbc.write_rows(spark.createDataFrame([(*r, "s") for r in each], kind), url, "company", "id", **DRIVER)
    write((900, "a"), (901, "b"))
    write((901, "c"), (902, "d"), (902, "d"))  # a repeated row, as a rerun task leaves it, counts once
    assert now() == {900: "a", 901: "c", 902: "d"}
    with pytest.raises(Exception):  # noqa: B017
        write((900, "x"), (903, None))
    with pytest.raises(Exception):  # noqa: B017
        write((904, "y"), (904, "z"))
    assert now() == {900: "a", 901: "c", 902: "d"}
    assert not [t for t in spark.read.format("jdbc").options(url=url, query="SELECT TABLENAME AS t FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'", **DRIVER).load().collect() if t[0].startswith("COMPANY_")]


@pytest.mark.parametrize("parts", [1, 2, 7, 256, 1000])
def test_ranges_of_text_hold_every_row_once(spark, parts):
    values = [None, "", "0", "00", "7f", "80", "ff", "fff", "zz", "é", *(uuid.UUID(int=k << 96).hex for k in range(0, 1 << 32, 1 << 25))]
    df = spark.createDataFrame([(v,) for v in values], "k string")
    hits = " + ".join(f"coalesce(cast(({p}) as int), 0)" for p in jdbc.hex_ranges("k", parts))
    assert {r[0] for r in df.select(F.expr(hits)).collect()} == {1}
