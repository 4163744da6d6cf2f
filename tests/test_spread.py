"""Heavy work on rows of a small file goes to all cores, and results don't hang on how rows are dealt."""

from pyspark.sql import functions as F

from cordage.plans import QUERIES, queries
from cordage.sources.tables import spread

SF = "/root/testdata/sf0.001"


def tasks(df):
    return df.rdd.getNumPartitions()


def test_spread_keeps_rows(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("v")).coalesce(1)
    assert sorted(spread(rows, "id").collect()) == sorted(rows.collect()) and tasks(spread(rows, "id")) >= 3 * 4


def test_noise_is_dealt_to_all_cores(spark):
    assert tasks(queries._noised(spark, SF)) >= 3 * 4


def test_call_events_are_told_on_all_cores(spark):
    from cordage.plans import call_queries

    assert tasks(call_queries.call_lines(spark, SF)) >= 3 * 4


def test_values_said_are_read_on_all_cores(spark):
    assert tasks(QUERIES["spoken_styles_all"](spark, SF)) >= 3 * 4


def test_percentiles_are_not_kept_for_each_call(spark):
    for name in ("kpi_summary", "kpi_hourly", "kpi_hourly_full"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        keys = [line.split("functions=")[0] for line in plan.splitlines() if "percentile_approx" in line and "functions=" in line]
        assert keys and not any("user_id" in k or "call_id" in k for k in keys)


def test_json_and_phrases_are_read_on_all_cores(spark):
    rows = queries._phrases(spark, SF)[0]
    assert tasks(rows) >= 3 * 4
    # read once: an inner explode infers a filter that holds the whole array again
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json") <= 1
    plan = QUERIES["event_line_check"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_published_copies_grow_in_files(spark, tmp_path, monkeypatch):
    from cordage.plans import stream_queries

    monkeypatch.setattr(stream_queries, "_folder", lambda s: f"{tmp_path}/p")
    assert QUERIES["published_manifest"](spark, SF).first().asDict() == {"rows": spark.read.parquet(f"{SF}/documents.parquet").count(), "changed": 0, "same": True}
    assert len(list(tmp_path.glob("p/b/v-*/*.parquet"))) >= 3 * 4
