"""Percentiles are exact on groups where a sketch's are not."""

import math
import random

from cordage.operators import warehouse as W
from cordage.operators.percentiles import percentiles


def test_percentiles_are_exact(spark):
    rows = spark.range(0, 60_000, 1, 4).selectExpr("CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a' ELSE 'b' END AS intent", "CASE WHEN id % 7 > 0 THEN pmod(xxhash64(id), 1000003) / 8D END AS end_to_end_ms")
    values = {}
    for r in rows.collect():
        values.setdefault(r.intent, []).append(r.end_to_end_ms)
    want = {}
    for k, v in values.items():
        own = sorted(x for x in v if x is not None)
        want[k] = (len(v), *(round(own[len(own) - math.floor(len(own) * (100 - p) / 100) - 1], 4) for p in (50, 95)))
    assert {r[0]: tuple(r[1:]) for r in W.kpi_intent(rows).collect()} == want


def test_percentiles_of_small_groups(spark):
    rng = random.Random(5)
    groups = {"one": [3.0], "none": [None, None], "nan": [float("nan"), 1.0, 2.0], "ties": [1.0] * 19 + [2.0], None: [float(rng.randrange(50)) for _ in range(41)]}
    rows = spark.createDataFrame([(k, x, 1.0) for k, v in groups.items() for x in v], "k string, x double, y double")
    got = {r.k: r for r in percentiles(rows, ["k"], ["x", "y"], (50, 95)).collect()}
    assert {k: r["rows"] for k, r in got.items()} == {k: len(v) for k, v in groups.items()}
    assert (got["one"].x_p50, got["one"].x_p95, got["ties"].x_p95, got["nan"].x_p50, got["none"].x_p50, got["none"].y_p95) == (3.0, 3.0, 1.0, 2.0, None, 1.0)
    assert math.isnan(got["nan"].x_p95) and (got[None].x_p50, got[None].x_p95) == (sorted(groups[None])[20], sorted(groups[None])[38])
    assert percentiles(rows.where("false"), ["k"], ["x"]).count() == 0
