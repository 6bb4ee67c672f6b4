import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import fusion, nearest_key, tolerance
from plumbline.operators.video import worst_case

SCHEMA = "item_id int, score double, threshold double, major_diameter_mm double, designation string, calibrated boolean, calibration_source string"


def judged(spark, rows, designation=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["item_id"]: r for r in fusion.fuse_verdict(df, designation=designation).collect()}


def test_truth_table(spark):
    out = judged(
        spark,
        [
            (1, 0.1, 0.5, 5.9, None, True, "x"),
            (2, 0.9, 0.5, 5.9, None, True, "x"),
            (3, 0.1, 0.5, 5.0, "M6", True, "x"),
            (4, 0.9, 0.5, 5.0, "M6", True, "x"),
            (5, 0.1, 0.5, None, None, True, "x"),
            (6, float("nan"), 0.5, 5.9, None, False, "demo"),
            (7, 0.5, 0.5, 5.9, "", True, "x"),
            (8, 0.1, 0.5, float("nan"), None, True, "x"),
        ],
        "designation",
    )
    assert [list(out[i]["failed_checks"]) for i in range(1, 9)] == [
        [], ["anomaly_score"], ["major_diameter"], ["anomaly_score", "major_diameter"], [], [], [], ["major_diameter"],
    ]
    assert [out[i]["verdict"] for i in (1, 2, 5, 6)] == ["GO", "NO_GO", "GO", "GO"]
    assert out[5]["matched_designation"] is None and fusion.SKIPPED in out[5]["reasoning"]
    assert out[7]["matched_designation"] == "M6"
    assert "demo" in out[6]["reasoning"][2] and out[6]["reasoning"][-1] == fusion.DISCLAIMER
    assert out[2]["reasoning"][0] == "anomaly score 0.900 exceeds threshold 0.500"


def test_text_rounds_the_exact_value(spark):
    from plumbline.functions.scalars import fixed

    rows = spark.createDataFrame([(1.0005,), (0.0625,), (float("nan"),), (None,), (-2.5,)], "x double")
    assert [r[0] for r in rows.select(fixed(F.col("x"), 3)).collect()] == ["1.000", "0.062", "nan", None, "-2.500"]
    rng = random.Random(2)
    values = [rng.choice([-1, 1]) * rng.uniform(0, 10 ** rng.randrange(-8, 15)) for _ in range(3000)] + [k / 2**j for j in (1, 3, 4, 5, 7) for k in range(-300, 300)]
    values += [round(rng.uniform(0, 99), 4) + rng.choice([0.0005, 0.00005, 0.05]) for _ in range(2000)] + [0.0, -0.0, 9.9995, 0.99995, 2.0**61, 123456789.9999999, 5e-324, float("inf"), -float("inf")]
    table = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2, 3, 4, 6):
        assert [r[0] for r in table.select(fixed(F.col("x"), digits)).collect()] == [f"{v:.{digits}f}" for v in values]


def test_nearest_size_tie_goes_to_the_first(spark):
    rows = spark.createDataFrame([(2.25,), (0.0,), (100.0,), (None,)], "d double")
    got = [r[0] for r in rows.select(tolerance.nearest_size(F.col("d"))["designation"]).collect()]
    assert got == ["M2", "M1.6", "M12", None]
    sizes = tolerance.size_table(spark)
    joined = tolerance.with_size(rows.withColumn("k", F.col("d")), sizes, "d")
    assert {r["d"]: r["size"] and r["size"]["designation"] for r in joined.collect()} == {2.25: "M2", 0.0: "M1.6", 100.0: "M12", None: None}


@pytest.mark.parametrize("keys_per_range, rows_per_deal", [(2_000, 500_000), (7, 40), (1, 1)])
def test_nearest_key_equals_all_pairs(spark, monkeypatch, keys_per_range, rows_per_deal):
    monkeypatch.setattr(nearest_key, "KEYS_PER_RANGE", keys_per_range)
    monkeypatch.setattr(nearest_key, "ROWS_PER_DEAL", rows_per_deal)
    rng = random.Random(6)
    keys = [(i, rng.choice([None, float("nan"), rng.randrange(60) / 2, rng.uniform(0, 30)])) for i in rng.sample(range(500), 60)]
    values = [rng.choice([None, float("nan"), -4.0, 99.0, 7.25, rng.randrange(120) / 4]) for _ in range(150)] + [7.25] * 100
    table = spark.createDataFrame(keys, "part long, price double")
    rows = spark.createDataFrame(list(enumerate(values)), "range_ long, v double")
    got = {r["range_"]: r["nearest"] for r in nearest_key.nearest_key(rows, "v", table, "price", "part").collect()}
    assert len(got) == len(values)
    for i, v in enumerate(values):
        real = [(abs(k - v), part) for part, k in keys if k is not None and k == k] if v is not None and v == v else []
        assert (got[i] and got[i]["part"]) == (min(real)[1] if real else None), v
    none = nearest_key.nearest_key(rows, "v", table.limit(0), "price", "part").collect()
    assert len(none) == len(values) and all(r["nearest"] is None for r in none)
    plan = nearest_key.nearest_key(rows, "v", table, "price", "part")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unknown_designation_raises(spark):
    rows = spark.createDataFrame([("M7",)], "n string")
    with pytest.raises(Exception, match="unknown designation M7"):
        rows.select(tolerance.size_of(F.col("n"))).collect()


def test_limits_are_inclusive(spark):
    rows = spark.createDataFrame([(5.974,), (5.794,), (5.9741,)], "d double").withColumn("s", tolerance.nearest_size(F.col("d")))
    assert [r[0] for r in rows.select(tolerance.within(F.col("d"), F.col("s"))).collect()] == [True, True, False]


def test_worst_case_union(spark):
    rows = spark.createDataFrame([(1, []), (1, ["b"]), (1, ["a", "b"]), (2, [])], "video_id int, failed_checks array<string>")
    out = {r["video_id"]: r for r in worst_case(rows).collect()}
    assert list(out[1]["failed_checks"]) == ["a", "b"] and out[1]["verdict"] == "NO_GO" and (out[1]["n_go"], out[1]["n_no_go"]) == (1, 2)
    assert out[2]["verdict"] == "GO" and math.isclose(out[2]["n_frames"], 1)
