import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import evaluation as ev


def scored(spark, s, y):
    return spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "score double, label int")


def test_auroc_with_ties_equals_pairs(spark):
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 9, 200), rng.integers(0, 2, 200)
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    r = ev.auroc(scored(spark, s, y), "score", "label").first()
    assert r["auroc"] == pytest.approx(want) and (r["n_normal"], r["n_anomalous"]) == (len(neg), len(pos))


def test_one_class_is_an_error(spark):
    with pytest.raises(Exception, match="both classes"):
        ev.auroc(scored(spark, [1, 2], [1, 1]), "score", "label").collect()


def test_youden_takes_the_largest_of_equals_and_none_below_chance(spark):
    r = ev.youden(scored(spark, [1, 2, 3, 4], [0, 1, 0, 1]), "score", "label").first()
    assert (r["threshold"], r["j"]) == (4.0, 0.5)
    r = ev.youden(scored(spark, [4, 1], [0, 1]), "score", "label").first()
    assert r["threshold"] == float("inf") and r["j"] == 0.0


def test_latency_and_equivalence(spark):
    rows = spark.createDataFrame([(10.0,), (20.0,), (30.0,)], "ms double")
    r = ev.latency_stats(rows, "ms").first()
    assert (r["mean_ms"], r["p50_ms"], r["p95_ms"], r["throughput"]) == (20.0, 20.0, 29.0, 50.0)
    assert ev.latency_stats(rows.select((F.col("ms") * 0).alias("ms")), "ms").first()["throughput"] == float("inf")
    pairs = spark.createDataFrame([(100.0, 100.05), (0.0, 0.001)], "a double, b double")
    r = ev.equivalence(pairs, "a", "b").first()
    assert r["all_close"] and r["max_abs_diff"] == pytest.approx(0.05) and r["max_rel_diff"] == pytest.approx(1e5)


def test_summary_and_pivot_with_missing_pitch(spark):
    rows = spark.createDataFrame(
        [("peak", "clean", 0.1, 1.0, None, None), ("peak", "clean", 0.3, 3.0, 0.2, 2.0), ("fft", "blur", 0.1, 1.0, None, None)],
        "estimator string, condition string, diameter_abs_error double, diameter_pct_error double, pitch_abs_error double, pitch_pct_error double",
    )
    summary = ev.summarize(rows)
    r = {(x["estimator"], x["condition"]): x for x in summary.collect()}
    assert r["peak", "clean"]["pitch_mae"] == 0.2 and r["peak", "clean"]["n_pitch"] == 1 and r["fft", "blur"]["pitch_mae"] is None
    lines = [x["line"] for x in ev.comparison_rows(summary).orderBy("n").collect()]
    assert lines[0].startswith("| Method | Clean pitch MAE (mm)") and lines[1] == "|---|---|---|---|"
    assert lines[2] == "| fft | n/a (0/0 produced an estimate) | n/a (0/1 produced an estimate) | n/a (0/0 produced an estimate) |"
    assert lines[3].startswith("| peak | 0.2000 (1/2 produced an estimate)")


def test_percentiles_of_groups(spark):
    rng = np.random.default_rng(3)
    groups = {"many": rng.normal(size=3000), "ties": rng.integers(0, 4, 500).astype(float), "one": np.array([7.0]), None: np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("many", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in ev.percentiles(df, "v", [0.0, 0.5, 0.95], ["g"]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert np.allclose(got[g], np.quantile(values, [0.0, 0.5, 0.95]), rtol=1e-12)
    stats = {r["g"]: r for r in ev.latency_stats(df, "v", ["g"]).collect()}
    assert len(stats) == 5 and stats["empty"]["p50_ms"] is None and stats[None]["p50_ms"] == 1.5
    assert ev.percentiles(df.limit(0), "v", [0.5]).collect()[0]["q0"] is None
