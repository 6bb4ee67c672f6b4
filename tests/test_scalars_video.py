import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators.video import annotation_lines, sample_frames


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scale_round_trip_and_guards(spark):
    assert one(spark, S.mm_to_px(S.px_to_mm(F.lit(123.0), F.lit(10.0)), F.lit(10.0))) == pytest.approx(123.0)
    assert one(spark, S.scale_from_reference(F.lit(200.0), F.lit(20.0))) == 10.0
    for bad in (0.0, -5.0):
        with pytest.raises(Exception, match="positive"):
            one(spark, S.px_to_mm(F.lit(1.0), F.lit(bad)))
        with pytest.raises(Exception, match="positive"):
            one(spark, S.scale_from_reference(F.lit(bad), F.lit(1.0)))


@pytest.mark.parametrize("size", [0, 57, 58, 200])
def test_base64_is_one_line(spark, size):
    import base64

    data = bytes(range(size))
    assert one(spark, S.base64_text(F.lit(data))) == base64.b64encode(data).decode()
    assert one(spark, S.base64_text(F.lit(None).cast("binary"))) is None


@pytest.mark.parametrize("fps,want", [(30.0, 15), (25.0, 12), (0.0, 10), (-1.0, 10), (0.5, 1), (33.0, 16)])
def test_interval_rounds_half_to_even(spark, fps, want):
    assert one(spark, S.sample_interval(F.lit(fps))) == want


def test_every_fifth_frame(spark):
    frames = spark.range(20).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_index"), F.lit(10.0).alias("fps"))
    got = sorted((r["frame_index"], r["timestamp_sec"]) for r in sample_frames(frames).collect())
    assert got == [(0, 0.0), (5, 0.5), (10, 1.0), (15, 1.5)]
    assert sample_frames(frames, F.lit(0)).count() == 4 and sample_frames(frames, F.lit(7)).count() == 3


def test_exceeds_is_false_for_nan_and_null(spark):
    nan = float("nan")
    for a, b, want in ((nan, 1.0, False), (2.0, nan, False), (2.0, 1.0, True), (1.0, 1.0, False)):
        assert one(spark, S.exceeds(F.lit(a), F.lit(b))) is want
    assert one(spark, S.exceeds(F.lit(1.0), F.lit(None).cast("double"))) is False


def test_annotation_shows_zero_pitch_as_missing(spark):
    rows = spark.createDataFrame([("GO", 1.234, 2.0, 0.0, 0.0, 2.0, [])], "verdict string, score double, threshold double, major_diameter_mm double, pitch_mm double, display_fps double, failed_checks array<string>")
    assert list(annotation_lines(rows).first()["lines"]) == ["GO", "anomaly 1.23 / 2.00", "diameter 0.00mm", "pitch n/a", "2.0 fps"]


def test_joined_names(spark):
    assert one(spark, S.joined(F.array(F.lit("a"), F.lit("b")))) == "a, b"
    assert one(spark, S.joined(F.array().cast("array<string>"))) == "none"
