import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import lens

TRUE = (620.0, 600.0, 320.0, 240.0, -0.12, 0.05)


@pytest.mark.parametrize("seed", [0, 1])
def test_camera_is_recovered(spark, seed):
    r = lens.calibrate(lens.board_views(spark, TRUE, seed=seed)).first()
    assert r["rms"] < 1e-3 and r["n_views"] == 12
    assert np.allclose([r["fx"], r["fy"], r["cx"], r["cy"]], TRUE[:4], atol=0.5) and np.allclose([r["k1"], r["k2"]], TRUE[4:], atol=1e-3)


def test_views_without_a_board_are_left_out_and_three_are_needed(spark):
    corners = lens.board_views(spark, TRUE, n_views=6)
    some = corners.withColumn("u", F.when((F.col("view_id") < 2) & (F.col("corner") == 3), None).otherwise(F.col("u")))
    assert lens.calibrate(some).first()["n_views"] == 4
    with pytest.raises(Exception, match="needs 3 views"):
        lens.calibrate(corners.where("view_id < 2")).collect()


def test_undistorted_points_follow_the_pinhole(spark):
    bent = lens.board_views(spark, TRUE, n_views=1)
    straight = lens.board_views(spark, (*TRUE[:4], 0.0, 0.0), n_views=1).select("corner", F.col("u").alias("u0"), F.col("v").alias("v0"))
    camera = F.struct(*[F.lit(x).alias(n) for n, x in zip(("fx", "fy", "cx", "cy", "k1", "k2"), TRUE, strict=True)])
    u, v = lens.undistort(F.col("u"), F.col("v"), camera)
    for r in bent.join(straight, "corner").select((u - F.col("u0")).alias("a"), (v - F.col("v0")).alias("b")).collect():
        assert abs(r["a"]) < 1e-2 and abs(r["b"]) < 1e-2


def test_views_together_equal_one_by_one():
    rng = np.random.default_rng(2)
    board, camera = rng.uniform(0, 300, (7, 2)), np.array([600.0, 610.0, 320.0, 240.0, -0.04, 0.02])
    poses = np.column_stack((rng.uniform(-0.5, 0.5, (4, 3)), rng.uniform(-30, 30, (4, 2)), rng.uniform(500, 800, 4)))
    poses[0, :3] = 0
    got = lens.project_views(np.tile(board, (4, 1)), np.repeat(np.arange(4), 7), camera, poses)
    assert np.allclose(got, np.concatenate([lens.project(board, camera, p) for p in poses]), rtol=1e-12)
