"""Thresholds, regions and components as relations, against the image kernels and plain searches."""

import random

import numpy as np
import pytest

from plumbline.operators import components, imaging, regions


def image_table(spark, images):
    rows = [(k, v.shape[0], v.shape[1], v.astype(np.uint8).tobytes()) for k, v in images.items()]
    return spark.createDataFrame(rows, "image_id string, height int, width int, data binary")


def test_thresholds_equal_the_kernel(spark):
    rng = np.random.default_rng(5)
    images = {f"i{k}": rng.integers(0, [2, 9, 256][k % 3], rng.integers(1, 30, 2)) for k in range(20)} | {"flat": np.full((4, 5), 7)}
    got = {r["image_id"]: r for r in regions.otsu_levels(regions.pixels(image_table(spark, images))).collect()}
    for k, v in images.items():
        assert got[k]["n"] == v.size and got[k]["n_above"] == (v > got[k]["level"]).sum()
        if len(np.unique(v)) > 1:
            assert ((v > got[k]["level"]) == (v > imaging.otsu(v))).all()


@pytest.mark.parametrize("diagonal", [True, False])
def test_regions_equal_the_kernel(spark, monkeypatch, diagonal):
    monkeypatch.setattr(regions, "TILE", 4)
    rng = np.random.default_rng(6)
    masks = {f"i{k}": rng.random(rng.integers(1, 25, 2)) < 0.5 for k in range(8)}
    spiral = np.zeros((15, 15), dtype=bool)
    for r in range(0, 7, 2):
        spiral[r, r : 15 - r] = spiral[r : 15 - r, 14 - r] = spiral[14 - r, r : 15 - r] = True
        spiral[r + 2 : 15 - r, r] = True
        spiral[r + 2, r : r + 3] = True
    masks |= {"spiral": spiral}
    cells = [(k, int(y), int(x)) for k, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    got = regions.regions(spark.createDataFrame(cells, "image_id string, y int, x int"), diagonal).collect()
    for k, m in masks.items():
        labels, n = imaging.label_regions(m, diagonal)
        want = []
        for i in range(1, n + 1):
            ys, xs = np.nonzero(labels == i)
            want.append((len(xs), int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1))
        assert sorted((r["area"], r["x"], r["y"], r["width"], r["height"]) for r in got if r["image_id"] == k) == sorted(want)
    best = {r["image_id"]: r["area"] for r in regions.largest_region(spark.createDataFrame(cells, "image_id string, y int, x int"), diagonal).collect()}
    assert best == {k: max(r["area"] for r in got if r["image_id"] == k) for k in best}


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(7)
    edges = [("chain", i, i + 1) for i in range(60)] + [("star", 0, i) for i in range(5, 40)] + [("random", rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    nodes = {(g, x) for g, a, b in edges for x in (a, b)} | {("alone", 3)}
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for g, a, b in edges:
        a, b = sorted((root((g, a)), root((g, b))))
        parent[b] = a
    rows = components.connected(spark.createDataFrame(list(nodes), "g string, v long"), spark.createDataFrame(edges, "g string, a long, b long"), "g").collect()
    assert len(rows) == len(nodes) and all((r["g"], r["label"]) == root((r["g"], r["v"])) for r in rows)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_images_from_a_small_file_are_never_broadcast(spark, tmp_path, monkeypatch):
    from plumbline import catalog

    spark.range(1, 60).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    joined = []
    cut = components.cut
    monkeypatch.setattr(components, "cut", lambda df: joined.append(plan_of(df)) or cut(df))
    joined.append(plan_of(catalog.largest_region(spark, str(tmp_path))))
    joined.append(plan_of(catalog.overlay_levels(spark, str(tmp_path))))
    assert len(joined) > 4 and sum("Join" in p for p in joined) > 2
    assert not any("Broadcast" in p for p in joined)


def test_tasks_grow_with_the_drawings_and_pixels_are_not_shuffled(spark, tmp_path, monkeypatch):
    from plumbline import catalog

    spark.range(1, 60).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(catalog, "DEALT", 3)
    assert catalog.drawings(spark, str(tmp_path)).rdd.getNumPartitions() == 20
    plan = plan_of(catalog.otsu_levels(spark, str(tmp_path)))
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 2 and plan.count("ArrowEvalPython") == 2


def test_overlays_take_each_drawing_once_and_join_nothing(spark, tmp_path, monkeypatch):
    import duckdb

    from plumbline import catalog

    spark.range(1, 300).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(catalog, "DEALT_ON", 30)
    made = catalog.overlay_levels(spark, str(tmp_path))
    plan = plan_of(made)
    assert plan.count("drawn(") == 1 and plan.count("Exchange") == 1 and "Join" not in plan
    assert made.rdd.getNumPartitions() == 10
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(tuple(r) for r in made.collect()) == sorted(con.execute(catalog.ORACLES["overlay_levels"]).fetchall())


def test_drawings_are_read_in_fewer_tasks_than_their_pixels_take(spark, tmp_path, monkeypatch):
    from plumbline import catalog

    spark.range(1, 60).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(catalog, "DEALT", 3)
    monkeypatch.setattr(catalog, "DEALT_ON", 10)
    plan = plan_of(catalog.read_drawings(spark, str(tmp_path)))
    assert "hashpartitioning(image_id" in plan and ", 20), REPARTITION_BY_NUM" in plan
    assert "hashpartitioning(p_partkey" in plan and ", 6), REPARTITION_BY_NUM" in plan
