import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import coreset, gaussians, nearest, vectors
from plumbline.plans import models


def patches(spark, images=6, cells=4, d=8, seed=0, shift=0.0):
    rng = np.random.default_rng(seed)
    rows = [(f"i{n}", p, [float(v) for v in rng.normal(p, 1, d) + shift]) for n in range(images) for p in range(cells)]
    return spark.createDataFrame(rows, "image_id string, patch_idx int, embedding array<float>")


def test_feature_choice_and_selection(spark):
    assert vectors.choose_features(10, 4, 1) == sorted(set(vectors.choose_features(10, 4, 1))) and vectors.choose_features(3, 9) == [0, 1, 2]
    rows = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "e array<float>")
    assert list(rows.select(vectors.select_features(F.col("e"), [1, 3])).first()[0]) == [2.0, 4.0]
    with pytest.raises(Exception, match="too few features"):
        rows.select(vectors.select_features(F.col("e"), [4])).collect()


def test_identity_covariance_gives_euclid(spark):
    stats = spark.createDataFrame([(0, 1, [0.0] * 3, np.eye(3).ravel().tolist())], "patch_idx int, n long, mean array<double>, cov_inv array<double>")
    rows = spark.createDataFrame([("a", 0, [3.0, 4.0, 0.0]), ("b", 0, [0.0] * 3)], "image_id string, patch_idx int, embedding array<float>")
    assert {r["image_id"]: r["distance"] for r in gaussians.mahalanobis(rows, stats).collect()} == {"a": 5.0, "b": 0.0}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("d", [2, 8, 30])
def test_gaussians_equal_numpy_and_move_no_vector(spark, monkeypatch, d):
    rows = patches(spark, images=17, d=d).repartition(6)
    x = {p: np.array([r["embedding"] for r in rows.where(F.col("patch_idx") == p).collect()], dtype=float) for p in range(4)}
    for limit in (1 << 20, 1):
        monkeypatch.setattr(gaussians, "MOMENTS_BYTES", limit)
        stats = gaussians.fit_gaussians(rows)
        made = stats.collect()
        assert len(made) == 4
        for r in made:
            own = x[r["patch_idx"]]
            assert r["n"] == 17 and np.allclose(r["mean"], own.mean(axis=0))
            assert np.allclose(np.reshape(r["cov_inv"], (d, d)), np.linalg.inv(np.cov(own.T) + 0.01 * np.eye(d)))
    here = gaussians.mahalanobis(rows, stats)
    monkeypatch.setattr(gaussians, "MODEL_BYTES", 0)
    monkeypatch.setattr(gaussians, "IMAGES_PER_GROUP", 4)
    apart = {(r["image_id"], r["patch_idx"]): r["distance"] for r in gaussians.mahalanobis(rows, stats).collect()}
    got = {(r["image_id"], r["patch_idx"]): r["distance"] for r in here.collect()}
    assert got.keys() == apart.keys() and len(got) == 68 and all(abs(got[k] - apart[k]) < 1e-9 for k in got)
    for r in rows.collect():
        gap = np.array(r["embedding"], dtype=float) - x[r["patch_idx"]].mean(axis=0)
        inverse = np.linalg.inv(np.cov(x[r["patch_idx"]].T) + 0.01 * np.eye(d))
        assert got[r["image_id"], r["patch_idx"]] == pytest.approx(math.sqrt(gap @ inverse @ gap), abs=1e-6)


def test_scoring_moves_no_vector(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.col("label").alias("patch_idx"), "embedding")
    stats = gaussians.fit_gaussians(rows)
    assert "Exchange" not in plan_of(gaussians.mahalanobis(rows, stats))
    with pytest.raises(Exception, match="no model for position"):
        gaussians.mahalanobis(rows, stats.where("patch_idx <> 3")).collect()


def test_single_image_has_only_the_ridge(spark):
    r = gaussians.fit_gaussians(patches(spark, images=1, cells=1, d=2)).first()
    assert np.allclose(np.reshape(r["cov_inv"], (2, 2)), 100 * np.eye(2))


@pytest.mark.parametrize("block, rows", [(20_000, 20_000), (16, 20_000), (16, 3)])
def test_nearest_equals_brute_force(spark, monkeypatch, block, rows):
    rng = np.random.default_rng(3)
    bank = np.concatenate([rng.normal(size=(60, 5)), rng.normal(9, 0.1, size=(60, 5)), np.zeros((40, 5))])
    some = np.concatenate([rng.normal(size=(20, 5)), rng.normal(9, 0.1, size=(20, 5)), bank[:3], np.full((2, 5), 1e4)])
    b = spark.createDataFrame([(v.tolist(),) for v in bank], "features array<double>")
    q = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(some)], "id int, embedding array<double>, cell string")
    want = np.sqrt(((some[:, None] - bank[None]) ** 2).sum(axis=2)).min(axis=1)
    monkeypatch.setattr(nearest, "BANK_BLOCK", block)
    monkeypatch.setattr(nearest, "PIVOTS", 8)
    monkeypatch.setattr(nearest, "CELL_ROWS", rows)
    got = nearest.nearest_distance(q, b, compared="seen").orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(len(some))) and got[0]["cell"] == "x"
    assert np.allclose([r["min_distance"] for r in got], want, atol=1e-12)
    with pytest.raises(ValueError, match="fitted"):
        nearest.nearest_distance(q, b.limit(0))


def test_nearest_in_a_large_bank(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(300, 16)) * 4
    bank = (centres[rng.integers(0, 300, 100_000)] + rng.normal(0, 0.4, size=(100_000, 16))).astype(np.float32)
    some = (centres[rng.integers(0, 300, 400)] + rng.normal(0, 0.4, size=(400, 16))).astype(np.float32)
    b = spark.createDataFrame(pa.table({"features": list(bank)}))
    q = spark.createDataFrame(pa.table({"id": range(400), "embedding": list(some)}))
    got = nearest.nearest_distance(q, b, compared="seen").orderBy("id").toPandas()
    want = np.concatenate([np.sqrt(((x - bank.astype(float)) ** 2).sum(axis=1)).min(keepdims=True) for x in some.astype(float)])
    assert np.abs(got["min_distance"].to_numpy() - want).max() < 1e-9
    assert got["seen"].mean() < 0.35 * len(bank)  # a fifth of it is the sample


def plain_farthest(x, keys, size, first):
    chosen = [first]
    while len(chosen) < size:
        gap = np.min([((x - x[c]) ** 2).sum(axis=1) for c in chosen], axis=0)
        if not gap.max():
            break
        chosen.append(min(np.flatnonzero(gap == gap.max()), key=lambda i: keys[i]))
    return [keys[c] for c in chosen]


def radius(x, chosen):
    return math.sqrt(np.min([((x - c) ** 2).sum(axis=1) for c in chosen], axis=0).max())


@pytest.mark.parametrize("rows", [1, 7, 2048])
def test_farthest_points_equal_the_sequential_choice(spark, monkeypatch, rows):
    monkeypatch.setattr(coreset, "FARTHEST_ROWS", rows)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-3, 4, (60, 2)), rng.normal(20, 1, (60, 2))]).astype(float)
    keys = rng.permutation(120).tolist()
    table = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x, strict=True)], "id long, embedding array<double>").repartition(5)
    got = [r["id"] for r in coreset.farthest_points(table, "id", 12, start="least").orderBy("ordinal").collect()]
    assert got == plain_farthest(x, keys, 12, keys.index(0))
    same = table.limit(30).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    assert coreset.farthest_points(same, "id", 5).count() == 1
    with pytest.raises(ValueError, match="at least one image"):
        coreset.farthest_points(table.limit(0), "id", 3)


def test_composed_centres_keep_their_bound(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").repartition(7)
    x = np.array([r["embedding"] for r in table.collect()], dtype=float)
    exact = coreset.farthest_points(table, "vec_id", 10)
    made = coreset.fit_bank(table, "vec_id", 10, pool=None)
    assert made.count() == 10 and coreset.composed(table, "vec_id", 10).count() <= 70
    assert radius(x, [r["features"] for r in made.collect()]) <= 4 * radius(x, [r["features"] for r in exact.collect()])
    assert "Exchange" not in plan_of(coreset.composed(spark.read.parquet(f"{data}/embeddings.parquet"), "vec_id", 10))


@pytest.mark.parametrize("size", [1, 50, 777, 3000, 5000])
def test_sample_equals_ordered_limit(spark, monkeypatch, size):
    monkeypatch.setattr(coreset, "RANGE_BITS", 3)
    monkeypatch.setattr(coreset, "RANGE_ROWS", 4)
    rows = spark.range(3000).withColumnRenamed("id", "k")
    want = {r["k"] for r in rows.orderBy(F.xxhash64(F.col("k"), F.lit(9)), "k").limit(size).collect()}
    assert {r["k"] for r in coreset.sample_by_rank(rows, "k", size, 9).collect()} == want


def test_models_fit_save_load_predict(spark, tmp_path):
    normal, odd = patches(spark, 12), patches(spark, 3, seed=5, shift=6.0)
    for fit in (lambda p: models.fit_gaussian(p, (2, 2), 5), lambda p: models.fit_bank(p, (2, 2), 5, size=10, pool=100)):
        model = fit(normal).with_threshold(1.23)
        models.save(model, str(tmp_path / model.kind))
        again = models.load(spark, str(tmp_path / model.kind))
        assert again.threshold == 1.23 and again.feature_indices == model.feature_indices
        a = {r["image_id"]: r["score"] for r in models.predict(model, odd).collect()}
        b = {r["image_id"]: r["score"] for r in models.predict(again, odd).collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)
        assert min(a.values()) > max(r["score"] for r in models.predict(model, normal).collect()) * 0.9
        free = models.predict(model.with_threshold(None), odd).collect()
        assert all(r["threshold"] is None and r["is_anomalous"] is False for r in free)
        with pytest.raises(Exception, match="grid"):
            models.predict(models.Model(model.kind, model.table, model.feature_indices, (1, 1)), odd).collect()
    with pytest.raises(RuntimeError, match="fitted"):
        models.predict(None, odd)
    with pytest.raises(ValueError, match="at least one image"):
        models.fit_gaussian(normal.limit(0), (2, 2))


def test_training_job(spark, tmp_path):
    normal, odd = patches(spark, 12), patches(spark, 4, seed=5, shift=6.0).withColumn("image_id", F.concat(F.lit("odd"), "image_id"))
    labels = normal.select("image_id", F.lit(0).alias("label")).union(odd.select("image_id", F.lit(1))).distinct()
    model, result = models.train(lambda p: models.fit_gaussian(p, (2, 2), 4), normal, normal.union(odd), labels, str(tmp_path / "m"))
    r = result.first()
    assert r["auroc"] == 1.0 and r["n_anomalous"] == 4 and model.threshold > 0
    assert models.load(spark, str(tmp_path / "m")).threshold == pytest.approx(model.threshold)
    assert models.info(model)["status"] == "ok" and models.info(None)["status"] == "unavailable"


def test_a_failed_save_leaves_the_former_model(spark, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        models.load(spark, path)
    model = models.fit_gaussian(patches(spark, 5), (2, 2), 3).with_threshold(1.0)
    models.save(model, path)
    broken = models.Model(model.kind, model.table.withColumn("n", F.raise_error(F.lit("lost")).cast("long")), [0], (1, 1), 9.0)
    with pytest.raises(Exception, match="lost"):
        models.save(broken, path)
    again = models.load(spark, path)
    assert (again.threshold, again.grid, again.table.count()) == (1.0, (2, 2), 4)
    models.save_threshold(spark, path, 2.5)
    models.save(model.with_threshold(None), path)
    assert models.load(spark, path).threshold is None
    assert [models.load(spark, path, v).threshold for v in (1, 2, 3)] == [1.0, 2.5, None]


def test_flat_binary_form(spark):
    model = models.fit_gaussian(patches(spark, 5, 4, 6), (2, 2), 3).with_threshold(1.2345)
    data = models.to_binary(model)
    back = models.from_binary(data)
    assert back["grid"] == (2, 2) and back["threshold"] == pytest.approx(1.2345) and back["mean"].shape == (4, 3) and back["cov_inv"].shape == (4, 3, 3)
    assert len(data) == 28 + 4 * (3 + 12 + 36)
    for bad in (b"XXXX" + data[4:], data[:-1], data[:10], data[:4] + b"\x09" + data[5:]):
        with pytest.raises(ValueError):
            models.from_binary(bad)


def test_a_pass_takes_a_bounded_part_of_the_bank(monkeypatch):
    from plumbline.operators import nearest

    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(20, 6)), rng.normal(size=(50, 6))
    y[40] = y[3]
    want = np.sqrt(((x[:, None] - y) ** 2).sum(axis=2))
    sizes, squared = [], nearest.squared
    monkeypatch.setattr(nearest, "BANK_PASS", 7)
    monkeypatch.setattr(nearest, "squared", lambda a, b: sizes.append(len(b)) or squared(a, b))
    place, gap = nearest.nearest_of(x, y)
    assert max(sizes) == 7 and (place == want.argmin(axis=1)).all() and np.allclose(gap, want.min(axis=1))


def test_resize_takes_many_at_once():
    maps = np.random.default_rng(9).random((3, 4, 6))
    assert (vectors.resize_map(maps, 7, 5) == [vectors.resize_map(m, 7, 5) for m in maps]).all()


def test_resize_keeps_constants_and_ends():
    assert np.allclose(vectors.resize_map(np.full((3, 4), 2.5), 7, 9), 2.5)
    out = vectors.resize_map(np.array([[0.0, 1.0]]), 1, 4)
    assert np.allclose(out, [[0, 0.25, 0.75, 1]])


def test_heatmap_table(spark):
    rows = spark.createDataFrame([("a", p, float(p)) for p in range(4)], "image_id string, patch_idx int, distance double")
    heat = models.heatmaps(rows, (2, 2), 4, 4).first()["heatmap"]
    assert len(heat) == 16 and heat[0] == 0.0 and heat[-1] == 3.0


def test_heatmap_of_an_image_that_lacks_patches(spark):
    rows = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 4.0)], "image_id string, patch_idx int, distance double")
    heat = models.heatmaps(rows, (2, 2), 4, 2, partial=True).first()["heatmap"]
    assert heat == [2.0, 4.0, 1.5, 3.0, 0.5, 1.0, None, None]
    with pytest.raises(Exception, match="no whole grid"):
        models.heatmaps(rows, (2, 2), 4, 2).collect()


def test_heatmap_cells_of_a_last_image_that_lacks_rows(spark, data, tmp_path):
    import duckdb

    from plumbline import catalog

    catalog.table(spark, data, "embeddings").where("vec_id < 33").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(catalog.ORACLES["heatmap_cells"]).fetchall())
    assert len({w[0] for w in want}) == 4
    assert sorted(tuple(r) for r in catalog.heatmap_cells(spark, str(tmp_path)).collect()) == want


def test_each_whole_image_has_a_heatmap(spark, data):
    from plumbline import catalog

    rows = catalog.table(spark, data, "embeddings").select("vec_id").collect()
    sizes = Counter(r["vec_id"] // 10 for r in rows)
    got = catalog.embedding_heatmap(spark, data).collect()
    assert sorted(r["image_id"] for r in got) == sorted(i for i, n in sizes.items() if n == 10)
    assert all(len(r["heatmap"]) == 40 for r in got)
