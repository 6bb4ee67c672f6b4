import json
import logging
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import evaluation, imaging
from plumbline.plans import inspection
from plumbline.plans.measurement import measure_images, validate, validation_records
from plumbline.sources import images, manifest, png, synthetic


def bar(angle):
    x = np.zeros((300, 300), dtype=np.uint8)
    x[50:250, 135:165] = 255
    return imaging.rotate(x, (150, 150), angle, (300, 300)) if angle else x


@pytest.mark.parametrize("angle", [0, 30, 60, -45])
def test_bar_area_angle_and_derotation(angle):
    mask = imaging.silhouette(bar(angle))
    assert 4500 < mask.sum() < 7500
    axis = imaging.principal_axis(mask)
    gap = (axis.angle_deg - (90 - angle)) % 180
    assert min(gap, 180 - gap) < 5
    up = imaging.principal_axis(imaging.derotate(mask, axis)).angle_deg
    assert abs(abs(up) - 90) < 5


def test_blank_image_is_an_error():
    with pytest.raises(imaging.MeasurementError):
        imaging.measure(np.zeros((100, 100), dtype=np.uint8))


def test_labels_holes_and_boxes():
    m = np.zeros((8, 9), dtype=bool)
    m[1:6, 1:6] = True
    m[3, 3] = False
    m[6, 6] = True
    assert imaging.label_regions(m, True)[1] == 1 and imaging.label_regions(m, False)[1] == 2
    assert imaging.fill_holes(m).sum() == m.sum() + 1 and imaging.bounding_box(m) == (1, 1, 6, 6)
    u = np.zeros((5, 7), dtype=bool)
    u[:, 0] = u[:, 6] = u[4] = True
    assert imaging.label_regions(u, False)[1] == 1


def test_clean_thread_dimensions(spark):
    rows = {(r["condition"], r["estimator"]): r for r in validation_records(spark, ["M6"], ["clean", "blur", "rotated"]).collect()}
    assert rows["clean", "fft"]["diameter_abs_error"] <= 0.2 and rows["clean", "fft"]["pitch_abs_error"] <= 0.1 and rows["clean", "fft"]["confidence"] > 0.8
    assert all(r["diameter_abs_error"] <= 0.3 for r in rows.values()) and len(rows) == 6
    summary = evaluation.summarize(validation_records(spark, ["M3", "M6"], ["clean", "blur"])).collect()
    assert len(summary) == 4 and all(r["n_cases"] == 2 and r["diameter_mae"] < 0.5 for r in summary)


def test_generator_guards():
    with pytest.raises(ValueError, match="unknown condition"):
        synthetic.draw_thread(6, 5, 1, condition="foggy")
    with pytest.raises(ValueError, match="narrow"):
        synthetic.draw_thread(60, 50, 1)


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 256, (13, 17), dtype=np.uint8)
    assert (png.decode_gray(png.encode(g)) == g).all()
    rgb = np.repeat(g[:, :, None], 3, axis=2)
    assert (np.abs(png.decode_gray(png.encode(rgb)).astype(int) - g) <= 1).all()
    for bad in (b"", b"x", png.encode(g)[:-30]):
        with pytest.raises(ValueError):
            png.decode_gray(bad)


def test_files_decode_and_quarantine(spark, tmp_path):
    (tmp_path / "v").mkdir()
    for i in range(3):
        (tmp_path / "v" / f"f_{i}.png").write_bytes(png.encode(bar(i * 10)))
    (tmp_path / "v" / "f_3.png").write_bytes(b"broken")
    decoded = images.decode(images.image_files(spark, str(tmp_path)))
    assert images.readable(decoded).count() == 3 and images.quarantined(decoded).first()["error"] == "not a PNG"
    with pytest.raises(Exception, match="could not decode"):
        images.all_readable(decoded).collect()
    frames = images.frame_table(spark, str(tmp_path), 10.0)
    assert sorted((r["video_id"], r["frame_index"]) for r in frames.collect()) == [("v", i) for i in range(4)]
    measured = {r["image_id"][-5]: r for r in measure_images(images.readable(decoded)).collect()}
    assert measured["0"]["error"] is None and measured["0"]["major_diameter_px"] == pytest.approx(30, abs=2)


def test_image_and_video_inspection(spark):
    drawn = synthetic.draw(synthetic.parameter_table(spark, ["M6"], ["clean"]))
    blank = spark.createDataFrame([("blank", 50, 50, bytearray(2500))], "image_id string, height int, width int, data binary")
    some = drawn.select(F.lit("good").alias("image_id"), "height", "width", "data").union(blank)
    scores = spark.createDataFrame([("good", 1.0, 2.0), ("blank", 1.0, 2.0)], "image_id string, score double, threshold double")
    out = {r["image_id"]: r for r in inspection.inspect_images(some, scores, 20.0, "bar", True).collect()}
    assert out["good"]["matched_designation"] == "M6" and out["blank"]["verdict"] == "GO" and out["blank"]["major_diameter_mm"] is None
    with pytest.raises(Exception, match="measurement failed"):
        inspection.inspect_images(some, scores, 20.0, strict=True).collect()
    assert json.loads(inspection.as_json(inspection.inspect_images(some, scores, 20.0)).first()["value"])["calibrated"] in (False, None)

    frames = spark.range(6).crossJoin(blank).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_index"), F.lit(4.0).alias("fps"), "height", "width", "data")
    frame_scores = spark.range(6).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_index"), F.when(F.col("id") == 4, 9.0).otherwise(0.0).alias("score"), F.lit(1.0).alias("threshold"))
    verdicts, worst = inspection.inspect_video(frames, frame_scores)
    assert sorted(r["frame_index"] for r in verdicts.collect()) == [0, 2, 4]
    assert worst.first()["verdict"] == "NO_GO" and "measurement failed" in verdicts.first()["frame_note"]


#: Published mean errors in mm by condition: diameter, pitch by spectrum, pitch by peaks, and how many of three have the last.
PUBLISHED = {"clean": (0.05, 0.0014, 0.0, 3), "blur": (0.0333, 0.0005, 0.0, 3), "rotated": (0.1, 0.008, 0.0, 1)}


def test_sweep_is_within_twice_the_published_errors(spark):
    records = validation_records(spark, ["M3", "M6", "M10"], list(PUBLISHED)).collect()
    for condition, (diameter, spectrum, peaks, n_peaks) in PUBLISHED.items():
        own = {e: [r for r in records if r["condition"] == condition and r["estimator"] == e] for e in ("fft", "peak")}
        found = [r["pitch_abs_error"] for r in own["peak"] if r["pitch_abs_error"] is not None]
        assert diameter / 2 <= np.mean([r["diameter_abs_error"] for r in own["fft"]]) <= 2 * diameter
        assert spectrum / 2 <= np.mean([r["pitch_abs_error"] for r in own["fft"]]) <= 2 * spectrum
        assert len(found) == n_peaks and max(found) <= peaks + 1e-9


def test_samples_of_a_table_are_drawn_and_measured(spark):
    """Other columns come along; a condition for each row; the diameter at any scale is within a pixel and a half on each side."""
    rows = [(str(k), s, c, px, k) for k, (s, c, px) in enumerate([("M4", "clean", 16.0), ("M6", "blur", 18.0), ("M10", "rotated", 17.0), ("M8", "clean", 20.0)])]
    samples = synthetic.dimensions(spark.createDataFrame(rows, "image_id string, designation string, condition string, px_per_mm double, extra int"))
    assert sorted((r["extra"], r["height"]) for r in synthetic.draw(samples).select("extra", "height").collect()) == [(k, synthetic.HEIGHT) for k in range(4)]
    out = validate(samples.drop("extra"), ("fft",)).collect()
    assert {(r["image_id"], r["designation"], r["condition"]) for r in out} == {r[:3] for r in rows}
    assert all(r["diameter_abs_error"] <= 3 / dict((x[0], x[3]) for x in rows)[r["image_id"]] and r["pitch_abs_error"] <= 0.1 for r in out)
    with pytest.raises(Exception, match="unknown designation"):
        synthetic.dimensions(spark.createDataFrame([("M99",)], "designation string")).collect()


def test_a_task_draws_a_bounded_number_of_samples(spark, monkeypatch):
    from plumbline.sources import synthetic

    monkeypatch.setattr(synthetic, "IN_TASK", 2)
    table = synthetic.parameter_table(spark, ["M6"] * 40, ["clean"])
    assert synthetic.draw(table).rdd.getNumPartitions() == 20


@pytest.mark.parametrize("angle", [0.0, 90.0, -37.3, 180.0])
def test_turning_and_smoothing_equal_their_plain_forms(angle):
    rng = np.random.default_rng(3)
    gray = np.zeros((41, 57), dtype=np.uint8)
    gray[5:30, 20:44] = rng.integers(0, 256, (25, 24))
    for taps in (imaging.SMOOTH_5, imaging.SMOOTH_7):
        r = len(taps) // 2
        x = np.pad(gray.astype(float), r, mode="reflect")
        x = sum(t * x[i : i + 41] for i, t in enumerate(taps))
        x = sum(t * x[:, i : i + 57] for i, t in enumerate(taps))
        assert (imaging.smooth(gray, len(taps)) == np.floor(x + 0.5)).all()
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    got = imaging.rotate(gray, (28.0, 20.0), angle, (41, 57))
    framed = np.pad(gray.astype(float), 60)
    for v in range(41):
        for u in range(57):
            x, y = (np.floor(k * 32 + 0.5) / 32 for k in (c * (u - 28) - s * (v - 20) + 28, s * (u - 28) + c * (v - 20) + 20))
            i, j = int(np.floor(y)), int(np.floor(x))
            four = framed[i + 60 : i + 62, j + 60 : j + 62]
            assert got[v, u] == np.floor(np.array([1 - (y - i), y - i]) @ four @ np.array([1 - (x - j), x - j]) + 0.5)


def test_colour_images_are_read(spark):
    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    grey = np.arange(6, dtype=np.uint8).reshape(2, 3)
    rows = spark.createDataFrame([("c", bytearray(png.encode(rgb))), ("g", bytearray(png.encode(grey))), ("x", None)], "image_id string, content binary")
    got = {r["image_id"]: r for r in images.decode(rows, colour=True).collect()}
    assert bytes(got["c"]["data"]) == rgb.tobytes() and bytes(got["g"]["data"]) == np.repeat(grey, 3).tobytes() and got["x"]["error"] == "not a PNG"


def test_axis_of_a_standing_part_points_down():
    mask = np.zeros((60, 60), dtype=bool)
    for y in range(5, 55):
        mask[y, 28 + y // 25 : 34 + y // 25] = True
    for one in (mask, mask[:, ::-1]):
        assert abs(imaging.principal_axis(one).angle_deg - 90) < 5
    assert abs(imaging.principal_axis(mask.T).angle_deg) < 5
    assert imaging.gaussian_kernel(7).sum() == 1 and imaging.gaussian_kernel(9).sum() == pytest.approx(1)


def test_overlay_and_levels(spark):
    levels = imaging.min_max_bytes(np.array([[1.0, 2.0, 3.0]]))
    assert levels.tolist() == [[0, 127, 255]] and imaging.min_max_bytes(np.ones((2, 2))).max() == 0
    assert imaging.jet(np.array([0, 255])).tolist() == [[0.0, 0.0, 127.5], [127.5, 0.0, 0.0]]
    some = spark.createDataFrame([("a", 2, 2, bytearray(b"\x00\x40\x80\xff"))], "image_id string, height int, width int, data binary")
    heat = spark.createDataFrame([("a", [0.0, 1.0, 2.0, 3.0])], "image_id string, heatmap array<float>")
    assert inspection.overlay_png(some, heat).first()["png_base64"].startswith("iVBOR")
    assert imaging.normalised_input(np.zeros((10, 10), dtype=np.uint8), 8).shape == (3, 8, 8)


def test_overlays_of_many_shapes_equal_those_made_one_by_one(spark, monkeypatch):
    import base64

    monkeypatch.setattr(inspection, "OVERLAY_VALUES", 30)  # two or three images at a time
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for k in range(40):
        gray, heat = rng.integers(0, 256, [(2, 3), (3, 2), (4, 7)][k % 3]).astype(np.uint8), rng.random([(2, 3), (3, 2), (4, 7)][k % 3]).astype(np.float32)
        if k % 5 == 0:
            heat[:] = 0.5
        x = heat - heat.min()
        levels = ((x / x.max() if x.max() > 0 else x) * 255).astype(np.uint8)
        want[k] = np.clip(np.rint(np.repeat(gray[:, :, None].astype(float), 3, axis=2) * 0.7 + imaging.jet(levels) * 0.3), 0, 255).astype(np.uint8)
        rows.append((k, *gray.shape, bytearray(gray.tobytes()), heat.ravel().tolist()))
    table = spark.createDataFrame(rows, "image_id long, height int, width int, data binary, heatmap array<float>").coalesce(1)
    for made in (inspection.overlay_png(table, alpha=0.3), inspection.overlay_png(table.drop("heatmap"), table.select("image_id", "heatmap"), 0.3)):
        got = {r["image_id"]: png.decode_colour(base64.b64decode(r["png_base64"])) for r in made.collect()}
        assert len(got) == 40 and all((got[k] == v).all() for k, v in want.items())
    for wrong in ("slice(heatmap, 1, 5)", "if(image_id = 7, null, heatmap)"):
        with pytest.raises(Exception, match="reshape|NoneType"):
            inspection.overlay_png(table.withColumn("heatmap", F.expr(wrong))).collect()
    with pytest.raises(Exception, match="NoneType|reshape"):
        inspection.overlay_png(table.withColumn("height", F.lit(None).cast("int"))).collect()


def test_lines_without_a_filter_are_read_as_those_with_one():
    rng = np.random.default_rng(12)
    for shape in ((1, 1), (4, 6), (5, 7, 3)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        plain = png.encode(image)
        h, w = shape[:2]
        lines = image.reshape(h, -1).astype(int)
        above = np.vstack([np.zeros_like(lines[:1]), lines[:-1]])
        body = b"".join(b"\2" + ((a - b) & 255).astype(np.uint8).tobytes() for a, b in zip(lines, above, strict=True))
        up = png._HEAD + png._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)) + png._chunk(b"IDAT", zlib.compress(body)) + png._chunk(b"IEND", b"")
        for data in (plain, up):
            got = png.decode(data)
            assert (got == image.reshape(h, w, -1)).all() and got.flags.writeable


def test_manifest(spark, tmp_path):
    path = tmp_path / "samples.json"
    path.write_text(json.dumps({"samples": [
        {"filepath": "a.png", "split": "train", "category": {"label": "screw"}, "defect": {"label": "good"}},
        {"filepath": "b.png", "split": "test", "category": {"label": "screw"}, "defect": {"label": "bent"}, "defect_mask": {"mask_path": "m.png"}},
        {"filepath": "c.png", "split": "test", "category": {"label": "nut"}, "defect": {"label": "good"}},
    ]}))
    rows = manifest.samples(manifest.read_manifest(spark, str(path)), "screw")
    assert [r["path"] for r in manifest.needed_files(rows).collect()] == ["a.png", "b.png", "m.png"]
    assert manifest.train_normal(rows).count() == 1 and manifest.image_label(manifest.test_samples(rows)).first()["label"] == 1
    assert manifest.verify_counts(rows, {"train": 1, "test": 1}).count() == 2
    with pytest.raises(RuntimeError, match="split counts"):
        manifest.verify_counts(rows, {"train": 320, "test": 160})


def test_json_log_lines():
    inspection.log_json()
    inspection.log_json()
    own = [h for h in logging.getLogger().handlers if isinstance(h.formatter, inspection.JsonLines)]
    record = logging.makeLogRecord({"msg": "hi %s", "args": ("you",), "levelname": "INFO", "name": "x", "frames": 3, "timestamp": "no"})
    said = json.loads(inspection.JsonLines().format(record))
    assert len(own) == 1 and said["message"] == "hi you" and said["frames"] == 3 and said["timestamp"] != "no"
    logging.getLogger().removeHandler(own[0])


def test_network_input_has_the_fixed_scale():
    flat = imaging.normalised_input(np.full((7, 9), 128, np.uint8), 4)
    assert flat.shape == (3, 4, 4) and flat.dtype == np.float32
    for c, (mean, deviation) in enumerate(((0.485, 0.229), (0.456, 0.224), (0.406, 0.225))):
        assert np.allclose(flat[c], (128 / 255 - mean) / deviation, atol=1e-6)
    ramp = imaging.normalised_input(np.tile(np.array([0, 255], np.uint8), (2, 1)), 4)[0] * 0.229 + 0.485
    assert np.allclose(ramp, [[0, 0.25, 0.75, 1]] * 4, atol=1e-6)


def test_levels_of_groups_equal_the_kernel(spark):
    from plumbline.operators import vectors

    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=50), "flat": np.full(4, 2.5)}
    rows = spark.createDataFrame([(g, i, float(v)) for g, vs in groups.items() for i, v in enumerate(vs)], "g string, i int, v double")
    got = {(r["g"], r["i"]): r["level"] for r in vectors.min_max_levels(rows, "g", "v").collect()}
    for g, vs in groups.items():
        assert [got[g, i] for i in range(len(vs))] == imaging.min_max_bytes(vs).tolist()
