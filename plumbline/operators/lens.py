"""Lens calibration from board corners: intrinsics, distortion and reprojection error, one camera at a time.

A corner table is long: (camera_id, view_id, corner, board_x, board_y, u, v), u and v null where a corner wasn't found.
Each view gives a homography; two linear conditions for each make the camera matrix; all parameters are then refined
together by damped least squares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ship, spread

MIN_VIEWS = 3
#: Cameras whose corners are made at a time.
AT_ONCE = 32
CORNERS = "camera_id string, view_id int, corner int, board_x double, board_y double, u double, v double"
CAMERA = "camera_id string, fx double, fy double, cx double, cy double, k1 double, k2 double, rms double, n_views int"


def rotation(r: np.ndarray) -> np.ndarray:
    """The rotation about the axis r by its length."""
    angle = np.linalg.norm(r)
    if angle < 1e-12:
        return np.eye(3)
    x, y, z = r / angle
    cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * cross @ cross


def axis_of(m: np.ndarray) -> np.ndarray:
    angle = np.arccos(np.clip((np.trace(m) - 1) / 2, -1, 1))
    if angle < 1e-9:
        return np.zeros(3)
    return angle / (2 * np.sin(angle)) * np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]])


def project(board: np.ndarray, camera: np.ndarray, pose: np.ndarray) -> np.ndarray:
    """Image points of board points; camera: fx, fy, cx, cy, k1, k2; pose: rotation axis, then shift."""
    p = np.column_stack((board, np.zeros(len(board)))) @ rotation(pose[:3]).T + pose[3:]
    x = p[:, :2] / p[:, 2:]
    r2 = (x**2).sum(axis=1, keepdims=True)
    return x * (1 + camera[4] * r2 + camera[5] * r2**2) * camera[:2] + camera[2:4]


def project_views(board: np.ndarray, view: np.ndarray, camera: np.ndarray, poses: np.ndarray) -> np.ndarray:
    """project for the points of many views at once; view: the place of each point's pose."""
    turn, shift = poses[:, :3], poses[:, 3:]
    angle = np.sqrt((turn**2).sum(axis=1))
    x, y, z = (turn / np.maximum(angle, 1e-12)[:, None]).T
    cross = np.zeros((len(poses), 3, 3))
    cross[:, 0, 1], cross[:, 0, 2], cross[:, 1, 0], cross[:, 1, 2], cross[:, 2, 0], cross[:, 2, 1] = -z, y, z, -x, -y, x
    r = np.eye(3) + np.sin(angle)[:, None, None] * cross + (1 - np.cos(angle))[:, None, None] * (cross @ cross)
    p = board[:, :1] * r[view, :, 0] + board[:, 1:] * r[view, :, 1] + shift[view]
    x = p[:, :2] / p[:, 2:]
    r2 = (x**2).sum(axis=1, keepdims=True)
    return x * (1 + camera[4] * r2 + camera[5] * r2**2) * camera[:2] + camera[2:4]


def homography(board: np.ndarray, image: np.ndarray) -> np.ndarray:
    """The plane map of two point sets, by the least singular vector, with both sets centred and scaled."""

    def frame(x: np.ndarray) -> np.ndarray:
        s = 2**0.5 / np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1)).mean()
        return np.array([[s, 0, -s * x[:, 0].mean()], [0, s, -s * x[:, 1].mean()], [0, 0, 1]])

    a, b = frame(board), frame(image)
    p, q = np.column_stack((board, np.ones(len(board)))) @ a.T, np.column_stack((image, np.ones(len(image)))) @ b.T
    zero = np.zeros_like(p)
    rows = np.concatenate((np.hstack((p, zero, -q[:, :1] * p)), np.hstack((zero, p, -q[:, 1:2] * p))))
    h = np.linalg.inv(b) @ np.linalg.svd(rows, full_matrices=len(rows) < 9)[2][-1].reshape(3, 3) @ a
    return h / h[2, 2]


def first_guess(maps: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Camera without distortion and each view's pose, from the plane maps."""

    def condition(h: np.ndarray, i: int, j: int) -> list[float]:
        a, b = h[:, i], h[:, j]
        return [a[0] * b[0], a[0] * b[1] + a[1] * b[0], a[1] * b[1], a[2] * b[0] + a[0] * b[2], a[2] * b[1] + a[1] * b[2], a[2] * b[2]]

    rows = [r for h in maps for r in (condition(h, 0, 1), np.subtract(condition(h, 0, 0), condition(h, 1, 1)))]
    rows.append([0, 1, 0, 0, 0, 0])  # no skew
    rows = np.array(rows, dtype=float)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    b11, b12, b22, b13, b23, b33 = np.linalg.svd(rows)[2][-1]
    d = b11 * b22 - b12 * b12
    cy = (b12 * b13 - b11 * b23) / d
    scale = b33 - (b13 * b13 + cy * (b12 * b13 - b11 * b23)) / b11
    fx, fy = np.sqrt(abs(scale / b11)), np.sqrt(abs(scale * b11 / d))
    cx = -b13 * fx * fx / scale
    inverse = np.linalg.inv(np.array([[fx, 0, cx], [0, fy, cy], [0, 0, 1]]))
    poses = []
    for h in maps:
        m = inverse @ h
        m = m / np.linalg.norm(m[:, 0])
        if m[2, 2] < 0:
            m = -m
        u, _, vt = np.linalg.svd(np.column_stack((m[:, 0], m[:, 1], np.cross(m[:, 0], m[:, 1]))))
        poses.append(np.concatenate((axis_of(u @ vt), m[:, 2])))
    return np.array([fx, fy, cx, cy, 0.0, 0.0]), poses


def calibrate_points(views: list[tuple[np.ndarray, np.ndarray]], steps: int = 40) -> tuple[np.ndarray, float]:
    """Camera parameters and root mean square error in pixels from (board, image) points of the views."""
    if len(views) < MIN_VIEWS:
        raise RuntimeError(f"calibration needs {MIN_VIEWS} views with a board, found {len(views)}")
    camera, poses = first_guess([homography(b, i) for b, i in views])
    theta = np.concatenate((camera, *poses))
    board, image = (np.concatenate([v[i] for v in views]) for i in (0, 1))
    view = np.repeat(np.arange(len(views)), [len(b) for b, _ in views])

    def gaps(t: np.ndarray) -> np.ndarray:
        return (project_views(board, view, t[:6], t[6:].reshape(-1, 6)) - image).ravel()

    point = np.arange(2 * len(board))
    pose_of = 6 + 6 * np.repeat(view, 2)
    now, damping = gaps(theta), 1e-3
    for _ in range(steps):
        reach = 1e-6 * np.maximum(1, np.abs(theta))
        slope = np.zeros((len(now), len(theta)))
        for k in range(6):
            moved = theta.copy()
            moved[k] += reach[k]
            slope[:, k] = (gaps(moved) - now) / reach[k]
            moved = theta.copy()
            moved[6 + k :: 6] += reach[6 + k :: 6]  # a view's points depend on its own pose alone, so all poses move together
            slope[point, pose_of + k] = (gaps(moved) - now) / reach[pose_of + k]
        normal = slope.T @ slope
        step = np.linalg.solve(normal + damping * np.diag(np.diag(normal) + 1e-12), -slope.T @ now)
        after = gaps(theta + step)
        if after @ after < now @ now:
            settled = (now @ now - after @ after) < 1e-12 * (1 + now @ now)
            theta, now, damping = theta + step, after, damping / 5
            if settled:
                break
        else:
            damping *= 5
            if damping > 1e12:
                break
    return theta[:6], float(np.sqrt(2 * (now @ now) / len(now)))


def calibrate(corners: DataFrame) -> DataFrame:
    """A row for each camera (see CAMERA); views without all their corners are left out; fewer than three are an error."""
    ship(corners.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        view, *points = (table.column(c).to_numpy() for c in ("view_id", "board_x", "board_y", "u", "v"))
        order = np.argsort(view, kind="stable")
        points = np.column_stack(points).astype(float)[order]
        views = []
        for v in np.split(points, np.flatnonzero(np.diff(view[order])) + 1):
            if len(v) >= 4 and not np.isnan(v).any():
                views.append((v[:, :2], v[:, 2:]))
        camera, rms = calibrate_points(views)
        return pa.table([pa.array([x]) for x in (table.column("camera_id")[0].as_py(), *camera, rms)] + [pa.array([len(views)], pa.int32())], [c.split()[0] for c in CAMERA.split(", ")])

    return spread(corners, "camera_id").groupBy("camera_id").applyInArrow(run, CAMERA)


def undistort(u: Column, v: Column, camera: Column, steps: int = 8) -> tuple[Column, Column]:
    """Where a point would be without distortion, by fixed-point steps; camera is a struct with fx, fy, cx, cy, k1, k2."""
    x0, y0 = (u - camera["cx"]) / camera["fx"], (v - camera["cy"]) / camera["fy"]
    start = F.struct(x0.alias("x"), y0.alias("y"))

    def step(p: Column, _: Column) -> Column:
        r2 = p["x"] * p["x"] + p["y"] * p["y"]
        bend = 1 + camera["k1"] * r2 + camera["k2"] * r2 * r2
        return F.struct((x0 / bend).alias("x"), (y0 / bend).alias("y"))

    p = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return p["x"] * camera["fx"] + camera["cx"], p["y"] * camera["fy"] + camera["cy"]


def seen_by(cameras: DataFrame, pattern: tuple[int, int] = (9, 6), square: float = 40.0, n_views: int = 12) -> DataFrame:
    """A corner table of a board seen from seeded poses by known cameras: (camera_id text, seed, fx, fy, cx, cy, k1, k2), a row for each."""
    ship(cameras.sparkSession)
    x, y = np.meshgrid(np.arange(pattern[0]) * square, np.arange(pattern[1]) * square)
    board = np.column_stack((x.ravel(), y.ravel()))
    boards, view = np.tile(board, (n_views, 1)), np.repeat(np.arange(n_views), len(board))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b.iloc[at : at + AT_ONCE] for b in batches for at in range(0, len(b), AT_ONCE)):
            seen = []
            for r in pdf.itertuples():
                rng = np.random.default_rng(r.seed)
                poses = []
                for _ in range(n_views):
                    turn = rng.uniform(-0.5, 0.5, 3)
                    centre = rotation(turn) @ np.array([*board.mean(axis=0), 0.0])
                    away = np.array([*rng.uniform(-30, 30, 2), rng.uniform(500, 800)])
                    poses.append(np.concatenate((turn, away - centre)))
                seen.append(project_views(boards, view, np.array([r.fx, r.fy, r.cx, r.cy, r.k1, r.k2]), np.array(poses)))
            n, at = len(seen), np.concatenate(seen)
            yield pd.DataFrame({
                "camera_id": np.repeat(pdf["camera_id"].to_numpy(), len(view)), "view_id": np.tile(view, n), "corner": np.tile(np.arange(len(board)), n * n_views),
                "board_x": np.tile(boards[:, 0], n), "board_y": np.tile(boards[:, 1], n), "u": at[:, 0], "v": at[:, 1],
            })

    return spread(cameras.select("camera_id", "seed", "fx", "fy", "cx", "cy", "k1", "k2")).mapInPandas(run, CORNERS)


def board_views(spark: SparkSession, camera: tuple[float, ...], pattern: tuple[int, int] = (9, 6), square: float = 40.0, n_views: int = 12, seed: int = 0, camera_id: str = "camera") -> DataFrame:
    """The corner table of one camera (fx, fy, cx, cy, k1, k2)."""
    one = spark.createDataFrame([(camera_id, seed, *camera)], "camera_id string, seed long, fx double, fy double, cx double, cy double, k1 double, k2 double")
    return seen_by(one, pattern, square, n_views)
