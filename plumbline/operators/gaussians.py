"""A Gaussian for each patch position: moments added up where the vectors lie, and distances with a model that is broadcast.

A patch table is long: (image_id, patch_idx, embedding ARRAY<FLOAT>).  Vectors are not moved, neither to fit nor to score: fitting
sends what a partition knows of each position, scoring takes the model to the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut, ship

REGULARISATION = 0.01
#: Bytes of moments that a task holds before it hands them on, and partial moments of a position are merged in so many groups first.
MOMENTS_BYTES, MERGE_GROUPS = 64 << 20, 64
#: Bytes of a model that is broadcast.  A larger one goes by position, with groups of so many images.
MODEL_BYTES, IMAGES_PER_GROUP = 128 << 20, 20_000

_PARTIAL = "patch_idx int, part int, n long, mean array<double>, spread array<double>"


def arrow_matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrow lists of one length as a matrix, without an object for each row."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if vectors.null_count:
        raise ValueError("a vector is null")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


class Moments:
    """Number, mean, and sum of outer products about the mean; while there are fewer vectors than dimensions, the centred vectors in place of these."""

    def __init__(self, n: int, mean: np.ndarray, spread: np.ndarray) -> None:
        self.n, self.mean, self.spread = n, mean, spread

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        centred = x - mean
        return cls(len(x), mean, centred if len(x) < x.shape[1] else centred.T @ centred)

    def squares(self) -> np.ndarray:
        return self.spread.T @ self.spread if self.n < len(self.mean) else self.spread

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        mean = self.mean + gap * other.n / n
        if n < len(mean):
            return Moments(n, mean, np.concatenate([m.spread + (m.mean - mean) for m in (self, other)]))
        return Moments(n, mean, self.squares() + other.squares() + np.outer(gap, gap) * (self.n * other.n / n))


def _rows(held: dict[int, Moments], part: int) -> pa.RecordBatch:
    columns = [list(held), [part] * len(held), [m.n for m in held.values()], [m.mean for m in held.values()], [m.spread.ravel() for m in held.values()]]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["patch_idx", "part", "n", "mean", "spread"])


def _merged(table: pa.Table) -> Moments:
    out = None
    for n, mean, spread in zip(*[table.column(c) for c in ("n", "mean", "spread")], strict=True):
        mean = mean.values.to_numpy()
        own = Moments(n.as_py(), mean, spread.values.to_numpy().reshape(-1, len(mean)))
        out = own if out is None else out.merged(own)
    return out


def _by_position(positions: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each position and its rows' numbers."""
    order = np.argsort(positions, kind="stable")
    edges = np.flatnonzero(np.diff(positions[order])) + 1
    for rows in np.split(order, edges):
        if len(rows):
            yield int(positions[rows[0]]), rows


def fit_gaussians(patches: DataFrame, regularisation: float = REGULARISATION) -> DataFrame:
    """(patch_idx, n, mean, cov_inv): mean and inverse covariance of the vectors at each position.

    Covariance with n - 1 (1 for a single image) in the denominator, plus regularisation on the diagonal; cov_inv is row-major.  Each
    partition adds up its own vectors; what it sends is never more numbers than its vectors have.  Without vectors it is an error.
    """
    ship(patches.sparkSession)
    limit = MOMENTS_BYTES

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        part = TaskContext.get().partitionId() % MERGE_GROUPS
        for batch in batches:
            x = arrow_matrix(batch.column(1))
            for p, rows in _by_position(batch.column(0).to_numpy(zero_copy_only=False)):
                own = Moments.of(x[rows])
                held[p] = held[p].merged(own) if p in held else own
            if sum(m.spread.nbytes for m in held.values()) > limit:
                yield _rows(held, part)
                held = {}
        if held:
            yield _rows(held, part)

    def together(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_rows({table.column("patch_idx")[0].as_py(): _merged(table)}, table.column("part")[0].as_py())])

    def finished(table: pa.Table) -> pa.Table:
        m = _merged(table)
        cov = m.squares() / max(m.n - 1, 1) + regularisation * np.eye(len(m.mean))
        columns = [[table.column("patch_idx")[0].as_py()], [m.n], [m.mean], [np.linalg.inv(cov).ravel()]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], ["patch_idx", "n", "mean", "cov_inv"])

    parts = patches.select(F.col("patch_idx").cast("int").alias("patch_idx"), "embedding").mapInArrow(partial, _PARTIAL)
    parts = parts.groupBy("patch_idx", "part").applyInArrow(together, _PARTIAL)
    fitted = cut(parts.groupBy("patch_idx").applyInArrow(finished, "patch_idx int, n long, mean array<double>, cov_inv array<double>"))
    if fitted.isEmpty():
        raise ValueError("fitting needs at least one image")
    return fitted


def _distances(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    gap = x - mean
    return np.sqrt(np.clip(((gap @ inverse) * gap).sum(axis=1), 0, None))


def mahalanobis(patches: DataFrame, stats: DataFrame) -> DataFrame:
    """(image_id, patch_idx, distance) from each position's Gaussian; a position without one is an error.

    A model of up to MODEL_BYTES, which is checked, is broadcast, and the vectors stay where they are.
    """
    spark = patches.sparkSession
    ship(spark)
    size = stats.agg(F.sum(8 * (F.size("mean") + F.size("cov_inv"))).alias("n")).first()["n"] or 0
    if size > MODEL_BYTES:
        return _mahalanobis_by_position(patches, stats)
    held = spark.sparkContext.broadcast({r["patch_idx"]: (np.array(r["mean"]), np.array(r["cov_inv"]).reshape(len(r["mean"]), -1)) for r in stats.select("patch_idx", "mean", "cov_inv").toLocalIterator()})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = arrow_matrix(batch.column(2))
            out = np.empty(len(x))
            for p, rows in _by_position(batch.column(1).to_numpy(zero_copy_only=False)):
                if p not in held.value:
                    raise ValueError(f"no model for position {p}")
                out[rows] = _distances(x[rows], *held.value[p])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["image_id", "patch_idx", "distance"])

    kind = dict(patches.dtypes)["image_id"]
    return patches.select("image_id", F.col("patch_idx").cast("int").alias("patch_idx"), "embedding").mapInArrow(score, f"image_id {kind}, patch_idx int, distance double")


def _mahalanobis_by_position(patches: DataFrame, stats: DataFrame) -> DataFrame:
    """The same for a model of any size: a position's images are dealt into groups of bounded size, each with its own copy of that position's part."""
    most = patches.groupBy("patch_idx").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, math.ceil(most / IMAGES_PER_GROUP))

    def score(images: pa.Table, model: pa.Table) -> pa.Table:
        if images.num_rows and not model.num_rows:
            raise ValueError(f"no model for position {images.column('patch_idx')[0].as_py()}")
        found = np.zeros(0)
        if images.num_rows:
            mean = model.column("mean")[0].values.to_numpy()
            found = _distances(arrow_matrix(images.column("embedding")), mean, model.column("cov_inv")[0].values.to_numpy().reshape(len(mean), -1))
        return images.select(["image_id", "patch_idx"]).append_column("distance", pa.array(found, pa.float64()))

    kind = dict(patches.dtypes)["image_id"]
    left = patches.select("image_id", F.col("patch_idx").cast("int").alias("patch_idx"), "embedding", F.pmod(F.xxhash64("image_id"), F.lit(parts)).cast("int").alias("salt"))
    right = stats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.groupBy("patch_idx", "salt").cogroup(right.groupBy("patch_idx", "salt")).applyInArrow(score, f"image_id {kind}, patch_idx int, distance double")


def mahalanobis_2d(x: Column, y: Column, mean_x: Column, mean_y: Column, vxx: Column, vyy: Column, vxy: Column) -> Column:
    """The closed form for two features, without Python."""
    det = vxx * vyy - vxy * vxy
    dx, dy = x - mean_x, y - mean_y
    squared = F.try_divide(vyy * dx * dx - 2.0 * vxy * dx * dy + vxx * dy * dy, det)
    return F.sqrt(F.greatest(squared, F.lit(0.0)))
