"""Embedding whitening by LOBPCG: leading eigenvectors of the covariance from products with blocks of vectors.

Entries become whole numbers, x = floor(64 c) + 1000000, and each distinct vector counts once.  The covariance is never formed: a
product V B, with B of d x m, is a sum over rows of (x - mean) ((x - mean)' B) / n, added up in each partition and then by cell.
Each round takes the residuals of the present vectors, makes them orthogonal to these and to the last directions,
multiplies them by V in one pass over the rows, and solves the small eigenproblem on the three blocks (Rayleigh-Ritz).  It ends when
every wanted vector's residual, recomputed with a fresh product, is at most TOLERANCE of the largest eigenvalue.  The block has
GUARD vectors more than are wanted; where the three blocks span the whole space the second round is exact.

What is broadcast or comes back is d x m numbers, which the data's size doesn't change.

Odd input: rows with a null vector, or a null or non-finite entry, are dropped.  Vectors shorter than the longest one are
filled with entries 0.  Entries beyond CLIP / 64 count as that.  Fewer components than wanted come where the covariance has a lower
rank (eigenvalues up to RANK_FLOOR of the largest count as 0): none for equal vectors, for a single one, or for no rows.  A deviation
beyond the largest long is null.  Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import scratch_path, ship

COMPONENTS, GUARD = 16, 8
SCALE, OFFSET, CLIP = 64, 1_000_000, 1 << 52
TOLERANCE, RANK_FLOOR, MOST_ROUNDS = 1e-12, 1e-12, 500
#: Rows that are centred in one numpy pass.
PASS_ROWS = 4096


@dataclass(frozen=True)
class Whitener:
    """n and sums are those of the fit list; vectors (d x k) and values are by falling value; trace is the covariance's."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    rounds: int


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is there and whose entries are all finite numbers."""
    wrong: Column = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & ~wrong)


def whole_numbers(vector: Column, length: int) -> Column:
    """The vector as whole numbers, with entries 0 up to the length."""
    most = F.lit(CLIP / SCALE)
    inside = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double"), most), -most) * SCALE) + OFFSET)
    return F.concat(inside, F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(length) - F.size(vector)))


def _matrix(vectors: pa.Array, d: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), d)


class FitList:
    """The distinct vectors as a table in the shared folder, their number and sums."""

    def __init__(self, rows: DataFrame, vector: str, length: int) -> None:
        spark = rows.sparkSession
        path = scratch_path(spark, "fit-list")
        rows.select(whole_numbers(F.col(vector), length).alias("x")).distinct().write.parquet(path)
        self.rows, self.d = spark.read.schema("x array<long>").parquet(path), length
        self.n, self.sums = 0, [0] * length
        if length:
            cells = self.rows.select(F.posexplode("x").alias("cell", "value")).groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
            for r in cells:  # one for each of the d dimensions
                self.sums[r["cell"]], self.n = int(r["s"]), r["n"]
        self.centre = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(length)
        self.base = np.array([s // self.n for s in self.sums], dtype=np.int64) if self.n else np.zeros(length, np.int64)
        self.rest = np.array([(s - b * self.n) / self.n for s, b in zip(self.sums, self.base.tolist(), strict=True)]) if self.n else np.zeros(length)

    def added(self, of, cells: int) -> np.ndarray:
        """The sum over all rows of of(centred rows), an array of so many cells, divided by n."""
        d, base, rest = self.d, self.base, self.rest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for a in range(0, batch.num_rows, PASS_ROWS):
                    x = (_matrix(batch.column(0).slice(a, PASS_ROWS), d) - base).astype(np.float64) - rest
                    own = of(x).ravel()
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], ["cell", "value"])

        sums = self.rows.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(cells)
        for r in sums:
            out[r["cell"]] = r["value"]
        return out / self.n

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of d x m."""
        return self.added(lambda x: x.T @ (x @ block), block.size).reshape(block.shape)


def _orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """A basis of what the block adds to the orthonormal columns `against`; directions that add nothing are left out."""
    sizes = np.linalg.norm(block, axis=0)
    block = block[:, sizes > 0] / sizes[sizes > 0]
    for _ in range(2):
        if against is not None:
            block = block - against @ (against.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(1.0, s.max(initial=0.0))]
    return block


def lobpcg(product, d: int, wanted: int, guard: int = GUARD, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, vectors, rounds): the leading eigenpairs of a symmetric positive matrix that is known by its products with blocks.

    The vectors' residuals are at most tolerance times the largest value; if that isn't reached in most_rounds it is an error.
    """
    m = min(d, wanted + guard)
    wanted = min(wanted, d)
    x = _orthonormal(np.random.default_rng(0).standard_normal((d, m)))
    ax = product(x)
    p = np.zeros((d, 0))
    ap = np.zeros((d, 0))
    fresh = True
    for rounds in range(most_rounds):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        turn = turn[:, ::-1]
        x, ax, values = x @ turn, ax @ turn, values[::-1]
        residual = ax - x * values
        if (np.linalg.norm(residual[:, :wanted], axis=0) <= tolerance * values[0]).all():
            if fresh:
                return values[:wanted], x[:, :wanted], rounds
            x = _orthonormal(x)  # certify with a product of its own, free of what the updates have gathered
            ax, fresh = product(x), True
            p, ap = np.zeros((d, 0)), np.zeros((d, 0))
            continue
        r = _orthonormal(residual, x)
        if p.shape[1]:
            basis = np.linalg.qr(np.concatenate([x, r], axis=1))[0]
            q = _orthonormal(p, basis)
        else:
            q = p
        block = np.concatenate([r, q], axis=1)
        made = product(block)  # residuals and directions in one pass, so that no error is carried on
        base, abase = np.concatenate([x, block], axis=1), np.concatenate([ax, made], axis=1)
        _, t = np.linalg.eigh((base.T @ abase + abase.T @ base) / 2)
        t = t[:, ::-1][:, :m]
        p = block @ t[m:]
        x, ax = base @ t, abase @ t
        fresh = False
    raise RuntimeError(f"the vectors did not settle in {most_rounds} rounds")


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[Whitener, FitList]:
    """The whitening of the distinct vectors, and the table that it was fitted on."""
    ship(rows.sparkSession)
    rows = usable(rows, vector)
    length = rows.agg(F.max(F.size(vector)).alias("d")).first()["d"] or 0
    fit_list = FitList(rows, vector, length)
    if fit_list.n < 2:
        return Whitener(fit_list.n, fit_list.sums, np.zeros((length, 0)), np.zeros(0), 0.0, 0), fit_list
    trace = float(fit_list.added(lambda x: (x * x).sum(axis=0), length).sum())
    values, vectors, rounds = lobpcg(fit_list.product, length, components)
    real = values > RANK_FLOOR * values[0]
    return Whitener(fit_list.n, fit_list.sums, vectors[:, real], values[real], trace, rounds), fit_list


def identity_error(model: Whitener, fit_list: FitList) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0
    turn = model.vectors / np.sqrt(model.values)
    centre = fit_list.added(lambda x: (x @ turn).sum(axis=0), k)

    def squares(x: np.ndarray) -> np.ndarray:
        y = x @ turn - centre
        return y.T @ y

    return float(np.abs(fit_list.added(squares, k * k).reshape(k, k) - np.eye(k)).max())


def _deviations(x: np.ndarray, base: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2 for each row, exactly: in 64 bits where all stays small, else in whole numbers of any size."""
    rest = [s - b * n for s, b in zip(sums, base.tolist(), strict=True)]
    near = x - base
    if float(np.square(near.astype(np.float64) * n).sum(axis=1).max(initial=0.0)) * 4 + 4.0 * n * n * len(sums) < 2**62:
        gap = near * n - np.array(rest, dtype=np.int64)
        return (gap * gap).sum(axis=1).tolist()
    exact = [sum((v * n - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in near.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(rows: DataFrame, key: str, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component.

    Components are numbered from 1 by falling eigenvalue.
    """
    model, fit_list = fit(rows, vector, components)
    error = identity_error(model, fit_list)
    kind, d, n, sums, base, rest, k = dict(rows.dtypes)[key], fit_list.d, model.n, model.sums, fit_list.base, fit_list.rest, len(model.values)
    turn = model.vectors / np.sqrt(model.values)
    explained = model.values / model.trace if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows if k else 0, PASS_ROWS):
                part = batch.slice(a, PASS_ROWS)
                x = _matrix(part.column(1), d)
                white = ((x - base).astype(np.float64) - rest) @ turn
                rows_of = np.repeat(np.arange(len(x)), k)
                columns = [
                    part.column(0).take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows_of), n, np.int64)),
                    pa.array(_deviations(x, base, n, sums), pa.int64()).take(pa.array(rows_of)), pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows_of), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    own = usable(rows, vector).select(key, whole_numbers(F.col(vector), d).alias("x"))
    return own.mapInArrow(run, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
