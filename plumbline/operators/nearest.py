"""Exact nearest neighbours in a bank of vectors: by broadcast for a bank of bounded size, else by cells around pivots.

With cells: (1) A bounded sample of the bank is broadcast.  Some of it are pivots, and a bank vector belongs to the cell of its nearest
pivot.  (2) Each vector's distance to the sample bounds its result from above.  A cell can hold a nearer one only if neither the
triangle inequality (the cell's least and largest distance from its pivot) nor the plane between its pivot and the vector's nearest
one rules it out.  (3) The vector meets the cells that are left, and there only the bank's rows whose distance to the pivot is
within the bound of its own.  The vectors are shuffled once, in as many copies as there are cells left; bounds are loosened by what rounding can
do, so nothing nearer is lost.  Cells with many vectors on either side are dealt out in groups of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.gaussians import arrow_matrix
from plumbline.session import cut, scratch_path, ship

#: Vectors of a bank that is broadcast whole; of a larger one so many are the sample, and so many of these the pivots.
BANK_BLOCK, PIVOTS = 20_000, 512
#: Rows of a cell, of either side, that one task takes at a time; vectors, and rows of a bank, that are compared in one numpy pass.
CELL_ROWS, PASS_ROWS, BANK_PASS = 20_000, 512, 2048
#: By how much bounds are loosened, relative to the sizes at hand.
LOOSE = 1e-7


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances, by products: good for choosing, not to the last digit."""
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1), 0)


def nearest_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of and distance to the nearest row of y; the distance is computed directly.  Memory follows x and a pass, not y."""
    place, least = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
    for at in range(0, len(y), BANK_PASS):
        gap = squared(x, y[at : at + BANK_PASS])
        here = gap.argmin(axis=1)
        some = gap[np.arange(len(x)), here]
        better = some < least
        place[better], least[better] = at + here[better], some[better]
    return place, np.sqrt(((x - y[place]) ** 2).sum(axis=1))


def _in_passes(x: np.ndarray, of) -> list:
    return [of(x[a : a + PASS_ROWS]) for a in range(0, len(x), PASS_ROWS)]


def nearest_distance(vectors: DataFrame, bank: DataFrame, embedding: str = "embedding", features: str = "features", compared: str | None = None, block: int | None = None, pivots: int | None = None) -> DataFrame:
    """vectors with min_distance: the Euclidean distance to the nearest vector of the bank.

    compared: the name of a further column, for the number of bank vectors that a vector was compared with.  block and pivots are
    BANK_BLOCK and PIVOTS unless given.  An empty bank is an error.  A null vector, or vectors of another length, are errors.
    """
    ship(vectors.sparkSession)
    block, pivots = block or BANK_BLOCK, pivots or PIVOTS
    some = bank.select(F.col(features).alias("f")).limit(block + 1).collect()
    if not some:
        raise ValueError("scoring needs a fitted memory bank")
    if len(some) <= block:
        return _by_broadcast(vectors, np.array([r["f"] for r in some], dtype=np.float64), embedding, compared)
    return _by_cells(vectors, bank.select(F.col(features).alias("f")), embedding, compared, block, pivots)


def _by_broadcast(vectors: DataFrame, bank: np.ndarray, embedding: str, compared: str | None) -> DataFrame:
    held = vectors.sparkSession.sparkContext.broadcast(bank)

    @F.arrow_udf("double")
    def distance(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = arrow_matrix(batch) if len(batch) else np.zeros((0, 1))
            yield pa.array(np.concatenate([np.zeros(0), *_in_passes(x, lambda some: nearest_of(some, held.value)[1])]))

    out = vectors.withColumn("min_distance", distance(F.col(embedding)))
    return out.withColumn(compared, F.lit(len(bank)).cast("long")) if compared else out


def _cells(bank: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(cell, r, f) of the bank, written once: each vector's nearest pivot and its distance."""
    spark = bank.sparkSession
    held = spark.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _in_passes(arrow_matrix(batch.column(0)) if batch.num_rows else np.zeros((0, 1)), lambda some: nearest_of(some, held.value))
            cell, r = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(r), batch.column(0)], ["cell", "r", "f"])

    path = scratch_path(spark, "bank")
    schema = "cell int, r double, f array<double>"
    bank.select(F.col("f").cast("array<double>")).mapInArrow(run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _candidates(vectors: DataFrame, embedding: str, sample: np.ndarray, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, path: str) -> DataFrame:
    """vectors with row_, bound_ and cells_ (those that may hold a nearer one), written once; low and high: the cells' distances from their pivots."""
    spark = vectors.sparkSession
    held = spark.sparkContext.broadcast((sample, pivots, low, high, np.sqrt(squared(pivots, pivots))))

    @F.arrow_udf("struct<bound:double,cells:array<int>>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sample, pivots, low, high, between = held.value

        def some(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
            bound = nearest_of(x, sample)[1]
            gap = np.sqrt(squared(x, pivots))
            home = gap.argmin(axis=1)
            loose = LOOSE * (1 + np.sqrt((x**2).sum(axis=1)) + np.abs(high).max())
            reach = (bound + loose)[:, None]
            own = gap[np.arange(len(x)), home][:, None]
            apart = between[home]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(apart > 0, (gap**2 - own**2) / (2 * apart), 0)
            keep = (gap - high < reach) & (low - gap < reach) & (plane < reach)
            return bound, [np.flatnonzero(k).astype(np.int32) for k in keep]

        for batch in batches:
            parts = _in_passes(arrow_matrix(batch) if len(batch) else np.zeros((0, 1)), some)
            bound = np.concatenate([np.zeros(0), *[p[0] for p in parts]])
            cells = pa.array([c for p in parts for c in p[1]], pa.list_(pa.int32()))
            yield pa.StructArray.from_arrays([pa.array(bound), cells], ["bound", "cells"])

    found = vectors.withColumn("search_", search(F.col(embedding))).withColumn("row_", F.monotonically_increasing_id())
    found = found.select(*vectors.columns, "row_", F.col("search_.bound").alias("bound_"), F.col("search_.cells").alias("cells_"))
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def _by_cells(vectors: DataFrame, bank: DataFrame, embedding: str, compared: str | None, block: int, n_pivots: int) -> DataFrame:
    spark = vectors.sparkSession
    bank = bank.distinct()
    picked = bank.orderBy(F.xxhash64("f")).limit(block).collect()
    sample = np.array([r["f"] for r in picked], dtype=np.float64)
    pivots = sample[:n_pivots]
    cells = _cells(bank, pivots)
    low, high, n_bank = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.zeros(len(pivots), dtype=np.int64)
    for r in cells.groupBy("cell").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count(F.lit(1)).alias("n")).collect():  # one for each pivot
        low[r["cell"]], high[r["cell"]], n_bank[r["cell"]] = r["a"], r["b"], r["n"]
    high = np.where(n_bank > 0, high, -np.inf)
    asked = _candidates(vectors, embedding, sample, pivots, low, np.where(np.isfinite(high), high, -1e300), scratch_path(spark, "asked"))
    n_asked = {r["cell"]: r["n"] for r in asked.select(F.explode("cells_").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each pivot

    sizes = spark.createDataFrame([(c, math.ceil(int(n_bank[c]) / CELL_ROWS), math.ceil(n / CELL_ROWS)) for c, n in n_asked.items()], "cell int, blocks int, deals int")
    pairs = asked.select("row_", "bound_", F.col(embedding).cast("array<double>").alias("v"), F.explode("cells_").alias("cell")).join(F.broadcast(sizes), "cell")
    pairs = pairs.select("row_", "bound_", "v", "cell", F.pmod(F.xxhash64("row_"), F.col("deals")).cast("int").alias("deal"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    parts = cells.join(F.broadcast(sizes), "cell")
    parts = parts.select("r", "f", "cell", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int").alias("block"))
    held = spark.sparkContext.broadcast(pivots)

    def meet(ask: pa.Table, part: pa.Table) -> pa.Table:
        best, seen = np.zeros(0), np.zeros(0, dtype=np.int64)
        if ask.num_rows and part.num_rows:
            part = part.sort_by("r")
            y, r = arrow_matrix(part.column("f")), part.column("r").to_numpy()
            x, bound = arrow_matrix(ask.column("v")), ask.column("bound_").to_numpy()
            gap = np.sqrt(((x - held.value[ask.column("cell")[0].as_py()]) ** 2).sum(axis=1))
            reach = bound + LOOSE * (1 + gap + r[-1])
            a, b = np.searchsorted(r, gap - reach), np.searchsorted(r, gap + reach, side="right")
            best, seen = bound.copy(), b - a
            order = np.argsort(a, kind="stable")
            for i in range(0, len(order), 256):
                some = order[i : i + 256]
                first, last = a[some].min(), b[some].max()
                if first < last:
                    best[some] = np.minimum(best[some], nearest_of(x[some], y[first:last])[1])
        elif ask.num_rows:
            best, seen = ask.column("bound_").to_numpy(), np.zeros(ask.num_rows, dtype=np.int64)
        return pa.table([ask.column("row_"), pa.array(best), pa.array(seen)], ["row_", "best_", "seen_"])

    keys = ["cell", "deal", "block"]
    met = pairs.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(meet, "row_ long, best_ double, seen_ long")
    met = cut(met.groupBy("row_").agg(F.min("best_").alias("best_"), F.sum("seen_").alias("seen_")))
    out = asked.join(met, "row_", "left").withColumn("min_distance", F.coalesce("best_", "bound_"))
    more = [(F.coalesce("seen_", F.lit(0)) + len(sample)).alias(compared)] if compared else []
    return out.select(*vectors.columns, "min_distance", *more)
