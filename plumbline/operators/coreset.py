"""k-center coresets and seeded samples that no task or driver sees whole.

Farthest-point choice is sequential, but a gap (the squared distance to the nearest centre so far) only ever shrinks.  So the rows with the
largest gaps are brought to the driver, a bounded number, and centres are chosen among them for as long as the best of them beats what every other
row had before; only then are all gaps brought up to date.  That gives exactly the sequential choice, with several centres for each pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.gaussians import arrow_matrix
from plumbline.session import cut, ship

#: Rows with the largest gaps that the driver sees at a time, and rows that a task covers by centres of its own at a time.
FARTHEST_ROWS, CHUNK_ROWS = 2048, 20_000
#: Bits of the hash by which a sample's threshold is narrowed at a time, and rows of the last range, which are put in order.
RANGE_BITS, RANGE_ROWS = 10, 4096


def sample_by_rank(rows: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """The rows of the `size` least hashes of their key: a seeded sample.  Keys are taken to be unique.

    The last hash that is in is found by counting ranges of hashes, then parts of the range that it falls in; nothing is sorted but
    the last range, and no task gathers the sample.
    """
    h = F.xxhash64(F.col(key), F.lit(seed)).bitwiseXOR(F.lit(-(2**63)))  # as bits, the least first
    low, left, shift = 0, size, 64
    hashes = rows.select(h.alias("h"), key)
    while True:
        width = min(RANGE_BITS, shift)
        inside = hashes if shift == 64 else hashes.where(F.shiftrightunsigned("h", shift) == low)
        part = F.shiftrightunsigned("h", shift - width)
        counts = dict(inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # 2 ** RANGE_BITS at most
        for p in sorted(counts):
            if left <= counts[p]:
                break
            left -= counts[p]
        else:
            return rows  # all of them
        low, shift = p, shift - width
        if counts[p] <= RANGE_ROWS or not shift:
            break
    signed = F.col("h").bitwiseXOR(F.lit(-(2**63)))
    own = hashes.where(F.shiftrightunsigned("h", shift) == low) if shift else hashes.where(F.col("h") == (low - 2**64 if low >= 2**63 else low))
    last = own.select(signed.alias("s"), key).orderBy("s", key).limit(left).orderBy(F.col("s").desc(), F.col(key).desc()).first()
    mine = F.xxhash64(F.col(key), F.lit(seed))
    return rows.where((mine < last["s"]) | ((mine == last["s"]) & (F.col(key) <= F.lit(last[key]))))


def squared_gaps(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((x - centre) ** 2).sum(axis=1)


def greedy_coreset(features: np.ndarray, size: int, first: int = 0) -> list[int]:
    """Places of a k-center coreset: from the first one on, always the farthest; the first of equals.  It ends where all gaps are 0."""
    chosen, gap = [first], squared_gaps(features, features[first])
    while len(chosen) < size and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, squared_gaps(features, features[chosen[-1]]))
    return chosen


def _updated(state: DataFrame, centres: list[np.ndarray], schema: str) -> DataFrame:
    held = state.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, gap = arrow_matrix(batch.column(1)), batch.column(2).to_numpy()
                for c in held.value:
                    gap = np.minimum(gap, squared_gaps(x, c))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gap)], batch.schema.names)

    return cut(state.mapInArrow(run, schema))


def farthest_points(vectors: DataFrame, key: str, size: int, embedding: str = "embedding", seed: int = 0, start: str = "hashed") -> DataFrame:
    """(ordinal, key, features): exactly the sequential farthest-point choice of `size` centres; of equals the least key.

    start: 'hashed', the row whose hashed key is least, or 'least', the row of the least key.  Where all vectors equal a centre, no
    more are chosen.  No rows are an error.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = dict(vectors.dtypes)[key]
    schema = f"`{key}` {kind}, v array<double>, gap double"
    state = vectors.select(key, F.col(embedding).cast("array<double>").alias("v"), F.lit(float("inf")).alias("gap"))
    order = [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)] if start == "hashed" else [F.col(key)]
    begin = state.orderBy(*order).select(key, "v").first()
    if begin is None:
        raise ValueError("fitting needs at least one image")
    made, fresh = [(begin[key], np.array(begin["v"]))], [np.array(begin["v"])]
    while len(made) < size:
        state = _updated(state, fresh, schema)
        far = state.orderBy(F.col("gap").desc(), F.col(key)).limit(FARTHEST_ROWS).collect()
        x, gap, keys = np.array([r["v"] for r in far]), np.array([r["gap"] for r in far]), [r[key] for r in far]
        others = (gap[-1], keys[-1]) if len(far) == FARTHEST_ROWS else None
        fresh = []
        while len(made) < size and gap.max() > 0:
            most = gap.max()
            best = min(np.flatnonzero(gap == most), key=lambda i: keys[i])
            if others and not (most > others[0] or (most == others[0] and keys[best] <= others[1])):
                break
            made.append((keys[best], x[best]))
            fresh.append(x[best])
            gap = np.minimum(gap, squared_gaps(x, x[best]))
        if not fresh:
            break
    return spark.createDataFrame([(i, k, v.tolist()) for i, (k, v) in enumerate(made)], f"ordinal int, `{key}` {kind}, features array<double>")


def composed(vectors: DataFrame, key: str, size: int, embedding: str = "embedding") -> DataFrame:
    """(key, embedding) of centres that the partitions choose, each for its own rows: `size` for every CHUNK_ROWS rows or fewer.

    Farthest points of these rows are centres of all rows with a radius of at most 4 times the best possible (each row is within
    twice the best radius of a partition's centre, and that one within twice of a chosen one).  One pass, no shuffle.
    """
    ship(vectors.sparkSession)
    kind = dict(vectors.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def chosen() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            yield from table.take(greedy_coreset(arrow_matrix(table.column(1)), size)).combine_chunks().to_batches()

        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(a, CHUNK_ROWS)
                if held and sum(b.num_rows for b in held) + part.num_rows > CHUNK_ROWS:
                    yield from chosen()
                    held.clear()
                held.append(part)
        if held:
            yield from chosen()

    return vectors.select(key, F.col(embedding).cast("array<double>").alias(embedding)).mapInArrow(run, f"`{key}` {kind}, `{embedding}` array<double>")


def fit_bank(vectors: DataFrame, key: str, size: int = 2000, pool: int | None = 20_000, seed: int = 0, embedding: str = "embedding", start: str = "hashed") -> DataFrame:
    """(ordinal, key, features): the farthest points of a sample of so many vectors; pool None: of what all partitions compose."""
    rows = composed(vectors, key, size, embedding) if pool is None else sample_by_rank(vectors.select(key, embedding), key, pool, seed)
    return farthest_points(rows, key, size, embedding, seed, start)
