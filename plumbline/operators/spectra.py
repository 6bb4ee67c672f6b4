"""The Fourier transform of signals of any length, in pieces of about the root of the length.

A signal of n = n1 x n2 values is n2 columns of n1 values: each column is transformed, turned by its twiddles, and the results, dealt anew by
frequency, are n1 rows of n2 values that are transformed again.  So there are two shuffles, and no task holds a signal.  A length without a
divisor near its root is turned into a convolution (chirps of quadratic phase) of a length that is a power of four.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import spectral_confidence
from plumbline.session import cut, ship

#: A length whose best divisor n1 leaves n2 above so many n1 goes by convolution.
UNEVEN = 64


def _pieces(rows: DataFrame, keys: list[str], place: Column, length: str, twiddle: bool, inverse: bool) -> DataFrame:
    """The keys and (at, re, im): transforms of the pieces that the keys name; a piece has `length` values at their places, others are 0."""
    held = rows.groupBy(*keys).agg(F.collect_list(F.struct(place.cast("int").alias("at"), "re", "im")).alias("values"))
    kinds = [f"`{k}` {dict(rows.dtypes)[k]}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            columns = {c: batch.column(names.index(c)) for c in names}
            sizes, n, j = (columns[c].to_pylist() for c in (length, "n", "j"))
            out: list[list[np.ndarray]] = [[], []]
            for values, size, whole, own in zip(columns["values"], sizes, n, j, strict=True):
                z = np.zeros(size, dtype=complex)
                parts = values.values
                z[parts.field("at").to_numpy()] = parts.field("re").to_numpy() + 1j * parts.field("im").to_numpy()
                z = np.fft.ifft(z) * size if inverse else np.fft.fft(z)
                if twiddle:
                    turn = (own * np.arange(size)) % whole
                    z = z * np.exp((2j if inverse else -2j) * np.pi * turn / whole)
                out[0].append(z.real)
                out[1].append(z.imag)
            yield pa.RecordBatch.from_arrays([*[columns[k] for k in keys], *[pa.array(o, pa.list_(pa.float64())) for o in out]], [*keys, "re", "im"])

    made = held.mapInArrow(run, ", ".join([*kinds, "re array<double>", "im array<double>"]))
    return made.select(*keys, F.posexplode(F.arrays_zip("re", "im")).alias("at", "z")).select(*keys, "at", "z.re", "z.im")


def transform(rows: DataFrame, inverse: bool = False) -> DataFrame:
    """(signal_id, n, n1, i, re, im): the transform, or n times its inverse, of rows (signal_id, n, n1, i, re, im); n1 divides n."""
    n2 = F.expr("n div n1")
    columns = rows.select("signal_id", "n", "n1", n2.alias("n2"), (F.col("i") % n2).alias("j"), F.expr("i div (n div n1)").alias("j1"), "re", "im")
    keys = ["signal_id", "n", "n1", "n2", "j"]
    first = _pieces(columns, keys, F.col("j1"), "n1", True, inverse)
    across = first.select("signal_id", "n", "n1", "n2", F.col("at").cast("long").alias("j"), F.col("j").alias("j2"), "re", "im")
    second = _pieces(across, keys, F.col("j2"), "n2", False, inverse)
    return second.select("signal_id", "n", "n1", (F.col("j") + F.col("n1") * F.col("at")).alias("i"), "re", "im")


def _chirp(i: Column, n: Column, sign: int) -> tuple[Column, Column]:
    turn = np.pi * ((i * i) % (2 * n)) / n
    return F.cos(turn), sign * F.sin(turn)


def _by_convolution(rows: DataFrame) -> DataFrame:
    """(signal_id, n, i, re, im) of rows (signal_id, n, i, re, im), whatever n is."""
    n, i = F.col("n"), F.col("i")
    root = F.pow(F.lit(2.0), F.ceil(F.log2((2 * n - 1).cast("double")) / 2)).cast("long")
    real, imag = _chirp(i, n, -1)
    a = rows.select("signal_id", (root * root).alias("n"), root.alias("n1"), "i", (F.col("re") * real - F.col("im") * imag).alias("re"), (F.col("re") * imag + F.col("im") * real).alias("im"))
    up, down = _chirp(i, n, 1)
    there = F.when(i == 0, F.array(i)).otherwise(F.array(i, root * root - i))
    b = rows.select("signal_id", (root * root).alias("n"), root.alias("n1"), F.explode(there).alias("i"), up.alias("re"), down.alias("im"))
    left, right = transform(a).alias("a"), transform(b).alias("b")
    both = left.join(right, ["signal_id", "n", "n1", "i"])
    product = both.select("signal_id", "n", "n1", "i", F.expr("a.re * b.re - a.im * b.im").alias("re"), F.expr("a.re * b.im + a.im * b.re").alias("im"))
    back = transform(product, inverse=True).select("signal_id", "i", (F.col("re") / F.col("n")).alias("cr"), (F.col("im") / F.col("n")).alias("ci"))
    own = rows.select("signal_id", "n", "i").join(back, ["signal_id", "i"])
    real, imag = _chirp(F.col("i"), F.col("n"), -1)
    return own.select("signal_id", "n", "i", (F.col("cr") * real - F.col("ci") * imag).alias("re"), (F.col("cr") * imag + F.col("ci") * real).alias("im"))


def spectrum(signal: DataFrame, value: str = "v") -> DataFrame:
    """(signal_id, k, magnitude) of the real Fourier transform, k up to half the length."""
    ship(signal.sparkSession)
    divisor = F.expr("array_max(filter(sequence(1L, cast(floor(sqrt(n)) AS bigint)), d -> n % d = 0))")
    sizes = cut(signal.groupBy("signal_id").agg(F.count(F.lit(1)).alias("n")).withColumn("n1", divisor))
    rows = signal.select("signal_id", F.col("i").cast("long").alias("i"), F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im")).join(sizes, "signal_id")
    uneven = F.expr(f"n div n1 > {UNEVEN} * n1")
    made = transform(rows.where(~uneven)).select("signal_id", "n", "i", "re", "im")
    if not sizes.where(uneven).isEmpty():
        made = made.unionByName(_by_convolution(rows.where(uneven)))
    half = made.where("i <= n div 2")
    return half.select("signal_id", F.col("i").cast("int").alias("k"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("magnitude"))


def dominant_frequency(spectrum_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(signal_id, pitch_px, confidence) from bins of two or more cycles; of equal peaks the lowest frequency."""
    valid = spectrum_rows.where(F.col("k") >= 2).withColumn("m", F.when(F.col("magnitude") < 1e-9, 0.0).otherwise(F.col("magnitude")))
    best = valid.groupBy("signal_id").agg(F.min(F.struct((-F.col("m")).alias("neg"), "k")).alias("b"), F.avg("m").alias("mean_m"))
    rows = best.join(sizes, "signal_id")
    return rows.select("signal_id", (F.col("n") / F.col("b.k")).alias("pitch_px"), spectral_confidence(-F.col("b.neg"), F.col("mean_m")).alias("confidence"))
