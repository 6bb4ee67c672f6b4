"""How operators run a kernel over a text column, and read the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.session import ship, table
from plumbline.llm.bytewords import in_slices

__all__ = ["free_name", "kernel_column", "read_public_file", "table", "with_kernel"]


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def read_public_file(path: str | None, default: str) -> bytes:
    """A vocabulary file, read on the driver; its size doesn't depend on the data."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(default)
    return Path(path).read_bytes()


def kernel_column(
    spark: SparkSession,
    text: Column,
    schema: T.StructType,
    make: Callable[[object], Callable[[list[str | None]], list]],
    payload: object = None,
    slice_chars: int = 1 << 20,
) -> Column:
    """A struct column that a kernel computes from a text column, in Arrow batches.

    payload is broadcast; make(payload) runs once in each task and returns the kernel, which turns
    a list of texts into one list (or array) for each field.  Batches are cut to about slice_chars
    characters, so memory follows that size and the longest text, not the batch's row count.
    """
    ship(spark)
    held = spark.sparkContext.broadcast(payload)
    names = [f.name for f in schema.fields]
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kernel = make(held.value)
        for batch in batches:
            parts = []
            for _, texts in in_slices(batch, slice_chars):
                columns = kernel(texts)
                parts.append(pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(zip(names, kinds, strict=True))))

    return run(text)


def with_kernel(docs: DataFrame, keep: list[str], text: str, schema: T.StructType, make: Callable, payload: object = None, slice_chars: int = 1 << 20) -> DataFrame:
    """The columns `keep` of docs, then the kernel's fields; other columns of docs are not read.

    Rows leave the kernel slice by slice, so a task holds no more than a slice of its results.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(payload)
    kept = docs.select(*[docs[c] for c in keep], docs[text].alias(free_name(docs, "text_")))
    names = [f.name for f in schema.fields]
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make(held.value)
        for batch in batches:
            for start, texts in in_slices(batch.column(len(keep)), slice_chars):
                own = [batch.column(i).slice(start, len(texts)) for i in range(len(keep))]
                made = [pa.array(c, k) for c, k in zip(kernel(texts), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(own + made, keep + names)

    out = T.StructType([f for f in kept.schema.fields[: len(keep)]] + list(schema.fields))
    return kept.mapInArrow(run, out)
