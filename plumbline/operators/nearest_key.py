"""The nearest key of a dimension table of any size, by order and not by pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut

#: Ranges of keys, keys that a range has about, and rows that one task takes of a range.
MOST_RANGES, KEYS_PER_RANGE, ROWS_PER_DEAL = 256, 2_000, 500_000


def _range_of(value: Column, bounds: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(b) for b in [*bounds, math.inf]]), lambda b: b < value))


def nearest_key(rows: DataFrame, value: str, keys: DataFrame, key: str, ordinal: str, name: str = "nearest") -> DataFrame:
    """rows with a struct of the columns of the row of `keys` whose key is nearest to the value; of equally near ones the least ordinal.

    Ranges of keys hold about equally many; each also gets the last key before it and the first one behind it, so that a row's
    neighbours are in its own range.  There, the last key up to a value and the first one from it on are running values in order.  Ranges
    with many rows are dealt out, each part with its own copy of the range's keys, so equal values may be any number.  The rows
    are shuffled once.  Values that are null or not a number, and all values where there are no keys, have null; such keys don't count.
    """
    real = F.col(key).isNotNull() & ~F.isnan(F.col(key).cast("double"))
    entry = F.struct(F.col(key).cast("double").alias("k_"), F.col(ordinal).alias("o_"), F.struct(*keys.columns).alias("row_"))
    one = cut(keys.where(real).groupBy(F.col(key).cast("double").alias("k_")).agg(F.min_by(entry, F.col(ordinal)).alias("e_")))
    n = min(MOST_RANGES, math.ceil(one.count() / KEYS_PER_RANGE))
    bounds = sorted(set(one.agg(F.percentile_approx("k_", [i / n for i in range(1, n)], 10_000)).first()[0] or [])) if n > 1 else []
    ranges = len(bounds) + 1

    own = one.select(_range_of(F.col("k_"), bounds).alias("range_"), "e_")
    all_ranges = rows.sparkSession.range(ranges).select(F.col("id").cast("int").alias("range_"))  # MOST_RANGES rows at most
    every = own.unionByName(all_ranges, allowMissingColumns=True).groupBy("range_").agg(F.min_by("e_", "e_.k_").alias("least"), F.max_by("e_", "e_.k_").alias("most"))
    order = Window.orderBy("range_")
    before = F.last("most", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.last("least", ignorenulls=True).over(Window.orderBy(F.col("range_").desc()).rowsBetween(Window.unboundedPreceding, -1))
    beside = every.select("range_", F.array(before, behind).alias("both")).select("range_", F.explode("both").alias("e_")).where("e_ IS NOT NULL")

    v = F.col(value).cast("double")
    good = v.isNotNull() & ~F.isnan(v)
    asked = rows.select(F.struct(*rows.columns).alias("asked_"), v.alias("v_"), F.when(good, _range_of(v, bounds)).otherwise(-1).alias("range_"))
    deals = asked.groupBy("range_").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_DEAL).alias("deals"))  # MOST_RANGES + 1 rows at most
    deals = F.broadcast(cut(deals))
    asked = asked.join(deals, "range_").select("range_", F.pmod(F.monotonically_increasing_id(), F.col("deals")).alias("deal"), "v_", "asked_")
    held = own.unionByName(beside).join(deals, "range_").select("range_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), F.col("e_.k_").alias("v_"), "e_")

    both = asked.unionByName(held, allowMissingColumns=True)
    part = Window.partitionBy("range_", "deal")
    is_row = F.col("asked_").isNotNull()
    low = F.last("e_", ignorenulls=True).over(part.orderBy("v_", is_row).rowsBetween(Window.unboundedPreceding, 0))
    high = F.last("e_", ignorenulls=True).over(part.orderBy(F.col("v_").desc(), is_row).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("low_", low).withColumn("high_", high).where(is_row)

    def option(c: str) -> Column:
        return F.when(F.col(c).isNotNull() & (F.col("range_") >= 0), F.struct(F.abs(F.col(f"{c}.k_") - F.col("v_")).alias("gap"), F.col(f"{c}.o_").alias("o"), F.col(f"{c}.row_").alias("row_")))

    best = F.least(option("low_"), option("high_"))
    return found.select("asked_.*", best["row_"].alias(name))
