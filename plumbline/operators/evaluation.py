"""Scores against labels, error summaries, latency and equivalence statistics."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import fixed
from plumbline.session import cut

CONDITIONS = ("clean", "blur", "rotated")


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """Normal and anomalous rows at each score: all that the ROC needs, combined before the shuffle."""
    return df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def _cumulated(counts: DataFrame, buckets: int = 64) -> DataFrame:
    """counts with pos_above and neg_above: rows at this score or higher.

    Running sums in two steps: inside ranges of scores, and over the ranges' totals; so no task holds all
    scores.  The ranges' bounds are approximate quantiles, which decide the balance only.
    """
    counts = cut(counts)
    bounds = [b for b in counts.agg(F.percentile_approx("s", [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []]
    place = F.lit(0)
    for b in sorted(set(bounds)):
        place = place + F.when(F.col("s") > b, 1).otherwise(0)
    rows = counts.withColumn("range_", place)
    totals = rows.groupBy("range_").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    after = Window.orderBy(F.col("range_").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    totals = totals.select(
        F.col("range_"),
        F.coalesce(F.sum("p").over(after), F.lit(0)).alias("p_after"),
        F.coalesce(F.sum("n").over(after), F.lit(0)).alias("n_after"),
        F.sum("p").over(every).alias("all_pos"),
        F.sum("n").over(every).alias("all_neg"),
    )
    inside = Window.partitionBy("range_").orderBy(F.col("s").desc())
    rows = rows.join(F.broadcast(totals), "range_")
    return rows.select(
        "s", "pos", "neg", "all_pos", "all_neg",
        (F.sum("pos").over(inside) + F.col("p_after")).alias("pos_above"),
        (F.sum("neg").over(inside) + F.col("n_after")).alias("neg_above"),
    )


def roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(s, pos, neg, all_pos, all_neg, pos_above, neg_above): the curve's points, for both evaluations below; the scores are read once."""
    return _cumulated(score_counts(df, score, label))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(auroc, n_normal, n_anomalous): the chance that an anomalous row scores higher, ties half.

    One class only is an error.
    """
    return auroc_of(roc(df, score, label))


def auroc_of(rows: DataFrame) -> DataFrame:
    won = F.sum(F.col("pos") * (F.col("all_neg") - F.col("neg_above")).cast("double") + F.col("pos") * F.col("neg") / 2.0)
    out = rows.agg(won.alias("won"), F.sum("pos").alias("n_anomalous"), F.sum("neg").alias("n_normal"))
    pairs = F.col("n_anomalous").cast("double") * F.col("n_normal")
    value = F.when(pairs > 0, F.try_divide(F.col("won"), pairs)).otherwise(F.raise_error(F.lit("AUROC needs both classes")).cast("double"))
    return out.select(value.alias("auroc"), "n_normal", "n_anomalous")


def youden(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, j): the score that maximises true less false positive rate; of equals the largest score.

    If no score does better than chance, the threshold is above all scores (infinity) and j is 0.
    """
    return youden_of(roc(df, score, label))


def youden_of(rows: DataFrame) -> DataFrame:
    j = F.try_divide(F.col("pos_above"), F.col("all_pos")) - F.try_divide(F.col("neg_above"), F.col("all_neg"))
    best = rows.agg(F.max(F.struct(j.alias("j"), F.col("s").alias("s"))).alias("b"))
    good = F.col("b.j") > 0
    return best.select(F.when(good, F.col("b.s")).otherwise(F.lit(float("inf"))).alias("threshold"), F.when(good, F.col("b.j")).otherwise(0.0).alias("j"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count_if(F.col(label) == 0).alias("n_normal"), F.count_if(F.col(label) == 1).alias("n_anomalous"))


def percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None, buckets: int = 64, empty: bool = False) -> DataFrame:
    """(by, q0, q1, ..., n, total): exact percentiles of each group, interpolated, with the values' number and sum; nulls don't count.

    Without groups there is always a row; empty: groups of nulls alone have one too.

    Equal values are counted before the shuffle, which deals them by ranges of values inside a group; the ranges' bounds are approximate and
    decide the balance only.  Each range then knows its count, so the ranks are sought in running counts of just the ranges that hold
    one: no buffer or task holds all values of a group.  The values are read twice (a costly input is cut first, by the caller); the
    counts' shuffle is used twice.
    """
    by = by or []
    s = F.col(value).cast("double")
    rows = df if empty else df.where(F.col(value).isNotNull())
    counts = rows.groupBy(*by, s.alias("s")).agg(F.count(value).alias("n"))
    bounds = rows.agg(F.percentile_approx(s, [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []
    edges = F.array(*[F.lit(b) for b in [*sorted(set(bounds)), float("inf")]])
    rows = counts.withColumn("range_", F.size(F.filter(edges, lambda b: b < F.col("s"))))
    totals = rows.groupBy(*by, "range_").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("s")).alias("t"))
    order, whole = Window.partitionBy(*by).orderBy("range_"), Window.partitionBy(*by)
    totals = totals.select(
        *[F.col(k).alias(f"{k}_") for k in by], F.col("range_").alias("held_"), "m",
        F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.sum("m").over(whole).alias("all_"), F.sum("t").over(whole).alias("total_"),
    )
    ranks = [r for q in shares for r in (F.floor(F.lit(q) * (F.col("all_") - 1)), F.ceil(F.lit(q) * (F.col("all_") - 1)))]
    sought = totals.where(reduce(or_, [F.col("all_") == 0] + [(r >= F.col("before_")) & (r < F.col("before_") + F.col("m")) for r in ranks]))  # 2 ranges for each share at most
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in by], F.col("range_") == F.col("held_"))
    inside = Window.partitionBy(*by, "range_").orderBy("s")
    rows = rows.join(sought, same).withColumn("upto", F.col("before_") + F.sum("n").over(inside)).withColumn("below", F.col("upto") - F.col("n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (rank < F.col("upto")), F.col("s")))

    found = rows.groupBy(*by).agg(
        F.max("all_").alias("n"), F.max("total_").alias("total"), *[x for i, _ in enumerate(shares) for x in (at(ranks[2 * i]).alias(f"low{i}"), at(ranks[2 * i + 1]).alias(f"high{i}"))]
    )

    def between(i: int, q: float) -> Column:
        place = F.lit(q) * (F.col("n") - 1)
        low, high, part = F.col(f"low{i}"), F.col(f"high{i}"), place - F.floor(place)
        return F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(f"q{i}")

    return found.select(*by, *[between(i, q) for i, q in enumerate(shares)], "n", "total")


def p99_threshold(scores: DataFrame, score: str = "score", q: float = 0.99) -> DataFrame:
    """The exact percentile, interpolated; null without scores."""
    return percentiles(scores, score, [q]).select(F.col("q0").alias("threshold"))


def latency_stats(df: DataFrame, ms: str, by: list[str] | None = None) -> DataFrame:
    """mean, p50, p95 and throughput per second (infinite for a mean that isn't positive); the input is read once."""
    by = by or []
    found = percentiles(df, ms, [0.5, 0.95], by, empty=True).withColumn("mean_ms", F.try_divide(F.col("total"), F.col("n")))
    rate = F.when(F.col("mean_ms") > 0, F.try_divide(F.lit(1000.0), F.col("mean_ms"))).otherwise(F.lit(float("inf")))
    return found.select(*by, "mean_ms", F.col("q0").alias("p50_ms"), F.col("q1").alias("p95_ms"), rate.alias("throughput"))


def equivalence(df: DataFrame, a: str, b: str, atol: float = 1e-2, rtol: float = 1e-3) -> DataFrame:
    """Largest and mean absolute difference, largest relative one, and whether all are within atol + rtol * |b|."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    gap = F.abs(x - y)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(gap).alias("max_abs_diff"),
        F.avg(gap).alias("mean_abs_diff"),
        F.max(gap / F.greatest(F.abs(x), F.lit(1e-8))).alias("max_rel_diff"),
        F.bool_and(gap <= atol + rtol * F.abs(y)).alias("all_close"),
    )


def summarize(records: DataFrame) -> DataFrame:
    """For each estimator and condition: cases, diameter errors, and pitch errors over the cases that have a pitch."""
    return records.groupBy("estimator", "condition").agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.avg("diameter_abs_error").alias("diameter_mae"),
        F.avg("diameter_pct_error").alias("diameter_mean_pct"),
        F.avg("pitch_abs_error").alias("pitch_mae"),
        F.avg("pitch_pct_error").alias("pitch_mean_pct"),
        F.count("pitch_abs_error").alias("n_pitch"),
    )


def pivot_conditions(summary: DataFrame, conditions: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """A row for each estimator; for each condition its pitch error, and its cases with a pitch and all cases (0 where absent)."""
    out = summary.groupBy("estimator").agg(
        *[
            x
            for c in conditions
            for x in (
                F.max(F.when(F.col("condition") == c, F.col("pitch_mae"))).alias(f"{c}_mae"),
                F.coalesce(F.max(F.when(F.col("condition") == c, F.col("n_pitch"))), F.lit(0)).alias(f"{c}_n_pitch"),
                F.coalesce(F.max(F.when(F.col("condition") == c, F.col("n_cases"))), F.lit(0)).alias(f"{c}_n_cases"),
            )
        ]
    )
    return out


def comparison_rows(summary: DataFrame, conditions: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """The pivot as rows of a Markdown table, in the order of their numbers."""
    wide = pivot_conditions(summary, conditions)

    def cell(c: str) -> Column:
        value = F.coalesce(fixed(F.col(f"{c}_mae"), 4), F.lit("n/a"))
        return F.concat(value, F.lit(" ("), F.col(f"{c}_n_pitch").cast("string"), F.lit("/"), F.col(f"{c}_n_cases").cast("string"), F.lit(" produced an estimate)"))

    body = wide.select(
        (F.row_number().over(Window.orderBy("estimator")) + 1).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", "estimator", *map(cell, conditions)), F.lit(" |")).alias("line")
    )
    head = [(0, "| Method | " + " | ".join(f"{c.capitalize()} pitch MAE (mm)" for c in conditions) + " |"), (1, "|---" * (len(conditions) + 1) + "|")]
    return summary.sparkSession.createDataFrame(head, "n int, line string").union(body)
