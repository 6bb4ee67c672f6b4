"""Patch vectors: feature selection, image scores, and maps of patches resized to their image.

A patch table is long: (image_id, patch_idx, embedding ARRAY<FLOAT>).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_features(embedding: Column, indices: list[int]) -> Column:
    """The features at those places (from 0); a vector that is too short is an error."""
    longest = max(indices, default=-1)
    picked = F.array(*[F.get(embedding, F.lit(int(i))).cast("double") for i in indices])
    return F.when(F.size(embedding) > longest, picked).otherwise(F.raise_error(F.lit("embedding has too few features")).cast("array<double>"))


def choose_features(total: int, wanted: int, seed: int = 0) -> list[int]:
    """A seeded choice of feature places without repeats, sorted."""
    return sorted(np.random.default_rng(seed).choice(total, size=min(wanted, total), replace=False).tolist())


def image_scores(distances: DataFrame, distance: str = "distance") -> DataFrame:
    """An image's score: its largest patch distance."""
    return distances.groupBy("image_id").agg(F.max(distance).alias("score"))


def min_max_levels(rows: DataFrame, group: str, value: str, level: str = "level") -> DataFrame:
    """rows with the value's place between its group's least and greatest as 0 to 255, cut down; 0 where all are equal.

    The ends are combined before the shuffle; groups of any size come back by a join.
    """
    ends = rows.groupBy(group).agg(F.min(value).alias("least_"), F.max(value).alias("most_"))
    span = F.when(F.col("most_") > F.col("least_"), F.col("most_") - F.col("least_")).otherwise(F.lit(1.0))
    both = rows.join(ends, group)
    return both.select(*[F.col(c) for c in rows.columns], F.floor((F.col(value) - F.col("least_")) / span * 255).cast("int").alias(level))


def resize_map(values: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with half-pixel centres and clamped edges, of one map or of each of a stack."""

    def axis(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(values.shape[-2], height)
    x0, x1, fx = axis(values.shape[-1], width)
    upper, lower = values[..., y0, :], values[..., y1, :]
    top = upper[..., x0] * (1 - fx) + upper[..., x1] * fx
    bottom = lower[..., x0] * (1 - fx) + lower[..., x1] * fx
    return top * (1 - fy[:, None]) + bottom * fy[:, None]
