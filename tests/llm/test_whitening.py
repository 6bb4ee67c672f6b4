"""Whitening against numpy's eigenvectors of the whole covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


def plain(vectors, components=16):
    """(x, n, sums, values, vectors, trace) over all vectors."""
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    one = np.unique(x, axis=0)
    sums = one.sum(axis=0)
    centred = one - sums / len(one)
    cov = centred.T @ centred / len(one)
    values, q = np.linalg.eigh(cov)
    return x, len(one), sums, values[::-1][:components], q[:, ::-1][:, :components], np.trace(cov)


def table(spark, vectors, extra=()):
    rows = [(i, [float(v) for v in r], 3, "x") for i, r in enumerate(vectors)] + [(1000 + i, r, 3, "x") for i, r in enumerate(extra)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("d", [3, 40, 150])
def test_whitened_rows_equal_plain_ones(spark, d):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((400, d)) @ np.diag(np.linspace(2, 0.3, d))).astype(np.float32)
    vectors = np.concatenate([vectors, vectors[:1].repeat(200, axis=0)])
    x, n, sums, values, q, trace = plain(vectors)
    odd = [None, [math.nan] * d, [math.inf] + [0.0] * (d - 1), [None] * d]
    got = wh.whiten(table(spark, vectors, odd), "vec_id").orderBy("vec_id", "component").collect()
    k = min(16, d)
    assert len(got) == k * len(vectors)
    made = np.array([r["whitened"] for r in got]).reshape(-1, k)
    want = (x - sums / n) @ q / np.sqrt(values)
    want *= np.sign((made * want).sum(axis=0))
    assert np.abs(made - want).max() < 1e-8
    assert {r["n"] for r in got} == {n} and [r["component"] for r in got[:k]] == list(range(1, k + 1))
    assert all(r["deviation"] == int(((n * x[i // k] - sums) ** 2).sum()) for i, r in enumerate(got))
    assert np.abs(np.array([r["explained"] for r in got[:k]]) / (values / trace) - 1).max() < 1e-9
    assert max(r["identity_error"] for r in got) < 1e-9


def test_lobpcg_settles_in_many_dimensions_and_with_close_values():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    for values in (np.linspace(10, 0.1, 300), np.concatenate([[5, 5, 5 - 1e-6], np.full(297, 1.0)]), np.concatenate([[3.0], np.zeros(299)]), 0.9 ** np.arange(300)):
        matrix = (q * values) @ q.T
        found, vectors, rounds = wh.lobpcg(lambda b, m=matrix: m @ b, 300, 16)
        assert rounds < 200
        assert np.abs(found - values[:16]).max() < 1e-11 * values[0]
        assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() < 2e-12 * values[0]
        assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12
    with pytest.raises(RuntimeError):
        wh.lobpcg(lambda b: matrix @ b, 300, 16, most_rounds=2)


def test_odd_tables(spark):
    assert wh.whiten(spark.createDataFrame([], SCHEMA), "vec_id").count() == 0
    assert wh.whiten(table(spark, [], [None, [math.nan]]), "vec_id").count() == 0
    assert wh.whiten(table(spark, [[1.0, 2.0]] * 5), "vec_id").count() == 0
    assert wh.whiten(table(spark, [[]]), "vec_id").count() == 0
    line = wh.whiten(table(spark, [[float(i), 2.0 * i, 7.0] for i in range(9)]), "vec_id").collect()
    assert {r["component"] for r in line} == {1} and len(line) == 9 and abs(line[0]["explained"] - 1) < 1e-12
    short = wh.whiten(table(spark, [[1.0], [1.0, 0.0], [2.0, 5.0], [0.5, 1.0]]), "vec_id").collect()
    assert {r["n"] for r in short} == {3} and len(short) == 8


def test_deviation_is_exact_or_null(spark):
    vectors = [[1e6, 0.0], [-1e6, 1.0], [3.0, 2.0]]
    got = {r["vec_id"]: r for r in wh.whiten(table(spark, vectors), "vec_id").where("component = 1").collect()}
    x, n, sums, *_ = plain(np.array(vectors))
    for i in range(3):
        assert got[i]["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True))
    big = wh.whiten(table(spark, [[1e30, 0.0], [0.0, 1.0], [3.0, 2.0]]), "vec_id").collect()
    assert big and all(r["deviation"] is None for r in big)
    assert wh._deviations(np.array([[10**9, 0]]), np.array([0, 0]), 7, [3, 1]) == [None if (v := (7 * 10**9 - 3) ** 2 + 1) >= 2**63 else v]
    assert Fraction(wh.CLIP, wh.SCALE).denominator == 1
