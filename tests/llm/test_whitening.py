from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislewise.llm import common, whitening
from tests.compare import SMALL, SMALLEST


def plain(rows, components=4):
    """{(vec_id, component): [...]} by exact fractions and one plain eigen-solve."""
    good = [(i, [math.floor(256.0 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    once = sorted({tuple(x) for _, x in good})
    n, dims = len(once), len(once[0])
    sums = [sum(x[i] for x in once) for i in range(dims)]
    centred = np.array([[n * x[i] - sums[i] for i in range(dims)] for x in once], object)
    cov = centred.T @ centred
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in cov])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    out = []
    for i, x in good:
        d = [n * a - s for a, s in zip(x, sums)]
        w = np.array([float(Fraction(int(c), n)) for c in d]) @ axes
        out += [(i, k + 1, n, sum(c * c for c in d), w[k] / math.sqrt(values[k]), values[k] / v.trace()) for k in range(min(components, dims))]
    return out


def same(found, expected):
    found, expected = sorted(found, key=lambda r: (r[0], r[1], r[3], abs(r[4]))), sorted(expected, key=lambda r: (r[0], r[1], r[3], abs(r[4])))
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    signs = {}
    for f, e in zip(found, expected):
        if abs(e[4]) > 1e-6:
            signs.setdefault(f[1], math.copysign(1, f[4] * e[4]))
        assert f[4] == pytest.approx(signs.get(f[1], 1) * e[4], abs=1e-9) and f[5] == pytest.approx(e[5], rel=1e-9)
        assert f[6] < 1e-9


@pytest.mark.parametrize("folder", [SMALLEST, SMALL])
def test_query_equals_exact_fractions(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in common.table(spark, folder, "embeddings").collect()]
    same([tuple(r) for r in whitening.query(spark, folder).collect()], plain(rows))


def test_nulls_copies_lengths_and_extra_columns(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(5, 0.2)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(50)] + [(7, rows[1][1]), (None, rows[2][1])]
    bad = [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 2.0]), (203, [1.0, float("inf"), 2.0]), (204, []), (205, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id int, embedding array<double>").withColumn("n", F.lit("x")).withColumn("Component", F.lit(1)).repartition(40)
    found = [tuple(r) for r in whitening.whiten(df).collect()]
    assert len(found) == 3 * len(rows)
    key = lambda i: -1 if i is None else i
    same([(key(r[0]), *r[1:]) for r in found], [(key(r[0]), *r[1:]) for r in plain(rows)])


def test_empty_table_and_vectors_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    alike = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in alike} == {(i, k, 1, 0, None, 0.0) for i in (1, 2) for k in (1, 2)}
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), float(2 * i)]) for i in range(9)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-12


def test_moments_keep_low_parts_across_many_tasks(spark):
    """Vectors far from zero with a small spread, dealt over many tasks: 90 bits are right, where plain sums lose all."""
    rng = random.Random(5)
    rows = [[(1 << 40) + rng.randrange(-3, 4), rng.randrange(-(10**6), 10**6), rng.randrange(5)] for _ in range(3000)]
    n = len(rows)
    sums = [sum(r[i] for r in rows) for i in range(3)]
    exact = [[sum(Fraction((n * r[i] - sums[i]) * (n * r[j] - sums[j]), n**3) for r in rows) for j in range(3)] for i in range(3)]
    df = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(70)
    centre = whitening.Whitening(n, sums, np.zeros(0), np.zeros((3, 0)), np.zeros(0)).mean()
    high, low = whitening.covariance(df, n, 3, lambda: lambda x: whitening.centred(x, *centre))
    largest = max(abs(exact[i][i]) for i in range(3))
    for i in range(3):
        for j in range(3):
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact[i][j]) < largest * Fraction(1, 2**90)
    plain_sum = np.array(rows, float)
    assert abs((plain_sum[:, 0] ** 2).mean() - plain_sum[:, 0].mean() ** 2 - float(exact[0][0])) > 1


def test_deviations_are_exact_beyond_64_bits():
    model = whitening.Whitening(10**9 + 7, [5 * 10**9, -(10**12) - 3], np.zeros(0), np.zeros((2, 0)), np.zeros(0))
    x = np.array([[7, -900], [5, -1000], [10**9, 10**10]], np.int64)
    exact = [sum(((10**9 + 7) * int(a) - s) ** 2 for a, s in zip(row, model.sums)) for row in x]
    assert model.deviations(x) == [e if e < 2**63 else None for e in exact]
    small = whitening.Whitening(1000, [-5, 77], np.zeros(0), np.zeros((2, 0)), np.zeros(0))
    rows = np.random.default_rng(1).integers(-(2**19), 2**19, (500, 2))
    assert small.deviations(rows) == [sum((1000 * int(a) - s) ** 2 for a, s in zip(row, small.sums)) for row in rows]


def test_eigenvectors_of_close_values():
    rng = np.random.default_rng(2)
    axes, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    values = np.array([9.0, 4.0 + 1e-7, 4.0, 1.0, 1e-3, 1e-9])
    exact = (axes.astype(np.longdouble) * values) @ axes.T.astype(np.longdouble)
    high = exact.astype(float)
    found, vectors = whitening.eigen((high, (exact - high).astype(float)))
    assert np.allclose(found, values, rtol=1e-12, atol=1e-15)
    assert np.abs(np.abs((vectors * axes).sum(axis=0)) - 1).max() < 1e-12


def test_plan_groups_once(spark):
    plan = whitening.query(spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the output reads the source again, without a shuffle
