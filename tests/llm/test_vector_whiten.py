import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvina.llm import vector_whiten as vw
from corvina.llm.queries import QUERIES

SHIFT = 1_000_000


def _expected(vectors):
    """Exact figures and numpy's decomposition of the exactly centred rows."""
    x = {i: [math.floor(64 * c) + SHIFT for c in map(float, v)] for i, v in vectors}
    fit = sorted({tuple(v) for v in x.values()})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    centred = {i: [n * v[j] - sums[j] for j in range(d)] for i, v in x.items()}
    rows = [[Fraction(n * v[j] - sums[j], n) for j in range(d)] for v in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in rows) / n) for j in range(d)] for i in range(d)])
    return n, {i: sum(c * c for c in v) for i, v in centred.items()}, {i: np.array([c / n for c in v]) for i, v in centred.items()}, cov


def _check(rows, vectors, tolerance=1e-9):
    n, deviation, centred, cov = _expected(vectors)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    ids = [i for i, _ in vectors]
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, k) for i in sorted(ids) for k in range(1, len(values) + 1)]
    for r in rows:
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-6)
        assert 0 <= r.identity_error < 1e-6
    for k in range(len(values)):
        got = {r.vec_id: r.whitened for r in rows if r.component == k + 1}
        want = np.array([centred[i] @ axes[:, k] for i in ids]) / np.sqrt(values[k])
        mine = np.array([got[i] for i in ids])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < tolerance * max(1, np.abs(want).max())


def _frame(spark, vectors, kind="double"):
    return spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>").withColumns({"x": F.lit(1), "d": F.lit("e"), "n": F.lit(0)})


@pytest.mark.parametrize("offset", [0.0, 1e6, -3e9])
def test_against_exact_figures(spark, offset):
    r = np.random.default_rng(1)
    spread = np.array([9.0, 7, 5, 3, 2, 1.5, 1])
    vectors = [(i, (r.normal(size=7) * spread + offset).tolist()) for i in range(300)]
    vectors += [(300 + i, v) for i, (_, v) in enumerate(vectors[:50] * 2)]  # repeated vectors count once
    _check(vw.whiten(_frame(spark, vectors).repartition(5)).collect(), vectors)


def test_given_vectors(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    _check(QUERIES["op13_whitening"](spark, sf).collect(), vectors, 1e-6)


def test_whitened_rows_have_the_identity_as_covariance(spark):
    rows = QUERIES["op13_whitening"](spark, "/root/testdata/sf0.01").collect()
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    first = {}
    for r in vectors:
        first.setdefault(tuple(math.floor(64 * c) for c in r.embedding), r.vec_id)
    place = {v: i for i, v in enumerate(first.values())}
    z = np.zeros((len(place), 16))
    for r in rows:
        if r.vec_id in place:
            z[place[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(z.mean(0)).max() < 1e-9
    assert np.abs(z.T @ z / len(z) - np.eye(16)).max() < 1e-9


def test_unusable_vectors_and_dimensions_of_their_own(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None, 2.0]), (3, [1.0, nan, 2.0]), (4, [inf, 0.0, 0.0]), (5, [])]
    three = [(10 + i, [float(i), float(i * i % 7), float(-i % 3)]) for i in range(9)]
    two = [(30 + i, [float(i % 4), float(i)]) for i in range(6)]
    rows = vw.whiten(_frame(spark, [*bad, *three, *two], "float")).collect()
    _check([r for r in rows if r.vec_id < 30], three)
    _check([r for r in rows if r.vec_id >= 30], two)
    assert vw.whiten(_frame(spark, bad)).count() == 0
    assert vw.whiten(_frame(spark, bad).limit(0)).count() == 0


def test_no_spread(spark):
    one = vw.whiten(_frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    line = vw.whiten(_frame(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(5)])).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True}
    assert {round(r.explained, 9) for r in line} == {1.0, 0.0}


def test_huge_entries_are_exact(spark):
    vectors = [(i, [3e15 * (i % 5), -1e16 + i, 7.0 * i * i]) for i in range(8)]
    n, deviation, _, _ = _expected(vectors)
    rows = vw.whiten(_frame(spark, vectors)).collect()
    assert {r.vec_id: r.deviation for r in rows} == {i: v if v < 2**63 else None for i, v in deviation.items()}
    assert vw.whiten(_frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0])])).count() == 4


def test_scatter_is_exact():
    r = np.random.default_rng(2)
    for bits in (5, 25, 50, 62):
        x = r.integers(-(1 << bits), 1 << bits, (1100, 3))
        s = vw.Scatter(3)
        s.add(x[:600])
        s.add(x[600:])
        wide = x.astype(object)
        assert (s.products == wide.T @ wide).all() and (s.sums == wide.sum(0)).all() and s.n == 1100
        m = vw.Model(1100, s.sums, np.eye(3), np.ones(3), np.ones(3))
        assert (m.centred(x) == 1100 * wide - s.sums).all()
