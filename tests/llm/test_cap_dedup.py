import math

import numpy as np
import pytest
from corvina.llm import cap_dedup


def run(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    return cap_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    x = np.vstack([base, *(base[rng.integers(0, 60, 60)] + 0.12 * rng.standard_normal((60, 16)) for _ in range(3))]).astype(np.float32)
    x = np.vstack([x, x[:5]])
    got = sorted(run(spark, [(i, v.tolist(), i % 3) for i, v in enumerate(x)]), key=lambda r: r.vec_id)
    d = x.astype(float)
    unit = d / np.sqrt((d * d).sum(1, keepdims=True))
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    found, there = sum(r.n_links for r in got), int(near.sum())
    assert found <= there and found >= 0.99 * there
    assert all(r.n_links <= n for r, n in zip(got, near.sum(1), strict=True))
    reach = near | np.eye(len(x), dtype=bool)
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    agree = [r.component_id == int(np.flatnonzero(reach[r.vec_id])[0]) for r in got]
    assert np.mean(agree) > 0.98 and all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize(("dim", "power"), [(2, 17), (3, 10), (4, 17), (5, 10), (6, 17), (8, 17), (12, 17), (16, 17), (64, 14), (64, 17)])
def test_recall_at_the_threshold(dim, power):
    code = cap_dedup.code_for(dim, power, 0.95, 0.999)
    rng = np.random.default_rng(99)
    a = rng.standard_normal((800, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((800, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(code.decode(a), code.decode(b), strict=True)]
    assert np.mean(met) >= 0.99
    # codebooks stay small whatever the number of vectors
    assert sum(book.nbytes for books in code.rounds for book in books) < 64 << 20


@pytest.mark.parametrize(("dim", "share", "parts"), [(4, 0.01, 1), (16, 0.002, 2), (16, 0.002, 4)])
def test_list_decoding_against_all_directions(monkeypatch, dim, share, parts):
    monkeypatch.setattr(cap_dedup, "MOST_WORDS", 8 if parts == 4 else 4096)
    code = cap_dedup.Code(dim, share)
    code.grow()
    code.grow()
    assert code.parts == parts
    unit = np.random.default_rng(7).standard_normal((60, dim))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found = code.decode(unit)
    total = 0
    for row, got in zip(unit.astype(np.float32), found, strict=True):
        want = set()
        for t, books in enumerate(code.rounds):
            number, score = np.array([t]), np.zeros(1, np.float32)
            for book in books:
                number = (number[:, None] * code.words + np.arange(code.words)).ravel()
                score = (score[:, None] + (row[None, :] @ book)).ravel()
            want |= set(number[score >= code.bound].tolist())
        assert len(set(got.tolist()) ^ want) <= 1 and len(got) == len(set(got.tolist()))  # rounding at the bound
        total += len(want)
    assert total > 60
    # codebooks of four parts stay small however many vectors there are
    assert cap_dedup.Code(64, cap_dedup.PER_FILTER / 2**40).words < 4096


@pytest.mark.parametrize("dim", [2, 5])
def test_few_dimensions_against_all_pairs(spark, dim):
    x = np.random.default_rng(dim).standard_normal((800, dim)).astype(np.float32)
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = run(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    found = sum(r.n_links for r in got)
    assert 0.995 * near.sum() <= found <= near.sum()
    assert all(r.n_links <= near[r.vec_id].sum() for r in got)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0] * 4, 0), (4, [nan, 1.0, 1.0, 1.0], 0), (5, [inf, 0.0, 0.0, 0.0], 0), (6, [None, 1.0, 1.0, 1.0], 0), (7, [1.0, 2.0, 3.0, 4.0], 0), (8, [2.0, 4.0, 6.0, 8.0], 1), (8, [1.0, 2.0, 3.0, 4.0], 1), (None, [1.0, 2.0, 3.0, 4.0], None), (9, [1.0, 2.0, 3.0], 0), (10, [5.0], 0), (11, [7.0], 0)]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in run(spark, rows)), key=lambda x: (x[0], x[1]))
    assert got == [(0, 3, 7, False), *[(i, 0, i, True) for i in range(1, 7)], (7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False)]
    assert run(spark, []) == []
    assert len(run(spark, [(1, [1.0] * 8, 3)], "vec_id long, embedding array<double>, node int")) == 1
