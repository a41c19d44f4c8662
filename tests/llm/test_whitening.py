"""Whitening against a plain eigensolver, and its parts."""

import numpy as np
import pytest

from tidemark.llm import catalog
from tidemark.llm import whitening as wh


def whitened(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<double>, n int, component double")
    return wh.whiten(table, **options).collect()


def plain(vectors, components=8, scale=1024):
    x = np.floor(scale * np.array(vectors)) + 100_000
    centred = x - x.mean(axis=0)
    v = centred.T @ centred / len(x)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return x.astype(int), centred @ u / np.sqrt(e), e / np.trace(v)


def test_equal_to_a_plain_eigensolver(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 1, (400, 12)) @ rng.normal(0, 0.2, (12, 12))
    rows = whitened(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])
    x, w, share = plain(vectors)
    assert len(rows) == 400 * 8
    sign = {r.component: np.sign(r.whitened * w[r.vec_id, r.component - 1]) for r in rows if r.vec_id == 0}
    sums = x.sum(axis=0)
    for r in rows:
        assert r.n == 400
        assert r.deviation == sum((400 * int(a) - int(s)) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
        assert r.whitened == pytest.approx(sign[r.component] * w[r.vec_id, r.component - 1], abs=1e-9)
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9


def test_given_table(spark):
    rows = catalog.op13_embedding_whitening(spark, "/root/testdata/sf0.001").collect()
    given = {r.vec_id: r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    ids = sorted(given)
    _, w, _ = plain([given[i] for i in ids])
    found = np.zeros_like(w)
    for r in rows:
        found[ids.index(r.vec_id), r.component - 1] = r.whitened
    assert np.abs(found * np.sign((found * w).sum(axis=0)) - w).max() < 1e-8
    assert rows[0].identity_error < 1e-9


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(0, 1, 5).tolist()) for i in range(40)] + [(None, rng.normal(0, 1, 5).tolist())]
    good += good[:3] + [(100 + i, good[0][1]) for i in range(20)]
    odd = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (205, [1.0, 2.0]), (206, [1e12] * 5)]
    rows = whitened(spark, good + odd)
    assert len(rows) == len(good) * 5
    assert {r.n for r in rows} == {len(good)}
    assert not {r.vec_id for r in rows} & set(range(200, 207))
    assert max(r.identity_error for r in rows) < 1e-9


def test_tables_without_spread(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, [0.5, 0.25])]) == []
    assert whitened(spark, [(i, [0.5, 0.25]) for i in range(9)]) == []
    rows = whitened(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])  # one direction
    assert {r.component for r in rows} == {1}
    assert rows[0].explained == pytest.approx(1)


def test_large_entries_stay_exact(spark):
    rows = whitened(spark, [(i, [float(i % 7) * 1e8, float(i * i % 11) * 1e8]) for i in range(30)], components=2)
    assert max(r.identity_error for r in rows) < 1e-9
    assert all(r.deviation is None for r in rows)


def test_counts_and_slices():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 30):
        m = rng.normal(0, 1, (size, size))
        m = m @ m.T
        tri = wh.tridiagonal(m)
        e = np.linalg.eigvalsh(m)
        for shift in [*(e + 1e-6), *(e - 1e-6), 0.0]:
            assert wh.above(tri, shift) == (e > shift).sum()
        found = wh.slices(tri, min(size, 8), float(np.trace(m)))
        assert sum(c for _, _, c in found) >= min(size, 8)
        for low, high, count in found:
            assert ((e > low) & (e <= high)).sum() == count


def test_feast_on_equal_and_close_eigenvalues():
    rng = np.random.default_rng(4)
    base = np.linalg.qr(rng.normal(0, 1, (20, 20)))[0]
    e = np.array([9.0] * 6 + [5.0, 5.0 - 1e-12, 4.0, 4.0 - 1e-5] + [1.0] * 10)
    m = (base * e) @ base.T
    m = (m + m.T) / 2
    found = [(wh.feast(m, *s), s) for s in wh.slices(wh.tridiagonal(m), 8, float(np.trace(m)))]
    values = np.concatenate([v for (v, _), _ in found])
    vectors = np.hstack([u for (_, u), _ in found])
    assert np.abs(values - e[: len(values)]).max() < 1e-10
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9
    assert np.abs(m @ vectors - vectors * values).max() < 1e-10


def test_a_wrong_count_is_an_error():
    m = np.diag([5.0, 4.0, 3.0, 2.0, 1.0])
    with pytest.raises(ArithmeticError):
        wh.feast(m, 2.5, 6.0, 2)
