"""Contour eigenpairs against LAPACK, whitening against numpy."""

import numpy as np
import pytest

from tracklake.llm import whitening
from tracklake.session import ship_package

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def _covariance(values, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.asarray(values, dtype=float)) @ q.T


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 64), [1.0] * 40, [5] + [1] * 20 + [0] * 11, np.geomspace(1e-9, 1e3, 50), [3.0], [2, 1], [7] * 17 + [6] * 17,
    np.concatenate([np.full(3, 9.0), np.full(20, 9.0 - 1e-7), np.linspace(0, 1, 30)]), [0.0] * 5])
def test_pairs_equal_lapack(values):
    v = _covariance(values)
    e, u = whitening.largest_pairs(v, 16)
    best = np.sort(np.asarray(values, dtype=float))[::-1][:16]
    best = best[best > 1e-12 * max(sum(best), 1e-300)] if best[0] else best[:0]
    assert len(e) == len(best) and np.allclose(e, best, rtol=1e-10, atol=1e-12 * max(values))
    assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-12)
    assert np.abs(v @ u - u * e).max(initial=0) <= 1e-11 * max(max(values), 1e-300)


def test_inertia_counts():
    values = np.array([0, 1, 1, 2, 5, 5, 5, 9.0])
    counts = whitening.Inertia(_covariance(values))
    for shift in (-1, 0.5, 1.5, 3, 6, 10):
        assert counts.above(shift) == (values > shift).sum()
    assert counts.separator(2) is None and 5 < counts.separator(1) < 9 and 2 < counts.separator(4) < 5


def _expected(vectors):
    x = np.array([np.floor(64 * np.asarray(v, dtype=float)) + 1_000_000 for v in vectors])
    fit = np.unique(x, axis=0)
    n = len(fit)
    z = fit - fit.sum(axis=0) / n
    cov = z.T @ z / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    off = [[n * int(a) - int(s) for a, s in zip(row, fit.sum(axis=0))] for row in x]
    return n, e / np.trace(cov), (x - fit.sum(axis=0) / n) @ u / np.sqrt(e), [sum(a * a for a in row) for row in off]


def _check(df, vectors):
    n, share, white, deviation = _expected(list(vectors.values()))
    rows = df.collect()
    assert len(rows) == len(vectors) * len(share)
    got = {(r.vec_id, r.component): r for r in rows}
    for k in range(len(share)):
        mine = np.array([got[i, k + 1].whitened for i in vectors])
        assert min(np.abs(mine - white[:, k]).max(), np.abs(mine + white[:, k]).max()) < 1e-6
        for i, d in zip(vectors, deviation):
            r = got[i, k + 1]
            assert (r.n, r.deviation) == (n, d) and abs(r.explained - share[k]) < 1e-9 and r.identity_error < 1e-9


def test_query_equals_numpy(spark):
    from tracklake.llm import queries
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    good = {r.vec_id: r.embedding for r in rows if r.embedding is not None and all(
        c is not None and np.isfinite(c) for c in r.embedding)}
    _check(queries.QUERIES["op11_feast_whitening"](spark, SMALL), good)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = {i: [float(np.float32(c)) for c in rng.standard_normal(6) * [9, 5, 3, 2, 1, .5]] for i in range(60)}
    good |= {100 + i: good[0] for i in range(40)}           # copies
    bad = {900: None, 901: [1.0] * 5 + [None], 902: [float("nan")] * 6, 903: [float("inf")] + [0.0] * 5}
    rows = [(i, v, 1, "x", 0.0) for i, v in {**good, **bad}.items()]
    schema = "vec_id long, embedding array<float>, n long, x string, white double"
    _check(whitening.whiten(spark.createDataFrame(rows, schema)), good)


def test_tables_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, []), (2, None)]):
        out = whitening.whiten(spark.createDataFrame(rows, schema))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_short_and_huge_vectors(spark):
    rows = [(1, [1.0]), (2, [2.0, 5.0]), (None, [0.5, 1e30]), (4, [-1.0, 2.0]), (5, [])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.vec_id for r in out} == {1, 2, None, 4, 5} and all(np.isfinite(r.whitened) for r in out)
    assert all(r.deviation is None for r in out if r.vec_id is None)
