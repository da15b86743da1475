"""Operator 13: eigenpairs against numpy's, exact deviations, identity covariance, odd rows."""

import math

import numpy as np
import pytest

from procmon.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def brute(vectors, most=32):
    """n, exact deviations, eigenvalues, trace, and the projections up to their signs."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    d = n * x - s
    centred = d.astype(float) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    return n, (d * d).sum(1).tolist(), e[::-1][:most], np.trace(v), centred @ u[:, ::-1][:, :most] / np.sqrt(np.abs(e[::-1][:most]))


def test_op13_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, deviation, e, trace, w = brute([r.embedding for r in rows])
    got = queries.QUERIES["op13_whitening"](spark, SF).collect()
    assert len(got) == 32 * len(rows) and {r.n for r in got} == {n}
    at = {r.vec_id: i for i, r in enumerate(rows)}
    own = np.zeros((len(rows), 32))
    for r in got:
        own[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[at[r.vec_id]] and abs(r.explained - e[r.component - 1] / trace) < 1e-10
    assert np.abs(own.T @ own / n - np.eye(32)).max() < 1e-9 and {r.identity_error for r in got}.pop() < 1e-9
    sign = np.sign((own * w).sum(0))
    assert np.abs(own * sign - w).max() < 1e-6


def matrices():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 64, 150):
        a = rng.standard_normal((400, n))
        yield a.T @ a
    yield np.diag(np.repeat([5.0, 3.0, 1.0], 20))  # repeated eigenvalues
    yield np.eye(40)
    a = rng.standard_normal((10, 64))
    yield a.T @ a  # rank 10
    a = rng.standard_normal((900, 64)) * np.logspace(0, -6, 64)
    yield a.T @ a
    q, _ = np.linalg.qr(rng.standard_normal((64, 64)))
    yield q @ np.diag(np.r_[np.full(50, 2.0) + 1e-12 * rng.random(50), np.full(14, 1.0)]) @ q.T  # a cluster


@pytest.mark.parametrize("v", list(matrices()), ids=range(11))
def test_components_equal_numpy(v):
    e, x = whitening.components(v, 32)
    all_ = np.linalg.eigvalsh(v)[::-1]
    real = int((all_ > 1e-12 * all_[0]).sum())
    assert len(e) == min(32, real)
    assert np.abs(e - all_[: len(e)]).max() < 1e-12 * all_[0]
    assert np.abs(v @ x - x * e).max() < 1e-11 * all_[0] and np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12


def test_inertia_counts():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((30, 30))
    v = a + a.T
    tri, all_ = whitening.tridiagonal(v), np.linalg.eigvalsh(v)
    for s in rng.uniform(all_[0] - 1, all_[-1] + 1, 50):
        assert whitening.below(tri, s) == (all_ < s).sum()


def test_op13_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.standard_normal(5).astype(np.float32).tolist()) for i in range(40)]
    good += [(None, [0.0] * 5), (3, [-0.0, 1.0, 2.0, 3.0, 4.0]), (3, good[3][1])]
    bad = [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0, 1.0]), (53, [math.nan] * 5), (54, [math.inf, 0.0, 0.0, 0.0, 0.0]), (55, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in good + bad], "vec_id long, embedding array<float>, n int, whitened double, id int").repartition(4)
    got = whitening.whiten(df).collect()
    n, deviation, e, trace, _ = brute([v for _, v in good])
    assert len(got) == 5 * len(good) and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 6))
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), s) for (i, _), s in zip(good, deviation, strict=True))
    assert max(r.identity_error for r in got) < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id > 49")).count() == 0
    assert whitening.whiten(df.where("vec_id = 3 and embedding[1] = 1.0")).count() == 0  # a single vector has no variance


def test_deviations_are_exact_beyond_doubles(spark):
    big = [(1, [1e9, 0.1]), (2, [-1e9, 0.2]), (3, [3.0, 2.0**53])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    _, deviation, *_ = brute([v for _, v in big])
    assert got == {i: (d if d < 1 << 63 else None) for (i, _), d in zip(big, deviation, strict=True)}
