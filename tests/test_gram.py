"""Blocked Gram matrices against dense products."""

import datetime as dt

import numpy as np
import pytest

from monthlens.operators import gram as G
from monthlens.operators import ridge as R
from monthlens.operators.vectorize import Features


def frame(spark, X):
    per = [dt.date(2000 + k // 12, k % 12 + 1, 1) for k in range(len(X))]
    cells = [(per[i], f"w{j:04d}", float(X[i, j])) for i, j in zip(*np.nonzero(X))]
    return Features("t", spark.createDataFrame(cells, "period date, feature string, value double").repartition(5), spark.createDataFrame([(d,) for d in per], "period date")), per


@pytest.fixture(scope="module")
def counts():
    X = np.random.default_rng(3).poisson(0.4, (26, 300)).astype(float)
    X[:, 5], X[:13, 6], X[:, 7] = 4.0, 2.0, 2 * X[:, 8]
    return X


def test_gram_of_all_and_of_some_rows(spark, counts):
    f, _ = frame(spark, counts)
    blocks = G.packed(f.values, f.periods, size=64)
    assert blocks.count() >= 5
    ok = counts.std(0) > 0
    Z = (counts[:, ok] - counts[:, ok].mean(0)) / counts[:, ok].std(0)
    assert np.allclose(G.gram(blocks, 26), Z @ Z.T)
    some = np.arange(26) < 20
    ok = counts[some].std(0) > 0
    Z = (counts[:, ok] - counts[some][:, ok].mean(0)) / counts[some][:, ok].std(0)
    assert np.allclose(G.gram(blocks, 26, some), Z @ Z.T)


@pytest.mark.parametrize("held", [8_000_000, 700])
def test_gram_of_every_origin(spark, counts, monkeypatch, held):
    monkeypatch.setattr(G, "HELD", held)                        # 700: one origin at a time
    f, _ = frame(spark, counts)
    got = {r.key: np.array(r.total).reshape(r.key + 1, -1) for r in G.expanding_grams(G.packed(f.values, f.periods, size=64), 26, 20).collect()}
    assert sorted(got) == list(range(20, 26))
    for t, K in got.items():
        sd = counts[:t].std(0)
        X = counts[:t + 1] / np.where(sd > 0, sd, 1)
        J = np.eye(t) - 1 / t                                   # equal once centred over the rows before t
        want = X[:t] @ X[:t].T
        assert np.allclose(J @ K[:t, :t] @ J, J @ want @ J)
        last = X[t] @ X[:t].T
        assert np.allclose((K[t, :t] - K[:t, :t].mean(0)) @ J, (last - want.mean(0)) @ J)


def test_expanding_forecast_of_counts(spark, counts):
    f, per = frame(spark, counts)
    y = np.random.default_rng(4).normal(size=26)
    grid = np.logspace(0, 6, 15).tolist()
    got = R.expanding_ridge(f, spark.createDataFrame([(p, float(v)) for p, v in zip(per, y)], "period date, y double"), grid).orderBy("t").collect()
    assert [r.t for r in got] == list(range(13, 26))
    for r in got:
        t = r.t
        sd = counts[:t].std(0)
        X = counts[:t + 1] / np.where(sd > 0, sd, 1)
        mu = X[:t].mean(0)
        Xc = X[:t] - mu
        dual = np.linalg.solve(Xc @ Xc.T + r.alpha * np.eye(t), y[:t] - y[:t].mean())
        assert r.pred == pytest.approx(y[:t].mean() + (X[t] - mu) @ Xc.T @ dual, rel=1e-8, abs=1e-10)


def test_no_rows(spark, counts):
    f, per = frame(spark, counts)
    none = Features("t", f.values.limit(0), f.periods.limit(0))
    assert R.centred_gram(none).count() == 0
    y = spark.createDataFrame([(per[0], 1.0)], "period date, y double")
    assert R.expanding_ridge(f, y, [1.0]).count() == 0 and R.expanding_ridge(none, y, [1.0]).count() == 0
    t = spark.createDataFrame([("a", per[0], 1.0)], "target string, period date, y double")
    assert R.ridge_recovery(none, t, [1.0]).count() == 0
