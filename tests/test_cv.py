"""Train/test comparisons (K-fold Ridge, RBF kernel ridge, OLS, K-fold Lasso)
against direct primal numpy computations."""

import numpy as np
import pytest

from monthlens.functions.stats import lasso_path_homotopy, r2_score
from monthlens.operators import cv as CV
from tests.test_models_spark import fixture, months, to_spark


def _primal_ridge(Xtr, ytr, Xte, a):
    mu, ym = Xtr.mean(0), ytr.mean()
    Xc = Xtr - mu
    if a == 0:
        b = np.linalg.pinv(Xc) @ (ytr - ym)
    else:
        b = np.linalg.solve(Xc.T @ Xc + a * np.eye(Xtr.shape[1]), Xc.T @ (ytr - ym))
    return ym + (Xte - mu) @ b


def _kfold_best(Xtr, ytr, alphas, k=5):
    folds = CV.contiguous_fold_ids(len(ytr), k)
    best, bs = None, -np.inf
    for a in alphas:
        s = np.mean([r2_score(ytr[folds == f], _primal_ridge(Xtr[folds != f], ytr[folds != f], Xtr[folds == f], a))
                     for f in range(k)])
        if s > bs:
            best, bs = a, s
    return best


def test_compare_models_matches_primal(spark):
    X, y, _ = fixture(5, n=40, p=12)
    f, _ = to_spark(spark, X, {})
    per = months(40)
    ys = spark.createDataFrame([(per[i], float(y[i])) for i in range(40)], "period date, y double")
    alphas = np.logspace(-3, 3, 20).tolist()
    got = {r.model: r for r in CV.compare_models(f, ys, ["ridge", "ols", "rbf_ridge"], alphas).collect()}
    ntr = 32
    sd = X[:ntr].std(0)
    Xs = X / sd
    Z = (X - X[:ntr].mean(0)) / sd
    a = _kfold_best(Xs[:ntr], y[:ntr], alphas)
    p = _primal_ridge(Xs[:ntr], y[:ntr], Xs[ntr:], a)
    assert got["ridge"].alpha == pytest.approx(a)
    assert got["ridge"].oos_r2 == pytest.approx(r2_score(y[ntr:], p), rel=1e-8)
    p = _primal_ridge(Xs[:ntr], y[:ntr], Xs[ntr:], 0.0)
    assert got["ols"].oos_r2 == pytest.approx(r2_score(y[ntr:], p), rel=1e-8)
    # exact RBF kernel ridge with gamma = 1 / (p * var(Z_train))
    gamma = 1.0 / (Z.shape[1] * Z[:ntr].var())
    d2 = ((Z[:, None, :] - Z[None, :, :]) ** 2).sum(-1)
    G = np.exp(-gamma * d2)
    ak, _ = CV.kfold_alpha(G[:ntr, :ntr], y[:ntr], np.array(alphas))
    pk = CV.dual_predict(G[:ntr, :ntr], y[:ntr], G[ntr:, :ntr], ak)
    assert got["rbf_ridge"].alpha == pytest.approx(ak)
    assert got["rbf_ridge"].oos_r2 == pytest.approx(r2_score(y[ntr:], pk), rel=1e-6)


def test_lasso_kfold_matches_numpy(spark):
    X, y, _ = fixture(6, n=40, p=15)
    f, _ = to_spark(spark, X, {})
    per = months(40)
    ys = spark.createDataFrame([(per[i], float(y[i])) for i in range(40)], "period date, y double")
    scores, words = CV.lasso_kfold(f, ys, k=5, n_alphas=30)
    got = scores.first()
    ntr = 32
    Xs = X / X[:ntr].std(0)
    Xtr, ytr = Xs[:ntr], y[:ntr]
    amax = np.max(np.abs((Xtr - Xtr.mean(0)).T @ (ytr - ytr.mean()))) / ntr
    grid = np.logspace(np.log10(amax * 1e-3), np.log10(amax), 30)[::-1]
    folds = CV.contiguous_fold_ids(ntr, 5)
    mse = np.zeros(len(grid))
    for fo in range(5):
        tr, te = folds != fo, folds == fo
        mu = Xtr[tr].mean(0)
        C, _ = lasso_path_homotopy(Xtr[tr] - mu, ytr[tr], grid)
        for i in range(len(grid)):
            pred = ytr[tr].mean() + (Xtr[te] - mu) @ C[i]
            mse[i] += np.mean((ytr[te] - pred) ** 2) / 5
    best = int(np.argmin(mse))
    mu = Xtr.mean(0)
    C, _ = lasso_path_homotopy(Xtr - mu, ytr, grid)
    pred = ytr.mean() + (Xs[ntr:] - mu) @ C[best]
    assert got.alpha == pytest.approx(grid[best], rel=1e-9)
    assert got.oos_r2 == pytest.approx(r2_score(y[ntr:], pred), rel=1e-6)
    assert got.n_features == np.count_nonzero(C[best])
    picked = words.orderBy("rank").collect()
    want = sorted(((abs(c), f"f{j:02d}", c) for j, c in enumerate(C[best]) if c), reverse=True)
    assert [r.feature for r in picked] == [w[1] for w in want] and [r.coef for r in picked] == pytest.approx([w[2] for w in want], rel=1e-6)
