"""Numeric kernels against independent brute-force answers (no Spark)."""

import numpy as np
import pytest

from monthlens.functions.stats import (
    betainc, f_upper_p, lasso_path_cd, lasso_path_homotopy, ols, r2_score, ridge_loo_dual, t_two_sided_p,
)
from monthlens.functions.text import log_grid


def tiny_design(seed=0, n=40, p=60):
    """n=40, p=60 (> n): known sparse coefficients, one constant column, two identical columns."""
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p))
    X[:, 10] = 3.0                 # constant
    X[:, 21] = X[:, 20]            # identical pair
    beta = np.zeros(p)
    beta[[1, 3, 7, 20]] = [2.0, -1.5, 1.0, 0.8]
    y = X @ beta + rng.normal(size=n) * 0.5
    return X, y


def standardise(X):
    sd = X.std(axis=0)
    Z = np.zeros_like(X)
    ok = sd > 0
    Z[:, ok] = (X[:, ok] - X[:, ok].mean(axis=0)) / sd[ok]
    return Z


def test_distribution_tails():
    # two-sided t(10) at 2.0 and F(1,10) at 4.0 are the same probability
    assert t_two_sided_p(2.0, 10) == pytest.approx(0.0733880347707, rel=1e-9)
    assert f_upper_p(4.0, 1, 10) == pytest.approx(0.0733880347707, rel=1e-9)
    assert t_two_sided_p(1.0, 3) == pytest.approx(0.3910022189557, rel=1e-9)
    assert betainc(2.0, 3.0, 0.0) == 0.0 and betainc(2.0, 3.0, 1.0) == 1.0
    # I_x(1, b) = 1 - (1-x)^b
    assert betainc(1.0, 4.0, 0.3) == pytest.approx(1 - 0.7 ** 4, rel=1e-12)


def test_homotopy_matches_coordinate_descent_and_kkt():
    X, y = tiny_design()
    Z = standardise(X[:, [j for j in range(X.shape[1]) if j != 21]])  # twins collapsed
    grid = np.array(log_grid(-6, 1, 200))
    C, R = lasso_path_homotopy(Z, y, grid)
    C2, _ = lasso_path_cd(Z, y, grid, max_nnz=15)
    m = len(C2)
    assert np.abs(C[:m] - C2).max() < 1e-7
    assert (np.count_nonzero(C[:m], axis=1) == np.count_nonzero(C2, axis=1)).all()
    n = len(y)
    for i in range(0, len(grid), 7):
        b, a = C[i], grid[i]
        c = Z.T @ (y - y.mean() - Z @ b) / n
        nz = b != 0
        assert np.all(np.abs(c[~nz]) <= a * (1 + 1e-8) + 1e-12)
        if nz.any():
            assert np.allclose(c[nz], a * np.sign(b[nz]), rtol=1e-7, atol=1e-10)


def test_homotopy_stop_rule_prefix():
    X, y = tiny_design(1)
    Z = standardise(X)
    grid = np.array(log_grid(-6, 1, 200))
    full, _ = lasso_path_homotopy(Z, y, grid)
    part, _ = lasso_path_homotopy(Z, y, grid, max_nnz=8)
    assert np.count_nonzero(part[-1]) > 8
    assert np.allclose(part, full[:len(part)], atol=1e-10)


def test_ols_rank_deficient_uses_pseudo_inverse():
    X, y = tiny_design()
    cols = [1, 3, 20, 21]          # 20 and 21 identical
    res = ols(X[:, cols], y)
    A = np.column_stack([np.ones(len(y)), X[:, cols]])
    beta = np.linalg.pinv(A) @ y
    assert np.allclose(res["beta"], beta)
    assert res["rank"] == 4 and res["df_resid"] == len(y) - 4
    assert res["beta"][3] == pytest.approx(res["beta"][4])        # split evenly by min-norm
    resid = y - A @ beta
    r2 = 1 - resid @ resid / ((y - y.mean()) @ (y - y.mean()))
    assert res["r2"] == pytest.approx(r2)


def test_ols_empty_selection_r2_zero():
    y = np.arange(10.0)
    res = ols(np.zeros((10, 0)), y)
    assert res["r2"] == pytest.approx(0.0)


def test_ridge_closed_form_loo_equals_refits():
    rng = np.random.default_rng(3)
    n, p = 25, 40
    X = rng.normal(size=(n, p))
    y = X[:, 0] - X[:, 5] + rng.normal(size=n)
    Z = standardise(X)
    alphas = np.logspace(-2, 4, 12)
    best, mse, _ = ridge_loo_dual(Z @ Z.T, y, alphas)
    brute = []
    for a in alphas:
        errs = []
        for i in range(n):
            m = np.ones(n, bool)
            m[i] = False
            Xt, yt = Z[m], y[m]
            mu, ym = Xt.mean(0), yt.mean()
            Xc = Xt - mu
            b = np.linalg.solve(Xc.T @ Xc + a * np.eye(p), Xc.T @ (yt - ym))
            errs.append(y[i] - (ym + (Z[i] - mu) @ b))
        brute.append(np.mean(np.square(errs)))
    assert np.allclose(mse, brute, rtol=1e-8)
    assert best == alphas[int(np.argmin(brute))]


def test_r2_score():
    y = np.array([1.0, 2.0, 3.0])
    assert r2_score(y, y) == 1.0
    assert r2_score(y, np.full(3, 2.0)) == pytest.approx(0.0)
