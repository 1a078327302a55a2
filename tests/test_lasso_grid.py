"""The whole grid for far more features than months: every point optimal over all of them."""

import datetime as dt

import numpy as np
import pytest

from monthlens.functions.stats import lasso_path_cd
from monthlens.functions.text import log_grid
from monthlens.operators import columns as C
from monthlens.operators import design as D
from monthlens.operators import lasso as L
from monthlens.operators.vectorize import Features

N, P = 30, 900


def sparse_counts(seed=0):
    rng = np.random.default_rng(seed)
    X = rng.poisson(0.25, (N, P)).astype(float)
    X[:, 50:60] = 3 * X[:, 40:50]                # multiples
    X[:, 60] = 2.0                               # constant
    X[:, 61:70] = X[:, 70:79]
    X[-1, 61:70] += 1                            # alike but for the last month
    y = X[:, 0] - X[:, 1] + rng.normal(size=N)
    return X, {"a": y, "b": rng.normal(size=N), "c": np.r_[rng.normal(size=N - 1), np.nan]}


def to_spark(spark, X, ys):
    per = [dt.date(2000 + k // 12, k % 12 + 1, 1) for k in range(len(X))]
    cells = [(per[i], f"w{j:04d}", float(X[i, j])) for i, j in zip(*np.nonzero(X))]
    f = Features("counts", spark.createDataFrame(cells, "period date, feature string, value double").repartition(5),
                 spark.createDataFrame([(d,) for d in per], "period date"))
    out = spark.createDataFrame([(per[i], o, float(v)) for o, y in ys.items() for i, v in enumerate(y) if not np.isnan(v)], "period date, outcome string, y double")
    return f, out


@pytest.fixture(scope="module")
def solved(spark):
    X, ys = sparse_counts()
    f, out = to_spark(spark, X, ys)
    grid = log_grid(-6, 1, 200)
    path = L.lasso_path(D.build_design(f, out), grid, m_init=20, enter=4)
    return X, ys, sorted(grid, reverse=True), path


def test_every_point_is_optimal_over_all_features(solved):
    X, ys, grid, path = solved
    coefs = {}
    for r in path.coefs.collect():
        coefs.setdefault((r.outcome, r.alpha_idx), {})[int(r.feature[1:])] = r.coef
    nnz = {(r.outcome, r.alpha_idx): r.nnz for r in path.nnz.collect()}
    assert len(nnz) == 3 * 200 and path.rounds > 2
    for o, y in ys.items():
        rows = ~np.isnan(y)
        A, v = X[rows], y[rows]
        ok = A.std(0) > 0
        Z = np.zeros_like(A)
        Z[:, ok] = (A[:, ok] - A[:, ok].mean(0)) / A[:, ok].std(0)
        for i, a in enumerate(grid):
            b = np.zeros(P)
            for j, c in coefs.get((o, i), {}).items():
                b[j] = c
            assert np.count_nonzero(b) == nnz[o, i]
            score = Z.T @ (v - v.mean() - Z @ b) / len(v)
            assert np.abs(score).max() <= a * (1 + 1e-5)                            # over all features
            assert np.allclose(score[b != 0], a * np.sign(b[b != 0]), rtol=1e-5)    # and tight where one is in
    assert max(nnz.values()) >= N - 2                                               # down to where the fit is exact


def test_against_coordinate_descent(solved):
    X, ys, grid, path = solved
    first = {f: [g for g in grid if g > 0.02] for f in "b"}
    Z = (X - X.mean(0)) / np.where(X.std(0) > 0, X.std(0), 1)
    twin = [j for j in range(P) if X[:, j].std() > 0 and not 50 <= j < 60]
    C0, _ = lasso_path_cd(Z[:, twin], ys["b"], np.array(first["b"]))
    got = {(r.alpha_idx, int(r.feature[1:])): r.coef for r in path.coefs.where("outcome = 'b'").collect()}
    for i in range(len(first["b"])):
        mine = np.array([got.get((i, j), 0.0) for j in twin])
        assert np.allclose(Z[:, twin] @ mine, Z[:, twin] @ C0[i], atol=1e-6)


def test_same_path_at_other_block_sizes_and_other_steps(spark, solved):
    X, ys, grid, path = solved
    f, out = to_spark(spark, X, ys)
    des = D.build_design(f, out)
    small = D.Design(des.features, des.y, des.op, des.pp, C.pack(des.features.values, des.pp, size=37))
    assert small.blocks.count() > des.blocks.count()
    other = L.lasso_path(small, grid, m_init=3, enter=2)
    key = lambda p: sorted((r.outcome, r.alpha_idx, r.feature, round(r.coef, 7)) for r in p.coefs.collect())
    assert key(other) == key(path)


def test_twins_are_judged_over_the_aligned_months(spark, solved):
    X, ys, _, path = solved
    des = path.design
    size = {p: n for p, n in des.op.select("outcome", "n").collect()}
    assert size == {"a": N, "b": N, "c": N - 1}
    seen = {}
    for r in des.blocks.join(des.op, "pattern").select("outcome", "features", "class_size").collect():
        seen.setdefault(r.outcome, {}).update(zip(r.features, r.class_size))
    assert "w0050" not in seen["a"] and seen["a"]["w0040"] == 2 and "w0060" not in seen["a"]
    assert "w0070" in seen["a"]                       # another column in the last month
    assert "w0070" not in seen["c"] and seen["c"]["w0061"] == 2
    assert {r.class_size for r in path.columns.where("feature = 'w0040'").collect()} <= {2}


def test_largest_scores(solved):
    X, ys, _, path = solved
    got = {r.outcome: (r.feature, r.score) for r in L.largest_scores(path.design).collect()}
    Z = (X - X.mean(0)) / np.where(X.std(0) > 0, X.std(0), 1)
    for o in "ab":
        score = np.abs(Z.T @ (ys[o] - ys[o].mean()) / N)
        assert got[o][1] == pytest.approx(score.max()) and abs(score[int(got[o][0][1:])] - score.max()) < 1e-12


def test_no_features_and_constant_outcomes(spark):
    X = np.ones((12, 3))
    f, out = to_spark(spark, X, {"a": np.arange(12.0), "k": np.ones(12)})
    path = L.lasso_path(D.build_design(f, out), log_grid(-3, 1, 10))
    assert path.coefs.count() == 0 and {r.nnz for r in path.nnz.collect()} == {0} and path.nnz.count() == 20
