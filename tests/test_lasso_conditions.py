import numpy as np
import pytest

from monthlens.functions.stats import lasso_conditions, lasso_path_cd, lasso_path_checked, lasso_path_homotopy, lasso_point
from monthlens.functions.text import log_grid


def tied(seed, n=60, p=40):
    """Counts with equal and opposite columns, so entries tie."""
    rng = np.random.default_rng(seed)
    X = rng.poisson(0.5, (n, p)).astype(float)
    X[:, 10:14] = X[:, 6:10]
    X[:, 14] = 3 - X[:, 0]
    X = X[:, X.std(0) > 0]
    Z = (X - X.mean(0)) / X.std(0)
    return Z, Z[:, :4] @ np.array([1, -1, 0.5, 0.25]) + rng.normal(size=n) * 0.5


@pytest.mark.parametrize("seed", range(4))
def test_every_grid_point_is_optimal(seed):
    Z, y = tied(seed)
    grid = np.array(sorted(log_grid(-6, 1, 200), reverse=True))
    coefs, resids = lasso_path_checked(Z, y, grid)
    assert len(coefs) == 200
    assert max(lasso_conditions(Z, r, b, a) for r, b, a in zip(resids, coefs, grid)) < 1e-6


@pytest.mark.parametrize("seed", range(3))
def test_point_from_nothing_equals_coordinate_descent(seed):
    Z, y = tied(seed)
    Z = np.delete(Z, range(10, 15), axis=1)     # one solution only
    for a in (0.5, 0.1, 0.02):
        cd, _ = lasso_path_cd(Z, y, np.array([a]))
        assert np.allclose(lasso_point(Z, y, a, np.zeros(Z.shape[1])), cd[0], atol=1e-7)


def test_points_that_the_homotopy_gets_wrong_are_solved_anew(monkeypatch):
    from monthlens.functions import stats
    Z, y = tied(9)
    grid = np.array([0.3, 0.1, 0.05])
    right, _ = lasso_path_homotopy(Z, y, grid)

    def wrong(Z, y, alphas, max_nnz=None):
        c = right.copy()
        c[1] = 0.0
        return c, (y - y.mean())[None, :] - c @ Z.T

    monkeypatch.setattr(stats, "lasso_path_homotopy", wrong)
    coefs, resids = stats.lasso_path_checked(Z, y, grid)
    assert max(lasso_conditions(Z, r, b, a) for r, b, a in zip(resids, coefs, grid)) < 1e-6
