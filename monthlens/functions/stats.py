"""Small numeric kernels that run inside grouped Arrow tasks (numpy only).

Each works on one group's dense matrix, whose size is bounded by the number
of periods (calendar months) times a candidate / selected feature count.
"""

from __future__ import annotations

import math

import numpy as np


# ----------------------------------------------------------- distributions
def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by Lentz's continued fraction."""
    if not (x > 0.0):
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - betainc(b, a, 1.0 - x)
    lbeta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    front = math.exp(math.log(x) * a + math.log1p(-x) * b - lbeta) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(0, 2000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = (m * (b - m) * x) / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        else:
            num = -((a + m) * (a + b + m) * x) / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        d = 1.0 + num * d
        d = tiny if abs(d) < tiny else d
        d = 1.0 / d
        c = 1.0 + num / c
        c = tiny if abs(c) < tiny else c
        cd = c * d
        f *= cd
        if abs(1.0 - cd) < 1e-14:
            break
    return front * (f - 1.0)


def t_two_sided_p(t: float, df: float) -> float:
    if df <= 0 or not np.isfinite(t):
        return float("nan") if df <= 0 else 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_upper_p(fstat: float, d1: float, d2: float) -> float:
    if d1 <= 0 or d2 <= 0 or not np.isfinite(fstat):
        return float("nan")
    if fstat <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * fstat))


# ----------------------------------------------------------- OLS
def ols(X: np.ndarray, y: np.ndarray) -> dict:
    """OLS with intercept; pseudo-inverse for rank-deficient designs.

    Returns coefficients (intercept first), standard errors, t, two-sided p,
    R², adjusted R², F, F p-value, n, rank."""
    n = len(y)
    A = np.column_stack([np.ones(n), X]) if X.size else np.ones((n, 1))
    pinv = np.linalg.pinv(A)
    beta = pinv @ y
    resid = y - A @ beta
    rank = int(np.linalg.matrix_rank(A))
    df_resid = n - rank
    df_model = rank - 1
    ssr = float(resid @ resid)
    yc = y - y.mean()
    sst = float(yc @ yc)
    r2 = 1.0 - ssr / sst if sst > 0 else float("nan")
    adj = 1.0 - (n - 1) / df_resid * (1.0 - r2) if df_resid > 0 else float("nan")
    sigma2 = ssr / df_resid if df_resid > 0 else float("nan")
    cov = sigma2 * (pinv @ pinv.T)
    se = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta / se
    p = np.array([t_two_sided_p(float(ti), df_resid) for ti in t])
    if df_model > 0 and df_resid > 0 and ssr > 0:
        fstat = ((sst - ssr) / df_model) / (ssr / df_resid)
        fp = f_upper_p(fstat, df_model, df_resid)
    else:
        fstat, fp = float("nan"), float("nan")
    return dict(beta=beta, se=se, t=t, p=p, r2=r2, adj_r2=adj, fstat=fstat, f_pvalue=fp,
                n=n, rank=rank, df_resid=df_resid)


# ----------------------------------------------------------- Lasso path
def lasso_path_cd(Z: np.ndarray, y: np.ndarray, alphas: np.ndarray, tol: float = 1e-10,
                  max_sweeps: int = 100000, max_nnz: int | None = None):
    """Lasso path for min (1/2n)||y - Zb||² + a||b||₁ over descending ``alphas``.

    Z must have centred columns (so the mean of y is irrelevant). Working-set
    coordinate descent: solve on the active set, then one vectorised
    optimality check over all columns; violators join the set. Exact zeros
    outside the set. Stops after the first alpha whose support exceeds
    ``max_nnz`` (None: full grid).

    Returns (coefs [n_solved, p], residuals [n_solved, n]) for the solved prefix.
    """
    n, p = Z.shape
    yc = y - y.mean()
    sq = (Z * Z).sum(axis=0) / n
    usable = sq > 0
    b = np.zeros(p)
    r = yc.copy()
    coefs, resids = [], []
    active: list[int] = []
    for a in alphas:
        for _outer in range(1000):
            # coordinate descent on the working set
            for _ in range(max_sweeps):
                delta = 0.0
                for j in active:
                    zj = Z[:, j]
                    old = b[j]
                    rho = zj @ r / n + sq[j] * old
                    new = np.sign(rho) * max(abs(rho) - a, 0.0) / sq[j]
                    if new != old:
                        r -= zj * (new - old)
                        b[j] = new
                        delta = max(delta, abs(new - old))
                if delta < tol:
                    break
            c = Z.T @ r / n
            viol = np.where(usable & (np.abs(c) > a * (1 + 1e-12)) & (b == 0))[0]
            viol = [int(j) for j in viol if j not in set(active)]
            if not viol:
                break
            active.extend(viol)
        coefs.append(b.copy())
        resids.append(r.copy())
        if max_nnz is not None and np.count_nonzero(b) > max_nnz:
            break
    return np.array(coefs).reshape(len(coefs), p), np.array(resids).reshape(len(resids), n)


def lasso_path_homotopy(Z: np.ndarray, y: np.ndarray, alphas: np.ndarray,
                        max_nnz: int | None = None, eps: float = 1e-12):
    """Exact Lasso path (piecewise linear in alpha) by the homotopy / LARS
    algorithm with the lasso drop step, evaluated on descending ``alphas``.

    Same objective and return value as :func:`lasso_path_cd`. Grid points are
    evaluated segment by segment as the kinks are computed (linear
    interpolation is exact between kinks; zeros stay exact zeros), and the
    path stops right after the first grid point whose support exceeds
    ``max_nnz`` -- so every returned grid point is final.
    """
    n, p = Z.shape
    grid = np.asarray(alphas, dtype=float)
    yc = y - y.mean()
    usable = (Z * Z).sum(axis=0) > 0
    c = Z.T @ yc / n
    c[~usable] = 0.0
    b = np.zeros(p)
    lam = float(np.max(np.abs(c))) if p else 0.0
    out: list[np.ndarray] = []
    gi = 0
    while gi < len(grid) and grid[gi] >= lam:        # above alpha_max: all zero
        out.append(np.zeros(p))
        gi += 1
    active: list[int] = [int(np.argmax(np.abs(c)))] if lam > 0 else []
    rank_cap = min(n - 1, int(usable.sum()))
    just_in = -1
    stop = False
    while gi < len(grid) and not stop:
        if not active or lam <= eps:                  # end of the path: solution stays
            while gi < len(grid) and not stop:
                out.append(b.copy())
                gi += 1
                stop = max_nnz is not None and np.count_nonzero(b) > max_nnz
            break
        A = np.array(active)
        s = np.sign(c[A])
        ZA = Z[:, A]
        d = np.linalg.lstsq(ZA.T @ ZA / n, s, rcond=None)[0]
        a = Z.T @ (ZA @ d) / n
        inactive = np.ones(p, dtype=bool)
        inactive[A] = False
        inactive &= usable
        with np.errstate(divide="ignore", invalid="ignore"):
            g1 = (lam - c) / (1.0 - a)
            g2 = (lam + c) / (1.0 + a)
            gd = -b[A] / d
        g1 = np.where(inactive & (g1 > eps), g1, np.inf)
        g2 = np.where(inactive & (g2 > eps), g2, np.inf)
        g_in = np.minimum(g1, g2)
        j_in = int(np.argmin(g_in))
        gamma_in = g_in[j_in] if len(active) < rank_cap else np.inf
        gd = np.where((gd > eps) & (A != just_in), gd, np.inf)
        k_out = int(np.argmin(gd))
        gamma_out = gd[k_out]
        gamma = min(gamma_in, gamma_out, lam)
        b_new = b.copy()
        b_new[A] += gamma * d
        new_lam = lam - gamma
        just_in = -1
        if gamma == gamma_out and gamma < lam:
            j = int(A[k_out])
            b_new[j] = 0.0
            active.remove(j)
        elif gamma == gamma_in and gamma < lam:
            active.append(j_in)
            just_in = j_in
        # grid points inside this segment: lam > alpha >= new_lam
        both_zero = (b == 0) & (b_new == 0)
        while gi < len(grid) and grid[gi] >= new_lam:
            w = (lam - grid[gi]) / (lam - new_lam) if lam > new_lam else 1.0
            bb = b + w * (b_new - b)
            bb[both_zero] = 0.0
            out.append(bb)
            gi += 1
            if max_nnz is not None and np.count_nonzero(bb) > max_nnz:
                stop = True
                break
        c = c - gamma * a
        b, lam = b_new, max(new_lam, 0.0)
    coefs = np.array(out).reshape(len(out), p)
    resids = (yc[None, :] - coefs @ Z.T) if len(out) else np.zeros((0, n))
    return coefs, resids


def lasso_conditions(Z: np.ndarray, resid: np.ndarray, b: np.ndarray, alpha: float) -> float:
    """Largest breach of the Lasso optimality conditions, relative to ``alpha``:
    scores of zero coefficients within alpha, of others at alpha with their sign."""
    c = Z.T @ resid / len(resid)
    return float(np.max(np.where(b == 0, np.abs(c) - alpha, np.abs(c - alpha * np.sign(b))), initial=0.0)) / alpha


def lasso_point(Z: np.ndarray, y: np.ndarray, alpha: float, start: np.ndarray, tol: float = 1e-7,
                max_steps: int = 5000) -> np.ndarray:
    """Exact Lasso solution at one alpha by an active-set search over signs.

    From ``start``, the coefficients move to the least-squares point of the
    current signs as far as the objective falls (stopping where one crosses
    zero, which then leaves); when the active ones are settled, the zero
    coefficient that breaches its condition most enters. Ties enter one by one."""
    n, p = Z.shape
    yc = y - y.mean()
    q = Z.T @ yc / n
    b = start.copy()
    sign = np.sign(b)

    def value(x: np.ndarray) -> float:
        r = yc - Z @ x
        return float(r @ r) / (2 * n) + alpha * float(np.abs(x).sum())

    for _ in range(max_steps):
        A = np.flatnonzero(sign)
        settled = True
        if len(A):
            _, sv, vt = np.linalg.svd(Z[:, A], full_matrices=True)
            if len(A) > len(sv) or sv[-1] <= 1e-11 * sv[0]:
                # dependent columns: along their null vector the fit stays, and
                # the penalty falls until one of them reaches zero and leaves
                v = vt[-1]
                fresh = b[A] == 0
                if abs(v @ sign[A]) > 1e-12:
                    v = -v * np.sign(v @ sign[A])
                elif fresh.any():
                    v = v * np.sign((v * sign[A])[fresh][0] or 1.0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(v * sign[A] < 0, -b[A] / v, np.inf)
                k = int(np.argmin(t))
                if np.isfinite(t[k]):
                    b[A] += t[k] * v
                    b[A[k]] = 0.0
                    sign[A[k]] = 0.0
                    continue
            want = np.zeros(p)
            ZA = Z[:, A]
            want[A] = np.linalg.lstsq(ZA.T @ ZA / n, q[A] - alpha * sign[A], rcond=1e-13)[0]
            move = want - b
            if np.max(np.abs(move)) > 1e-14 * max(1.0, np.max(np.abs(want))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = -b / move
                stops = np.unique(np.concatenate([[1.0], t[(t > 1e-15) & (t < 1) & (move != 0)]]))
                points = []
                for s in stops:
                    x = b + s * move
                    x[np.isclose(t, s, rtol=1e-12, atol=0) & (s < 1)] = 0.0
                    points.append(x)
                values = [value(x) for x in points]
                best = int(np.argmin(values))
                settled = best == len(stops) - 1 and bool(np.all(np.sign(points[best][A]) == sign[A]))
                b = points[best]
                sign = np.where(b == 0, 0.0, np.sign(b))
        if not settled:
            continue
        c = q - Z.T @ (Z @ b) / n
        breach = np.where(b == 0, np.abs(c) - alpha, 0.0)
        j = int(np.argmax(breach))
        if breach[j] <= tol * alpha:
            return b
        sign[j] = np.sign(c[j])
    return b


def lasso_path_checked(Z: np.ndarray, y: np.ndarray, alphas: np.ndarray, tol: float = 1e-6,
                       max_nnz: int | None = None):
    """The path of :func:`lasso_path_homotopy`, every grid point checked
    on all columns and solved anew where a condition does not hold (ties make
    the homotopy miss an entry). Raises if a point cannot be solved."""
    coefs, resids = lasso_path_homotopy(Z, y, alphas, max_nnz=max_nnz)
    yc = y - y.mean()
    warm = None
    for i, a in enumerate(alphas[:len(coefs)]):
        if lasso_conditions(Z, resids[i], coefs[i], a) <= tol:
            warm = coefs[i]
            continue
        start = np.zeros(Z.shape[1]) if warm is None else warm
        coefs[i] = lasso_point(Z, y, a, start)
        resids[i] = yc - Z @ coefs[i]
        breach = lasso_conditions(Z, resids[i], coefs[i], a)
        if breach > tol:
            raise RuntimeError(f"Lasso conditions are breached by {breach:.2g} of alpha at alpha = {a:.3g}")
        warm = coefs[i]
    return coefs, resids


# ----------------------------------------------------------- Ridge (dual)
def ridge_loo_dual(K: np.ndarray, y: np.ndarray, alphas: np.ndarray):
    """Ridge with a free intercept from the training Gram ``K`` (n×n, of the
    already-scaled features). Leave-one-out errors in closed form:
    H = Kc (Kc + aI)^-1 + 11'/n,  e = (y - Hy) / (1 - diag H).

    Returns (best_alpha, loo_mse per alpha, eigen pieces for prediction)."""
    n = len(y)
    J = np.eye(n) - 1.0 / n
    Kc = J @ K @ J
    Kc = (Kc + Kc.T) / 2
    lam, U = np.linalg.eigh(Kc)
    lam = np.clip(lam, 0, None)
    ybar = y.mean()
    Uy = U.T @ (y - ybar)
    U2 = U * U
    mse = np.empty(len(alphas))
    for i, a in enumerate(alphas):
        s = lam / (lam + a)
        fit = U @ (s * Uy) + ybar
        h = U2 @ s + 1.0 / n
        e = (y - fit) / (1.0 - h)
        mse[i] = float(np.mean(e * e))
    best = int(np.argmin(mse))
    return float(alphas[best]), mse, (lam, U, Uy, ybar, J)


def ridge_dual_fit(K: np.ndarray, y: np.ndarray, alpha: float):
    """In-sample fitted values of ridge with intercept from Gram K."""
    n = len(y)
    J = np.eye(n) - 1.0 / n
    Kc = J @ K @ J
    ybar = y.mean()
    dual = np.linalg.solve(Kc + alpha * np.eye(n), y - ybar)
    return Kc @ dual + ybar, dual


def r2_score(y: np.ndarray, p: np.ndarray) -> float:
    d = y - y.mean()
    sst = float(d @ d)
    e = y - p
    return 1.0 - float(e @ e) / sst if sst > 0 else float("nan")
