"""Ridge regression with a free intercept over long period features.

Everything goes through the months x months Gram of the scaled features (dual form): Spark
sums it over blocks of columns (operators/gram.py), and the eigen-solves happen on
n x n matrices, n being the number of months (calendar-bounded). Shifting a
column changes nothing once the Gram is centred, so columns are taken less a
mean or a first value where that is better conditioned.

Alpha choice is leave-one-out in closed form:
H = Kc (Kc + aI)^-1 + 11'/n,  e = (y - Hy) / (1 - diag H),  pick min mean e².
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthlens.functions.stats import ridge_loo_dual
from monthlens.operators.gram import expanding_grams, gram, packed
from monthlens.operators.vectorize import Features
from monthlens.session import cut_lineage, ship_package


def restrict(f: Features, periods: DataFrame) -> Features:
    """Feature set restricted to the given months (calendar-bounded broadcast)."""
    p = periods.select("period").distinct()
    return Features(f.rep, f.values.join(F.broadcast(p), "period"), p)


def month_order(periods: DataFrame) -> list:
    """The months in order (calendar-bounded)."""
    return sorted(r[0] for r in periods.select("period").distinct().collect())


def centred_gram(f: Features) -> DataFrame:
    """Centred Gram of the standardised features, (period_a, period_b, k), for
    every pair of months."""
    spark = f.values.sparkSession
    order = month_order(f.periods)
    if not order:
        return spark.createDataFrame([], "period_a date, period_b date, k double")
    K = gram(packed(f.values, f.periods), len(order))
    return spark.createDataFrame([(a, b, float(K[i, j])) for i, a in enumerate(order) for j, b in enumerate(order)],
                                 "period_a date, period_b date, k double")


# ------------------------------------------------------------------ recovery
#: Targets that one task solves together.
TARGETS_PER_BLOCK = 2000


def ridge_recovery(x: Features, targets: DataFrame, alphas: list[float], blocks: int | None = None) -> DataFrame:
    """Each target series (target, period, y; zeros implicit) regressed on all
    features of ``x`` over the months both cover; LOO alpha; in-sample R².

    Targets are hashed into blocks of about TARGETS_PER_BLOCK; the Gram (months²
    numbers) goes to every block, which solves the eigenproblem once for all its
    targets. -> (target, n, alpha, r2, loo_mse)"""
    spark = targets.sparkSession
    ship_package(spark)
    schema = "target string, n int, alpha double, r2 double, loo_mse double"
    months = x.periods.join(targets.select("period").distinct(), "period")
    xs = restrict(x, months)
    order = month_order(xs.periods)
    n = len(order)
    if n < 3:
        return spark.createDataFrame([], schema)
    if blocks is None:
        blocks = -(-targets.select("target").distinct().count() // TARGETS_PER_BLOCK) or 1
    Kc = gram(packed(xs.values, xs.periods), n)
    grid = np.asarray(alphas, dtype=float)
    index = spark.createDataFrame([(p, i) for i, p in enumerate(order)], "period date, t int")
    # every target reaches its block, also one without a value in these months
    cells = (targets.join(F.broadcast(index), "period", "left").where(F.col("y").isNotNull())
                    .withColumn("blk", F.pmod(F.xxhash64("target"), F.lit(blocks)).cast("int")).select("blk", "target", "t", "y"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=["target", "n", "alpha", "r2", "loo_mse"])
        names = sorted(pdf["target"].unique())
        Y = np.zeros((n, len(names)))
        tidx = {t: j for j, t in enumerate(names)}
        inside = pdf[pdf["t"].notna()]
        Y[inside["t"].to_numpy(dtype=int), inside["target"].map(tidx).to_numpy(dtype=int)] = inside["y"].to_numpy(dtype=float)
        lam, U = np.linalg.eigh((Kc + Kc.T) / 2)
        lam = np.clip(lam, 0, None)
        U2 = U * U
        keep = Y.std(axis=0) > 0                  # zero-variance targets are skipped
        Y = Y[:, keep]
        names = [t for t, k in zip(names, keep) if k]
        if not names:
            return empty
        ybar = Y.mean(axis=0)
        UY = U.T @ (Y - ybar)                     # all targets of the block at once
        mse = np.empty((len(grid), Y.shape[1]))
        for i, a in enumerate(grid):
            sh = lam / (lam + a)
            fit = U @ (sh[:, None] * UY) + ybar
            h = U2 @ sh + 1.0 / n
            e = (Y - fit) / (1.0 - h)[:, None]
            mse[i] = np.mean(e * e, axis=0)
        best = np.argmin(mse, axis=0)             # first alpha wins ties
        r2 = np.empty(Y.shape[1])
        for i in np.unique(best):
            cols = best == i
            sh = lam / (lam + grid[i])
            fit = U @ (sh[:, None] * UY[:, cols]) + ybar[cols]
            d = Y[:, cols] - ybar[cols]
            r2[cols] = 1.0 - ((Y[:, cols] - fit) ** 2).sum(axis=0) / (d * d).sum(axis=0)
        out = [(t, n, float(grid[best[j]]), float(r2[j]), float(mse[best[j], j])) for j, t in enumerate(names)]
        return pd.DataFrame(out, columns=empty.columns)

    return cells.groupBy("blk").applyInPandas(solve, schema)


# ------------------------------------------------------------------ expanding
def expanding_ridge(x: Features, y: DataFrame, alphas: list[float], min_train_frac: float = 0.5) -> DataFrame:
    """One-step-ahead forecasts from an expanding window (no look-ahead).

    ``y(period, y)`` non-null target; rows = months in both ``x`` and ``y``
    in period order. For each origin t >= floor(min_train_frac * n): scale
    features by their population std over rows < t (zero std -> 1), ridge
    with intercept, LOO alpha on rows < t, predict row t.

    The Gram of each origin is summed over blocks of columns (gram.expanding_grams); a task
    then solves origins from their Gram alone. -> (period, t, y, pred, alpha)"""
    from monthlens.operators.timeseries import positions

    spark = y.sparkSession
    ship_package(spark)
    rows = cut_lineage(positions(y.join(F.broadcast(x.periods), "period").select("period", "y")))
    series = [r.y for r in rows.orderBy("t").collect()]          # one number a month
    n = len(series)
    first = max(int(np.floor(n * min_train_frac)), 2)
    schema = "t int, pred double, alpha double"
    if first >= n:
        return rows.join(spark.createDataFrame([], schema), "t").select("period", "t", "y", "pred", "alpha")
    grid, yv = np.asarray(alphas, dtype=float), np.asarray(series, dtype=float)
    inside = x.values.join(F.broadcast(rows.select("period")), "period")
    grams = expanding_grams(packed(inside, rows.select("period")), n, first)

    def solve(batches):
        for pdf in batches:
            out = []
            for t, flat in zip(pdf["key"], pdf["total"]):
                K = np.asarray(flat).reshape(t + 1, t + 1)
                Ktr, ytr = K[:t, :t], yv[:t]
                alpha, _mse, (_lam, _U, _Uy, ybar, J) = ridge_loo_dual(Ktr, ytr, grid)
                dual = np.linalg.solve(J @ Ktr @ J + alpha * np.eye(t), ytr - ybar)
                kt = K[t, :t] - K[t, :t].mean() - Ktr.mean(axis=0) + Ktr.mean()
                out.append((t, float(kt @ dual + ybar), alpha))
            yield pd.DataFrame(out, columns=["t", "pred", "alpha"])

    out = grams.mapInPandas(solve, schema)
    return rows.join(out, "t").select("period", "t", "y", "pred", "alpha")
