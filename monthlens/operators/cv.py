"""Chronological train/test model comparisons: K-fold Ridge (linear and RBF
kernel), plain OLS and K-fold Lasso, all fitted on training months only.

Everything Ridge-like runs in the dual on K0[s,t] = sum_j x_sj x_tj / sigma_j^2
with sigma from the TRAINING months (summed over blocks of columns). Translation-invariant pieces (RBF distances) and the
intercept's centring are taken in-task on the months x months matrix.

A Nystroem map whose component count exceeds the training rows uses every
training row as basis; ridge on those features equals kernel ridge with the
RBF kernel itself, which is what is solved here. gamma = 1/(p var(Z_train))
reduces to n_train / trace(Kc_train) for standardised columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthlens.functions.stats import r2_score
from monthlens.operators.gram import gram, packed
from monthlens.operators.vectorize import Features
from monthlens.session import cut_lineage, ship_package


def dual_predict(Ktt: np.ndarray, y: np.ndarray, Kxt: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge with intercept from an uncentred train Gram; alpha = 0 gives the
    minimum-norm least-squares fit."""
    ybar = y.mean()
    rm = Ktt.mean(axis=0)
    gm = Ktt.mean()
    Kc = Ktt - rm[None, :] - rm[:, None] + gm
    kc = Kxt - Kxt.mean(axis=1)[:, None] - rm[None, :] + gm
    if alpha > 0:
        dual = np.linalg.solve(Kc + alpha * np.eye(len(y)), y - ybar)
    else:
        dual = np.linalg.pinv(Kc, rcond=1e-10, hermitian=True) @ (y - ybar)
    return kc @ dual + ybar


def contiguous_fold_ids(n: int, k: int) -> np.ndarray:
    sizes = np.full(k, n // k)
    sizes[: n % k] += 1
    return np.repeat(np.arange(k), sizes)


def kfold_alpha(K: np.ndarray, y: np.ndarray, alphas, k: int = 5) -> tuple[float, np.ndarray]:
    """Alpha with the best mean held-out-fold R² (unshuffled contiguous folds;
    first alpha wins ties)."""
    folds = contiguous_fold_ids(len(y), k)
    scores = []
    for a in alphas:
        r2s = []
        for f in range(k):
            te, tr = folds == f, folds != f
            p = dual_predict(K[np.ix_(tr, tr)], y[tr], K[np.ix_(te, tr)], a)
            r2s.append(r2_score(y[te], p))
        scores.append(np.mean(r2s))
    scores = np.array(scores)
    return float(alphas[int(np.argmax(scores))]), scores


def rbf_from_gram(K0: np.ndarray, train: np.ndarray) -> np.ndarray:
    diag = np.diag(K0)
    d2 = np.clip(diag[:, None] + diag[None, :] - 2 * K0, 0, None)
    Ktr = K0[np.ix_(train, train)]
    rm = Ktr.mean(axis=0)
    trace_c = float(np.trace(Ktr) - 2 * rm.sum() + Ktr.mean() * len(rm))   # trace of the centred train Gram
    gamma = len(rm) / trace_c if trace_c > 0 else 1.0
    return np.exp(-gamma * d2)


MODEL_SCHEMA = "model string, alpha double, oos_r2 double, oos_mse double, n_train int, n_test int, n_features long"


def split_rows(f: Features, y: DataFrame, train_frac: float = 0.8) -> DataFrame:
    """Months in both the feature set and the non-null target, with position t
    and 'train' / 'test' split (first floor(train_frac n) months train)."""
    from monthlens.operators.timeseries import chrono_split
    rows = y.join(F.broadcast(f.periods), "period").select("period", "y")
    return cut_lineage(chrono_split(rows, train_frac))


def train_scaled_gram(f: Features, rows: DataFrame) -> tuple[np.ndarray, list]:
    """(Gram over all rows, the rows in order): columns scaled by their population std
    over the training months only; zero-variance features dropped."""
    order = [(r.t, r.y, r.split) for r in rows.orderBy("t").collect()]     # one row a month
    inside = f.values.join(F.broadcast(rows.select("period")), "period")
    train = np.array([s == "train" for _, _, s in order])
    return gram(packed(inside, rows.select("period")), len(order), train), order


def compare_models(f: Features, y: DataFrame, models: list[str], alphas: list[float], k: int = 5,
                   train_frac: float = 0.8) -> DataFrame:
    """One row per model: 'ridge' (K-fold linear ridge), 'rbf_ridge' (K-fold
    RBF kernel ridge), 'ols' (plain least squares, min-norm if singular)."""
    spark = y.sparkSession
    ship_package(spark)
    rows = split_rows(f, y, train_frac)
    K0, order = train_scaled_gram(f, rows)                     # months squared
    train = np.array([s == "train" for _, _, s in order])
    yv = np.array([v for _, v, _ in order], dtype=float)
    p = f.values.select("feature").distinct().count()
    grid = np.asarray(alphas, dtype=float)

    def solve(batches):
        for pdf in batches:
            out = []
            for model in pdf["model"]:
                K = rbf_from_gram(K0, train) if model.startswith("rbf") else K0
                Ktr, Kte = K[np.ix_(train, train)], K[np.ix_(~train, train)]
                alpha = 0.0 if model.startswith("ols") else kfold_alpha(Ktr, yv[train], grid, k)[0]
                pred = dual_predict(Ktr, yv[train], Kte, alpha)
                out.append((model, alpha, r2_score(yv[~train], pred), float(np.mean((yv[~train] - pred) ** 2)),
                            int(train.sum()), int((~train).sum()), p))
            yield pd.DataFrame(out, columns=["model", "alpha", "oos_r2", "oos_mse", "n_train", "n_test", "n_features"])

    return spark.createDataFrame([(m,) for m in models], "model string").repartition(len(models)).mapInPandas(solve, MODEL_SCHEMA)


def lasso_kfold(f: Features, y: DataFrame, k: int = 5, n_alphas: int = 100, eps: float = 1e-3,
                train_frac: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """K-fold Lasso on the chronological training months, refit at the best
    alpha, scored on the test months.

    Columns are scaled once by their training std (a scaler fitted before the
    folds) and centred per fold by the intercept. Alpha grid: n_alphas
    log-spaced from alpha_max down to eps * alpha_max (alpha_max from all
    training months); best alpha = lowest mean held-out MSE. Each fold's
    training set is one pseudo-outcome of a single Lasso design; the folds' working
    sets hold few columns, and only those are read for the predictions.
    -> (one row: model 'lasso', scores;  the selected features: feature, coef on the
    scaled column, rank by |coef|)"""
    from pyspark.sql import Window

    from monthlens.operators import design as D
    from monthlens.operators import lasso as L
    from monthlens.operators.columns import columns, pack
    from monthlens.operators.timeseries import mse, r2

    rows = split_rows(f, y, train_frac)
    train = rows.where(F.col("split") == "train")
    n_tr = train.count()
    folds = train.withColumn("fold", (F.ntile(k).over(Window.orderBy("t")) - 1).cast("int"))  # month-level
    folds = cut_lineage(folds)
    # training std per feature (population, implicit zeros) -> scaled cells
    vals = cut_lineage(f.values.join(F.broadcast(rows.select("period")), "period"))
    # proportional columns are identical after scaling by their own std:
    # keep one per class (the prediction does not change)
    one = F.lit(0).cast("long").alias("pattern")
    vals = vals.join(columns(vals, rows.select(one, "period")).select("feature"), "feature", "left_semi")
    m = (vals.join(F.broadcast(train.select("period")), "period").groupBy("feature")
             .agg(F.sum("value").alias("s1"), F.sum(F.col("value") ** 2).alias("s2")))
    var = F.col("s2") / n_tr - (F.col("s1") / n_tr) ** 2
    sd = m.where(var > 1e-12 * F.col("s2") / n_tr).select("feature", F.sqrt(var).alias("sd"))
    xs = cut_lineage(vals.join(sd, "feature").select("period", "feature", (F.col("value") / F.col("sd")).alias("value")))
    # pseudo-outcomes: fold_i = training months outside fold i; 'all' = every training month
    ys = folds.select("period", "y", "fold")
    fy = ys.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("fold") != F.col("f")) \
           .select("period", F.concat(F.lit("fold_"), F.col("f").cast("string")).alias("outcome"), "y")
    yall = ys.select("period", F.lit("all").alias("outcome"), "y")
    yy = cut_lineage(fy.unionByName(yall))
    op, pp = D.patterns(yy)
    op, pp = op.cache(), pp.cache()
    feats = Features(f.rep, xs, rows.select("period"))
    des = D.Design(feats, yy, op, pp, pack(xs, pp, collapse=False, standardise=False))
    top = {r.outcome: r.score for r in L.largest_scores(des).collect()}
    amax = top.get("all", 1.0)
    grid = list(np.logspace(np.log10(amax * eps), np.log10(amax), n_alphas)[::-1])
    path = L.lasso_path(des, grid)
    coefs = cut_lineage(path.coefs)
    used = cut_lineage(xs.join(coefs.select("feature").distinct(), "feature", "left_semi"))   # the working columns, scaled
    # held-out predictions: ybar_f - sum_j mu_fj b_j + sum_j x_tj b_j
    mu = path.columns.select("outcome", "feature", "mu")
    icpt = (coefs.join(mu, ["outcome", "feature"]).groupBy("outcome", "alpha_idx")
                 .agg(F.sum(-F.col("mu") * F.col("coef")).alias("shift")))
    ybar = yy.groupBy("outcome").agg(F.avg("y").alias("ybar"))
    held = folds.select("period", "y", F.concat(F.lit("fold_"), F.col("fold").cast("string")).alias("outcome"))
    held = held.withColumn("alpha_idx", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    part = (used.join(F.broadcast(folds.select("period", "fold")), "period")
                .select("period", "feature", "value", F.concat(F.lit("fold_"), F.col("fold").cast("string")).alias("outcome"))
                .join(coefs.select("outcome", "alpha_idx", "feature", "coef"), ["outcome", "feature"])
                .groupBy("outcome", "alpha_idx", "period").agg(F.sum(F.col("value") * F.col("coef")).alias("xb")))
    pred = (held.join(part, ["outcome", "alpha_idx", "period"], "left")
                .join(icpt, ["outcome", "alpha_idx"], "left").join(F.broadcast(ybar), "outcome")
                .select("outcome", "alpha_idx", "y",
                        (F.col("ybar") + F.coalesce("shift", F.lit(0.0)) + F.coalesce("xb", F.lit(0.0))).alias("p")))
    cv = (pred.groupBy("outcome", "alpha_idx").agg(F.avg((F.col("y") - F.col("p")) ** 2).alias("mse"))
              .groupBy("alpha_idx").agg(F.avg("mse").alias("cv_mse")))
    best = cv.orderBy("cv_mse", "alpha_idx").first()["alpha_idx"]
    # refit on all training months at the best alpha, score the test months
    call = coefs.where((F.col("outcome") == "all") & (F.col("alpha_idx") == best))
    chosen = call.join(mu.where("outcome = 'all'").drop("outcome"), "feature").agg(F.sum(-F.col("mu") * F.col("coef")).alias("shift"), F.count("*").alias("nnz")).first()
    ybar_all = yall.agg(F.avg("y")).first()[0]
    test = rows.where(F.col("split") == "test").select("period", "y")
    xb = (used.join(F.broadcast(test.select("period")), "period").join(call.select("feature", "coef"), "feature")
              .groupBy("period").agg(F.sum(F.col("value") * F.col("coef")).alias("xb")))
    tp = test.join(xb, "period", "left").select("y", (F.lit(ybar_all + (chosen["shift"] or 0.0)) + F.coalesce("xb", F.lit(0.0))).alias("p"))
    scores = tp.agg(F.lit("lasso").alias("model"), F.lit(float(grid[best])).alias("alpha"),
                    r2("y", "p").alias("oos_r2"), mse("y", "p").alias("oos_mse"),
                    F.lit(n_tr).cast("int").alias("n_train"), F.count("*").cast("int").alias("n_test"),
                    F.lit(chosen["nnz"]).cast("long").alias("n_features"))
    # at most as many features as months, so one window over all of them
    words = call.select("feature", "coef", F.row_number().over(Window.orderBy(F.desc(F.abs("coef")), "feature")).alias("rank"))
    return scores, words
