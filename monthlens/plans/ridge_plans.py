"""Ridge-based analyses: recovering series from embeddings and expanding-window
forecasts against the historical-mean baseline."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthlens.functions.text import bar
from monthlens.operators import ridge as R
from monthlens.operators import timeseries as TS
from monthlens.operators import vectorize as V
from monthlens.session import cut_lineage
from monthlens.sources import tables as S

# --- fixed values: alpha grids (ascending, as 10**linspace) -------------------
RECOVERY_ALPHAS = np.logspace(-2, 4, 50).tolist()
FORECAST_ALPHAS = np.logspace(0, 6, 15).tolist()
# --- end fixed values ---------------------------------------------------------
#: Topics that the report looks up by name.
FEATURED = ("Brand#11", "Brand#23", "Brand#34", "Brand#45")


def best_and_worst(res: DataFrame, top: int, bottom: int) -> DataFrame:
    """The first ``top`` and last ``bottom`` rows by rank, and which they are."""
    last = res.agg(F.max("rank")).first()[0] or 0
    part = F.when(F.col("rank") <= top, "top").when(F.col("rank") > last - bottom, "bottom")
    return res.withColumn("part", part).where(F.col("part").isNotNull())


def featured(res: DataFrame, names) -> DataFrame:
    return res.where(F.col("target").isin(*names))


def ranked(res: DataFrame, scale: int = 30) -> DataFrame:
    """Rank by R² (descending, ties by target) with the distributed global
    numbering (range sort + partition offsets), not a single-task window:
    the number of targets grows with the vocabulary."""
    from monthlens.operators.inference import global_row_number
    r = res.withColumn("_neg", -F.col("r2"))
    r = global_row_number(r, ["_neg", "target"], "rank0")
    return (r.withColumn("rank", (F.col("rank0") + 1).cast("int")).drop("rank0", "_neg")
             .withColumn("bar", bar("r2", scale)))


def recover_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand-share topic series regressed on all monthly embedding dims."""
    x = V.monthly_embeddings(S.article_vectors(spark, sf))
    t = S.topics_long(spark, sf).select(F.col("feature").alias("target"), "period", F.col("value").alias("y"))
    return ranked(R.ridge_recovery(x, t, RECOVERY_ALPHAS))


def recover_generated_terms(spark: SparkSession, sf: str, top: int | None = 50) -> DataFrame:
    """Monthly counts of generated keyword terms regressed on embeddings; the
    ``top`` most frequent terms (ties by term), or every term with variance."""
    from monthlens.plans.analyses import features
    g = features(spark, sf, "generated")
    x = V.monthly_embeddings(S.article_vectors(spark, sf))
    t = g.values.select(F.col("feature").alias("target"), "period", F.col("value").alias("y"))
    freq = t.groupBy("target").agg(F.sum("y").alias("freq"))
    if top:
        keep = freq.orderBy(F.desc("freq"), "target").limit(top)
        t = t.join(F.broadcast(keep.select("target")), "target")   # top-n: n rows
    return ranked(R.ridge_recovery(x, t, RECOVERY_ALPHAS)).join(freq, "target")


def recovery_summary(res: DataFrame) -> DataFrame:
    return res.agg(F.count("*").alias("n_targets"), F.avg("r2").alias("mean_r2"), F.median("r2").alias("median_r2"),
                   F.min("r2").alias("min_r2"), F.max("r2").alias("max_r2"),
                   F.count_if(F.col("r2") > 0.5).alias("n_r2_gt_05"), F.count_if(F.col("r2") > 0.7).alias("n_r2_gt_07"),
                   F.count_if(F.col("r2") > 0.9).alias("n_r2_gt_09"), F.median("alpha").alias("median_alpha"),
                   F.min_by("target", F.struct("r2", "target")).alias("worst_target"),
                   F.max_by("target", F.struct("r2", "target")).alias("best_target"))


def forecast_rows(spark: SparkSession, sf: str, rep: str, target: str = "indprol1",
                  min_train_frac: float = 0.5) -> DataFrame:
    from monthlens.plans.analyses import features
    x = features(spark, sf, rep)
    y = S.outcomes(spark, sf, complete_months_only=False, names=[target]).select("period", "y")
    fc = R.expanding_ridge(x, y, FORECAST_ALPHAS, min_train_frac)
    rows = y.join(F.broadcast(x.periods), "period")
    hm = TS.expanding_mean_forecast(rows, min_train_frac).select("period", F.col("forecast").alias("hist_mean"))
    out = fc.join(hm, "period")
    return TS.running_r2(out, pred="pred")


def expanding_forecast(spark: SparkSession, sf: str, rep: str, target: str = "indprol1") -> DataFrame:
    """Out-of-sample R² / MSE of the expanding Ridge and the historical mean."""
    rows = forecast_rows(spark, sf, rep, target)
    return rows.agg(F.lit(rep).alias("rep"), F.lit(target).alias("target"), F.count("*").alias("n_test"),
                    F.min("t").alias("n_train_first"),
                    TS.r2("y", "pred").alias("oos_r2"), TS.mse("y", "pred").alias("mse"),
                    TS.r2("y", "hist_mean").alias("hist_mean_r2"), TS.mse("y", "hist_mean").alias("hist_mean_mse"),
                    F.median("alpha").alias("median_alpha"))


# --- fixed values: comparison grids ---------------------------------------------
CMP_ALPHAS_TOPICS = np.logspace(-3, 3, 50).tolist()
CMP_ALPHAS_COUNTS = np.logspace(-1, 4, 50).tolist()
# --- end fixed values -------------------------------------------------------------


def kernel_ridge_compare(spark: SparkSession, sf: str, target: str = "indprol1") -> DataFrame:
    """Topics -> target, chronological 80/20: RBF kernel ridge (5-fold alpha),
    plain OLS and linear ridge (5-fold alpha), out-of-sample R² and MSE."""
    from monthlens.operators.cv import compare_models
    from monthlens.plans.analyses import features
    f = features(spark, sf, "topics")
    y = S.outcomes(spark, sf, complete_months_only=False, names=[target]).select("period", "y")
    return compare_models(f, y, ["rbf_ridge", "ols", "ridge"], CMP_ALPHAS_TOPICS)


def oos_ridge_lasso_compare(spark: SparkSession, sf: str, target: str = "indprol1") -> DataFrame:
    """Counts vs topics, chronological 80/20, 5-fold Ridge and 5-fold Lasso."""
    from monthlens.operators.cv import compare_models, lasso_kfold
    from monthlens.plans.analyses import features
    y = cut_lineage(S.outcomes(spark, sf, complete_months_only=False, names=[target]).select("period", "y"))
    out = None
    for rep, alphas in (("topics", CMP_ALPHAS_TOPICS), ("counts", CMP_ALPHAS_COUNTS)):
        f = features(spark, sf, rep)
        r = compare_models(f, y, ["ridge"], alphas).unionByName(lasso_kfold(f, y)[0])
        r = r.withColumn("rep", F.lit(rep))
        out = r if out is None else out.unionByName(r)
    return out.select("rep", "model", "alpha", "oos_r2", "oos_mse", "n_train", "n_test", "n_features")


def lasso_cv_words(spark: SparkSession, sf: str, target: str = "indprol1") -> DataFrame:
    """The words that the 5-fold Lasso on counts picks, with their coefficients on the scaled
    counts, largest first."""
    from monthlens.operators.cv import lasso_kfold
    from monthlens.plans.analyses import features
    y = S.outcomes(spark, sf, complete_months_only=False, names=[target]).select("period", "y")
    return lasso_kfold(features(spark, sf, "counts"), y)[1].select("rank", F.col("feature").alias("word"), "coef")
