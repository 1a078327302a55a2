"""Month-level time-series operators (expanding windows, splits, folds, scores).

Inputs here are period series (one row per month, or per month and group),
so an ordered window without a partition key runs over at most a few hundred
rows per series; where a group key exists it is the window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(part: list[str] | None):
    return Window.partitionBy(*part).orderBy("period") if part else Window.orderBy("period")


def positions(df: DataFrame, part: list[str] | None = None) -> DataFrame:
    """Adds ``t`` (0-based position in period order) and ``n`` (series length)."""
    w = _w(part)
    tot = Window.partitionBy(*part) if part else Window.partitionBy()
    return df.withColumn("t", (F.row_number().over(w) - 1).cast("int")).withColumn("n", F.count("*").over(tot).cast("int"))


def expanding_mean_forecast(y: DataFrame, min_train_frac: float = 0.5, part: list[str] | None = None) -> DataFrame:
    """Historical-mean forecast: at position t, mean of y over positions < t.
    Test rows are t >= floor(min_train_frac * n). -> + t, n, forecast, is_test"""
    w = _w(part).rowsBetween(Window.unboundedPreceding, -1)
    p = positions(y, part)
    return (p.withColumn("forecast", F.avg("y").over(w))
             .withColumn("is_test", F.col("t") >= F.floor(F.col("n") * F.lit(min_train_frac))))


def running_r2(df: DataFrame, pred: str = "forecast", part: list[str] | None = None) -> DataFrame:
    """R² of the first i+1 test forecasts, after each step (NULL for the first)."""
    w = _w(part).rowsBetween(Window.unboundedPreceding, 0)
    e2 = F.sum((F.col("y") - F.col(pred)) ** 2).over(w)
    sy = F.sum("y").over(w)
    sy2 = F.sum(F.col("y") * F.col("y")).over(w)
    m = F.count("*").over(w)
    sst = sy2 - sy * sy / m
    # NULL (not an ANSI divide-by-zero error) while the evaluated y are constant
    return (df.withColumn("running_r2", F.when((m > 1) & (sst > 0), 1 - e2 / sst))
              .withColumn("step", m.cast("int")))


def r2(y: Column | str, p: Column | str) -> Column:
    """Aggregate R² (1 - SSE/SST around the mean of the evaluated y)."""
    yc = F.col(y) if isinstance(y, str) else y
    pc = F.col(p) if isinstance(p, str) else p
    sse = F.sum((yc - pc) ** 2)
    sst = F.sum(yc * yc) - F.sum(yc) * F.sum(yc) / F.count(yc)
    return F.when(sst > 0, 1 - sse / sst)


def mse(y: Column | str, p: Column | str) -> Column:
    yc = F.col(y) if isinstance(y, str) else y
    pc = F.col(p) if isinstance(p, str) else p
    return F.avg((yc - pc) ** 2)


def chrono_split(df: DataFrame, train_frac: float = 0.8, part: list[str] | None = None) -> DataFrame:
    """First floor(train_frac * n) periods are 'train', the rest 'test'."""
    p = positions(df, part)
    return p.withColumn("split", F.when(F.col("t") < F.floor(F.col("n") * F.lit(train_frac)), "train").otherwise("test"))


def contiguous_folds(train: DataFrame, k: int = 5, part: list[str] | None = None) -> DataFrame:
    """Unshuffled K-fold on period order: fold sizes differ by at most one,
    the first (n mod k) folds taking the extra row."""
    return train.withColumn("fold", (F.ntile(k).over(_w(part)) - 1).cast("int"))
