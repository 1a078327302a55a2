"""Grouped OLS with inference (intercept, pseudo-inverse for rank deficiency).

Each group is one (outcome, selection) pair; its design is n months x k
selected features, built inside a grouped Arrow task from the long cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthlens.functions.stats import ols
from monthlens.session import ship_package

TERM = "struct<feature:string, coef:double, se:double, t:double, p:double>"


def _schema(keys: list[str], key_types: dict[str, str]) -> str:
    ks = ", ".join(f"{k} {key_types.get(k, 'string')}" for k in keys)
    return (f"{ks}, n bigint, n_features int, r2 double, adj_r2 double, fstat double, f_pvalue double, "
            f"intercept double, terms array<{TERM}>")


def _fn(keys: list[str]):
    def fit(key, cells: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        ys = ys.sort_values("period")
        periods = list(ys["period"])
        pidx = {p: i for i, p in enumerate(periods)}
        yv = ys["y"].to_numpy(dtype=float)
        n = len(yv)
        feats = sorted(cells["feature"].unique()) if len(cells) else []
        X = np.zeros((n, len(feats)))
        if feats:
            fidx = {f: j for j, f in enumerate(feats)}
            c = cells[cells["period"].isin(pidx.keys())]
            X[c["period"].map(pidx).to_numpy(), c["feature"].map(fidx).to_numpy()] = c["value"].to_numpy(dtype=float)
        if n == 0:
            return pd.DataFrame([], columns=keys + ["n", "n_features", "r2", "adj_r2", "fstat", "f_pvalue",
                                                    "intercept", "terms"])
        res = ols(X, yv)
        if not feats:
            res["fstat"], res["f_pvalue"] = float("nan"), 1.0
        terms = [dict(feature=f, coef=float(res["beta"][j + 1]), se=float(res["se"][j + 1]),
                      t=float(res["t"][j + 1]), p=float(res["p"][j + 1])) for j, f in enumerate(feats)]
        row = list(key) + [n, len(feats), float(res["r2"]), float(res["adj_r2"]), float(res["fstat"]),
                           float(res["f_pvalue"]), float(res["beta"][0]), terms]
        return pd.DataFrame([row], columns=keys + ["n", "n_features", "r2", "adj_r2", "fstat", "f_pvalue",
                                                   "intercept", "terms"])
    return fit


def ols_groups(groups: DataFrame, selected: DataFrame, values: DataFrame, y: DataFrame,
               keys: list[str]) -> DataFrame:
    """OLS of y on the selected raw feature values, one fit per group.

    groups    keys (must include 'outcome') -- every group, even with no feature
    selected  keys + feature
    values    period, feature, value   (long, zeros absent)
    y         outcome, period, y       (aligned months)
    """
    ship_package(groups.sparkSession)
    key_types = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    # fresh attribute ids: both sides usually derive from the same selection plan
    groups = groups.select(*[F.col(k).alias(k) for k in keys])
    selected = selected.select(*[F.col(k).alias(k) for k in keys], F.col("feature").alias("feature"))
    cells = values.join(selected, "feature").select(*keys, "feature", "period", "value")
    ys = y.join(groups.select(*keys).distinct(), "outcome").select(*keys, "period", "y")
    return (cells.groupBy(*keys).cogroup(ys.groupBy(*keys))
                 .applyInPandas(_fn(keys), _schema(keys, key_types)))


def first_reaching(selected: DataFrame, columns: DataFrame, y: DataFrame, targets: DataFrame) -> DataFrame:
    """Per outcome the smallest k whose OLS reaches the target R².

    selected  outcome, k, feature     (k features each)
    columns   outcome, feature, x     (raw values over the outcome's months, in order)
    y         outcome, period, y;  targets  outcome, target_r2
    -> outcome, k_match int, matched_r2   (outcomes that never reach it are absent)

    A group holds one outcome's working columns and its sizes (both bounded by the months)."""
    ship_package(selected.sparkSession)
    sizes = selected.groupBy("outcome", "feature").agg(F.collect_set("k").alias("ks"))
    left = columns.select("outcome", "feature", "x").join(sizes, ["outcome", "feature"])

    def tried(key, cols: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=["outcome", "k_match", "matched_r2"])
        if cols.empty or ys.empty:
            return empty
        ys = ys.sort_values("period")
        yv, target = ys["y"].to_numpy(dtype=float), float(ys["target_r2"].iloc[0])
        cols = cols.sort_values("feature")
        X = np.vstack(cols["x"].to_numpy()).T
        member = [set(ks) for ks in cols["ks"]]
        for k in sorted(set().union(*member)):
            r2 = ols(X[:, [j for j, ks in enumerate(member) if k in ks]], yv)["r2"]
            if r2 >= target:
                return pd.DataFrame([(key[0], int(k), float(r2))], columns=empty.columns)
        return empty

    series = y.join(F.broadcast(targets.select("outcome", "target_r2")), "outcome")
    lanes = 2 * max(targets.count(), 1)            # few rows, much work: not to be coalesced by size
    return left.repartition(lanes, "outcome").groupBy("outcome").cogroup(series.repartition(lanes, "outcome").groupBy("outcome")).applyInPandas(tried, "outcome string, k_match int, matched_r2 double")


def with_stars(df: DataFrame) -> DataFrame:
    """Adds the significance marker to each term."""
    from monthlens.functions.text import stars
    return df.withColumn("terms", F.transform("terms", lambda t: t.withField("stars", stars(t["p"]))))
