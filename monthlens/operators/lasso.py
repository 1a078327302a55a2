"""Lasso paths for many outcomes over a long, sparse feature table.

Objective per outcome (columns standardised over the aligned months):
    min_b (1/2n) ||y - Z b||^2 + alpha ||b||_1      (no intercept; Z centred)

The whole grid is solved, whatever the number of features (never collects the feature matrix):

1. Columns are packed into blocks over the aligned months (columns.pack), once.
2. Each outcome has a working set of columns; it starts with the best scores at the outcome itself.
   In a grouped Arrow task its path is solved exactly on that set (homotopy; every grid
   point checked on the set's columns, and solved anew where ties made it miss an entry).
3. A pass over all blocks scores every column against the residuals of all points that
   are not certified yet. A point without a column whose |z_j' r|/n exceeds alpha is certified: it
   is optimal over all features, and stays so as sets grow. Of the columns that breach
   a point, the ``ENTER`` worst join its outcome's set (each task keeps its worst ones, and the
   worst of these are taken), and outcomes with open points go back to step 2.

Each round certifies a point or adds a column, so the loop ends with every grid point
certified; how many columns enter at a time decides the rounds alone. What goes through the
driver is month-level: residuals (outcomes x months x grid) and the names of the working sets.
"""

from __future__ import annotations

import os
import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthlens.functions.stats import lasso_path_checked
from monthlens.functions.text import log_grid
from monthlens.operators.columns import read_blocks
from monthlens.operators.design import Design
from monthlens.session import cut_lineage, ship_package

PATH_SCHEMA = "outcome string, alpha_idx int, alpha double, nnz int, features array<string>, coefs array<double>, resid array<double>"
COLUMN_SCHEMA = "outcome string, feature string, class_size long, x array<double>, mu double, sigma double"
#: Columns that enter an outcome's working set for each grid point that they breach.
ENTER = 32
#: A score may exceed alpha by this share of it.
TOLERANCE = 1e-6


@dataclass
class LassoPath:
    design: Design
    alphas: list[float]
    coefs: DataFrame   # outcome, alpha_idx, alpha, feature, coef   (non-zero only)
    nnz: DataFrame     # outcome, alpha_idx, alpha, nnz             (every grid point)
    rounds: int
    columns: DataFrame | None = None   # outcome, feature, class_size, x, mu, sigma   (working sets; x over the months in order)

    def on(self, alphas: list[float]) -> LassoPath:
        """The path at those of its grid points alone."""
        wanted = set(alphas)
        places = [i for i, a in enumerate(self.alphas) if a in wanted]
        keep = F.col("alpha_idx").isin(*places)
        return LassoPath(self.design, self.alphas, self.coefs.where(keep), self.nnz.where(keep), self.rounds, self.columns)

    def cells(self) -> DataFrame:
        """(period, feature, value) of the columns in working sets."""
        months = self.design.y.groupBy("outcome").agg(F.array_sort(F.collect_list("period")).alias("ps"))
        pairs = F.explode(F.arrays_zip(F.col("ps").alias("period"), F.col("x").alias("value"))).alias("c")
        return (self.columns.join(F.broadcast(months), "outcome").select("feature", pairs)
                    .select("c.period", "feature", "c.value").where(F.col("value") != 0).distinct())


def _solver(alphas: list[float]):
    grid = np.asarray(alphas, dtype=float)

    def fit(key, cols: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        yv = ys.sort_values("period")["y"].to_numpy(dtype=float)
        cols = cols.sort_values("feature")
        names = cols["feature"].to_numpy()
        Z = np.zeros((len(yv), 0))
        if len(cols):
            Z = (np.vstack(cols["x"].to_numpy()).T - cols["mu"].to_numpy(dtype=float)) / cols["sigma"].to_numpy(dtype=float)
        coefs, resids = lasso_path_checked(Z, yv, grid, tol=TOLERANCE)
        rows = []
        for i in range(len(grid)):
            nz = np.flatnonzero(coefs[i])
            rows.append((key[0], i, float(grid[i]), len(nz), names[nz].tolist(), coefs[i, nz].tolist(), resids[i].tolist()))
        return pd.DataFrame(rows, columns=["outcome", "alpha_idx", "alpha", "nnz", "features", "coefs", "resid"])
    return fit


def _column(block, j: int) -> tuple:
    return block.features[j], int(block.class_size[j]), block.X[:, j].tolist(), float(block.mu[j]), float(block.sigma[j])


def _worst(blocks: DataFrame, points: dict, months: dict[int, int], known: dict[str, set[str]], enter: int, least: float) -> DataFrame:
    """Columns outside the known ones with the largest |z_j' r| / (n alpha), over ``least``, of each
    point: (COLUMN_SCHEMA, hits array of (point, ratio)), the ``enter`` worst of each task.

    points: pattern -> (outcome of each column of R, its place in the grid, R scaled by n alpha)."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast((points, {p: months[p] for p in points}, known))
    schema = COLUMN_SCHEMA + ", hits array<struct<point:int,ratio:double>>"

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, months, known = sent.value
        held: dict[int, tuple] = {}    # pattern -> ratios (points x kept), columns, what a column must beat for each point
        for batch in batches:
            for pattern, block in read_blocks(batch, months):
                outcomes, _, R = points[pattern]
                ratio = np.abs(R.T @ block.Z)                       # points x features
                for outcome in set(outcomes):
                    inside = [j for j, f in enumerate(block.features) if f in known.get(outcome, ())]
                    if inside:
                        ratio[np.ix_(np.array(outcomes) == outcome, inside)] = 0.0
                # a column matters where it beats the worst ones held so far for some point
                beats = held[pattern][2] if pattern in held else np.full(len(ratio), least)
                new = np.flatnonzero((ratio > beats[:, None]).any(0))
                if not len(new):
                    continue
                both = ratio[:, new]
                cols = [(block, j) for j in new.tolist()]
                if pattern in held:
                    both = np.concatenate([held[pattern][0], both], axis=1)
                    cols = held[pattern][1] + cols
                if both.shape[1] > enter:
                    top = np.argpartition(-both, enter - 1, axis=1)[:, :enter]
                    beats = np.maximum(np.take_along_axis(both, top, 1).min(1), least)
                    stay = np.unique(top[np.take_along_axis(both, top, 1) > least])
                    both, cols = both[:, stay], [cols[j] for j in stay]
                else:
                    beats = np.full(len(ratio), least)
                # only the columns that stay are kept, not their blocks
                held[pattern] = (both, [c if len(c) == 5 else _column(*c) for c in cols], beats)
        rows = []
        for pattern, (ratio, cols, _) in held.items():
            outcomes = np.array(points[pattern][0])
            for outcome in dict.fromkeys(outcomes.tolist()):
                own = np.flatnonzero(outcomes == outcome)
                for j, (feature, size, x, mu, sigma) in enumerate(cols):
                    hits = [{"point": int(k), "ratio": float(ratio[k, j])} for k in own if ratio[k, j] > least]
                    if hits:
                        rows.append({"outcome": outcome, "feature": feature, "class_size": size, "x": x, "mu": mu, "sigma": sigma, "hits": hits})
        kinds = pa.schema([("outcome", pa.string()), ("feature", pa.string()), ("class_size", pa.int64()), ("x", pa.list_(pa.float64())), ("mu", pa.float64()), ("sigma", pa.float64()),
                           ("hits", pa.list_(pa.struct([("point", pa.int32()), ("ratio", pa.float64())])))])
        yield pa.RecordBatch.from_pylist(rows, kinds)

    return blocks.mapInArrow(body, schema)


def _entering(found: DataFrame, enter: int) -> DataFrame:
    """Of the tasks' worst columns, the ``enter`` worst of each point of an outcome."""
    from pyspark.sql import Window
    w = Window.partitionBy("outcome", "h.point").orderBy(F.desc("h.ratio"), "feature")
    names = (found.select("outcome", "feature", F.explode("hits").alias("h")).withColumn("rank", F.row_number().over(w))
                  .where(F.col("rank") <= enter).select("outcome", "feature").distinct())
    return found.drop("hits").join(names, ["outcome", "feature"], "left_semi")


def largest_scores(d: Design, m: int = 1) -> DataFrame:
    """(outcome, feature, score): the ``m`` columns of each outcome with the largest |z_j' (y - mean)| / n."""
    pattern = {r.outcome: r.pattern for r in d.op.select("outcome", "pattern").collect()}
    series = {o: g.sort_values("period")["y"].to_numpy(dtype=float) for o, g in d.y.toPandas().groupby("outcome")}
    points: dict = {}
    for o, y in series.items():
        points.setdefault(pattern[o], []).append((o, (y - y.mean()) / len(y)))
    months = {pattern[o]: len(y) for o, y in series.items()}
    points = {p: ([x[0] for x in v], [0] * len(v), np.array([x[1] for x in v]).T) for p, v in points.items()}
    from pyspark.sql import Window
    w = Window.partitionBy("outcome").orderBy(F.desc("score"), "feature")
    found = _worst(d.blocks, points, months, {}, m, 0.0).select("outcome", "feature", F.explode("hits.ratio").alias("score"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m).drop("rank")


def lasso_path(d: Design, alphas: list[float] | None = None, m_init: int = 128, enter: int = ENTER,
               max_rounds: int = 1000) -> LassoPath:
    """Every grid point of every outcome, each certified over all features."""
    alphas = sorted(alphas if alphas is not None else log_grid(-6, 1, 200), reverse=True)
    spark = d.y.sparkSession
    ship_package(spark)
    grid = np.asarray(alphas, dtype=float)
    pattern = {r.outcome: (r.pattern, r.n) for r in d.op.select("outcome", "pattern", "n").collect()}
    months = {p: n for p, n in pattern.values()}
    # the outcomes themselves as residuals: the columns with the largest scores start the sets
    series = {o: g.sort_values("period")["y"].to_numpy(dtype=float) for o, g in d.y.toPandas().groupby("outcome")}
    resid = {(o, 0): y - y.mean() for o, y in series.items()}
    scale = {(o, 0): len(y) * max(float(np.abs(y - y.mean()).max()), 1e-300) for o, y in series.items()}
    known: dict[str, set[str]] = {}
    sets, ended, rounds = None, [], 0
    todo = {o: set(range(len(grid))) for o in series}
    first = True
    debug = os.environ.get("MONTHLENS_DEBUG")
    while todo:
        t0 = time.time()
        points: dict = {}
        for (o, i), r in resid.items():
            points.setdefault(pattern[o][0], []).append((o, i, r / (scale[o, i] if first else len(r) * grid[i])))
        points = {p: ([x[0] for x in v], [x[1] for x in v], np.array([x[2] for x in v]).T) for p, v in points.items()}
        worst = cut_lineage(_worst(d.blocks, points, months, known, m_init if first else enter, 0.0 if first else 1 + TOLERANCE))
        found = cut_lineage(_entering(worst, m_init if first else enter))
        names = found.select("outcome", "feature").collect()      # bounded by the points that are open
        if not first:
            hit = worst.select("outcome", F.explode("hits.point").alias("point")).distinct().collect()
            breached: dict[str, set[int]] = {}
            for r in hit:
                breached.setdefault(r.outcome, set()).add(points[pattern[r.outcome][0]][1][r.point])
            todo = breached
        if debug:
            print(f"[lasso] round {rounds}: pass {time.time() - t0:.1f}s points {len(resid)} open {sum(map(len, todo.values()))} new {len(names)}", file=sys.stderr, flush=True)
        first = False
        if not todo:
            break
        for r in names:
            known.setdefault(r.outcome, set()).add(r.feature)
        sets = found if sets is None else cut_lineage(sets.unionByName(found))
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError("the Lasso path did not converge")
        t0 = time.time()
        is_open = F.col("outcome").isin(*todo)
        # little data and much work: dealt by a number of partitions that is not coalesced by size
        lanes = 2 * len(todo)
        path = cut_lineage(sets.where(is_open).repartition(lanes, "outcome").groupBy("outcome")
                               .cogroup(d.y.where(is_open).repartition(lanes, "outcome").groupBy("outcome"))
                               .applyInPandas(_solver(alphas), PATH_SCHEMA))
        ended = [(df, outs - set(todo)) for df, outs in ended] + [(path, set(todo))]
        rows = path.where(F.col("nnz") > 0).select("outcome", "alpha_idx", "resid").toPandas()
        # certified points stay so; above the largest score, which the set has, nothing is active
        resid = {(o, int(i)): np.asarray(r) for o, i, r in zip(rows["outcome"], rows["alpha_idx"], rows["resid"]) if i in todo[o]}
        if debug:
            print(f"[lasso] round {rounds}: path {time.time() - t0:.1f}s sets {sum(map(len, known.values()))} largest {max(map(len, known.values()))}", file=sys.stderr, flush=True)
        if not resid:
            break
    solved = None
    for df, outs in ended:
        if outs:
            part = df.where(F.col("outcome").isin(*outs))
            solved = part if solved is None else solved.unionByName(part)
    if solved is None:
        raise ValueError("no outcome has aligned months")
    pairs = F.explode(F.arrays_zip(F.col("features").alias("feature"), F.col("coefs").alias("coef"))).alias("c")
    coefs = solved.select("outcome", "alpha_idx", "alpha", pairs).select("outcome", "alpha_idx", "alpha", "c.feature", "c.coef")
    return LassoPath(d, alphas, coefs, solved.select("outcome", "alpha_idx", "alpha", "nnz"), rounds, sets)


def select_k(path: LassoPath, ks: list[int]) -> DataFrame:
    """Grid point per (outcome, k): the smallest alpha whose support has exactly
    k features; otherwise the first grid point (largest alpha) whose support
    size is closest to k. -> (outcome, k, alpha_idx, alpha, nnz)"""
    from pyspark.sql import Window
    k = F.col("k")
    w = Window.partitionBy("outcome", "k").orderBy(
        F.abs(F.col("nnz") - k), F.when(F.col("nnz") == k, F.col("alpha")).otherwise(-F.col("alpha")))
    return (path.nnz.withColumn("k", F.explode(F.array(*[F.lit(int(x)) for x in ks])))
                .withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r"))


def exact_k_points(path: LassoPath) -> DataFrame:
    """For every support size k > 0 on the path, the smallest alpha with it."""
    from pyspark.sql import Window
    w = Window.partitionBy("outcome", "nnz").orderBy("alpha")
    return (path.nnz.where(F.col("nnz") > 0).withColumn("_r", F.row_number().over(w))
                .where(F.col("_r") == 1).select("outcome", F.col("nnz").alias("k"), "alpha_idx", "alpha", "nnz"))


def selected_features(path: LassoPath, picks: DataFrame) -> DataFrame:
    """Features with non-zero coefficients at the picked grid points.
    -> picks' columns + feature, coef"""
    return picks.join(path.coefs.select("outcome", "alpha_idx", "feature", "coef"), ["outcome", "alpha_idx"])
