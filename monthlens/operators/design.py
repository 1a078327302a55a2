"""Align feature sets with outcomes.

Month-level tables (periods, outcome series, per-outcome period patterns) have
one row per calendar month and outcome, so their size is bounded by the
calendar and the outcome count, never by the document volume; these are the
only sides broadcast here.

Standardisation (columns.pack) follows the population convention: mu = sum(x)/n,
sigma^2 = sum(x^2)/n - mu^2 over the n aligned months, with implicit zeros.
Features with zero variance over the aligned months get no column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthlens.operators.columns import pack
from monthlens.operators.vectorize import Features, kept


@dataclass
class Design:
    features: Features
    y: DataFrame         # outcome, period, y   (aligned months only)
    op: DataFrame        # outcome, pattern, n  (one row per outcome)
    pp: DataFrame        # pattern, period
    blocks: DataFrame    # packed columns of each pattern (columns.pack)


def align(features: Features, outcomes: DataFrame) -> DataFrame:
    """Inner join of outcome values with the feature set's months."""
    return outcomes.join(F.broadcast(features.periods), "period").select("outcome", "period", "y")


def patterns(y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes with the same aligned months share one pattern (moments are
    computed once per pattern, not once per outcome)."""
    p = (y.groupBy("outcome").agg(F.array_sort(F.collect_list("period")).alias("ps"))
          .withColumn("pattern", F.xxhash64("ps")))
    op = p.select("outcome", "pattern", F.size("ps").alias("n"))
    pp = p.select("pattern", F.explode("ps").alias("period")).distinct()
    return op, pp


def build_design(features: Features, outcomes: DataFrame) -> Design:
    """Aligned design, materialised once.

    The corpus-derived pieces (feature cells, packed columns) are written to the
    reliable checkpoint folder: every later job (screening, path rounds,
    optimality checks) reads them instead of re-tokenising the corpus,
    and executor loss cannot force a recompute from the raw text. Month-level
    tables are only cached."""
    fs = kept(features)                          # one pass over the corpus
    y = align(fs, outcomes).cache()
    op, pp = patterns(y)
    op, pp = op.cache(), pp.cache()              # month-level, derived from the cached y
    return Design(fs, y, op, pp, pack(fs.values, pp))
