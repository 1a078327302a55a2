"""Gram matrices of periods over packed feature columns: one matrix product a block, summed over tasks.

A task adds up the products of its blocks, so what it returns has the size of the periods squared, whatever the
number of features; those sums meet in two steps (``LANES`` a key, then the key), so no group grows with the
cluster by more than its root's order. No pair of cells, and no copy of a cell, is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthlens.operators.columns import pack, read_blocks
from monthlens.session import cut_lineage

#: First-level sums of a key.
LANES = 16
#: Doubles that a task adds up at a time.
HELD = 8_000_000
PART = "key int, lane int, total array<double>"


def packed(values: DataFrame, periods: DataFrame, size: int | None = None) -> DataFrame:
    """Blocks of all columns over the given months; proportional ones are not collapsed."""
    pp = periods.select(F.lit(0).cast("long").alias("pattern"), "period")
    return pack(values.select("period", "feature", "value"), pp, collapse=False, size=size)


def added(parts: DataFrame) -> DataFrame:
    """(key, total): element-wise sums of ``parts`` (PART) by key, lane by lane."""
    def add(key, rows):
        total = np.zeros(len(rows["total"][0]))
        for chunk in rows["total"].chunks:
            flat = chunk.flatten().to_numpy()
            total += flat.reshape(len(chunk), -1).sum(0)
        return pa.table({"key": pa.array([key[0].as_py()], pa.int32()), "lane": pa.array([0], pa.int32()), "total": pa.array([total], pa.list_(pa.float64()))})

    return parts.groupBy("key", "lane").applyInArrow(add, PART).groupBy("key").applyInArrow(add, PART).select("key", "total")


def _row(key: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([TaskContext.get().partitionId() % LANES], pa.int32()),
                                       pa.array([total.ravel()], pa.list_(pa.float64()))], ["key", "lane", "total"])


def gram(blocks: DataFrame, n: int, scale_on: np.ndarray | None = None) -> np.ndarray:
    """sum_j x_j x_j' / sigma_j^2 over the packed columns, each less its mean over the ``scale_on``
    months (all by default), with sigma_j the population std there; columns constant there
    are left out. Months squared; centring changes by nothing what is centred later."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            for _, block in read_blocks(batch, {0: n}):
                Z = block.Z
                if scale_on is not None:
                    X = block.X - block.X[scale_on].mean(0)
                    var, square = X[scale_on].var(0), (block.X[scale_on] ** 2).mean(0)
                    keep = var > 1e-12 * square
                    Z = X[:, keep] / np.sqrt(var[keep])
                total += Z @ Z.T
        yield _row(0, total)

    rows = added(blocks.mapInArrow(body, PART)).collect()
    return np.array(rows[0].total).reshape(n, n) if rows else np.zeros((n, n))


def expanding_grams(blocks: DataFrame, n: int, first: int) -> DataFrame:
    """(key, total): for each origin key in first..n-1 the Gram of rows 0..key, flattened, with the
    columns scaled by their population std over the rows before the origin (where that is zero, 1).

    The variances of all origins come from prefix sums over the months of a block; no cell is
    copied to an origin. Columns are taken less their first value, which changes no centred
    product. Origins are taken in runs whose products fit ``HELD`` doubles."""
    def of(origins: list[int]):
        def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {t: np.zeros((t + 1, t + 1)) for t in origins}
            for batch in batches:
                for _, block in read_blocks(batch, {0: n}):
                    X = block.X - block.X[0]
                    count = np.arange(1, n + 1)[:, None]
                    mean = np.cumsum(X, 0) / count
                    var = np.cumsum(X * X, 0) / count - mean * mean           # row t - 1: over rows before t
                    same = np.maximum.accumulate(X, 0) == np.minimum.accumulate(X, 0)
                    for t in origins:
                        weight = np.where(same[t - 1], 1.0, 1.0 / np.where(same[t - 1], 1.0, np.maximum(var[t - 1], 1e-300)))
                        total[t] += (X[:t + 1] * weight) @ X[:t + 1].T
            for t in origins:
                yield _row(t, total[t])
        return body

    out, run, held = None, [], 0
    for t in [*range(max(first, 1), n), None]:
        if t is None or (run and held + (t + 1) ** 2 > HELD):
            part = cut_lineage(added(blocks.mapInArrow(of(run), PART))) if run else None
            out = part if out is None else out.unionByName(part)
            run, held = [], 0
        if t is not None:
            run.append(t)
            held += (t + 1) ** 2
    return out
