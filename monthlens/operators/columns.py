"""Feature columns packed into blocks, so that a pass over all of them is a scan without a shuffle.

A block holds up to ``FEATURES`` columns over the aligned months of one pattern: who they are,
their non-zero cells, mean and scale.  Blocks are written once; their size follows from the
constants here, never from the cluster's settings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthlens.session import cut_lineage, ship_package

#: Columns of a block; a column has a cell for each month at most.
FEATURES = 4096
#: Columns whose variance is below this share of their mean square are constant.
CONSTANT = 1e-12
BLOCK = ("pattern long, features array<string>, class_size array<long>, ends array<int>, t array<int>, x array<double>, "
         "mu array<double>, sigma array<double>")


def month_index(pp: DataFrame) -> DataFrame:
    """(pattern, period, t, n): place of each month within its pattern (month-level)."""
    w = Window.partitionBy("pattern")
    return pp.select("pattern", "period", (F.row_number().over(w.orderBy("period")) - 1).alias("t"), F.count("*").over(w).cast("int").alias("n"))


def columns(values: DataFrame, pp: DataFrame, collapse: bool = True) -> DataFrame:
    """(pattern, n, feature, class_size, cells): one row for each column over a pattern's months.

    Columns that are positive multiples of each other there standardise alike; with
    ``collapse`` the alphabetically first stands for its class.  They are grouped by a
    128-bit digest of the column over its largest value, rounded to 12 digits.

    Cells meet by feature once, whatever the number of patterns: columns proportional over all
    months are so in each pattern, so only one of each such class is dealt out to the patterns."""
    months = pp.select("period").distinct().withColumn("t", F.row_number().over(Window.orderBy("period")) - 1)  # month-level
    cells = values.where(F.col("value") != 0).join(F.broadcast(months), "period")
    cols = cells.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("cells")).withColumn("class_size", F.lit(1).cast("long"))
    if collapse:
        cols = _classes(cols, [])
    # where each month of them all lies in a pattern
    patterns = pp.select("pattern").distinct()
    place = (months.withColumnRenamed("t", "every").crossJoin(F.broadcast(patterns)).join(month_index(pp), ["pattern", "period"], "left").groupBy("pattern")
                   .agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("every", "t"))), lambda x: x["t"]).alias("place")))
    own = F.transform(F.filter("cells", lambda x: F.get("place", x["t"]).isNotNull()), lambda x: F.struct(F.get("place", x["t"]).alias("t"), x["value"].alias("value")))
    cols = cols.crossJoin(F.broadcast(place)).select("pattern", "n", "feature", "class_size", own.alias("cells")).where(F.size("cells") > 0)
    # one pattern has all months
    return _classes(cols, ["pattern", "n"]) if collapse and patterns.count() > 1 else cols


def _classes(cols: DataFrame, keys: list[str]) -> DataFrame:
    """One column for each class of proportional ones, by ``keys``: class sizes summed, the first feature's cells."""
    most = F.array_max(F.transform("cells", lambda x: F.abs(x["value"])))
    shape = F.transform("cells", lambda x: F.struct(x["t"], F.rint(x["value"] / F.col("most") * 1e12).cast("long")))
    digest = F.struct(F.xxhash64(F.lit(0), "shape"), F.xxhash64(F.lit(1), "shape")).alias("digest")
    return (cols.withColumn("most", most).withColumn("shape", shape).select(*keys, "feature", "class_size", "cells", digest).groupBy(*keys, "digest")
                .agg(F.min("feature").alias("feature"), F.sum("class_size").alias("class_size"), F.min_by("cells", "feature").alias("cells"))
                .select(*keys, "feature", "class_size", "cells"))


def pack(values: DataFrame, pp: DataFrame, collapse: bool = True, standardise: bool = True, size: int | None = None) -> DataFrame:
    """Blocks of the columns of ``values`` (period, feature, value; zeros absent) over the months
    of each pattern.  Columns constant there are left out.  Without ``standardise`` the
    scale is 1 (values that were scaled before)."""
    ship_package(values.sparkSession)
    most = size or FEATURES

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            pattern = batch.column("pattern").to_numpy()
            for p in np.unique(pattern):
                own = batch.take(pa.array(np.flatnonzero(pattern == p)))
                for a in range(0, own.num_rows, most):
                    part = own.slice(a, most)
                    n, cells = part.column("n")[0].as_py(), part.column("cells")
                    length = cells.value_lengths().to_numpy()
                    flat = cells.flatten()
                    t, x = flat.field("t").to_numpy(), flat.field("value").to_numpy()
                    X = np.zeros((n, part.num_rows))
                    X[t, np.repeat(np.arange(part.num_rows), length)] = x
                    mu = X.mean(0)
                    var = X.var(0)
                    keep = var > CONSTANT * (X * X).mean(0)
                    if not keep.any():
                        continue
                    inside = np.repeat(keep, length)
                    kept = part.filter(pa.array(keep))
                    sigma = np.sqrt(var[keep]) if standardise else np.ones(int(keep.sum()))
                    one = lambda v, kind: pa.array([v], pa.list_(kind))
                    arrays = [pa.array([p], pa.int64()), one(kept.column("feature").to_pylist(), pa.string()), one(kept.column("class_size").to_pylist(), pa.int64()),
                              one(np.cumsum(length[keep]), pa.int32()), one(t[inside], pa.int32()), one(x[inside], pa.float64()), one(mu[keep], pa.float64()), one(sigma, pa.float64())]
                    schema = schema or ["pattern", "features", "class_size", "ends", "t", "x", "mu", "sigma"]
                    yield pa.RecordBatch.from_arrays(arrays, schema)

    return cut_lineage(columns(values, pp, collapse).mapInArrow(body, BLOCK))


class Block:
    """One block in a task: ``Z`` has its standardised columns, months by features."""

    def __init__(self, row: dict, n: int):
        self.features, self.class_size, self.mu, self.sigma = row["features"], row["class_size"], np.array(row["mu"]), np.array(row["sigma"])
        ends = np.array(row["ends"])
        self.X = np.zeros((n, len(self.features)))
        self.X[row["t"], np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))] = row["x"]
        self.Z = (self.X - self.mu) / self.sigma


def read_blocks(batch: pa.RecordBatch, months: dict[int, int]) -> Iterator[tuple[int, Block]]:
    """(pattern, block) of each row whose pattern is asked for; ``months``: months by pattern."""
    for k in range(batch.num_rows):
        pattern = batch.column("pattern")[k].as_py()
        if pattern in months:
            numbers = lambda name: batch.column(name)[k].values.to_numpy(zero_copy_only=False)
            row = {c: numbers(c) for c in ("ends", "t", "x", "mu", "sigma", "class_size")}
            yield pattern, Block(row | {"features": batch.column("features")[k].values.to_pylist()}, months[pattern])
