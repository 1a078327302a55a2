"""Incremental, restartable results: append finished keys, skip them on rerun.

The batch job equivalent of a checkpointed stream. Every append is a folder ``commit=<id>`` of
its own, written by one Spark job; it counts once that job has committed (its ``_SUCCESS`` is
there), so what a lost job leaves behind is never read. Rows lie by ``partition_by`` below it, so a
reader that asks for one value reads that value's files alone. Readers keep the latest row of
each key, which makes appends idempotent. ``compact`` writes these rows as one commit and removes
the ones it replaces, so the store holds a row for each key however many rounds there were.

One application writes at a time.
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthlens.session import ensure_checkpoint_dir

#: Commits from which a store is compacted.
COMPACT_AT = 16


def default_path(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "incremental", f"{name}-{uuid.uuid4().hex[:8]}")


class IncrementalTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], order_col: str = "attempt", partition_by: str | None = None):
        self.spark, self.path, self.keys, self.order_col, self.partition_by = spark, path, keys, order_col, partition_by

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _below(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []

    def _has(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def commits(self) -> list[str]:
        """Folders of the appends that have been committed, oldest first."""
        names = [n for n in self._below(self.path) if n.startswith("commit=")]
        return [c for c in (os.path.join(self.path, n) for n in names) if self._has(os.path.join(c, "_SUCCESS"))]

    def values(self) -> list[str]:
        """The values of ``partition_by`` that the store has, from its folders alone."""
        head = f"{self.partition_by}="
        return sorted({n[len(head):] for c in self.commits() for n in self._below(c) if n.startswith(head)})

    def append(self, df: DataFrame) -> None:
        target = os.path.join(self.path, f"commit={time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
        w = df.write.mode("error")
        (w.partitionBy(self.partition_by) if self.partition_by else w).parquet(target)

    def read(self, schema: str | None = None) -> DataFrame | None:
        """The latest row of each key, None where nothing has been committed."""
        commits = self.commits()
        if not commits:
            return None
        r = self.spark.read.option("basePath", self.path)
        r = (r.schema(schema) if schema else r).parquet(*commits).drop("commit")
        rest = [c for c in r.columns if c not in self.keys]
        # grouped by key with a partial aggregate: each task sends its latest row of a key
        latest = r.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), self.order_col).alias("_l"))
        return latest.select(*self.keys, *[F.col(f"_l.{c}").alias(c) for c in rest]).select(*r.columns)

    def pending(self, work: DataFrame) -> DataFrame:
        """Rows of ``work`` whose key is not finished yet."""
        done = self.read()
        if done is None:
            return work
        return work.join(done.select(*self.keys), self.keys, "left_anti")

    def compact(self, schema: str | None = None, at: int = 2) -> bool:
        """From ``at`` commits on: one commit of the latest rows in place of them. DataFrames
        read before do not outlive it."""
        old = self.commits()
        if len(old) < at:
            return False
        self.append(self.read(schema))
        for c in old:
            fs, p = self._fs(c)
            fs.delete(p, True)
        return True
