"""Helpers shared by the operators: table access, Arrow column views, shared-folder tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthlens.session import cut_lineage, ship_package

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Written to and reread from the shared checkpoint folder: survives lost executors."""
    return cut_lineage(df)


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have: ``name``, or with underscores before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns of those names, in whatever case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def ship(spark: SparkSession) -> None:
    ship_package(spark)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, mod ``n`` (null id: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def fold_of(doc_id, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mix (splitmix64), vectorised."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def binary_views(col: pa.Array) -> list[memoryview]:
    """Zero-copy views of the values of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4))
    if data is None:
        return [memoryview(b"")] * len(col)
    view = memoryview(data)
    at = at.tolist()
    out = [view[a:b] for a, b in zip(at, at[1:])]
    if col.null_count:
        empty = memoryview(b"")
        out = [empty if null else v for v, null in zip(out, col.is_null().to_pylist())]
    return out


def long_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """int64 values (null as 0) and the null mask."""
    null = col.is_null().to_numpy(zero_copy_only=False)
    return col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False), null


def int_column(values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(values, pa.int64(), mask=null) if null is not None and null.any() else pa.array(values, pa.int64())


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def signed64(x: int) -> int:
    """An unsigned 64-bit integer as Spark's long."""
    return x - (1 << 64) if x >> 63 else x


def with_text_hash(docs: DataFrame, name: str) -> DataFrame:
    """docs and, as ``name``, the 64-bit hash (xxh3) of the text."""
    ship(docs.sparkSession)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [signed64(xxhash.xxh3_64_intdigest(v)) for v in binary_views(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], [*batch.schema.names, name])

    return docs.mapInArrow(body, docs.select("*", F.lit(0).cast("long").alias(name)).schema)
