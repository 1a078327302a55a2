"""Vector codes: each part of a vector is written as the index of its nearest codebook entry.

Components are integers.  A block of rows holds for each dimension the dictionary of the
integers that occur and, for each row, their places in it.  Against a codebook, the squared
differences of every distinct integer to all entries are tabulated once; the distances of all
rows are then sums of looked-up rows of those tables, and the sums for new entries are counts
of places times the dictionary.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthlens.llm.common import free, ship, stored, without

#: Rows of a block at most (places in a dictionary are 16-bit), and components.
ROWS, CELLS = 1 << 16, 1 << 22
BLOCK = "n int, codes binary, sizes array<int>, entries binary, wide boolean"
Codebooks = list[list[list[int]]]  # by part, entry and position within the part


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as int64 or, where that does not hold them, as Python's integers."""
    with np.errstate(over="ignore"):
        out = np.floor(values * float(scale))
    if np.abs(out).max(initial=0) < 2.0 ** 62:
        return out.astype(np.int64)
    # a double of 2**53 or more is an integer; scale is a power of two, so the product is exact below
    wide = [int(x) * scale if abs(x) >= 2.0 ** 53 else int(np.floor(x * scale)) for x in values.ravel().tolist()]
    return np.array(wide, object).reshape(values.shape)


class Block:
    """Rows of integers by dictionary: ``values[d]`` the distinct ones of dimension d, ascending,
    ``codes[d]`` each row's place in them."""

    def __init__(self, n: int, codes: list[np.ndarray], values: list[np.ndarray]):
        self.n, self.codes, self.values = n, codes, values

    @classmethod
    def of(cls, cells: np.ndarray) -> Block:
        values, codes = zip(*(np.unique(cells[:, d], return_inverse=True) for d in range(cells.shape[1]))) if cells.shape[1] else ((), ())
        return cls(len(cells), [c.astype("<u2") for c in codes], list(values))

    def row(self) -> dict:
        wide = any(v.dtype == object for v in self.values)
        entries = json.dumps([[int(x) for x in v] for v in self.values]).encode() if wide else b"".join(v.astype("<i8").tobytes() for v in self.values)
        return {"n": self.n, "codes": b"".join(c.tobytes() for c in self.codes), "sizes": [len(v) for v in self.values], "entries": entries, "wide": wide}

    @classmethod
    def read(cls, row: dict) -> Block:
        codes = np.frombuffer(row["codes"], "<u2").reshape(-1, row["n"])
        if row["wide"]:
            values = [np.array(v, object) for v in json.loads(row["entries"])]
        else:
            values = np.split(np.frombuffer(row["entries"], "<i8"), np.cumsum(row["sizes"])[:-1]) if row["sizes"] else []
        return cls(row["n"], list(codes), values)

    def wide(self, books: Codebooks) -> bool:
        """Whether distances could leave 64 bits."""
        most = max([0, *(abs(int(x)) for v in self.values if len(v) for x in (v[0], v[-1])), *(abs(x) for book in books for entry in book for x in entry)])
        return 4 * most * most * max(len(self.values), 1) * max(self.n, 1) >= 1 << 62

    def assign(self, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry of each part, lowest of equals; squared distance), parts by rows."""
        kind = object if self.wide(books) else np.int64
        best, error = [], []
        at = 0
        for book in books:
            entries = np.array(book, kind).reshape(len(book), len(book[0]))
            away = np.zeros((self.n, len(book)), kind)
            for d in range(entries.shape[1]):
                table = (self.values[at + d].astype(kind)[:, None] - entries[:, d][None, :]) ** 2
                away += table[self.codes[at + d]]
            at += entries.shape[1]
            nearest = away.argmin(1) if self.n else np.zeros(0, np.int64)
            best.append(nearest)
            error.append(away[np.arange(self.n), nearest])
        return np.array(best).reshape(len(books), self.n), np.array(error, kind).reshape(len(books), self.n)

    def sums(self, books: Codebooks) -> list[list[tuple[int, list[int]]]]:
        """By part and entry: the number of rows nearest to it, and the sums of their components."""
        best, _ = self.assign(books)
        kind = object if self.wide(books) else np.int64
        at, out = 0, []
        for book, nearest in zip(books, best):
            k, width = len(book), len(book[0])
            n = np.bincount(nearest, minlength=k)
            total = []
            for d in range(at, at + width):
                often = np.bincount(self.codes[d].astype(np.int64) * k + nearest, minlength=len(self.values[d]) * k).reshape(-1, k)
                total.append(self.values[d].astype(kind) @ often.astype(kind))
            at += width
            out.append([(int(n[e]), [int(t[e]) for t in total]) for e in range(k)])
        return out


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are, and are finite."""
    return F.coalesce(F.forall(F.col(f"`{vector}`").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def blocks(vectors: DataFrame, vector: str, dims: int, scale: int) -> DataFrame:
    """``rows`` (the other columns of the vectors of a block) and the block's dictionaries and
    codes: written once, for all rounds to read."""
    ship(vectors.sparkSession)
    others = [c for c in vectors.columns if c != vector]
    base = vectors.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{vector}`").cast("array<double>").alias(cells := free(vectors, "_cells")))
    held = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("_"))
    base = base.select(held.alias("row"), cells)
    schema = base.select(F.array("row").alias("rows")).schema
    schema = type(schema)([*schema.fields, *vectors.sparkSession.createDataFrame([], BLOCK).schema.fields])
    most = max(1, min(ROWS, CELLS // max(dims, 1)))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                n = part.num_rows
                block = Block.of(whole(part.column(cells).flatten().to_numpy(zero_copy_only=False).reshape(n, dims), scale)).row()
                rows = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column("row"))
                yield pa.RecordBatch.from_arrays([rows, pa.array([n], pa.int32()), pa.array([block["codes"]], pa.binary()), pa.array([block["sizes"]], pa.list_(pa.int32())),
                                                  pa.array([block["entries"]], pa.binary()), pa.array([block["wide"]])], schema.names)

    return stored(base.mapInArrow(body, schema))


def _blocks_of(batch: pa.RecordBatch) -> Iterator[Block]:
    for row in batch.select(["n", "codes", "sizes", "entries", "wide"]).to_pylist():
        yield Block.read(row)


def improved(packed: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, every used entry to the floor of its parts' mean."""
    sent = packed.sparkSession.sparkContext.broadcast(books)  # parts * entries * width numbers, at any input size
    schema = "part int, entry int, n long, total array<string>"

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for batch in batches:
            for block in _blocks_of(batch):
                for p, part in enumerate(block.sums(sent.value)):
                    for e, (n, total) in enumerate(part):
                        if n:
                            m, old = held.get((p, e), (0, [0] * len(total)))
                            held[p, e] = m + n, [x + y for x, y in zip(old, total)]
        rows = [{"part": p, "entry": e, "n": n, "total": [str(x) for x in total]} for (p, e), (n, total) in held.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.string()))]))

    def added(key, rows):  # a row from each task
        totals = [sum(map(int, column)) for column in zip(*rows["total"].to_pylist())]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "entry": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([sum(rows["n"].to_pylist())], pa.int64()),
                         "total": pa.array([[str(x) for x in totals]], pa.list_(pa.string()))})

    part = packed.select("n", "codes", "sizes", "entries", "wide").mapInArrow(body, schema)
    new = [[list(entry) for entry in book] for book in books]
    for r in part.groupBy("part", "entry").applyInArrow(added, schema).collect():  # a row for each entry
        new[r.part][r.entry] = [int(x) // r.n for x in r.total]
    return new


def first_books(vectors: DataFrame, key: str, vector: str, parts: int, entries: int, scale: int) -> tuple[int, Codebooks]:
    """(dimensions, codebooks): the parts of the vectors of the smallest keys."""
    first = vectors.select(F.col(f"`{key}`").alias("k"), F.col(f"`{vector}`").cast("array<double>").alias("v")).orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return 0, []
    dims = len(first[0].v)
    same = [r.v for r in first if len(r.v) == dims]
    cells = whole(np.array(same, np.float64).reshape(len(same), dims), scale)
    return dims, [[[int(x) for x in row] for row in part] for part in np.array_split(cells, parts, 1)]


def compress(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6,
             scale: int = 4096) -> tuple[DataFrame, Codebooks]:
    """(columns of vectors but the vector, with code binary and error long; the codebooks).

    Each component x is the integer floor(scale * x), with scale a power of two; vectors are cut
    into ``parts`` consecutive parts.  Each part has a codebook that starts as that part of the
    ``entries`` (at most 256) vectors of the smallest keys and is improved for ``rounds``
    rounds: every part goes to its nearest entry by squared distance (the lowest of equals),
    then each used entry becomes the floor of the mean of its parts.  ``code`` has a byte for each
    part, its entry's index; ``error`` is the squared distance summed over the parts.  All
    arithmetic is on whole numbers, so results do not depend on how rows are split.

    Vectors that are null or hold null or non-finite components are dropped.  Null keys come
    last in order, rows of equal keys by their vectors; rows given twice count twice.  Vectors of
    another length than that of the smallest key have null code and error and teach nothing; a
    length that ``parts`` does not divide makes the first parts one longer.  An error beyond 64
    bits is null.  An empty table gives an empty one, with empty codebooks.  Columns named like the
    new ones are replaced, others stay.
    """
    if not 0 < entries <= 256 or scale <= 0 or scale & (scale - 1):
        raise ValueError("entries must be 1 to 256 and scale a power of two")
    base = without(vectors, ["code", "error"]).filter(finite(vector))
    dims, books = first_books(base, key, vector, parts, entries, scale)
    others = [c for c in base.columns if c != vector]
    kept = base.select(*[F.col(f"`{c}`") for c in others])
    new = vectors.sparkSession.createDataFrame([], "code binary, error long").schema
    schema = type(new)([*kept.schema.fields, *new.fields])
    if not books:
        return vectors.sparkSession.createDataFrame([], schema), []
    size = F.size(f"`{vector}`")
    packed = blocks(base.filter(size == dims), vector, dims, scale)
    for _ in range(rounds):
        books = improved(packed, books)
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    n_others = len(others)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("rows")
            for k, block in enumerate(_blocks_of(batch)):
                best, error = block.assign(sent.value)
                code = np.ascontiguousarray(best.T.astype(np.uint8))
                total = [x if x < 1 << 63 else None for x in error.sum(0).tolist()]
                held = rows.slice(k, 1).flatten().flatten()[:n_others]
                yield pa.RecordBatch.from_arrays([*held, pa.array([bytes(c) for c in code], pa.binary()), pa.array(total, pa.int64())], schema.names)

    out = packed.mapInArrow(body, schema)
    odd = base.filter(size != dims).select(*[F.col(f"`{c}`") for c in others], F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return out.unionByName(odd), books


def decompressed(codes: DataFrame, books: Codebooks, *, scale: int = 4096) -> DataFrame:
    """The columns of codes plus vector array<double>: what each code stands for (the middle of
    its integers' intervals)."""
    book = F.lit(json.dumps([[[(x + 0.5) / scale for x in entry] for entry in part] for part in books]))
    entries = F.from_json(book, "array<array<array<double>>>")
    places = F.transform(F.sequence(F.lit(0), F.lit(max(len(books) - 1, 0))), lambda p: F.conv(F.hex(F.substring("code", p + 1, F.lit(1))), 16, 10).cast("int"))
    return codes.withColumn("vector", F.flatten(F.zip_with(entries, places, lambda part, e: F.get(part, e))))


def digest(books: Codebooks) -> str:
    """SHA-256 of all components as decimal integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()


def with_group_error(codes: DataFrame, group: str) -> DataFrame:
    """``codes`` plus <group>_error long: error summed over the rows of an equal group (nulls
    together; null where no row has an error or the sum is beyond 64 bits)."""
    rows = stored(codes)
    name, same, total = f"{group}_error", free(codes, "_group"), free(codes, "_total")
    sums = rows.groupBy(F.col(group).alias(same)).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias(total))
    joined = without(rows, [name]).join(sums, F.col(group).eqNullSafe(F.col(same)), "left")
    return joined.withColumn(name, F.col(total)).drop(same, total)
