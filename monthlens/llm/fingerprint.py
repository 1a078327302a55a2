"""Document fingerprints by locally consistent parsing.

A text is parsed in levels.  On each level runs of one symbol become blocks; deterministic
coin tossing (the place and value of the lowest bit in which a symbol differs from the one
before) shrinks neighbouring symbols to six colours, then three; a phrase begins at every
local maximum, so phrases have two to four symbols; and a phrase's name is a hash of its
symbols, the next level's symbol.  Where a phrase begins depends on a few symbols around it
alone, so equal substrings get equal phrases inside, wherever they stand.

The fingerprint of a text holds the ``KEEP`` smallest of its names of level ``LEVELS``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthlens.llm.common import binary_views, int_column, long_column, mix, ship

U64 = np.uint64
LEVELS, KEEP = 3, 64
#: Characters parsed at a time.
CHUNK = 1 << 20
_ODD = U64(0x9E3779B97F4A7C15)
NO = 9  # the colour beyond either end


def _toss_table() -> np.ndarray:
    """The label of (symbol, symbol before) for symbols below 128."""
    a, b = np.arange(128)[:, None], np.arange(128)[None, :]
    d = a ^ b
    low = np.bitwise_count((d & -d) - 1)
    return np.where(d == 0, 0, 2 * low + ((a >> low) & 1)).astype(np.uint8).ravel()


_TOSS = _toss_table()
# the smallest of three colours that neither neighbour has
_FREE = np.array([[min({0, 1, 2} - {a, b}) for b in range(10)] for a in range(10)], np.uint8)


def colours(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Colours 0, 1, 2 of symbols, no two neighbours alike; ``head``: first symbols of texts."""
    d = x[1:] ^ x[:-1]
    one = x.dtype.type(1)
    with np.errstate(over="ignore"):
        low = np.bitwise_count((d & (~d + one)) - one)
    label = np.empty(len(x), np.uint8)
    label[1:] = 2 * low + ((x[1:] >> low.astype(x.dtype)) & one).astype(np.uint8)
    first = np.flatnonzero(head)
    label[first] = (x[first] & one).astype(np.uint8)
    for _ in range(3):  # below 128, then 14, 8 and 6
        own = label[first] & 1
        label[1:] = _TOSS[(label[1:].astype(np.int16) << 7) | label[:-1]]
        label[first] = own
    last = np.append(first[1:] - 1, len(x) - 1)
    for c in (3, 4, 5):
        at = np.flatnonzero(label == c)
        left, right = label[at - 1], label[np.minimum(at + 1, len(x) - 1)]
        left = np.where(head[at], NO, left)
        ends = np.zeros(len(x), bool)
        ends[last] = True
        label[at] = _FREE[left, np.where(ends[at], NO, right)]
    return label


def level(x: np.ndarray, head: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of symbols x, and which of them begin a text."""
    same = np.zeros(len(x), bool)
    same[1:] = (x[1:] == x[:-1]) & ~head[1:]
    if same.any():
        at = np.flatnonzero(~same)
        size = np.diff(np.append(at, len(x)))
        wide = x[at].astype(U64)
        # a block is another symbol than its letter; it may not equal its neighbours by chance
        x = np.where(size > 1, mix(wide * _ODD + size.astype(U64)) | U64(1) << U64(63), wide)
        head = head[at]
    c = colours(x, head).astype(np.int8)
    before, after = np.empty_like(c), np.empty_like(c)
    before[1:], after[:-1] = c[:-1], c[1:]
    before[head] = -1
    ends = np.append(head[1:], True)
    after[ends] = -1
    start = head | ((c > before) & (c > after))
    at = np.flatnonzero(start)
    place = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
    power = _ODD ** np.arange(1, int(place.max()) + 2, dtype=U64)
    total = np.add.reduceat(mix(x.astype(U64) + U64(number)) * power[place], at)
    size = np.diff(np.append(at, len(x))).astype(U64)
    return mix(total + size * U64(number + 1)), head[at]


def parse(texts: list[str]) -> list[np.ndarray]:
    """Sorted fingerprint values of each text (none for the empty text)."""
    sizes = np.array([len(t) for t in texts])
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    head = np.zeros(len(x), bool)
    head[np.cumsum(sizes[full]) - sizes[full]] = True
    for k in range(LEVELS):
        x, head = level(x, head, k)
    names = (mix(x) >> U64(32)).astype(np.uint32)
    for k, part in zip(full.tolist(), np.split(names, np.flatnonzero(head)[1:])):
        out[k] = np.unique(part)[:KEEP]
    return out


def text_of(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of phrases that two texts have in common (Dice's coefficient, from the
    smallest values of both); two empty texts are alike."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    distinct = len(both) - len(twice)
    size = min(distinct, KEEP)
    if distinct > KEEP:
        edge = np.unique(both)[size - 1]
        twice = twice[twice <= edge]
    j = len(twice) / size
    return 2 * j / (1 + j)


def _batches(rows: Iterator) -> Iterator[list]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, copy, doc_id, text) in order to fingerprints; the rows of a bucket end
    with a copy of the row that follows the bucket."""

    def rows():
        for batch in batches:
            ids, null = long_column(batch.column("doc_id"))
            copy = batch.column("copy").to_pylist()
            for i, view in enumerate(binary_views(batch.column("text"))):
                yield ids[i], null[i], bytes(view).decode("utf-8", "replace"), copy[i]

    last = None  # (id, null, text, copy, values) of the row before
    for part in _batches(rows()):
        values = parse([r[2] for r in part])
        chain = ([] if last is None else [last]) + [(*r, v) for r, v in zip(part, values)]
        todo = [(a, b) for a, b in zip(chain, chain[1:]) if not a[3]]
        half = [len(a[2]) // 2 for a, _ in todo]
        edited = [a[2][: len(a[2]) - h] + b[2][:h] for (a, b), h in zip(todo, half)]
        prints = []
        for lo in range(0, len(edited), 256):
            prints += parse(edited[lo : lo + 256])
        yield pa.RecordBatch.from_arrays([
            int_column(np.array([a[0] for a, _ in todo], np.int64), np.array([a[1] for a, _ in todo], bool)),
            pa.array([len(a[2]) for a, _ in todo], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([text_of(a[4]) for a, _ in todo], pa.string()), pa.array([text_of(p) for p in prints], pa.string()),
            pa.array([likeness(a[4], p) for (a, _), p in zip(todo, prints)], pa.float64()),
            pa.array([likeness(a[4], b[4]) for a, b in todo], pa.float64())],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        last = chain[-1]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text of a row is its own with the last floor(n_chars / 2) code points replaced
    by the first as many (or all) of the next row, in the order of doc_id, then of text; the
    first row follows the last.  Null texts are empty; null ids come first; a row given twice
    follows itself, as does a single row.  Empty texts have the empty fingerprint.  Equal texts
    have equal fingerprints.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ranges of ids, as many as Spark deals out: a number for each goes through the driver
    ranks = [(k + 1) / parts for k in range(parts - 1)] or [1.0]
    bounds = np.unique(np.array(docs.agg(F.percentile_approx("doc_id", ranks)).first()[0] or [], np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        null = ids.isna().to_numpy()
        at = np.searchsorted(bounds, ids.fillna(0).to_numpy().astype(np.int64), side="left")
        return pd.Series(np.where(null, 0, at).astype(np.int32))

    if not len(bounds):  # no ids at all
        bucket = lambda c: F.lit(0)
    first = (docs.select("doc_id", bucket(F.col("doc_id")).alias("bucket")).groupBy("bucket")
             .agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("null")).orderBy("bucket").collect())  # a row for each range
    order = [r[0] for r in first]
    before = {b: order[k - 1] for k, b in enumerate(order)}  # the first range follows the last
    lows = {r[0]: None if r[2] else r[1] for r in first}
    ids = [x for x in lows.values() if x is not None]
    head = F.col("doc_id").isin(ids) if ids else F.lit(False)
    if any(x is None for x in lows.values()):
        head = head | F.col("doc_id").isNull()
    named = docs.filter(head).select("doc_id", "text", bucket(F.col("doc_id")).alias("bucket"))
    named = named.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("x"))
    to = F.create_map(*[F.lit(v) for kv in before.items() for v in kv])[F.col("bucket")] if before else F.lit(0)
    copies = named.select(to.alias("bucket"), F.lit(1).alias("copy"), "x.doc_id", "x.text")
    rows = docs.select(bucket(F.col("doc_id")).alias("bucket"), F.lit(0).alias("copy"), "doc_id", "text").unionAll(copies)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "copy", "doc_id", "text")
    return rows.mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
