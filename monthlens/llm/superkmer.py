"""Substring dedup by super-k-mers: repeated windows of words go, the earliest stays.

A window is ``window`` consecutive words of one document.  Consecutive windows that share a
minimiser form a super-k-mer, which travels as one packed string to the bucket of its
minimiser; there sorting tells equal windows, exactly, word by word (see ``windows``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthlens.llm import windows as W
from monthlens.llm.common import binary_views, int_column, long_column, mix, runs_of, ship, stored

U64 = np.uint64
WINDOW = 20
#: Words of an inner gram: long enough that grams seldom repeat by chance.
GRAM = 5
_BASE = U64(0x9E3779B97F4A7C15)


def words(view, grams: bool = True):
    """Canonical bytes (words joined by one space), word starts and ends, gram hashes.

    bytes.split() divides at 0x20 and 0x09-0x0D, as the pattern [^\\x20\\x09-\\x0D]+ does."""
    text = b" ".join(bytes(view).split())
    if not text:
        return text, np.array([], np.int64), np.array([], np.int64), None
    data = np.frombuffer(text, np.uint8)
    gap = np.flatnonzero(data == 32)
    start = np.concatenate([[0], gap + 1])
    end = np.append(gap, len(data))
    if not grams or len(start) < GRAM:
        return text, start, end, None
    return text, start, end, gram_hashes(word_hashes(data, start, end), GRAM)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start + 1
    size[-1] -= 1
    power = _BASE ** np.arange(int(size.max()) + 1, dtype=U64)
    place = np.arange(len(data)) - np.repeat(start, size)
    return mix(np.add.reduceat((data.astype(U64) + U64(1)) * power[place] * (data != 32), start))


def gram_hashes(word: np.ndarray, k: int) -> np.ndarray:
    n = len(word) - k + 1
    total = np.zeros(n, U64)
    for i in range(k):
        total = total * _BASE + word[i : i + n]
    return mix(total)


def sort_windows(window: int, shard: int):
    """Kernel: of equal windows of a shard all but the earliest are marked."""

    def kernel(rows: pa.Table) -> pa.RecordBatch:
        sid, flag, thash, span = (rows.column(i).to_numpy() for i in (0, 1, 3, 4))
        doc, null = long_column(rows.column(2).combine_chunks())
        key = pd.DataFrame({"a": sid, "b": doc, "c": null, "d": thash, "e": span})
        keep = np.flatnonzero(~key.duplicated().to_numpy())  # rows given twice
        strings = rows.column(5).to_pylist()
        strings = [strings[i] for i in keep.tolist()]
        sid, flag, thash, span, doc, null = (x[keep] for x in (sid, flag, thash, span, doc, null))
        first, n = span >> 32, span & 0xFFFFFFFF
        word, _ = pd.factorize(np.array(b" ".join(strings).split(b" "), object))
        # names of 1, 2, 4, ... words; two overlapping names tell a window
        name, size = word.astype(np.int64), 1

        def joined(a, b):
            return pd.factorize(a * (int(b.max()) + 1) + b)[0].astype(np.int64)

        while size * 2 <= window:
            name = joined(name[:-size], name[size:])
            size *= 2
        if size < window:
            name = joined(name[: -(window - size)], name[window - size :])
        base = np.concatenate([[0], np.cumsum(n + (window - 1))[:-1]])
        string = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
        name, at = name[base[string] + inner], first[string] + inner
        order = np.lexsort((at, thash[string], doc[string], ~null[string], name, sid[string]))
        head = np.ones(len(order), bool)
        head[1:] = (np.diff(name[order]) != 0) | (np.diff(sid[string[order]]) != 0)
        later = np.zeros(len(order), bool)
        later[order[~head]] = True
        # marked windows as runs within their string
        edge = np.zeros(len(later), bool)
        edge[np.cumsum(n)[:-1]] = True
        run, length = split_runs(later, edge)
        where = string[run]
        out = [(np.zeros(len(run), np.int64), np.zeros(len(run), np.int64), where, (at[run] << 32) | length, W.MARK)]
        # shards of a seed that has several tell each other what they hold
        many = pd.Series(sid).groupby(sid).transform("size").to_numpy() >= shard
        wide = np.flatnonzero(((flag > 0) | many)[string] & ~later)
        if len(wide):
            words_of = {}
            prints = np.empty((len(wide), 2), np.uint64)
            for k, (s, i) in enumerate(zip(string[wide].tolist(), inner[wide].tolist())):
                if s not in words_of:
                    words_of = {s: strings[s].split(b" ")}
                digest = xxhash.xxh3_128_intdigest(b" ".join(words_of[s][i : i + window]))
                prints[k] = digest >> 64, digest & 0xFFFFFFFFFFFFFFFF
            out.append((W.signed(prints[:, 0]), W.signed(prints[:, 1]), string[wide], (at[wide] << 32) | 1, W.FINGERPRINT))
        return found_batch(out, doc, null, thash)

    return kernel


def split_runs(mask: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of True that also end where ``edge`` is True (a new string begins)."""
    head = mask & (edge | ~np.concatenate([[False], mask[:-1]]))
    at = np.flatnonzero(head)
    last = mask & np.concatenate([edge[1:] | ~mask[1:], [True]])
    return at, np.flatnonzero(last) - at + 1


def found_batch(parts: list, doc, null, thash, shard=None) -> pa.RecordBatch:
    """FOUND rows of (sid, fp, string, span, kind) parts; flag: the string's shard."""
    sid, fp, row, span = (np.concatenate([p[i] for p in parts]) for i in range(4))
    kind = np.concatenate([np.full(len(p[0]), p[4], np.int32) for p in parts])
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(sid), pa.array(fp), pa.array(np.zeros(len(kind), np.int32) if shard is None else shard[row]), int_column(doc[row], null[row]), pa.array(thash[row]), pa.array(span)], W.FOUND_NAMES)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, shard: int = W.SHARD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (word ranges [first, past)) of each row.

    Each word covered by a window whose word sequence also starts earlier (smaller doc_id,
    or same document and earlier start) is removed; windows are judged on the input.

    ``shard``: strings of one minimiser that one kernel call compares; the result does not
    depend on it.

    Null and blank texts have no words.  A null doc_id counts as the smallest.  Rows with
    equal doc_id and text are one document given twice: each gets the same result.  Rows
    with equal doc_id and different texts are ordered by a hash of the text.  Other columns
    are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = W.found_runs(docs, lambda hot: W.local_runs(words, window, GRAM, hot, False), False, shard)
    packed = W.pack(docs, found, words, window).repartition("sid").sortWithinPartitions("sid")
    checked = stored(packed.mapInArrow(W.by_shard(sort_windows(window, shard)), W.FOUND))
    marks = found.unionAll(checked).filter(F.col("kind") == W.MARK).unionAll(W.merged(checked.filter(F.col("kind") == W.FINGERPRINT), False))
    return W.with_spans(docs, marks).mapInArrow(remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:int,past:int>>")


def remove(window: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha, spans = [], [], [], []
            for view, marks in zip(binary_views(batch.column(1)), batch.column(2).to_pylist()):
                text, start, _, _ = words(view, grams=False)
                gone, ranges = 0, []
                if marks and (mine := W.marks_of(marks, view)) is not None:
                    mask = W.marked_units(len(start), mine, window)
                    kept = text.split(b" ")
                    text = b" ".join([w for w, m in zip(kept, mask.tolist()) if not m])
                    gone = int(mask.sum())
                    at, size = runs_of(mask)
                    ranges = [{"first": a, "past": a + n} for a, n in zip(at.tolist(), size.tolist())]
                n_words.append(len(start))
                n_removed.append(gone)
                sha.append(hashlib.sha256(text).hexdigest())
                spans.append(ranges)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())])))], ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    return body
