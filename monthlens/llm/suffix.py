"""Suffix-array dedup: bytes covered by a repeated string of ``window`` bytes are removed.

Shards are made by content, not by document: windows that share a minimiser lie in the
shards of that minimiser (see ``windows``), so that a repeat is found without comparing
every shard with every other.  In a shard the suffix array of the packed strings is built
by Larsson-Sadakane refinement, its common prefixes come by Kasai's rule, and neighbours
with a common prefix of ``window`` bytes are repeats.  A seed with more strings than one
shard takes has several; each ships its distinct windows as sorted fingerprints, and the
sorted lists are merged across shards by binary search.
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
from monthlens.llm.common import binary_views, long_column, mix, runs_of, ship, stored
from monthlens.llm.superkmer import found_batch, split_runs

U64 = np.uint64
WINDOW = 200
#: Bytes of an inner gram (4 * 8).
GRAM = 32
_ODD = U64(0x9E3779B97F4A7C15)


def words8(data: np.ndarray, big: bool) -> np.ndarray:
    """The 8 bytes from each position as one integer; zeros follow the end."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U64)
    for k in (1, 2, 4):
        a, b = x[:-k], x[k:]
        x = (a << U64(8 * k)) | b if big else a | (b << U64(8 * k))
    return x[: len(data)]


def bytes_of(view, grams: bool = True):
    """The text itself; each byte is a unit."""
    text = bytes(view)
    n = len(text)
    at = np.arange(n + 1)
    if not grams or n < GRAM:
        return text, at[:-1], at[1:], None
    x = words8(np.frombuffer(text, np.uint8), False)
    x *= _ODD
    x ^= x >> U64(29)
    for k in (8, 16):
        x = (x[:-k] + (x[k:] << U64(1))) * _ODD
        x ^= x >> U64(32)
    return text, at[:-1], at[1:], x[: n - GRAM + 1]


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes sorted by their first ``depth`` bytes at least, by Larsson-Sadakane refinement.

    Starts from the order by 8 bytes; each round sorts the groups that are still open by the
    rank of the suffix h further on, and doubles h.  Returns the array, for each place in it
    the h at which it parted from the place before (0: not parted), and the last h."""
    n = len(data)
    key = words8(data, True)
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    parted = np.zeros(n, np.int32)
    parted[0] = 1
    parted[1:][key[1:] != key[:-1]] = 1
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    starts = np.flatnonzero(parted)
    rank[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    h = 8
    while h < depth:
        open_ = parted == 0
        open_[:-1] |= open_[1:]  # the first place of a group with others
        at = np.flatnonzero(open_)
        if not len(at):
            break
        p = sa[at]
        key = rank[p] * (n + 2) + rank[np.minimum(p + h, n)] + 1
        order = np.argsort(key, kind="stable")
        p, key = p[order], key[order]
        head = np.ones(len(at), bool)
        head[1:] = key[1:] != key[:-1]
        fresh = head & (parted[at] == 0)
        sa[at] = p
        parted[at[fresh]] = h
        place = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        rank[p] = at[place]
        h *= 2
    return sa, parted, h


def prefixes_reach(data: np.ndarray, sa: np.ndarray, parted: np.ndarray, h: int, depth: int) -> np.ndarray:
    """For each place of the array: has it ``depth`` bytes in common with the place before?

    Places that never parted have; those that parted at some k share under 2k bytes.  The
    rest are decided by Kasai's rule: a suffix shares with the one before it at least one
    byte less than its left neighbour in the text did, so only the first of each stretch of
    text is compared byte by byte, and those of its followers the rule leaves open."""
    n = len(data)
    reach = parted == 0
    reach[0] = False
    some = np.flatnonzero(parted >= (depth + 1) // 2)
    some = some[some > 0]
    if not len(some):
        return reach
    i, j = sa[some], sa[some - 1]
    by_text = np.argsort(i)
    some, i, j = some[by_text], i[by_text], j[by_text]
    x = words8(data, False)

    def common(i, j, most):
        got = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        k = 0
        while len(live) and k < most:
            a, b = i[live] + k, j[live] + k
            inside = (a < n) & (b < n)
            differ = np.where(inside, x[np.minimum(a, n - 1)] ^ x[np.minimum(b, n - 1)], U64(1))
            low = differ & (~differ + U64(1))
            got[live] += np.where(differ == 0, 8, np.bitwise_count(low - U64(1)) // 8)
            live = live[differ == 0]
            k += 8
        return np.minimum(got, n - np.maximum(i, j))

    first = np.ones(len(i), bool)
    first[1:] = np.diff(i) != 1
    lead = np.flatnonzero(first)
    length = common(i[lead], j[lead], 2 * h)
    of = np.cumsum(first) - 1
    least = length[of] - (i - i[lead][of])
    sure = least >= depth
    sure[lead] = length >= depth
    rest = np.flatnonzero(~sure & ~first)
    if len(rest):
        sure[rest] = common(i[rest], j[rest], depth) >= depth
    reach[some] = sure
    return reach


def match_suffixes(window: int, shard: int):
    """Kernel: every window of a shard that another place of the shard starts too is marked."""

    def kernel(rows: pa.Table) -> pa.RecordBatch:
        sid, flag, thash, span = (rows.column(i).to_numpy() for i in (0, 1, 3, 4))
        doc, null = long_column(rows.column(2).combine_chunks())
        key = pd.DataFrame({"a": sid, "b": doc, "c": null, "d": thash, "e": span})
        keep = np.flatnonzero(~key.duplicated().to_numpy())  # rows given twice
        strings = rows.column(5).to_pylist()
        strings = [strings[i] for i in keep.tolist()]
        sid, flag, thash, span, doc, null = (x[keep] for x in (sid, flag, thash, span, doc, null))
        first, n = span >> 32, span & 0xFFFFFFFF
        data = np.frombuffer(b"".join(strings), np.uint8)
        sa, parted, h = suffix_array(data, window)
        reach = prefixes_reach(data, sa, parted, h, window)
        size = n + (window - 1)
        base = np.cumsum(size) - size
        valid = np.zeros(len(data) + 1, np.int32)
        valid[base] += 1
        valid[base + n] -= 1
        valid = np.cumsum(valid[:-1]) > 0
        group = np.cumsum(~reach)  # places with `window` bytes in common
        live = valid[sa]
        place, group = sa[live], group[live]
        count = np.bincount(group)
        again = np.zeros(len(data), bool)
        again[place[count[group] > 1]] = True
        string = np.repeat(np.arange(len(n)), size)
        edge = np.zeros(len(data), bool)
        edge[base] = True
        run, length = split_runs(again, edge)
        at = first[string] + np.arange(len(data)) - base[string]
        out = [(np.zeros(len(run), np.int64), np.zeros(len(run), np.int64), string[run], (at[run] << 32) | length, W.MARK)]
        many = pd.Series(sid).groupby(sid).transform("size").to_numpy() >= shard
        wide = (flag > 0) | many
        if wide.any():
            # one place for each distinct window of each wide shard
            own = place[wide[string[place]]]
            g = group[wide[string[place]]]
            pick = own[np.sort(np.unique(np.stack([g, pd.factorize(sid)[0][string[own]]]), axis=1, return_index=True)[1])]
            text = data.tobytes()
            prints = np.empty((len(pick), 2), U64)
            for k, p in enumerate(pick.tolist()):
                digest = xxhash.xxh3_128_intdigest(text[p : p + window])
                prints[k] = digest >> 64, digest & 0xFFFFFFFFFFFFFFFF
            out.append((W.signed(prints[:, 0]), W.signed(prints[:, 1]), string[pick], (at[pick] << 32) | 1, W.FINGERPRINT))
        return found_batch(out, doc, null, thash, (sid >> 33).astype(np.int32))

    return kernel


def dedup_bytes(docs: DataFrame, window: int = WINDOW, shard: int = W.SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (byte ranges) of each row.

    Every byte covered by a ``window``-byte string that also starts anywhere else, same
    document included, is removed; overlaps count; strings are judged on the input and never
    cross documents.

    ``shard``: strings of one minimiser that one suffix array takes; the result does not
    depend on it.

    A null text is empty.  A row given twice is two documents, so all its windows repeat.
    A null doc_id is an id like any other.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = W.found_runs(docs, lambda hot: W.local_runs(bytes_of, window, GRAM, hot, True), True, shard)
    packed = W.pack(docs, found, bytes_of, window).repartition("sid").sortWithinPartitions("sid")
    checked = stored(packed.mapInArrow(W.by_shard(match_suffixes(window, shard)), W.FOUND))
    marks = found.unionAll(checked).filter(F.col("kind") == W.MARK).unionAll(merged(checked.filter(F.col("kind") == W.FINGERPRINT)))
    return W.with_spans(docs, marks).mapInArrow(remove(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<first:int,past:int>>")


def merged(prints: DataFrame) -> DataFrame:
    """MARK rows of the windows that several shards hold.

    Each shard has sent its distinct windows.  They are dealt out and sorted by fingerprint;
    of every stretch each shard's part is a sorted list, and is looked up in the merged list
    of all shards by binary search: what stands there twice is held by another shard too."""
    rows = prints.repartition("sid").sortWithinPartitions("sid", "fp")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([batch] if held is None else [*held, batch])
            key = both.column("sid").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # equal fingerprints may go on in the next batch
            yield from look(both.slice(0, whole))
            held = both.slice(whole).to_batches()
        if held is not None:
            yield from look(pa.Table.from_batches(held))

    def look(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        key = np.empty(rows.num_rows, [("hi", "<i8"), ("lo", "<i8")])
        key["hi"], key["lo"] = rows.column("sid").to_numpy(), rows.column("fp").to_numpy()
        # names of equal fingerprints, in their order
        name = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        shard = rows.column("flag").to_numpy()
        again = np.zeros(len(name), bool)
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            again[own] = np.searchsorted(name, name[own], "right") - np.searchsorted(name, name[own], "left") > 1
        table = rows.filter(pa.array(again)).combine_chunks()
        n = table.num_rows
        if n:
            zero = pa.array(np.zeros(n, np.int64))
            none = zero.cast(pa.int32())
            at = [table.column(c).combine_chunks() for c in ("doc_id", "thash", "span")]
            yield pa.RecordBatch.from_arrays([none, zero, zero, none, *at], W.FOUND_NAMES)

    return rows.mapInArrow(body, W.FOUND)


def remove(window: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, sha, spans = [], [], [], [], []
            for view, marks in zip(binary_views(batch.column(1)), batch.column(2).to_pylist()):
                text, gone, ranges = bytes(view), 0, []
                if marks and (mine := W.marks_of(marks, view)) is not None:
                    mask = W.marked_units(len(text), mine, window)
                    text = np.frombuffer(text, np.uint8)[~mask].tobytes()
                    at, size = runs_of(mask)
                    gone = int(mask.sum())
                    ranges = [{"first": a, "past": a + n} for a, n in zip(at.tolist(), size.tolist())]
                n_bytes.append(len(view))
                n_removed.append(gone)
                n_spans.append(len(ranges))
                sha.append(hashlib.sha256(text).hexdigest())
                spans.append(ranges)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, long), pa.array(n_removed, long), pa.array(n_spans, long), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())])))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return body
