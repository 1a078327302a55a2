"""Windows that travel together: runs of consecutive windows sharing a minimiser.

Two operators remove repeated windows (of words, of bytes).  Both go the same way:

1. ``runs``      each document is cut into runs: maximal stretches of consecutive
                 windows whose minimiser (smallest hash of an inner gram) has the same
                 value, the *seed*.  Equal windows have equal seeds, so they lie in runs
                 of the same seed, whatever surrounds them.  A run is known by its seed,
                 the hash of its packed string, and where it lies.
2. ``scan``      the runs are dealt out by seed and sorted.  Runs with equal strings
                 repeat as a whole.  Only where a seed has two different strings (or one
                 that repeats inside itself) must the content be looked at: those runs,
                 one for each distinct string, are *checks*.
3. ``pack``      the checks get their packed strings from the documents.
4. a kernel      (sorting of windows, or suffix arrays) compares the windows of a shard;
                 a shard has at most ``SHARD`` strings of one seed.
5. ``spans_by_document``  what is marked goes back to its document.

Seeds that very many documents share are known from a sample of documents, which decides
nothing but how their runs are spread: they are salted over several tasks.  Shards of one
seed exchange 128-bit fingerprints of their distinct windows (``fingerprint`` rows) and so
lose no match.  Strings of one seed are told apart by a 64-bit hash, so two windows are
taken as equal unseen only if two 64-bit hashes (seed, string) collide at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthlens.llm.common import binary_views, int_column, long_column, mix, stored, with_text_hash

U64 = np.uint64
TOP = U64(0xFFFFFFFFFFFFFFFF)
#: Most strings of one seed that one kernel call compares directly.
SHARD = 4096
#: Documents in the sample that finds the seeds to salt; a seed in this share of it is salted.
SAMPLE_DOCS, HOT_SHARE, SALTS = 4000, 0.004, 64

RUN = "pk long, seed long, shash long, doc_id long, thash long, span long, flag int"
SELF, MULTI, HOT = 1, 2, 4
FOUND = "kind int, sid long, fp long, flag int, doc_id long, thash long, span long"
MARK, CHECK, FINGERPRINT = 0, 1, 2


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each w consecutive entries: block prefix and suffix minima."""
    n = len(a) - w + 1
    if w == 1:
        return a
    b = np.concatenate([a, np.full(-len(a) % w, TOP)]).reshape(-1, w)
    before = np.minimum.accumulate(b, axis=1).ravel()
    after = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def cut(grams: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``w`` grams: seed, first window, number of windows, and whether the
    seed stands at two places of the run, without which no window can repeat inside it."""
    low = sliding_min(grams, w)
    first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    n = np.diff(np.append(first, len(low)))
    # the largest minimum of the windows over a gram tells whether the gram is ever a minimum
    padded = np.concatenate([np.zeros(w - 1, U64), low, np.zeros(w - 1, U64)])
    at = np.flatnonzero(~sliding_min(~padded, w) == grams)
    twice = np.concatenate([[0], np.cumsum((grams[at[1:]] == grams[at[:-1]]) & (at[1:] - at[:-1] <= w))])
    lo = np.searchsorted(at, first)
    hi = np.searchsorted(at, first + n - 1 + w) - 1
    inside = (hi > lo) & (twice[np.maximum(hi, 0)] > twice[np.minimum(lo, len(twice) - 1)])
    return low[first], first, n, inside


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)


def local_runs(units: Callable, window: int, gram: int, hot: np.ndarray, everywhere: bool) -> Callable:
    """mapInArrow body: (doc_id, text) to RUN rows plus finished MARK rows (pk null).

    ``units(view)`` returns (canonical bytes, starts of units, ends of units, gram hashes);
    ``everywhere``: a repeat marks all its places, else all but the earliest."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, null = long_column(batch.column("doc_id"))
            parts, rows, counts, thash = [], [], [], []
            for row, view in enumerate(binary_views(batch.column("text"))):
                text, start, end, grams = units(view)
                if len(start) < window:
                    continue
                seed, first, n, inside = cut(grams, window - gram + 1)
                string = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(start[first].tolist(), end[first + n + (window - 2)].tolist())]
                parts.append((seed, np.array(string, U64), (first.astype(np.int64) << 32) | n, inside))
                rows.append(row)
                counts.append(len(n))
                thash.append(xxhash.xxh3_64_intdigest(view))
            if not parts:
                continue
            seed, string, span, inside = (np.concatenate(x) for x in zip(*parts))
            row = np.repeat(np.array(rows), counts)
            doc, no_doc, whole = ids[row], null[row], np.repeat(signed(np.array(thash, U64)), counts)
            # what repeats within this batch is told at once; one row for each string goes on
            order = np.lexsort((span, whole, doc, ~no_doc, string, seed))
            seed, string, span, inside, doc, no_doc, whole = (x[order] for x in (seed, string, span, inside, doc, no_doc, whole))
            head = np.ones(len(seed), bool)
            head[1:] = (seed[1:] != seed[:-1]) | (string[1:] != string[:-1])
            copies = np.diff(np.append(np.flatnonzero(head), len(head)))
            marked = np.repeat(copies > 1, copies) if everywhere else ~head
            if not everywhere:  # a row given twice is no earlier than itself
                f = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
                marked &= ~((doc == doc[f]) & (no_doc == no_doc[f]) & (whole == whole[f]) & (span == span[f]))
            flag = inside * SELF
            is_hot = np.isin(seed, hot)
            pk = seed ^ np.where(is_hot, mix(string % U64(SALTS) + U64(1)), U64(0))
            flag = flag | is_hot * HOT
            flag[head] |= (copies > 1) * MULTI
            keep = np.flatnonzero(head)
            say = np.flatnonzero(marked)

            def out(at, pks, kinds):
                return [pks, pa.array(signed(seed[at])), pa.array(signed(string[at])), int_column(doc[at], no_doc[at]), pa.array(whole[at]), pa.array(span[at]), pa.array(kinds.astype(np.int32))]

            yield pa.RecordBatch.from_arrays(out(keep, pa.array(signed(pk[keep])), flag[keep]), NAMES)
            if len(say):
                yield pa.RecordBatch.from_arrays(out(say, pa.nulls(len(say), pa.int64()), flag[say] * 0), NAMES)

    return body


NAMES = [x.split()[0] for x in RUN.split(", ")]
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def hot_seeds(docs: DataFrame, body: Callable, rows: int) -> np.ndarray:
    """Seeds in more than HOT_SHARE of a sample of documents (so 1 / HOT_SHARE seeds per
    run of a document at most); what is not found here is merely not salted."""
    least = max(8, int(HOT_SHARE * min(rows, SAMPLE_DOCS)))
    sample = docs.sample(min(1.0, SAMPLE_DOCS / max(rows, 1)), seed=7)
    found = (sample.mapInArrow(body(np.array([], U64)), RUN).groupBy("seed")
             .agg(F.count_distinct("doc_id").alias("n")).filter(F.col("n") >= least)
             .orderBy(F.desc("n"), "seed").limit(65536).select("seed").collect())
    return np.array([r[0] for r in found], np.int64).view(U64)


def scan(everywhere: bool, most: int) -> Callable:
    """mapInArrow body over RUN rows sorted by (pk, seed, shash, doc_id, thash, span).

    Emits MARK rows for runs whose whole string repeats and CHECK rows for the first run of
    each string that must be compared, ``most`` strings of a seed to a shard.  One row is carried from batch to batch, so a seed
    may have any number of rows."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # the first row of the last string, and what is known of it

        def work(cols, last: bool):
            nonlocal carry
            pk, seed, shash, doc, null, thash, span, flag = cols
            seen = earlier = False
            ordinal = 0
            if carry is not None:
                row, seen, earlier, ordinal = carry
                pk, seed, shash, doc, null, thash, span, flag = (np.concatenate([a, b]) for a, b in zip(row, cols))
            if not len(pk):
                return None
            new_pk = np.ones(len(pk), bool)
            new_pk[1:] = (pk[1:] != pk[:-1]) | (seed[1:] != seed[:-1])
            head = new_pk.copy()
            head[1:] |= shash[1:] != shash[:-1]
            at = np.flatnonzero(head)
            size = np.diff(np.append(at, len(pk)))
            group = np.cumsum(head) - 1
            if everywhere:
                many = (size > 1) | ((flag[at] & MULTI) > 0)
                many[0] |= seen
                marked = many[group]
                if seen:
                    marked[0] = False  # told before
            else:
                f = at[group]
                marked = ~head & ~((doc == doc[f]) & (null == null[f]) & (thash == thash[f]) & (span == span[f]))
                many = size > 1
            fresh = new_pk[at]  # first string of its seed
            before = ~fresh
            before[0] = earlier
            after = np.zeros(len(at), bool)
            after[:-1] = ~fresh[1:]
            # number of the string within its seed
            idx = np.arange(len(at))
            base = np.maximum.accumulate(np.where(fresh, idx, 0))
            number = idx - base
            number[base == 0] += ordinal
            check = before | after | ((flag[at] & (SELF | HOT)) > 0)
            if not last:
                check[-1] = False
                i = at[-1]
                carry = ([x[i : i + 1] for x in (pk, seed, shash, doc, null, thash, span, flag)], bool(many[-1]) if everywhere else False, bool(before[-1]), int(number[-1]))
            c = at[check]
            shard = mix(pk[c].view(U64) + U64(0x9E3779B97F4A7C15) * (number[check] // most).astype(U64))
            hot = ((flag[c] & HOT) > 0) | (number[check] >= most)
            m = np.flatnonzero(marked)
            n = len(m)
            both = np.concatenate([m, c])
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array([MARK, CHECK], np.int32), [n, len(c)])),
                pa.array(np.concatenate([np.zeros(n, np.int64), signed(shard)])),
                pa.array(np.zeros(len(both), np.int64)),
                pa.array(np.concatenate([np.zeros(n, np.int32), hot.astype(np.int32)])),
                int_column(doc[both], null[both]), pa.array(thash[both]), pa.array(span[both])], FOUND_NAMES)

        empty = [np.array([], np.int64)] * 4 + [np.array([], bool)] + [np.array([], np.int64)] * 2 + [np.array([], np.int32)]
        for batch in batches:
            done = batch.column(0).null_count  # rows without pk come first
            if done:
                zero = pa.array(np.zeros(done, np.int64))
                none = zero.cast(pa.int32())
                yield pa.RecordBatch.from_arrays([none, zero, zero, none, *(batch.column(i).slice(0, done) for i in (3, 4, 5))], FOUND_NAMES)
                batch = batch.slice(done)
            if not batch.num_rows:
                continue
            doc, null = long_column(batch.column(3))
            got = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4, 5, 6)]
            out = work([got[0], got[1], got[2], doc, null, got[3], got[4], got[5]], False)
            if out is not None and out.num_rows:
                yield out
        if carry is not None:
            out = work(empty, True)
            if out is not None and out.num_rows:
                yield out

    return body


def found_runs(docs: DataFrame, make_body: Callable, everywhere: bool, shard: int) -> DataFrame:
    """Steps 1 and 2, stored: MARK and CHECK rows of all documents."""
    rows = docs.count()
    hot = hot_seeds(docs, make_body, rows)
    runs = docs.mapInArrow(make_body(hot), RUN)
    # rows without pk are finished marks; they may lie anywhere
    dealt = runs.repartition(F.coalesce("pk", F.xxhash64("doc_id", "span")))
    dealt = dealt.sortWithinPartitions("pk", "seed", "shash", "doc_id", "thash", "span")
    return stored(dealt.mapInArrow(scan(everywhere, shard), FOUND))


def merged(prints: DataFrame, everywhere: bool) -> DataFrame:
    """MARK rows of FINGERPRINT rows: the windows that several shards hold."""
    rows = prints.select(F.col("sid").alias("pk"), F.col("sid").alias("seed"), F.col("fp").alias("shash"), "doc_id", "thash", "span", F.lit(0).alias("flag"))
    rows = rows.repartition("pk").sortWithinPartitions("pk", "seed", "shash", "doc_id", "thash", "span")
    return rows.mapInArrow(scan(everywhere, SHARD), FOUND).filter(F.col("kind") == MARK)


def pack(docs: DataFrame, found: DataFrame, units: Callable, window: int) -> DataFrame:
    """Step 3: the packed string of each check, cut from its document.  One row of a document
    that is given several times is enough."""
    checks = (found.filter(F.col("kind") == CHECK).groupBy("doc_id", "thash")
              .agg(F.collect_set(F.struct("sid", "flag", "span")).alias("runs")))
    keyed = with_text_hash(docs.select(F.col("doc_id").alias("d_id"), "text"), "d_hash")
    joined = checks.join(keyed, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("thash") == F.col("d_hash")), "inner").select("doc_id", "thash", "runs", "text")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, null = long_column(batch.column(0))
            thash = batch.column(1).to_numpy()
            runs = batch.column(2)
            offs = runs.offsets.to_numpy()
            sid, flag, span = (runs.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            strings, take, row_of = [], [], []
            for row, view in enumerate(binary_views(batch.column(3))):
                text, start, end, _ = units(view, grams=False)
                a, b = offs[row], offs[row + 1]
                first, n = span[a:b] >> 32, span[a:b] & 0xFFFFFFFF
                strings += [text[p:q] for p, q in zip(start[first].tolist(), end[first + n + (window - 2)].tolist())]
                take.append(np.arange(a, b))
                row_of.append(np.full(b - a, row))
            if strings:
                at, row = np.concatenate(take), np.concatenate(row_of)
                size = np.fromiter(map(len, strings), np.int64, len(strings))
                step = np.flatnonzero(np.diff((np.cumsum(size) >> 25), prepend=-1))  # 32 MB at a time
                for lo, hi in zip(step, np.append(step[1:], len(strings))):
                    yield pa.RecordBatch.from_arrays([pa.array(sid[at[lo:hi]]), pa.array(flag[at[lo:hi]]), int_column(ids[row[lo:hi]], null[row[lo:hi]]), pa.array(thash[row[lo:hi]]), pa.array(span[at[lo:hi]]), pa.array([bytes(s) for s in strings[lo:hi]], pa.binary())], ["sid", "flag", "doc_id", "thash", "span", "string"])

    return joined.mapInArrow(body, "sid long, flag int, doc_id long, thash long, span long, string binary")


def by_shard(kernel: Callable, chunk_bytes: int = 1 << 21) -> Callable:
    """mapInArrow body over rows sorted by sid: feeds ``kernel`` whole shards, several small
    ones at a time.  kernel(list of arrays) returns FOUND column arrays."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def run(rows: pa.Table):
            if rows.num_rows:
                yield kernel(rows.combine_chunks())

        for batch in batches:
            if not batch.num_rows:
                continue
            at = 0
            step = np.flatnonzero(np.diff(np.cumsum([len(s) for s in binary_views(batch.column(5))]) // chunk_bytes, prepend=-1))
            for lo, hi in zip(step, np.append(step[1:], batch.num_rows)):
                held.append(batch.slice(lo, hi - lo))
                size += held[-1].nbytes
                if size < chunk_bytes:
                    continue
                rows = pa.Table.from_batches(held)
                sid = rows.column(0).to_numpy()
                whole = int(np.searchsorted(sid, sid[-1]))  # the last shard may go on
                if whole:
                    yield from run(rows.slice(0, whole))
                    rest = rows.slice(whole)
                    held, size = rest.to_batches(), 0
                    size = rest.nbytes
        if held:
            yield from run(pa.Table.from_batches(held))

    return body


def spans_by_document(marks: DataFrame) -> DataFrame:
    """(doc_id, thash) with the marked runs, as many at most as the document has, however often
    it is given."""
    return marks.groupBy("doc_id", "thash").agg(F.collect_set("span").alias("spans"))


def with_spans(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, text, marks: each document with the marks of its id and text hash."""
    per_text = spans_by_document(marks).select(F.col("doc_id").alias("m_id"), F.col("thash").alias("m_hash"), F.array(F.struct("thash", "spans")).alias("marks"))
    return (with_text_hash(docs.select("doc_id", "text"), "d_hash")
            .join(per_text, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("d_hash") == F.col("m_hash")), "left").select("doc_id", "text", "marks"))


def marked_units(n: int, spans: np.ndarray, window: int) -> np.ndarray:
    """Mask of the units that the marked windows cover."""
    cover = np.zeros(n + 1, np.int32)
    first, count = spans >> 32, spans & 0xFFFFFFFF
    np.add.at(cover, first, 1)
    np.add.at(cover, first + count + (window - 1), -1)
    return np.cumsum(cover[:n]) > 0


def marks_of(marks: list, view) -> np.ndarray | None:
    """The spans of this text among those of its doc_id."""
    own = signed(np.array([xxhash.xxh3_64_intdigest(view)], U64))[0]
    spans = [s for m in marks if m["thash"] == own for s in m["spans"]]
    return np.array(spans, np.int64) if spans else None
