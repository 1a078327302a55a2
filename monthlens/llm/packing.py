"""Best-fit packing: pieces of token ids into sequences of a fixed capacity.

A plan is made from the number of pieces of each length alone, so its size follows from the
capacity and not from the rows: combinations that fill a gap exactly are looked up by their
sums and used as often as the counts allow; what is left goes by best fit.  Spark numbers the
pieces within their length and each takes the place that the plan has for its number.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthlens.llm.common import binary_views, free, ship, stored, without

#: Longer texts are encoded in blocks of about so many bytes, cut at white space.
CHUNK = 1 << 20
#: New words after which a worker forgets those that have not come up since.
WORDS = 500_000
#: Pieces of one length are numbered in buckets of about so many, in up to MOST_BUCKETS.
BUCKET, MOST_BUCKETS = 128, 4096
#: Bits for the number of a piece within its length.
NUMBER_BITS = 44


# ---------------------------------------------------------------- pieces of documents

#: Words whose characters every version of Unicode treats alike: they are lower-cased and parted here.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The steps before BPE for which that is done; with any others the library does all of them.
STEPS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]


def byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: a visible byte for
    itself, the others by turns from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordIds(dict):
    """Token ids of texts as little-endian 32-bit integers, word by word; remembers words.

    Fits tokenizers that drop white space and look no further than a word, so that a text's
    ids are those of its words, one after the other.  Of the words remembered, those that have
    not come up for WORDS new ones are forgotten."""

    def __init__(self, spec: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.before: dict[bytes, bytes] = {}
        made = json.loads(spec)
        steps = (made["normalizer"] or {}).get("normalizers", []) + (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.parts = None
        if [x["type"] for x in steps] == STEPS and steps[3]["invert"] and steps[3]["behavior"] == "Removed" and not steps[4]["add_prefix_space"] and not steps[4]["use_regex"]:
            self.parts = regex.compile(steps[3]["pattern"]["Regex"])
        self.special = re.compile("|".join(re.escape(x["content"]) for x in made["added_tokens"]) or "(?!)").search
        self.bytes = byte_characters()

    def __missing__(self, word: bytes) -> bytes:
        found = self.before.get(word)
        if found is None:
            ids = self.ids(word.decode("utf-8", "replace"))
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = found
        return found

    def ids(self, word: str) -> list[int]:
        if self.parts is None or not (word.isascii() and word.isalpha() or PLAIN.fullmatch(word)) or self.special(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        low = word.lower()
        return [t.id for part in ([low] if low.isalpha() else self.parts.findall(low))
                for t in self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.bytes))]

    def encode(self, views: list) -> Iterator[bytes]:
        """The ids of each text; those of a text over CHUNK bytes are found in blocks."""
        for view in views:
            text = bytes(view)
            parts = [text] if len(text) <= CHUNK else blocks(text)
            yield b"".join([b"".join(map(self.__getitem__, part.split())) for part in parts])  # at ASCII white space


_TOKENIZERS: dict[str, WordIds] = {}


def words_of(spec: str) -> WordIds:
    """One for each worker process, so that words are remembered from task to task."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordIds(spec)
    return _TOKENIZERS[key]


def blocks(text: bytes) -> Iterator[bytes]:
    """Parts of about CHUNK bytes that end at ASCII white space."""
    at = 0
    while at < len(text):
        past = at + CHUNK
        while past < len(text) and text[past] not in b" \t\n\r\x0b\x0c":
            past += 1
        yield text[at:past]
        at = past


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, text: str = "text", ids: bool = True) -> DataFrame:
    """The columns of docs without the text, plus piece int, start, length, ids_crc32 long and,
    where ``ids``, ids array<int>: one row for each piece of a document.

    A document is the ids of its whole text (null: none) and then ``end_id``.  One of more than
    ``capacity`` is cut into pieces of that many; the last may be shorter.  The tokenizer must
    drop white space and treat words apart (``word_bpe_49k.json`` does).

    Rows given twice give their pieces twice; texts over CHUNK bytes are encoded in blocks cut
    at white space (text without any in one); an empty table gives an empty one.  Columns named
    like the new ones are replaced, others stay.
    """
    spark = docs.sparkSession
    ship(spark)
    # the file is as large at any input size; it is read here, once
    sent = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    new = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    fresh = [c.split()[0] for c in new.split(", ")]
    kept = without(docs, [*fresh, text]).columns
    base = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias(column := free(docs, "_text")))
    added = spark.createDataFrame([], new).schema
    schema = type(added)([f for f in base.schema.fields if f.name != column] + added.fields)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(sent.value)
        end = np.array([end_id], "<u4").tobytes()

        def out(batch, rows, parts, of):
            blob = b"".join(parts)
            size = np.array([len(p) // 4 for p in parts], np.int64)
            arrays = [batch.column(c).take(pa.array(rows)) for c in kept]
            arrays += [pa.array([k for k, _ in of], pa.int32()), pa.array([k * capacity for k, _ in of], pa.int64()), pa.array(size), pa.array([c for _, c in of], pa.int64())]
            if ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.frombuffer(blob, np.int32))))
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            rows, parts, of, held = [], [], [], 0
            for row, got in enumerate(words.encode(binary_views(batch.column(column)))):
                got += end
                for k, a in enumerate(range(0, len(got), 4 * capacity)):
                    part = got[a:a + 4 * capacity]
                    rows.append(row)
                    parts.append(part)
                    of.append((k, zlib.crc32(part)))
                    held += len(part)
                    if held > 4 * CHUNK:
                        yield out(batch, rows, parts, of)
                        rows, parts, of, held = [], [], [], 0
            if rows:
                yield out(batch, rows, parts, of)

    return base.mapInArrow(body, schema)


# ---------------------------------------------------------------- the plan

class Sums:
    """Lengths that are left, and by their sum the pairs of them."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self.size = len(left)
        self.pairs = np.zeros(self.size, np.int64)  # pairs of lengths that are left, by sum
        for a in np.flatnonzero(left):
            self._pairs_with(a, 1, self.left[:a + 1] > 0)
        self.pairs[2 * np.flatnonzero(left[:(self.size + 1) // 2] == 1)] -= 1  # one piece is no pair

    def _pairs_with(self, a: int, by: int, others: np.ndarray) -> None:
        b = np.flatnonzero(others)
        b = b[b + a < self.size]
        self.pairs[b + a] += by

    def take(self, length: int, n: int) -> None:
        before = self.left[length]
        self.left[length] -= n
        after = self.left[length]
        if before >= 2 > after and 2 * length < self.size:
            self.pairs[2 * length] -= 1
        if before and not after:
            others = self.left > 0
            others[length] = False
            self._pairs_with(length, -1, others)

    def pair(self, total: int, free: np.ndarray) -> list[int] | None:
        """Two free lengths of that sum, those that can be used most often."""
        if total < 2 or not self.pairs[total]:
            return None
        a = np.arange(1, total // 2 + 1)
        often = np.minimum(free[a], free[total - a])
        if total % 2 == 0:
            often[-1] = free[total // 2] // 2
        best = int(often.argmax())
        return [total - best - 1, best + 1] if often[best] > 0 else None

    def exact(self, gap: int, free: np.ndarray, reach: int = 3) -> list[int] | None:
        """One free length, or two or three as far as ``reach`` goes, of that sum."""
        if not gap:
            return []
        if free[gap] > 0:
            return [gap]
        if reach > 1 and (two := self.pair(gap, free)):
            return two
        if reach < 3:
            return None
        a = np.flatnonzero(free[1:max(gap - 1, 1)] > 0) + 1
        a = a[self.pairs[gap - a] > 0]
        for first in a[np.argsort(-free[a], kind="stable")].tolist():
            free[first] -= 1
            two = self.pair(gap - first, free)
            free[first] += 1
            if two:
                return [first, *two]
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces by length, number of sequences) that use up the counts.

    Gaps are filled exactly with up to three lengths, then with up to two, then with one; the
    way that needs the fewest sequences is taken (triples save most where pieces are short,
    but where most are over half the capacity they use up what those need)."""
    if bad := [k for k in counts if k is None or not 0 < k <= capacity]:
        raise ValueError(f"lengths must be between 1 and {capacity}: {bad[:5]}")
    return min((filled(counts, capacity, reach) for reach in (3, 2, 1)), key=lambda done: sum(n for _, n in done))


def filled(counts: dict[int, int], capacity: int, reach: int) -> list[tuple[dict[int, int], int]]:
    """From the longest pieces down, a sequence is opened, its gap filled exactly, and that
    repeated as often as the counts allow.  With a reach of three the longest pieces that fit
    join first where the gap is wider.  Pieces without such an end are packed by best fit."""
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    sums, done, rest = Sums(left), [], []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            free, used, gap = left.copy(), {}, capacity

            def put(length: int, times: int = 1) -> None:
                free[length] -= times
                used[length] = used.get(length, 0) + times

            put(longest)
            gap -= longest
            end = sums.exact(gap, free, reach)
            while end is None and reach == 3:
                fits = np.flatnonzero(free[:gap + 1])
                if not len(fits):
                    break
                nxt = int(fits[-1])
                times = int(min(free[nxt], max(1, (gap - 1) // nxt - 2)))  # three lengths reach no further
                put(nxt, times)
                gap -= nxt * times
                end = sums.exact(gap, free)
            if end is None:
                rest.append((longest, int(left[longest])))
                sums.take(longest, int(left[longest]))
                continue
            for length in end:
                put(length)
            n = min(int(left[k]) // t for k, t in used.items())
            for k, t in used.items():
                sums.take(k, n * t)
            done.append((used, n))
    return done + best_fit(rest, capacity)


def best_fit(lengths: list[tuple[int, int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, of (length, count): equal sequences are filled together."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length, n in sorted(lengths, reverse=True):
        while n:
            gap = min((g for g in open_ if g >= length), default=0)
            if gap:
                used, bins = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
            else:
                used, bins, gap = {}, n, capacity
            # what has just been filled stays the best fit until the length fits no more
            each = gap // length
            full = min(bins, n // each)
            over = n - full * each if bins > full else 0
            whole = bins - full - (over > 0)
            for times, many in ((each, full), (over, int(over > 0))):
                if many:
                    open_.setdefault(gap - times * length, []).append((used | {length: times}, many))
            if whole and used:
                open_.setdefault(gap, []).append((used, whole))
            n -= full * each + over
    return [x for group in open_.values() for x in group]


def places(done: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """One row for each length of each entry of a plan: length, first number of a piece, pieces
    in a sequence, first sequence, offset; by length and number."""
    rows, used, base = [], {}, 0
    for pattern, n in done:
        offset = 0
        for length, times in sorted(pattern.items(), reverse=True):
            rows.append((length, used.get(length, 0), times, base, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * times
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# ---------------------------------------------------------------- packing

def pack(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """The columns of pieces plus sequence_id and offset: where each piece lies.

    ``pieces`` has a long ``length`` from 1 to ``capacity`` (others raise).  Each sequence is
    gapless from offset 0 and at most ``capacity`` long.  Which of several pieces of one length
    takes which place follows from how the rows are split, and is fixed once packed.

    Rows given twice, and rows of null or equal ids, are pieces of their own; an empty table
    gives an empty one.  Columns named like the new ones are replaced, others stay.
    """
    spark = pieces.sparkSession
    ship(spark)
    base = without(pieces, ["sequence_id", "offset"])
    tag, bucket, many, number = (free(base, c) for c in ("_tag", "_bucket", "_many", "_number"))
    # written once, so that the numbers of the rows hold whatever is computed again
    rows = stored(base.withColumn(tag, F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # a row for each length: at most ``capacity``
    found = places(plan(counts, capacity))
    # as many rows as there are lengths; a common length has many buckets
    buckets = spark.createDataFrame([(k, min(MOST_BUCKETS, -(-n // BUCKET))) for k, n in counts.items()], f"length long, `{many}` long")
    dealt = rows.join(F.broadcast(buckets), "length").withColumn(bucket, F.pmod(F.xxhash64(tag), F.col(many))).drop(many)
    before = (dealt.groupBy("length", bucket).count()
              .select("length", bucket, (F.sum("count").over(Window.partitionBy("length").orderBy(bucket)) - F.col("count")).alias(many)))
    ranked = (dealt.withColumn(number, F.row_number().over(Window.partitionBy("length", bucket).orderBy(tag)) - 1)
              .join(before, ["length", bucket]).withColumn(number, F.col(number).cast("long") + F.col(many)).select(*base.columns, number))
    new = spark.createDataFrame([], "sequence_id long, offset long").schema
    schema = type(new)([*base.schema.fields, *new.fields])
    sent = spark.sparkContext.broadcast(found)  # at most a few rows for each length

    kept = base.columns

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        keys = (at[:, 0] << NUMBER_BITS) + at[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            no = batch.column(number).to_numpy()
            _, first, times, sequence, offset = at[np.searchsorted(keys, (length << NUMBER_BITS) + no, "right") - 1].T
            no = no - first
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence + no // times), pa.array(offset + no % times * length)], schema.names)

    return ranked.mapInArrow(body, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_pieces, length and ids: the sequences that packed pieces (with their ids)
    make up.  A sequence has at most ``capacity`` pieces, so no group is large."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("length"), parts.alias("parts"))
            .select("sequence_id", "n_pieces", "length", F.flatten("parts.ids").alias("ids")))
