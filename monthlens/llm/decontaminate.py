"""Benchmark decontamination on templates.

Words of a text are brought to a canonical form in which numbers, names and units become
typed placeholders, so a benchmark question whose values were changed keeps its template.
Windows of ``WINDOW`` template words of documents are joined by hash with those of the
benchmark; a shorter question is one window, and documents have windows of its length too.
Windows of too few plain words are joined by their words and values as they are.  A window counts
where it stands word for word, and else only if its slots are consistent: along one alignment,
each of the question's values in it stands for one value in the document.

Names show by their capitals, so a copy in another case has another template.  Beside the
template windows a text therefore has *folded* windows: of its words in lower case, without
marks at their edges and without placeholders.  They are joined alike and have no slots.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthlens.llm.common import binary_views, free, int_column, long_column, mix, ship, signed64, stored, with_text_hash
from monthlens.llm.superkmer import gram_hashes

U64 = np.uint64
WINDOW = 8
#: Least share of a question's windows that a document must hold, and of plain words in a window
#: whose values may differ.
SHARE, PLAIN = 0.5, 0.5
#: Benchmark windows (8 bytes each) up to which their hashes are sent to every task; beyond,
#: the windows of the documents are joined by shuffle.
BROADCAST_WINDOWS = 2_000_000
#: Documents with a question (16 bytes each) up to which their ids are sent to every task.
BROADCAST_LEAKS = 1_000_000
CHUNK, REMEMBER = 4 << 20, 400_000
# fixed values: units of measure, lower case
UNITS = frozenset("""
mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours
day days week weeks month months year years hz khz mhz ghz w kw mw kwh j kj cal kcal v a k c f b kb mb gb tb % ‰ ° $ € £ ¥
usd eur gbp jpy chf dollar dollars euro euros cent cents meter meters metre metres kilometer kilometers kilometre kilometres
mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres
mph kmh percent degree degrees
""".split())
# fixed values: number words
NUMBERS = frozenset("""
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
""".split())
NUMERAL = re.compile(r"[-+]?[$€£¥]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?(?P<unit>\D*)")
EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’…*"
WORD, NUMBER, UNIT, NAME = range(4)
SALT = U64(0x9E3779B97F4A7C15)
SLOT_HASH = [U64(0), *(U64(xxhash.xxh3_64_intdigest(x)) for x in ("<number>", "<unit>", "<name>"))]
ENDS = b".!?"


def kind_of(token: bytes) -> tuple[int, int, str]:
    """Kind, hash of the plain word and value of a token. UNIT and NAME hold only where a
    number, or no sentence end, stands before; see ``template``."""
    whole = token.decode("utf-8", "replace")
    word = whole.strip(EDGE)
    low = word.lower()
    name = xxhash.xxh3_64_intdigest((low or whole).encode())
    m = NUMERAL.fullmatch(low)
    if m and (not m["unit"] or m["unit"] in UNITS) or low in NUMBERS:
        return NUMBER, name, low
    if low in UNITS or word in UNITS:
        return UNIT, name, low
    if word[:1].isupper():
        return NAME, name, word
    return WORD, name, low


class Templates:
    """Template words of texts, with the kinds of words remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.kind, self.hash, self.ends, self.value = np.empty(0, np.int8), np.empty(0, U64), np.empty(0, bool), []
        self.value_hash = np.empty(0, U64)

    def meet(self, tokens: set[bytes]) -> None:
        if len(self.known) + len(tokens) > REMEMBER:
            self.__init__()
        fresh = [t for t in tokens if t not in self.known]
        got = [kind_of(t) for t in fresh]
        n = len(self.known)
        self.known.update(zip(fresh, range(n, n + len(fresh))))
        self.kind = np.append(self.kind, np.array([g[0] for g in got], np.int8))
        self.hash = np.append(self.hash, np.array([g[1] for g in got], U64))
        self.ends = np.append(self.ends, np.array([t[-1] in ENDS for t in fresh], bool))
        self.value += [g[2] for g in got]
        self.value_hash = np.append(self.value_hash, np.array([xxhash.xxh3_64_intdigest(g[2].encode()) for g in got], U64))

    def places(self, tokens: list[bytes]) -> np.ndarray:
        """Where the tokens are remembered; ``meet`` them first."""
        self.meet(set(tokens))
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))

    def template(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, kind, first token) of each template word of the tokens at these places.

        A capital word is a name unless a sentence begins with it, a unit word a unit only
        after a number; a run of names is one name."""
        kind = self.kind[at]
        start = np.concatenate([[True], self.ends[at[:-1]]])
        kind[(kind == NAME) & start] = WORD
        after_number = np.concatenate([[False], kind[:-1] == NUMBER])
        kind[(kind == UNIT) & ~after_number] = WORD
        name = kind == NAME
        keep = np.flatnonzero(~(name & np.concatenate([[False], name[:-1]])))
        kind = kind[keep]
        return np.where(kind == WORD, self.hash[at[keep]], np.array(SLOT_HASH)[kind]), kind, keep

    def literals(self, at: np.ndarray, first: np.ndarray, names: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Hash of each template word with its value; a name's value is that of the whole run."""
        own = self.value_hash[at]
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        run = np.add.reduceat(mix(own + place.astype(U64) * SALT), first)
        return np.where(kind == WORD, names, mix(names ^ run))

    def slots(self, at: np.ndarray, first: np.ndarray, kind: np.ndarray, lo: int, hi: int) -> list[str]:
        """Values of the placeholders among template words lo..hi."""
        out = []
        for k in range(lo, hi):
            if kind[k] != WORD:
                a, b = first[k], first[k + 1] if k + 1 < len(first) else len(at)
                if kind[k] != NAME:
                    b = a + 1
                out.append(" ".join(self.value[p] for p in at[a:b].tolist()))
        return out


def window_hashes(names: np.ndarray, kind: np.ndarray, literals, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of n words and whether enough of it is plain words; the hash of
    other windows is that of their ``literals()``."""
    plain = np.concatenate([[0], np.cumsum(kind == WORD)])
    good = (plain[n:] - plain[:-n]) >= PLAIN * n
    h = mix(gram_hashes(names, n) + U64(n))
    return (h if good.all() else np.where(good, h, mix(gram_hashes(literals(), n) + U64(n) + SALT))), good


def folded_windows(words: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of n words that lie within one text, their first words and texts;
    text t has words[begin[t] : begin[t + 1]]."""
    if len(words) < n:
        return np.array([], U64), np.array([], np.int64), np.array([], np.int64)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    at = np.flatnonzero(text[: len(words) - n + 1] == text[n - 1 :])
    return mix(gram_hashes(words, n) + U64(n) + SALT + SALT)[at], at, text[at]


WINDOWS = "hash long, pos int, size int, folded boolean, plain boolean, n_plain int, n_all int, slots array<string>"


def windows_of(view_column: str, key: str, key_type: str, wanted=None, window: int = WINDOW, sizes: tuple[list[int], list[int]] | None = None):
    """mapInArrow body: (key, text) to (key, thash, hash, pos, size, folded, plain, n_plain,
    n_all, slots): whether the window is folded or one of plain words, and how many of plain
    words, and of its sort at all, the text has.

    ``sizes``: lengths of the template windows and of the folded ones; without them a text has
    windows of ``window`` words, a shorter one is one window.  ``wanted``: broadcast sorted
    hashes, other windows are left out."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        want = None if wanted is None else wanted.value
        if want is not None:
            # one bit for each hash rules out nearly all windows at once
            bits = np.zeros(1 << 22, bool)
            bits[(want >> U64(42)).astype(np.int64)] = True

        def asked(h: np.ndarray) -> np.ndarray:
            """Which of the windows to report."""
            if want is None:
                return np.arange(len(h))
            some = np.flatnonzero(bits[(h >> U64(42)).astype(np.int64)])
            if len(some):
                at = np.searchsorted(want, h[some])
                some = some[want[np.minimum(at, len(want) - 1)] == h[some]]
            return some

        for batch in batches:
            ids, null = long_column(batch.column(key))
            views = binary_views(batch.column(view_column))
            ends = np.cumsum([len(v) for v in views])
            cuts = np.flatnonzero(np.diff(ends // CHUNK, prepend=-1))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(views)]):
                texts = [bytes(v).split() for v in views[lo:hi]]
                begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                places = templates.places(list(chain.from_iterable(texts)))
                found = []  # (row, hash, pos, size, folded, plain, n_plain, n_all, slots)
                for r in range(len(texts)):
                    at = places[begin[r] : begin[r + 1]]
                    if not len(at):
                        continue
                    names, kind, first = templates.template(at)
                    mine = [n for n in ([min(window, len(names))] if sizes is None else sizes[0]) if n <= len(names)]
                    if not mine:
                        continue
                    literals = cache(lambda: templates.literals(at, first, names, kind))  # noqa: B023
                    cut = [window_hashes(names, kind, literals, n) for n in mine]
                    h, good = (np.concatenate(x) for x in zip(*cut))
                    if not len(some := asked(h)):
                        continue
                    place = np.concatenate([np.arange(len(x)) for x, _ in cut])
                    width = np.repeat(mine, [len(x) for x, _ in cut])
                    n_plain = int(good.sum())
                    for k in some.tolist():
                        p, n = int(place[k]), int(width[k])
                        found.append((lo + r, h[k], p, n, False, bool(good[k]), n_plain, len(good), templates.slots(at, first, kind, p, p + n)))
                words, long = templates.hash[places], np.diff(begin)
                for n in sorted({min(window, x) for x in long.tolist()} - {0}) if sizes is None else sizes[1]:
                    h, at, text = folded_windows(words, begin, n)
                    some = asked(h)
                    if sizes is None:
                        some = some[np.minimum(long[text[some]], window) == n]
                    for k in some.tolist():
                        r = int(text[k])
                        found.append((lo + r, h[k], int(at[k] - begin[r]), n, True, False, 0, int(long[r]) - n + 1, []))
                row, *cols = zip(*found) if found else [()] * 9
                own = {r: signed64(xxhash.xxh3_64_intdigest(views[r])) for r in set(row)}
                at = np.array(row, np.int64)
                hashes, types = np.array(cols[0], U64).view(np.int64), (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([int_column(ids[at], null[at]), pa.array([own[r] for r in row], pa.int64()), pa.array(hashes), *(pa.array(c, t) for c, t in zip(cols[1:], types))],
                                                 [key, "thash", "hash", "pos", "size", "folded", "plain", "n_plain", "n_all", "slots"])

    return body


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, thash, item_id, n_windows, n_matched, coverage, n_slots, n_changed): the pairs
    of a document and a question of which it holds ``share`` of the windows at least.

    n_matched counts the question's windows that stand in the document as they are, or with
    changed values none of which clashes; n_changed the slots whose values differ (0: the
    question as it is).

    Windows of too few plain words count only as they are.  The share is that of the windows
    of plain words, of all template windows, or of the folded windows, whichever is greatest;
    n_windows and n_matched are those of the greatest share.  So a copy in capitals or in small
    letters is found, as are its literal parts.

    Null and empty texts match nothing.  Questions of fewer words than a window are one window, which is
    looked for anywhere in a document.  A document given twice is reported once, rows of a null doc_id with a null doc_id.  Questions with a
    null item_id are ignored.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    bench = stored(items.mapInArrow(windows_of("text", "item_id", "long", window=window), f"item_id long, thash long, {WINDOWS}")
                   .withColumnRenamed("thash", "item_hash"))
    hashes = bench.select("hash").distinct()
    wanted = None
    if hashes.count() <= BROADCAST_WINDOWS:
        found = np.array([r[0] for r in hashes.collect()], np.int64).view(U64)
        wanted = spark.sparkContext.broadcast(np.sort(found))
    lengths = bench.select("size", "folded").distinct().collect()
    sizes = tuple(sorted(r["size"] for r in lengths if r.folded == f) for f in (False, True))
    mine = docs.mapInArrow(windows_of("text", "doc_id", "long", wanted, window, sizes), f"doc_id long, thash long, {WINDOWS}")
    mine = mine.select("doc_id", "thash", "hash", F.col("pos").alias("d_pos"), F.col("slots").alias("d_slots"))
    theirs = bench.select("item_id", "item_hash", "hash", F.col("pos").alias("i_pos"), "folded", "plain", "n_plain", "n_all", F.col("slots").alias("i_slots"))
    both = stored(mine.join(theirs, "hash").distinct().withColumn("shift", F.col("d_pos") - F.col("i_pos")))
    line = ["doc_id", "thash", "item_id", "item_hash", "shift"]
    pair = [c for c in line if c != "shift"]
    slots = lambda rows: rows.select(*line, F.explode(F.arrays_zip(F.col("i_slots").alias("i"), F.col("d_slots").alias("d"))).alias("s")).select(*line, F.col("s.i").alias("i"), F.col("s.d").alias("d")).distinct()
    keyed = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias("k_" + c) for c in line]
    # values of the question that stand for two on an alignment: windows that hold one count as they are only
    clash = slots(both).groupBy(*line, "i").agg(F.count("*").alias("n")).filter("n > 1").groupBy(*keyed).agg(F.collect_set("i").alias("clash"))
    named = both.select("*", *keyed).join(clash, [f"k_{c}" for c in line], "left")
    good = named.filter((F.col("i_slots") == F.col("d_slots")) | F.col("clash").isNull() | ~F.arrays_overlap("i_slots", "clash"))
    good = stored(good.select(both.columns))
    changed = slots(good).groupBy(*pair).agg(F.count("*").alias("n_slots"), F.count(F.when(F.col("i") != F.col("d"), 1)).alias("n_changed"))
    part = {"plain": F.col("plain"), "all": ~F.col("folded"), "fold": F.col("folded")}
    most = lambda c, rows: F.coalesce(F.max(F.when(rows, F.col(c))), F.lit(0))
    out = good.groupBy(*pair).agg(most("n_plain", part["all"]).alias("n_plain"), *[most("n_all", part[k]).alias("n_" + k) for k in ("all", "fold")],
                                  *[F.count_distinct(F.when(rows, F.col("i_pos"))).alias("m_" + k) for k, rows in part.items()])
    # the greatest of the shares m / n, the first of equal ones; of none there is -1 of 1
    share_of = lambda k: F.struct(F.when(F.col("n_" + k) > 0, F.col("m_" + k) / F.col("n_" + k)).otherwise(F.lit(-1.0)).alias("s"), F.lit(-list(part).index(k)).alias("k"), F.col("n_" + k).cast("long").alias("n"), F.col("m_" + k).alias("m"))
    out = out.withColumn("top", F.greatest(*[share_of(k) for k in part])).withColumn("n_windows", F.col("top.n")).withColumn("n_matched", F.col("top.m"))
    out = out.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).filter(F.col("coverage") >= share)
    changed = changed.select(*[F.col(c).alias("c_" + c) for c in pair], "n_slots", "n_changed")
    on = [F.col(c).eqNullSafe(F.col("c_" + c)) for c in pair]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.join(changed, cond, "left").select("doc_id", "thash", "item_id", F.col("n_windows").cast("long").alias("n_windows"), F.col("n_matched").cast("long").alias("n_matched"), "coverage", zero("n_slots"), zero("n_changed"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """The rows of docs, with their columns, that hold no question (see ``leaks``)."""
    found = leaks(docs, benchmark, window, share).select("doc_id", "thash").distinct()
    mark, leak_id, leak_hash = (free(docs, c) for c in ("_text_hash", "_leak_id", "_leak_hash"))
    marked = with_text_hash(docs, mark)
    found = stored(found.select(F.col("doc_id").alias(leak_id), F.col("thash").alias(leak_hash)))
    if found.count() <= BROADCAST_LEAKS:  # so that the texts need no shuffle
        found = F.broadcast(found)
    cond = marked["doc_id"].cast("long").eqNullSafe(found[leak_id]) & (marked[mark] == found[leak_hash])
    return marked.join(found, cond, "left_anti").drop(mark)
