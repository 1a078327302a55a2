"""Toxic spans by a linear-chain conditional random field.

Tokens are words; each sentence is a chain over two tags, *toxic* and *other*.  Emissions sum
hashed features of the word (itself, its prefixes and suffixes) and of its neighbours; two-by-
two transitions link the tags.  Forward-backward gives each token's marginal; the marginals of
a text aggregate to its score, and tokens that are likelier toxic than not give its offsets.

Only documents are labelled, so the tokens that the field learns from get their labels from
those: a word or prefix that a likelihood-ratio test finds in toxic documents and hardly in
others marks its tokens in the toxic documents of the learning rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthlens.llm.common import binary_views, fold, ship

#: Learning rows, about: the only bound of this operator.
SAMPLE = 12000
CUT = 0.7
BUCKETS = 1 << 16
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4)
#: Least likelihood ratio (G) and share of toxic documents of a telling word or prefix.
TELLING, PURE = 24.0, 0.97
ROUNDS, STEP, RIDGE = 40, 1.0, 1e-6
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’…*#$%&|-_"
#: Text bytes tagged at a time, and words remembered from one time to the next.
CHUNK, REMEMBER = 4 << 20, 400_000


def plain(token: bytes) -> str:
    return token.decode("utf-8", "replace").lower().strip(EDGE)


def shapes(word: str) -> list[str]:
    """What a word shows: itself, its prefixes and its suffixes."""
    out = ["=" + word]
    out += ["<" + word[:k] for k in PREFIXES if len(word) >= k]
    out += [">" + word[-k:] for k in SUFFIXES if len(word) > k]
    return out


def bucket(shape: str) -> int:
    return xxhash.xxh3_64_intdigest(shape.encode()) & (BUCKETS - 1)


def chains(tokens: list[bytes]) -> np.ndarray:
    """Where a sentence begins: at the start and after a token that ends in . ! or ?"""
    if not tokens:
        return np.zeros(0, bool)
    end = np.fromiter((t[-1] in b".!?" for t in tokens), bool, len(tokens))
    return np.concatenate([[True], end[:-1]])


class Chains:
    """Tokens of many sentences laid out for step-by-step recursions over all at once."""

    def __init__(self, head: np.ndarray):
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, len(head)))
        order = np.argsort(-size, kind="stable")
        self.start, self.size = start[order], size[order]
        steps = int(self.size[0]) if len(order) else 0
        # how many sentences still have a token at each step
        self.live = np.searchsorted(-self.size, -np.arange(steps), side="left")

    def marginals(self, odds: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginal odds of each token, and forward and backward odds; ``odds``: emission odds.

        trans[a, b] = exp(weight) of tag a before tag b (0 other, 1 toxic)."""
        fore, back = np.empty(len(odds)), np.ones(len(odds))
        low, high = 1e-280, 1e280
        for t, n in enumerate(self.live.tolist()):
            at = self.start[:n] + t
            r = 1.0 if t == 0 else (fore[at - 1] * trans[1, 1] + trans[0, 1]) / (fore[at - 1] * trans[1, 0] + trans[0, 0])
            fore[at] = np.clip(r * odds[at], low, high)
        for t in range(len(self.live) - 2, -1, -1):
            at = self.start[: self.live[t + 1]] + t
            x = np.clip(back[at + 1] * odds[at + 1], low, high)
            back[at] = (trans[1, 1] * x + trans[1, 0]) / (trans[0, 1] * x + trans[0, 0])
        return np.clip(fore * back, low, high), fore, back


def neighbours(values: np.ndarray, head: np.ndarray, empty: float) -> tuple[np.ndarray, np.ndarray]:
    """values of the token before and after within the sentence."""
    before = np.concatenate([[empty], values[:-1]])
    before[head] = empty
    last = np.append(head[1:], True) if len(head) else head
    after = np.append(values[1:], empty)
    after[last] = empty
    return before, after


class Field:
    """Weights: own shapes, the word before, the word after, bias, transitions, score scale."""

    def __init__(self, own, before, after, bias, trans, middle=0.0, slope=1.0):
        self.own, self.before, self.after = own, before, after
        self.bias, self.trans, self.middle, self.slope = bias, trans, middle, slope
        self.known: dict[bytes, int] = {}
        self.tables = [np.empty(0)] * 3

    def state(self):
        return self.own.astype(np.float32).tobytes(), self.before.astype(np.float32).tobytes(), self.after.astype(np.float32).tobytes(), [float(x) for x in (self.bias, *self.trans.ravel(), self.middle, self.slope)]

    @classmethod
    def of(cls, own, before, after, rest):
        own, before, after = (np.frombuffer(x, np.float32).astype(float) for x in (own, before, after))
        return cls(own, before, after, rest[0], np.array(rest[1:5]).reshape(2, 2), rest[5], rest[6])

    def meet(self, tokens: set[bytes]) -> None:
        """Sums the weights of words not met yet."""
        if len(self.known) + len(tokens) > REMEMBER:
            self.known, self.tables = {}, [np.empty(0)] * 3
        fresh = [t for t in tokens if t not in self.known]
        own, before, after = np.empty(len(fresh)), np.empty(len(fresh)), np.empty(len(fresh))
        for k, t in enumerate(fresh):
            s = [bucket(x) for x in shapes(plain(t))]
            own[k] = self.own[s].sum()
            before[k], after[k] = self.before[s[0]], self.after[s[0]]
        n = len(self.known)
        self.known.update(zip(fresh, range(n, n + len(fresh))))
        self.tables = [np.concatenate([a, b]) for a, b in zip(self.tables, (own, before, after))]

    def tag(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Marginal log odds of each token of each text."""
        sizes = [len(t) for t in texts]
        every = [w for t in texts for w in t]
        if not every:
            return [np.empty(0)] * len(texts)
        self.meet(set(every))
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        head = np.concatenate([chains(t) for t in texts])
        before, after = neighbours(at, head, -1)
        own, b, a = self.tables
        e = own[at] + np.where(before >= 0, b[before], 0) + np.where(after >= 0, a[after], 0) + self.bias
        odds, _, _ = Chains(head).marginals(np.exp(np.clip(e, -60, 60)), np.exp(self.trans))
        return np.split(np.log(odds), np.cumsum(sizes)[:-1])


def nothing() -> Field:
    """The field that knows no toxic word."""
    return Field(np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS), -4.0, np.zeros((2, 2)))


def strength(logits: np.ndarray) -> float:
    """The marginals of a text in one number: close to the largest, more where several are high."""
    if not len(logits):
        return -60.0
    top = logits.max()
    return float(top + 0.5 * np.log(np.exp(2 * (logits - top)).sum()))


def telling(texts: list[list[bytes]], toxic: np.ndarray) -> set[str]:
    """Words and prefixes that a likelihood-ratio test ties to toxic documents.

    What is counted are the different words before them, so that copies of one passage
    count once."""
    shape_of: dict[bytes, list[str]] = {}
    pairs = [set(), set()]
    for tokens, y in zip(texts, toxic.tolist()):
        pairs[y].update(zip(tokens, [b"", *tokens]))
    places = [len(pairs[0]), len(pairs[1])]
    if not all(places):
        return set()
    n = []
    for some in pairs[1], pairs[0] - pairs[1]:
        words, shapes_ = Counter(w for w, _ in some), Counter()
        for w, k in words.items():
            if w not in shape_of:
                shape_of[w] = [s for s in shapes(plain(w)) if s[0] != ">" and len(s) > 1]
            for s in shape_of[w]:
                shapes_[s] += k
        n.append(shapes_)
    rate = places[1] / sum(places)
    out = set()
    for s, k in n[0].items():
        if k * -2 * np.log(rate) < TELLING:
            continue
        c = n[1][s]
        p = k / places[1] / (k / places[1] + c / places[0])
        g = 2 * (k * np.log(k / ((k + c) * rate)) + (c * np.log(c / ((k + c) * (1 - rate))) if c else 0))
        if g >= TELLING and p >= PURE:
            out.add(s)
    return out


def train(texts: list[list[bytes]], toxic: np.ndarray) -> Field:
    signs = telling(texts, toxic)
    rng = np.random.default_rng(2)
    tokens, head, tags = [], [], []
    sign: dict[bytes, bool] = {}  # of each word
    for words, y in zip(texts, toxic.tolist()):
        if not words:
            continue
        begin = chains(words)
        marked = np.zeros(len(words), bool)
        if y:
            for t in set(words).difference(sign):
                sign[t] = any(s in signs for s in shapes(plain(t)))
            marked = np.fromiter(map(sign.__getitem__, words), bool, len(words))
        start = np.flatnonzero(begin)
        past = np.append(start[1:], len(words))
        some = set(rng.choice(len(start), min(2, len(start)), replace=False).tolist())
        some |= set((np.searchsorted(start, np.flatnonzero(marked), side="right") - 1).tolist())
        for k in sorted(some):
            tokens += words[start[k] : past[k]]
            head += [True] + [False] * (past[k] - start[k] - 1)
            tags += marked[start[k] : past[k]].tolist()
    if not any(tags):
        return nothing()
    own, before, after, bias, trans = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS), -4.0, np.zeros((2, 2))
    head, tags = np.array(head), np.array(tags)
    names = {t: [bucket(s) for s in shapes(plain(t))] for t in set(tokens)}
    shape = np.array([b for t in tokens for b in names[t]])
    of = np.repeat(np.arange(len(tokens)), [len(names[t]) for t in tokens])
    word = np.array([names[t][0] for t in tokens])
    prev, next_ = neighbours(word, head, -1)
    laid = Chains(head)
    joint = np.flatnonzero(~head)  # tokens with a token before
    seen = np.array([[np.sum((tags[joint - 1] == a) & (tags[joint] == b)) for b in (0, 1)] for a in (0, 1)], float)
    sums = [np.full(BUCKETS, 1e-6) for _ in range(3)] + [1e-6, np.full((2, 2), 1e-6)]
    for _ in range(ROUNDS):
        e = np.bincount(of, own[shape], len(tokens)) + np.where(prev >= 0, before[prev], 0) + np.where(next_ >= 0, after[next_], 0) + bias
        odds, tr = np.exp(np.clip(e, -60, 60)), np.exp(trans)
        m, fore, back = laid.marginals(odds, tr)
        p = m / (1 + m)
        miss = tags - p
        # expected transitions from forward odds, emissions and backward odds
        f, x = fore[joint - 1], back[joint] * odds[joint]
        cell = np.array([[np.ones(len(f)), x], [f, f * x]]) * tr[:, :, None]
        cell = np.nan_to_num(cell / cell.sum(axis=(0, 1)), nan=0.0)
        grads = [
            np.bincount(shape, miss[of], BUCKETS) - RIDGE * own,
            np.bincount(prev[prev >= 0], miss[prev >= 0], BUCKETS) - RIDGE * before,
            np.bincount(next_[next_ >= 0], miss[next_ >= 0], BUCKETS) - RIDGE * after,
            miss.sum(), seen - cell.sum(axis=2)]
        for s, g in zip(range(5), grads):
            sums[s] = sums[s] + g * g
        own, before, after, bias, trans = (v + STEP * g / np.sqrt(s) for v, g, s in zip((own, before, after, bias, trans), grads, sums))
    field = Field(own, before, after, bias, trans)
    # logistic regression of the label on the strength: where it is even, and how steep
    value = np.concatenate([[strength(x) for x in field.tag(texts[lo : lo + 500])] for lo in range(0, len(texts), 500)])
    x = np.stack([np.clip(value, -10, 10), np.ones(len(value))], axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (toxic - p) - 0.1 * w)
    field.slope = float(max(w[0], 1e-3))
    field.middle = float(-w[1] / field.slope)
    return field


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Trains on about ``sample`` labelled rows, a third of them toxic."""
    marks = labels.filter("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("y"))
    per = {r[0]: r[1] for r in marks.groupBy("y").count().collect()}
    share = {y: min(1.0, sample * part / per[y]) for y, part in ((0, 2 / 3), (1, 1 / 3)) if y in per}
    draw = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 20)) < F.when(F.col("y") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0))) * (1 << 20)
    chosen = marks.filter(draw)
    rows = docs.select("doc_id", "text")
    # about `sample` ids of 12 bytes; without the hint Spark would shuffle every text
    rows = rows.join(F.broadcast(chosen), "doc_id")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += [bytes(v).split() for v in binary_views(batch.column("text"))]
            y += batch.column("y").to_pylist()
        field = train(texts, np.array(y, int)) if texts else nothing()
        own, before, after, rest = field.state()
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([before], pa.binary()), pa.array([after], pa.binary()), pa.array([rest], pa.list_(pa.float64()))], ["own", "b", "a", "rest"])

    # the sample is bounded, so one task trains on it, in a fixed order
    got = rows.repartition(1).sortWithinPartitions("doc_id", "y", F.xxhash64("text")).mapInArrow(body, "own binary, b binary, a binary, rest array<double>").first()
    return nothing() if got is None else Field.of(*got)  # None: no labelled row


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """The columns of docs plus score double and spans array<struct<first, past>>: byte offsets
    of the tokens that are likelier toxic than not.  Columns of docs of these two names are replaced."""
    ship(docs.sparkSession)
    base = docs.drop("score", "spans")
    names = base.columns
    sent = docs.sparkSession.sparkContext.broadcast(field.state())  # BUCKETS numbers three times
    span = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field.of(*sent.value)
        for batch in batches:
            views = binary_views(batch.column("text"))
            ends = np.cumsum([len(v) for v in views])
            cuts = np.flatnonzero(np.diff(ends // CHUNK, prepend=-1))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(views))):
                texts = [bytes(v).split() for v in views[lo:hi]]
                value, spans = [], []
                for view, logits in zip(views[lo:hi], field.tag(texts)):
                    value.append(strength(logits))
                    hit = np.flatnonzero(logits > 0)
                    if len(hit):
                        at = [m.span() for m in WORD.finditer(view)]
                        spans.append([{"first": at[k][0], "past": at[k][1]} for k in hit.tolist()])
                    else:
                        spans.append([])
                z = field.slope * (np.array(value) - field.middle) + np.log(CUT / (1 - CUT))
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array(spans, span)], [*names, "score", "spans"])

    return base.mapInArrow(body, base.select("*", F.lit(0.0).alias("score"), F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("past"))).alias("spans")).schema)


def toxicity(docs: DataFrame, labels: DataFrame, held: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted, spans: the toxicity of every whole text.

    Learns ``labels.toxic`` (null: no label) only from rows whose crc32(doc_id) mod ``held``
    is not 1.  Null and empty texts have no token and get the lowest score; so does everything
    where nothing is labelled toxic.  Equal texts get equal scores.  Rows of a null id are scored
    but teach nothing; rows given twice each get a row.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    mine = labels.filter(fold(F.col("doc_id"), held) != 1)
    field = learn(docs.select("doc_id", "text"), mine)
    out = tag(docs.select("doc_id", "text"), field)
    return out.select("doc_id", (fold(F.col("doc_id"), held) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "spans")
