"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts are lower-cased, what is no letter becomes one blank, and n-grams of one to three
characters are hashed to ``BUCKETS``.  Document frequencies come from every labelled document
of the learning folds; weights are trained by follow-the-regularised-leader with elastic-net
penalties on a bounded sample of them; a temperature fitted on part of that sample makes
scores of probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthlens.llm.common import binary_views, fold, ship

BUCKETS = 1 << 14
ORDERS = 3
#: Learning rows, about: the only bound of this operator.
SAMPLE = 6000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
UNKNOWN = "und"
_LOWER: list[np.ndarray] = []


def lower_table() -> np.ndarray:
    """Code point of the lower-cased letter, 32 for what is no letter; made once a process."""
    if not _LOWER:
        low = np.full(0x110000, 32, np.int32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                x = c.lower()
                low[i] = ord(x) if len(x) == 1 else i
        _LOWER.append(low)
    return _LOWER[0]


def letters(view) -> np.ndarray:
    """Lower-cased letters with single blanks between and around; empty without a letter."""
    points = np.frombuffer(bytes(view).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    c = np.concatenate([[32], lower_table()[points], [32]])
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    return c if len(c) > 2 else c[:0]


def counts(view) -> np.ndarray | None:
    """How often each n-gram bucket occurs; None without a letter."""
    c = letters(view).astype(np.uint32)
    if not len(c):
        return None
    total = np.zeros(BUCKETS, np.int64)
    h = c * np.uint32(0x9E3779B1)
    for n in range(ORDERS):
        if n:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[n:] * np.uint32(0x9E3779B1) + np.uint32(n)
        x = h ^ (h >> np.uint32(13))
        x = (x * np.uint32(0xC2B2AE3D)) >> np.uint32(18)
        total += np.bincount(x, minlength=BUCKETS)
    return total


def vector(view, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and TF-IDF values of unit length."""
    n = counts(view)
    if n is None:
        return None
    at = np.flatnonzero(n)
    x = (1 + np.log(n[at])) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple], n_classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal on (buckets, values, class) rows, then the temperature by one part in five."""
    order = np.random.default_rng(5).permutation(len(rows))
    held = order[: len(order) // 5]
    z, n = np.zeros((BUCKETS, n_classes)), np.zeros((BUCKETS, n_classes))

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    for _ in range(epochs):
        for r in order[len(held) :].tolist():
            at, x, y = rows[r]
            w = weights(at)
            g = softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g
            g2 = g * g
            z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g2
    w = weights(slice(None))
    best = 1.0
    if len(held):
        logits = np.stack([rows[r][1] @ w[rows[r][0]] for r in held.tolist()])
        y = np.array([rows[r][2] for r in held.tolist()])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
        best = min(np.geomspace(0.05, 5, 60), key=loss)
    return w, float(best)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the documents each bucket occurs, and how many documents there are."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for view in binary_views(batch.column("text")):
                c = counts(view)
                if c is not None:
                    df += c > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "n"])

    got = docs.select("text").mapInArrow(body, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()  # BUCKETS rows at most
    df, n = np.zeros(BUCKETS, np.int64), 0
    for bucket, k in got:
        if bucket < 0:
            n = k
        else:
            df[bucket] = k
    return df, n


def learn(labelled: DataFrame, sample: int = SAMPLE):
    """(classes, weights, temperature, idf) from rows (doc_id, text, lang)."""
    per = labelled.groupBy("lang").count().collect()  # a row for each language
    classes = sorted(r[0] for r in per)
    if not classes:
        return [], np.zeros((BUCKETS, 0)), 1.0, np.zeros(BUCKETS)
    df, n = document_frequencies(labelled)
    idf = np.log((1 + n) / (1 + df)) + 1
    # the same number of rows of each language, about, chosen by a hash of the id
    share = F.create_map(*[x for r in per for x in (F.lit(r[0]), F.lit(min(1.0, sample / len(per) / r[1])))])
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
    number = {c: i for i, c in enumerate(classes)}

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for view, lang in zip(binary_views(batch.column("text")), batch.column("lang").to_pylist()):
                v = vector(view, idf)
                if v is not None:
                    rows.append((*v, number[lang]))
        w, t = train(rows, len(classes)) if rows else (np.zeros((BUCKETS, len(classes))), 1.0)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([t])], ["w", "t"])

    # the sample is bounded, so one task trains on it; its order is fixed
    rows = labelled.filter(draw).select("doc_id", "text", "lang").repartition(1).sortWithinPartitions("doc_id", F.xxhash64("text"))
    got = rows.mapInArrow(body, "w binary, t double").first()
    if got is None:  # the draw left nothing
        return [], np.zeros((BUCKETS, 0)), 1.0, idf
    w, t = got
    return classes, np.frombuffer(w, np.float64).reshape(BUCKETS, -1), t, idf


def predict(docs: DataFrame, model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns of docs plus the predicted language and its probability; columns of docs of
    these two names are replaced."""
    ship(docs.sparkSession)
    classes, w, t, idf = model
    sent = docs.sparkSession.sparkContext.broadcast((classes, w.astype(np.float32), t, idf))  # BUCKETS rows
    base = docs.drop(pred, score)
    names = base.columns
    schema = base.select("*", F.lit("").alias(pred), F.lit(0.0).alias(score)).schema

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, w, t, idf = sent.value
        for batch in batches:
            lang, p = [], []
            for view in binary_views(batch.column("text")):
                v = vector(view, idf) if classes else None
                if v is None:
                    lang.append(UNKNOWN)
                    p.append(0.0)
                    continue
                probs = softmax(v[1].astype(np.float32) @ w[v[0]] / t)
                best = int(probs.argmax())
                lang.append(classes[best])
                p.append(float(min(1.0, probs[best])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(p, pa.float64())], [*names, pred, score])

    return base.mapInArrow(body, schema)


def identify(docs: DataFrame, held: int = 5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language of every whole text.

    Learns from text and non-null lang of rows whose crc32(doc_id) mod ``held`` is not 0.
    Texts that are null or have no letter are ``und`` with score 0, as is everything when
    there is nothing to learn from.  Equal texts get equal predictions.  Null ids count as
    the empty text in the fold.  Rows given twice each get a row.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    mark = fold(F.col("doc_id"), held) == 0
    model = learn(docs.filter(~mark & F.col("lang").isNotNull()), sample)
    return predict(docs.select("doc_id", "text", mark.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
