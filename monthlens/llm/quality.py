"""Quality classifier: Bradley-Terry ranking on preference pairs.

Every text has a short vector of surface statistics.  Weights are learned by logistic loss on
the differences of the vectors of all pairs (better, worse) of labelled rows.  No pair is made:
a row's part in the loss depends on its score and on how many rows of the other class have which
score, so a Newton step is two scans, one for the rows and sums of vectors by class and step
of a grid of scores, one for the weighted products of vectors.  The cut between the classes is the
score that parts all learning rows best, and scores are put on a scale of 0 to 1 on which the
cut lies at ``CUT``.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthlens.llm.common import binary_views, fold, ship, stored

#: Steps of the grid of scores, Newton steps at most, and first-level sums of the tasks' results.
GRID, ROUNDS, LANES = 2048, 12, 16
CUT = 0.3
RIDGE = 1e-3
_KINDS: list[np.ndarray] = []
UPPER, LOWER, OTHER_LETTER, DIGIT, SPACE, PUNCT, SYMBOL, REST = range(8)


def kinds() -> np.ndarray:
    """Kind of each code point; made once a process."""
    if not _KINDS:
        first = {"L": OTHER_LETTER, "N": DIGIT, "Z": SPACE, "P": PUNCT, "S": SYMBOL}
        out = np.full(0x110000, REST, np.uint8)
        for i in range(0x110000):
            c = unicodedata.category(chr(i))
            out[i] = UPPER if c == "Lu" else LOWER if c == "Ll" else first.get(c[0], REST)
        out[[9, 10, 11, 12, 13]] = SPACE
        _KINDS.append(out)
    return _KINDS[0]


def features(view) -> list[float]:
    text = bytes(view).decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = np.bincount(kinds()[points], minlength=8).astype(float)
    chars, letters = max(len(points), 1), max(n[UPPER] + n[LOWER] + n[OTHER_LETTER], 1)
    words = text.split()
    total = max(len(words), 1)
    often = Counter(words)
    twice = sum(map(eq, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    size = sum(map(len, words)) / total
    shares = [
        n[UPPER] / letters, n[DIGIT] / chars, n[PUNCT] / chars, n[SYMBOL] / chars, n[SPACE] / chars, n[REST] / chars,
        1 - letters / chars if len(points) else 1.0,
        twice / total, 1 - len(often) / total, max(often.values(), default=0) / total,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(map(str.isupper, often)) / max(len(often), 1),
        1 - sum(map(str.isalnum, often)) / max(len(often), 1),
        text.count("!") / chars, text.count("|") / chars,
    ]
    return [np.log1p(len(words)), np.log1p(len(lines)), size, *shares, *np.log1p(np.array(shares) * 50)]


N_FEATURES = 3 + 2 * 15


def surface(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row's whole text; a null text counts as empty."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(v) for v in binary_views(batch.column("text"))]
            flat = np.array(x, np.float32).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * N_FEATURES, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(body, docs.select("doc_id", F.array(F.lit(0.0).cast("float")).alias("x")).schema)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def raw_scores(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Summed row by row: equal rows have equal scores, wherever in a batch they are."""
    return (standard(x, mean, scale) * w).sum(axis=1)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, N_FEATURES).astype(float)


def summed(rows: DataFrame, of, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``of(x, y)``, an array of that shape, over the batches of all tasks, added up lane by lane."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of(matrix(batch), batch.column("y").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % LANES], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], ["lane", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(shape).ravel()
        for chunk in table.column("total").chunks:
            total += chunk.flatten().to_numpy().reshape(len(chunk), -1).sum(0)
        return pa.table({"total": pa.array([total], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(body, "lane int, total array<double>").groupBy("lane").applyInArrow(add, "total array<double>").collect()
    return sum((np.array(r.total) for r in parts), np.zeros(shape).ravel()).reshape(shape)


def preferences(rows: DataFrame):
    """(mean, scale, weights) of rows (y, x); weights by Newton steps on the loss over all pairs of a
    row of label 1 and one of label 0.  Rows count at the mean score of their class and step of the grid."""
    first = summed(rows, lambda x, y: np.stack([np.c_[np.ones(keep.sum()), x[keep], x[keep] ** 2].sum(0) for keep in (y == 0, y == 1)]), (2, 1 + 2 * N_FEATURES))
    n_bad, n_good = first[:, 0]
    n, total, square = np.split(first.sum(0), [1, 1 + N_FEATURES])
    mean = total / max(n[0], 1)
    scale = np.sqrt(np.maximum(square / max(n[0], 1) - mean**2, 0)) + 1e-6
    w = np.zeros(N_FEATURES)
    if not n_good or not n_bad:
        return mean, scale, w, int(n_bad), int(n_good)
    for _ in range(ROUNDS):
        reach = 8 * np.abs(w).sum() + 1e-9

        def cell(z: np.ndarray, y: np.ndarray, w=w, reach=reach) -> np.ndarray:
            step = ((z @ w + reach) * (GRID / (2 * reach))).astype(int)
            return y * GRID + np.clip(step, 0, GRID - 1)

        def sums(x: np.ndarray, y: np.ndarray, cell=cell) -> np.ndarray:
            z = standard(x, mean, scale)
            at = cell(z, y)
            return np.stack([np.bincount(at, c, 2 * GRID) for c in (np.ones(len(z)), *z.T)], axis=1)

        cells = summed(rows, sums, (2 * GRID, 1 + N_FEATURES))
        bad, good = (np.flatnonzero(cells[a : a + GRID, 0]) + a for a in (0, GRID))
        s = cells[:, 1:] @ w / np.maximum(cells[:, 0], 1)
        p = 1 / (1 + np.exp(np.clip(s[good][:, None] - s[bad], -30, 30)))
        share = cells / np.where(np.arange(2 * GRID) < GRID, n_bad, n_good)[:, None]
        grad = share[good, 1:].T @ (p @ share[bad, 0]) - share[bad, 1:].T @ (share[good, 0] @ p) - RIDGE * w
        q = p * (1 - p)
        weight = np.zeros(2 * GRID)
        weight[good], weight[bad] = q @ share[bad, 0] / n_good, share[good, 0] @ q / n_bad

        def products(x: np.ndarray, y: np.ndarray, cell=cell, weight=weight) -> np.ndarray:
            z = standard(x, mean, scale)
            return (z * weight[cell(z, y)][:, None]).T @ z

        cross = share[good, 1:].T @ q @ share[bad, 1:]
        hess = summed(rows, products, (N_FEATURES, N_FEATURES)) - cross - cross.T + RIDGE * np.eye(N_FEATURES)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w, int(n_bad), int(n_good)


def best_cut(scores: DataFrame, n_bad: int) -> float:
    """The cut of (y, s) with the fewest errors if rows below it are called 0; of equal ones the one in the widest gap.

    Errors are running sums over the distinct scores in order: within range partitions, with what lies before each."""
    by = scores.groupBy("s").agg(F.sum(F.lit(2) * F.col("y") - 1).alias("more"))
    by = stored(by.orderBy("s").withColumn("part", F.spark_partition_id()))
    order = Window.orderBy("part")  # one row a partition
    parts = by.groupBy("part").agg(F.sum("more").alias("own"), F.min("s").alias("least"))
    parts = parts.select("part", (F.sum("own").over(order) - F.col("own")).alias("before"), F.lead("least").over(order).alias("after"))
    within = Window.partitionBy("part").orderBy("s")
    wrong = F.lit(n_bad) + F.col("before") + F.sum("more").over(within.rowsBetween(Window.unboundedPreceding, 0))
    past = by.join(F.broadcast(parts), "part").select("s", wrong.alias("wrong"), F.coalesce(F.lead("s").over(within), "after").alias("next"))
    gap = F.coalesce(F.col("next") - F.col("s"), F.lit(0.0))
    least = past.agg(F.min(F.struct("wrong", -gap, "s", "next")), F.min("s")).first()
    if n_bad <= least[0].wrong:  # no better than calling all 1
        return least[1] - 1e-6
    return (least[0].s + least[0].next) / 2 if least[0].next is not None else least[0].s + 1e-6


def score_of(x: np.ndarray, model) -> np.ndarray:
    mean, scale, w, cut, slope = model
    s = raw_scores(x, mean, scale, w)
    return 1 / (1 + np.exp(-np.clip(slope * (s - cut) + np.log(CUT / (1 - CUT)), -30, 30)))


def learned(rows: DataFrame):
    """(mean, scale, weights, cut, slope) from all rows (y, x)."""
    mean, scale, w, n_bad, n_good = preferences(rows)
    if not n_bad or not n_good:
        # nothing to prefer: every score lies on the side of the one class there is
        return mean, scale, w, 0.0 if not n_bad and not n_good else -1.0 if n_good else 1.0, 1.0

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(raw_scores(matrix(batch), mean, scale, w))], ["y", "s"])

    scores = stored(rows.mapInArrow(rate, "y int, s double"))
    spread = scores.agg(F.stddev_pop("s")).first()[0]
    return mean, scale, w, best_cut(scores, n_bad), 4 / (spread + 1e-6)


def classify(docs: DataFrame, labels: DataFrame, held: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted: the quality of every whole text.

    Learns ``labels.quality`` (null: no label) from all rows whose crc32(doc_id) mod ``held``
    is not 0, and only from them.  Null and empty texts are scored by their (empty) statistics.  Without labels,
    or with one class only, all get one score.  Equal texts get equal scores.  Rows of a null id
    are scored but teach nothing; rows given twice each get a row.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    seen = stored(surface(docs.select("doc_id", "text")))
    marks = labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y"))
    marks = marks.filter(fold(F.col("doc_id"), held) != 0)
    model = learned(stored(seen.join(marks, "doc_id").select("y", "x")))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_of(matrix(batch), model))], ["doc_id", "score"])

    scored = seen.mapInArrow(rate, seen.select("doc_id", F.lit(0.0).alias("score")).schema)
    return scored.select("doc_id", (fold(F.col("doc_id"), held) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
