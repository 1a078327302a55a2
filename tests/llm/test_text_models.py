"""op1, op5, op8: learned operators by held-out accuracy, and their edge cases."""

import random

import numpy as np
import pytest

from monthlens.llm import langid, quality, toxicity
from monthlens.llm.common import fold_of

LANGS = {"en": "the of and ing tion er th a".split(), "de": "der die und sch ung ein ich ß".split(), "es": "que de la ción os ar ñ el".split()}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(LANGS[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(0)
    return [(k, prose(rnd, lang, rnd.randint(8, 60)), lang) for k in range(300) for lang in [rnd.choice(list(LANGS))]]


EDGE = [(1000, None, "en"), (1001, "", None), (1002, "123 !?", "de"), (None, "the and of the", None), (1003, "ung " * 5000, "de"), (1003, "ung " * 5000, "de")]


def test_languages(documents, rows):
    got = langid.identify(documents(rows + EDGE, extra=("lang_pred", "held_out", "bucket"))).collect()
    assert len(got) == len(rows) + len(EDGE)
    by = {r.doc_id: r for r in got}
    held = [r for r in rows if fold_of(r[0], 5) == 0]
    assert np.mean([by[i].lang_pred == lang for i, _, lang in held]) > 0.95
    assert all(by[i].held_out == (fold_of(i, 5) == 0) and 0 <= by[i].score <= 1 for i, _, _ in rows)
    assert [(by[k].lang_pred, by[k].score) for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[1003].lang_pred == "de" and by[None].lang_pred == "en"


def test_languages_without_anything_to_learn_from(documents):
    assert langid.identify(documents([])).collect() == []
    got = langid.identify(documents([(1, "abc", None), (2, "x", None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2


def toxic_rows():
    rnd = random.Random(3)
    out, labels = [], []
    for k in range(400):
        words = prose(rnd, "en", rnd.randint(30, 80)).split()
        bad = k % 4 == 0
        if bad:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), "vile" + rnd.choice(["", "ly", "st", "ness"]))
        out.append((k, " ".join(words) + "."))
        labels.append((k, 1 - int(k % 5 == 0), int(bad)))
    return out, labels


def test_toxic_spans(spark, documents):
    rows, labels = toxic_rows()
    marks = spark.createDataFrame([*labels, (None, None, 1), (9999, 1, None)], "doc_id long, quality int, toxic int")
    edge = [(1000, None), (1001, ""), (None, "vile vilely"), (1002, "the and " * 20000 + "vilest"), (1002, "the and " * 20000 + "vilest")]
    got = toxicity.toxicity(documents(rows + edge, extra=("score", "spans", "toxic")), marks).collect()
    assert len(got) == len(rows) + len(edge)
    by = {r.doc_id: r for r in got}
    held = [k for k, _ in rows if fold_of(k, 3) == 1]
    assert all(by[k].held_out for k in held) and 100 < len(held) < 170
    assert np.mean([by[k].predicted == int(k % 4 == 0) for k in held]) > 0.97
    text = dict(rows)
    for k in held:
        for s in by[k].spans:
            assert text[k].encode()[s.first : s.past].startswith(b"vile")
    assert by[1002].predicted == 1 and len(by[1002].spans) == 1 and by[None].predicted == 1
    assert by[1000].predicted == by[1001].predicted == 0 and by[1000].score == by[1001].score


def test_toxicity_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.toxicity(documents([(1, "a b"), (2, None)]), none).collect()] == [0, 0]
    assert toxicity.toxicity(documents([]), none).collect() == []


def test_marginals_against_enumeration():
    rng = np.random.default_rng(4)
    head = np.array([1, 0, 0, 1, 0, 1, 0, 0, 0], bool)
    odds, trans = np.exp(rng.normal(size=9)), np.exp(rng.normal(size=(2, 2)))
    got, _, _ = toxicity.Chains(head).marginals(odds, trans)
    start = np.flatnonzero(head)
    for a, b in zip(start, [*start[1:], 9]):
        total = np.zeros((b - a, 2))
        for code in range(1 << (b - a)):
            tags = [(code >> k) & 1 for k in range(b - a)]
            w = np.prod([odds[a + k] for k, t in enumerate(tags) if t]) * np.prod([trans[x, y] for x, y in zip(tags, tags[1:])])
            for k, t in enumerate(tags):
                total[k, t] += w
        assert np.allclose(got[a:b], total[:, 1] / total[:, 0])


def test_quality(spark, documents):
    rnd = random.Random(5)
    rows, labels = [], []
    for k in range(400):
        words = prose(rnd, "en", rnd.randint(30, 80)).split()
        bad = k % 5 == 0
        if bad:
            words = [w + "###" for w in words] if k % 2 else [words[0]] * 50
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad), 0))
    marks = spark.createDataFrame([*labels, (None, 1, 0), (77777, None, 0)], "doc_id long, quality int, toxic int")
    edge = [(1000, None), (1001, ""), (1002, "the of and " * 30000), (None, "plain words here")]
    got = quality.classify(documents(rows + edge, extra=("x", "y", "score")), marks).collect()
    assert len(got) == len(rows) + len(edge)
    by = {r.doc_id: r for r in got}
    held = [k for k, _ in rows if fold_of(k, 5) == 0]
    assert all(by[k].held_out for k in held)
    assert np.mean([by[k].predicted == int(k % 5 != 0) for k in held]) > 0.95
    assert by[1000].score == by[1001].score and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len({r.score for r in quality.classify(documents(rows[:9]), none).collect()}) == 1
    assert quality.classify(documents([]), marks).collect() == []


def test_quality_learns_from_every_labelled_row(spark, documents):
    from pyspark.sql import functions as F

    rnd = random.Random(6)
    texts = [(k, " ".join(rnd.choice(["plain", "word", "Or", "7", "!!"]) for _ in range(4))) for k in range(32000)]
    quality_of = {k: int(rnd.random() < 0.1 + 0.8 * ("plain" in text)) for k, text in texts}
    rows = documents(texts).select("doc_id", "text").localCheckpoint()
    # what a draw by hash of about 20,000 rows, half of each class, leaves out
    learning = [k for k, _ in texts if fold_of(k, 5) != 0]
    ones = sum(quality_of[k] for k in learning)
    drawn = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 20)) < 10000 / min(ones, len(learning) - ones) * (1 << 20)
    out = [r[0] for r in spark.range(32000).filter(~drawn).collect() if fold_of(r[0], 5) != 0]
    # as many of each class, so that the classes keep their sizes
    pairs = list(zip([k for k in out if quality_of[k]], [k for k in out if not quality_of[k]]))
    out = {k for pair in pairs for k in pair}
    assert len(out) > 200
    flipped = {k: 1 - y if k in out else y for k, y in quality_of.items()}
    marks = [spark.createDataFrame([(k, y, 0) for k, y in m.items()], "doc_id long, quality int, toxic int") for m in (quality_of, flipped)]
    a, b = ({r.doc_id: r.score for r in quality.classify(rows, m).collect()} for m in marks)
    assert a != b


def test_quality_weights_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, quality.N_FEATURES)).astype(np.float32)
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=300) > 0.8).astype(int)
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "y int, x array<float>").repartition(5)
    mean, scale, w, cut, _ = quality.learned(rows)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    assert np.allclose(mean, x.mean(0), atol=1e-5) and np.allclose(scale, x.std(0), atol=1e-5)
    d = (z[y == 1][:, None] - z[y == 0]).reshape(-1, x.shape[1])
    v = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(d @ v))
        v += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + quality.RIDGE * np.eye(len(v)), d.T @ p / len(d) - quality.RIDGE * v)
    assert np.abs(w - v).max() < 0.01
    s = quality.raw_scores(x.astype(float), mean, scale, w)
    assert ((s >= cut) != y).sum() == min(((s >= c) != y).sum() for c in [*s, s.max() + 1])
