"""Features are read from their source once, whatever reads them after; columns meet once for all patterns."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthlens.functions.standin import distinct_terms, hashed_embedding_model, ranked_terms
from monthlens.operators import inference as I
from monthlens.operators import vectorize as V
from monthlens.operators.columns import columns

from .conftest import SF0001

ROWS = [(1, "2000-01-03", "Alpha beta beta the"), (2, "2000-01-09", "beta gamma"), (3, "2000-02-01", "the of"), (4, "2000-03-05", None), (5, "2000-04-05", "alpha")]


@pytest.fixture
def articles(spark):
    df = spark.createDataFrame(ROWS, "article_id long, display_date string, headline string")
    return df.withColumn("display_date", F.col("display_date").cast("timestamp_ntz"))


def test_features_do_not_go_back_to_the_text(spark, articles, tmp_path):
    path = str(tmp_path / "articles")
    articles.write.parquet(path)
    counts, tfidf = V.monthly_counts_and_tfidf(spark.read.parquet(path))
    for f in (counts, tfidf, V.monthly_counts(spark.read.parquet(path)), V.monthly_tfidf(spark.read.parquet(path))):
        assert not [x for df in (f.values, f.periods) for x in df.inputFiles() if path in x]
        assert f.periods.count() == 4       # months without a token too


def test_counts_beside_tfidf_are_the_counts(articles):
    alone = V.monthly_counts(articles)
    counts, tfidf = V.monthly_counts_and_tfidf(articles)
    assert sorted(counts.values.collect()) == sorted(alone.values.collect()) and counts.values.count() == 4
    per = V.tfidf_article(articles).groupBy("period", F.col("term").alias("feature")).agg(F.sum("w").alias("value"))
    want = {(r.period, r.feature): r.value for r in per.collect()}
    got = {(r.period, r.feature): r.value for r in tfidf.values.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_topics_are_read_from_lineitem_once(spark):
    from monthlens.plans.analyses import features
    f = features(spark, SF0001, "topics")
    assert not [x for df in (f.values, f.periods) for x in df.inputFiles() if "lineitem" in x]


def test_classes_of_each_pattern(spark):
    rng = np.random.default_rng(2)
    months = [dt.date(2001, m, 1) for m in range(1, 7)]
    cols = {f"f{j:02d}": rng.integers(0, 3, 6) * rng.integers(1, 4) for j in range(60)}
    values = spark.createDataFrame([(p, f, float(v)) for f, x in cols.items() for p, v in zip(months, x)], "period date, feature string, value double")
    patterns = {1: months, 2: months[1:], 3: months[:4]}
    pp = spark.createDataFrame([(k, p) for k, ps in patterns.items() for p in ps], "pattern long, period date")
    got = {(r.pattern, r.feature): (r.n, r.class_size, [(c.t, c.value) for c in r.cells]) for r in columns(values, pp).collect()}
    want = {}
    for k, ps in patterns.items():
        own = {f: [x[months.index(p)] for p in ps] for f, x in cols.items()}
        groups: dict = {}
        for f, x in own.items():
            if any(x):
                groups.setdefault(tuple(round(v / max(x), 9) for v in x), []).append(f)
        for fs in groups.values():
            want[k, min(fs)] = (len(ps), len(fs), [(t, float(v)) for t, v in enumerate(own[min(fs)]) if v])
    assert got == want


def test_batches_number_rows_of_one_id_apart(spark):
    rows = [(i, f"text {i}") for i in range(30)] + [(7, "another"), (7, "third")]
    got = I.batches(spark.createDataFrame(rows, "article_id long, headline string").repartition(5), 8).collect()
    places = sorted((r.batch_id, r.pos, r.article_id, r["item"]) for r in got)
    assert [(b, p) for b, p, _, _ in places] == [(k // 8, k % 8 + 1) for k in range(32)]
    assert [(i, t) for _, _, i, t in places] == sorted(rows)


def test_segments_are_left_out_where_none_is_asked_for(spark):
    from monthlens.sources import tables as S
    some = S.outcomes(spark, SF0001, names=["mret"])
    assert not [x for x in some.inputFiles() if "customer" in x]
    every = S.outcomes(spark, SF0001).where("outcome = 'mret'")
    assert sorted(some.collect()) == sorted(every.collect())


def test_hashed_vectors():
    import hashlib

    import pandas as pd
    items = ["the Alpha beta_2 beta_2 x", "", "Straße über naïve 12", "of the"]
    for item, got in zip(items, hashed_embedding_model(8)(pd.DataFrame({"item": items}))):
        v = np.zeros(8)
        for t in ranked_terms(item):
            h = int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "little")
            v[h % 8] += 1.0 if (h >> 31) & 1 else -1.0
        assert got == (v / (np.linalg.norm(v) or 1)).tolist()
    assert distinct_terms(items[2]) == {"straße", "über", "naïve", "12"}
