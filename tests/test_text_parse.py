"""Tokeniser, stop words and reply parsing (tiny_headlines / tiny_replies)."""

import re

from pyspark.sql import functions as F

from monthlens.functions.parse import parse_lenient, parse_strict
from monthlens.functions.text import ENGLISH_STOP_WORDS, content_tokens, ellipsize, stars, tokens
from monthlens.operators import vectorize as V


def py_tokens(s):
    # independent reference: Python's unicode word rule, runs of >= 2
    return re.findall(r"(?u)\b\w\w+\b", s.lower())


TINY_HEADLINES = [
    (1, "Fed RAISES Rates; a I x", "1990-01-05"),
    (2, "Café crème & naïve façade, 2008 crash_risk", "1990-01-20"),
    (3, "the of and to in", "1990-02-03"),          # only stop words
    (4, "", "1990-02-10"),                            # empty
    (5, "date Date DATE interest", "1990-03-01"),     # 'date' is a plain term; 'interest' is a stop word
]


def test_tokeniser_matches_python_word_rule(spark):
    df = spark.createDataFrame([(i, t) for i, t, _ in TINY_HEADLINES], "id long, t string")
    got = {r.id: r.toks for r in df.select("id", tokens("t").alias("toks")).collect()}
    for i, t, _ in TINY_HEADLINES:
        assert got[i] == py_tokens(t), (i, got[i])


def test_stop_words_removed_duplicates_kept(spark):
    df = spark.createDataFrame([("the fed and the fed rates",)], "t string")
    assert df.select(content_tokens("t").alias("c")).first().c == ["fed", "fed", "rates"]
    assert len(ENGLISH_STOP_WORDS) == 318


def test_monthly_counts_and_empty_months(spark):
    a = spark.createDataFrame([(i, t, d) for i, t, d in TINY_HEADLINES], "article_id long, headline string, d string") \
             .select("article_id", "headline", F.to_timestamp("d").cast("timestamp_ntz").alias("display_date"))
    f = V.monthly_counts(a)
    vals = {(str(r.period), r.feature): r.value for r in f.values.collect()}
    assert vals[("1990-01-01", "fed")] == 1.0
    assert vals[("1990-03-01", "date")] == 3.0
    assert ("1990-03-01", "interest") not in vals
    assert not any(p == "1990-02-01" for p, _ in vals)       # only stop words / empty
    assert f.periods.count() == 3                             # ...but the month still exists
    s = V.dtm_stats(a).first()
    assert s.n_docs == 5


def test_tfidf_rows_are_unit_norm(spark):
    a = spark.createDataFrame([(i, t, d) for i, t, d in TINY_HEADLINES], "article_id long, headline string, d string") \
             .select("article_id", "headline", F.to_timestamp("d").cast("timestamp_ntz").alias("display_date"))
    w = V.tfidf_article(a)
    norms = w.groupBy("article_id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-12 for r in norms)


TINY_REPLIES = [
    ("1. a b\n2. c\n3. d", 3, ["a b", "c", "d"], ["a b", "c", "d"]),          # exact
    ("1. x\n2. y", 3, None, ["x", "y", ""]),                                    # one missing
    ("1. a\n2. b\n3. c\n4. d", 3, None, ["a", "b", "c"]),                      # one extra
    ("1. a\n2) x\n3: y", 3, ["a", "x", "y"], ["a", "x", "y"]),                 # other separators
    ("\n 1. a \n\n2. b\n\n", 2, ["a", "b"], ["a", "b"]),                       # blank lines
    ("keywords only\n2. z", 2, ["keywords only", "z"], ["keywords only", "z"]),  # unnumbered
    ("1. 2008 crash\n2. q3: 4 banks", 2, ["2008 crash", "q3: 4 banks"], ["2008 crash", "q3: 4 banks"]),
    ("x1. a\n2. b", 2, ["x1. a", "b"], ["x1. a", "b"]),                        # separator after non-number
    ("", 2, None, ["", ""]),                                                    # empty
]


def test_reply_parsing(spark):
    df = spark.createDataFrame([(t, n) for t, n, _, _ in TINY_REPLIES], "t string, n int")
    got = df.select(parse_strict("t", "n").alias("s"), parse_lenient("t", "n").alias("l")).collect()
    for (t, n, strict, lenient), r in zip(TINY_REPLIES, got):
        assert r.s == strict, (t, r.s)
        assert r.l == lenient, (t, r.l)


def test_display_helpers(spark):
    df = spark.createDataFrame([(0.005,), (0.03,), (0.07,), (0.5,)], "p double")
    assert [r.s for r in df.select(stars("p").alias("s")).collect()] == ["***", "**", "*", ""]
    h = spark.createDataFrame([("x" * 60,), ("short",)], "h string")
    out = [r.e for r in h.select(ellipsize("h").alias("e")).collect()]
    assert out[0] == "x" * 57 + "..." and out[1] == "short"
