"""Text and vector featurisation into long, sparse period features.

A feature set is a pair of DataFrames:

``values``  (period date, feature string, value double) -- zeros absent
``periods`` (period date)  -- every month that has at least one source row
            (a month whose articles hold no token still counts, with all-zero
            features, as in a dense document-term matrix)

Nothing is pivoted wide: the vocabulary is data, not schema.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monthlens.functions.text import is_stop_word, tokens
from monthlens.session import cut_lineage
from monthlens.sources.tables import month


@dataclass
class Features:
    rep: str
    values: DataFrame   # period, feature, value
    periods: DataFrame  # period
    stored: bool = False  # both read a table, not the source

    def long(self) -> DataFrame:
        return self.values.select(F.lit(self.rep).alias("rep"), "period", "feature", "value")


def kept(f: Features) -> Features:
    """``f`` with its values and months written once, so that later jobs do not go back to the source."""
    return f if f.stored else Features(f.rep, cut_lineage(f.values), cut_lineage(f.periods), True)


def _token_rows(docs: DataFrame, text_col: str, key_cols: list[str]) -> DataFrame:
    """One row per non-stop token occurrence (JVM regex + InSet lookup)."""
    return (docs.select(*key_cols, F.explode(tokens(text_col)).alias("term"))
                .where(~is_stop_word("term")))


def _content(term: str) -> F.Column:
    """The term, or null for a stop word."""
    return F.when(~is_stop_word(term), F.col(term))


def with_period(df: DataFrame, ts_col: str = "display_date") -> DataFrame:
    return df.withColumn("period", month(ts_col))


# ------------------------------------------------------------------ counts
def dtm(articles: DataFrame, text_col: str = "headline") -> DataFrame:
    """Document-term counts ``(article_id, period, term, tf)``; zeros absent."""
    a = with_period(articles) if "period" not in articles.columns else articles
    return (_token_rows(a, text_col, ["article_id", "period"])
            .groupBy("article_id", "period", "term").agg(F.count("*").alias("tf")))


def monthly_counts(articles: DataFrame, text_col: str = "headline", rep: str = "counts") -> Features:
    """Monthly sums of term counts. Tokens are aggregated straight to
    (period, term): the map-side partial aggregate collapses hot terms before
    the shuffle, so no per-article matrix is materialised. One pass over the text: a row
    without a feature keeps the month of articles without a token."""
    a = with_period(articles) if "period" not in articles.columns else articles
    cells = cut_lineage(a.select("period", F.explode_outer(tokens(text_col)).alias("term"))
                         .groupBy("period", _content("term").alias("feature")).agg(F.count("*").cast("double").alias("value")))
    return Features(rep, cells.where(F.col("feature").isNotNull()), cells.select("period").distinct(), True)


# ------------------------------------------------------------------ tf-idf
#: Bytes of idf rows (terms and numbers) up to which they are broadcast.
IDF_BROADCAST_BYTES = 64 << 20


def term_rows(articles: DataFrame, text_col: str = "headline") -> DataFrame:
    """(article_id, period, terms array<struct<term, tf>>, copies): one row for each article, and how many rows it had.
    Counting and gathering go by article, so text that lies by article is not shuffled."""
    words = articles.select("article_id", "period", F.posexplode_outer(tokens(text_col)).alias("at", "word"))
    counts = (words.groupBy("article_id", "period", _content("word").alias("term"))
                   .agg(F.count("*").alias("tf"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("first")))
    cell = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
    return counts.groupBy("article_id", "period").agg(F.collect_list(cell).alias("terms"), F.sum("first").alias("copies"))


def _weights(articles: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(term rows with each article's norm, idf by term).

    Smooth idf ln((1+N)/(1+df)) + 1; N counts every article. The term rows are written once. Norms need the
    idf of every term, but one number an article comes out of that join: it is summed up before
    any shuffle and joined to the rows, not to their terms. The idf rows are broadcast
    only where their bytes, summed by a job, are few; else Spark joins by term."""
    rows = cut_lineage(term_rows(articles, text_col))
    n_docs = rows.agg(F.sum("copies")).first()[0] or 0
    cells = rows.select("article_id", F.explode("terms").alias("c")).select("article_id", "c.term", "c.tf")
    idf = cut_lineage(cells.groupBy("term").agg((F.log((1.0 + n_docs) / (1.0 + F.count("*"))) + 1.0).alias("idf")))
    if (idf.agg(F.sum(F.octet_length("term") + 40)).first()[0] or 0) <= IDF_BROADCAST_BYTES:
        idf = F.broadcast(idf)
    norms = (cells.join(idf, "term").groupBy("article_id")
                  .agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm")))
    return rows.join(norms, "article_id", "left"), idf


def tfidf_article(articles: DataFrame, text_col: str = "headline") -> DataFrame:
    """(article_id, period, term, w): smooth TF-IDF, L2-normalised per article,
    w = tf * idf / norm."""
    a = with_period(articles) if "period" not in articles.columns else articles
    rows, idf = _weights(a, text_col)
    cells = rows.select("article_id", "period", "norm", F.explode("terms").alias("c"))
    return (cells.select("article_id", "period", "norm", "c.term", "c.tf").join(idf, "term")
                 .select("article_id", "period", "term", (F.col("tf") * F.col("idf") / F.col("norm")).alias("w")))


def monthly_tfidf(articles: DataFrame, text_col: str = "headline", rep: str = "tfidf") -> Features:
    """Monthly sums of the articles' weights."""
    return monthly_counts_and_tfidf(articles, text_col, rep=rep)[1]


def monthly_counts_and_tfidf(articles: DataFrame, text_col: str = "headline", rep: str = "tfidf") -> tuple[Features, Features]:
    """Both from one pass over the text. The idf of a term is the same in all articles of a
    month, so tf / norm is summed first and multiplied by it after. A row without a term
    keeps the month of articles without a token."""
    a = with_period(articles) if "period" not in articles.columns else articles
    rows, idf = _weights(a, text_col)
    sums = (rows.select("period", "norm", F.explode_outer("terms").alias("c")).groupBy("period", F.col("c.term").alias("feature"))
                .agg(F.sum(F.col("c.tf") / F.col("norm")).alias("share"), F.sum("c.tf").cast("double").alias("count")))
    sums = cut_lineage(sums.join(idf.withColumnRenamed("term", "feature"), "feature", "left"))
    cells, periods = sums.where(F.col("feature").isNotNull()), sums.select("period").distinct()
    counts = cells.select("period", "feature", F.col("count").alias("value"))
    weights = cells.select("period", "feature", (F.col("share") * F.col("idf")).alias("value"))
    return Features("counts", counts, periods, True), Features(rep, weights, periods, True)


# ------------------------------------------------------------------ vectors
def is_failed_vector(col: str = "embedding") -> F.Column:
    return F.forall(col, lambda v: v == 0)


def monthly_vector_mean(vectors: DataFrame, col: str = "embedding", drop_failed: bool = False) -> DataFrame:
    """Element-wise monthly mean ``(period, mean array<double>)``.

    Uses the JVM ``Summarizer`` aggregate on ML vectors: one partial
    aggregate per (task, month) map-side, no explode of the dimensions."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = with_period(vectors) if "period" not in vectors.columns else vectors
    if drop_failed:
        v = v.where(~is_failed_vector(col))
    return (v.select("period", array_to_vector(F.col(col)).alias("v"))
             .groupBy("period").agg(Summarizer.mean(F.col("v")).alias("m"))
             .select("period", vector_to_array("m").alias("mean")))


def dim_name(pos: F.Column) -> F.Column:
    return F.format_string("emb_%03d", pos)


def monthly_embeddings(vectors: DataFrame, col: str = "embedding", drop_failed: bool = False,
                       rep: str = "embeddings") -> Features:
    m = cut_lineage(monthly_vector_mean(vectors, col, drop_failed))  # one row a month
    vals = (m.select("period", F.posexplode("mean").alias("pos", "value"))
             .select("period", dim_name(F.col("pos")).alias("feature"), "value")
             .where(F.col("value") != 0))
    return Features(rep, vals, m.select("period"), True)


def vectors_failed_summary(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    return vectors.agg(F.count("*").alias("n_vectors"),
                       F.count_if(is_failed_vector(col)).alias("n_failed"),
                       F.max(F.size(col)).alias("dims"))


# ------------------------------------------------------------------ stats
def term_frequency(articles: DataFrame, text_col: str = "headline") -> DataFrame:
    """Corpus frequency ``(term, freq)``."""
    return (_token_rows(articles, text_col, []).groupBy("term")
            .agg(F.count("*").alias("freq")))


def top_terms(articles: DataFrame, n: int = 25, text_col: str = "headline") -> DataFrame:
    """Top-n corpus terms, ties by term (TakeOrderedAndProject: top-n per task, then merge)."""
    w = Window.orderBy(F.desc("freq"), "term")
    tf = term_frequency(articles, text_col)
    top = tf.orderBy(F.desc("freq"), "term").limit(n)
    return top.select(F.row_number().over(w).alias("rank"), "term", "freq")


def dtm_stats(articles: DataFrame, text_col: str = "headline") -> DataFrame:
    """Documents, vocabulary, non-zeros, density and mean distinct terms per document."""
    d = dtm(articles, text_col)
    n_docs = articles.agg(F.count("*").alias("n_docs"))
    s = d.agg(F.countDistinct("term").alias("vocab"), F.count("*").alias("nnz"),
              F.sum("tf").alias("n_tokens"))
    return _stats_join(n_docs, s)


def _stats_join(nd: DataFrame, s: DataFrame) -> DataFrame:
    # both sides are single aggregate rows; a constant key makes a 1x1 equi-join
    j = nd.withColumn("_k", F.lit(1)).join(s.withColumn("_k", F.lit(1)), "_k")
    return j.select(
        F.col("n_docs").cast("bigint").alias("n_docs"),
        F.col("vocab").cast("bigint").alias("vocab"),
        F.col("nnz").cast("bigint").alias("nnz"),
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        (F.col("nnz") / (F.col("n_docs") * F.col("vocab"))).alias("density"),
        (F.col("nnz") / F.col("n_docs")).alias("avg_terms_per_doc"))
