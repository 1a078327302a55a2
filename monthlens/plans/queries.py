"""Registered queries: callables ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or views Spark derives from them) in
full; values that are compared against the SQL oracle are rounded the same
way on both sides and every computed column is aliased.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthlens.operators import vectorize as V
from monthlens.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r(c, d: int = 8):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


# ----------------------------------------------------------- featurisation
@query("top_terms")
def q_top_terms(spark, sf):
    t = V.top_terms(S.articles(spark, sf), 25)
    return t.select(F.col("rank").cast("bigint").alias("rank"), "term", "freq")


@query("dtm_stats")
def q_dtm_stats(spark, sf):
    return V.dtm_stats(S.articles(spark, sf))


@query("monthly_counts")
def q_monthly_counts(spark, sf):
    return V.monthly_counts(S.articles(spark, sf)).values


@query("monthly_tfidf")
def q_monthly_tfidf(spark, sf):
    v = V.monthly_tfidf(S.articles(spark, sf)).values
    return v.select("period", "feature", r("value").alias("value"))


@query("monthly_embeddings")
def q_monthly_embeddings(spark, sf):
    v = V.monthly_embeddings(S.article_vectors(spark, sf)).values
    return v.select("period", "feature", r("value").alias("value"))


@query("macro_outcomes")
def q_macro(spark, sf):
    return S.outcomes(spark, sf).select("period", "outcome", r("y").alias("y"))


@query("macro_from_csv")
def q_macro_from_csv(spark, sf):
    """The outcomes by month written as CSV with a date column, and read back with a schema."""
    import os
    import uuid

    from monthlens.session import ensure_checkpoint_dir
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", f"macro-{uuid.uuid4().hex}.csv")
    wide = S.macro_wide(spark, sf).withColumnRenamed("period", "date")
    wide.write.option("header", True).csv(path)
    back = S.read_csv_series(spark, path, [c for c in wide.columns if c != "date"])
    return back.where(F.col("value").isNotNull()).select("period", F.col("name").alias("outcome"), r("value").alias("y"))


@query("topic_shares")
def q_topics(spark, sf):
    return S.topics_long(spark, sf).select("period", "feature", r("value").alias("value"))


# ----------------------------------------------------------- design / screening
@query("count_moments")
def q_count_moments(spark, sf):
    f = V.monthly_counts(S.articles(spark, sf))
    n = f.periods.count()
    m = f.values.groupBy("feature").agg(F.sum("value").alias("s1"), F.sum(F.col("value") ** 2).alias("s2"))
    mu = F.col("s1") / n
    return m.select("feature", F.lit(n).cast("bigint").alias("n"), r(mu).alias("mu"),
                    r(F.sqrt(F.greatest(F.col("s2") / n - mu * mu, F.lit(0.0)))).alias("sigma"))


@query("lasso_alpha_max")
def q_alpha_max(spark, sf):
    from monthlens.operators import design as D
    from monthlens.operators import lasso as L
    f = V.monthly_counts(S.articles(spark, sf))
    des = D.build_design(f, S.outcomes(spark, sf, complete_months_only=False))
    return L.largest_scores(des).select("outcome", r("score", 6).alias("alpha_max"))


# ----------------------------------------------------------- lasso -> ols
def _lasso_all(spark, sf, rep):
    from monthlens.plans import analyses as A
    return A.order_terms_by_abs_coef(A.lasso_ols(spark, sf, rep, ks=(5,)))


@query("lasso_topics_mret")
def q_lasso_topics_mret(spark, sf):
    from monthlens.plans import analyses as A
    return A.order_terms_by_abs_coef(A.lasso_ols(spark, sf, "topics", ks=(5,), outcomes=["mret"]))


@query("lasso_topics_all")
def q_lasso_topics_all(spark, sf):
    return _lasso_all(spark, sf, "topics")


@query("lasso_topics_summary")
def q_lasso_topics_summary(spark, sf):
    from monthlens.plans import analyses as A
    return A.r2_summary(_lasso_all(spark, sf, "topics"))


@query("selection_frequency")
def q_selection_frequency(spark, sf):
    from monthlens.plans import analyses as A
    return A.selection_frequency(_lasso_all(spark, sf, "topics"))


@query("counts_vs_topics")
def q_counts_vs_topics(spark, sf):
    from monthlens.plans import analyses as A
    from monthlens.session import cut_lineage
    t = cut_lineage(_lasso_all(spark, sf, "topics"))       # read for the comparison and for the targets
    # one path over the points of both grids: k = 5 on the one, k to match on the other
    grid, fine = A.log_grid(*A.LASSO_GRID), A.log_grid(*A.LASSO_FINE_GRID)
    des = A.design(spark, sf, "counts")
    path = A.L.lasso_path(des, sorted({*grid, *fine}))
    c = A.order_terms_by_abs_coef(A.select_and_fit(des, path.on(grid), (5,), "counts"))
    cmp = A.compare_reps(t, c, "topics", "counts")
    km = A.k_to_match(spark, sf, des, t.select("outcome", F.col("r2").alias("target_r2")), path=path)
    return cmp.join(km.drop("target_r2"), "outcome", "left")


@query("counts_vs_topics_report")
def q_counts_vs_topics_report(spark, sf):
    """The comparison as it is printed: missing values spelled out."""
    from monthlens.plans import analyses as A
    return A.report(QUERIES["counts_vs_topics"](spark, sf))


@query("ols_single_topics")
def q_ols_single_topics(spark, sf):
    """OLS with inference of every outcome on every topic alone."""
    from monthlens.operators import ols as O
    from monthlens.plans import analyses as A
    des = A.design(spark, sf, "topics")
    topics = des.features.values.select("feature").distinct()
    groups = des.op.select("outcome").join(topics.withColumnRenamed("feature", "topic"))
    res = O.ols_groups(groups, groups.withColumn("feature", F.col("topic")), des.features.values, des.y, ["outcome", "topic"])
    t = F.col("terms")[0]
    return res.select("outcome", "topic", "n", r("intercept", 6).alias("intercept"), r(t["coef"], 6).alias("coef"), r(t["se"], 6).alias("se"),
                      r(t["t"], 6).alias("t"), r("r2", 8).alias("r2"), r("adj_r2", 8).alias("adj_r2"), r("fstat", 6).alias("fstat"))


@query("standardised_variance")
def q_standardised_variance(spark, sf):
    """Months, features and the variance of all cells of the standardised matrix (what scales an RBF kernel)."""
    from monthlens.operators import gram as G
    from monthlens.operators import ridge as R
    f = V.monthly_embeddings(S.article_vectors(spark, sf))
    n, p = len(R.month_order(f.periods)), f.values.select("feature").distinct().count()
    trace = float(G.gram(G.packed(f.values, f.periods), n).trace())
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n"), F.lit(p).cast("bigint").alias("p"), F.round(F.lit(trace / (n * p)), 8).alias("variance"))


@query("tfidf_vs_counts")
def q_tfidf_vs_counts(spark, sf):
    from monthlens.plans import analyses as A
    y = A.read_outcomes(spark, sf)
    c, t = (A.lasso_ols(spark, sf, f, ks=(5,), y=y) for f in V.monthly_counts_and_tfidf(S.articles(spark, sf)))
    return A.compare_reps(A.order_terms_by_abs_coef(t), A.order_terms_by_abs_coef(c), "tfidf", "counts")


@query("tfidf_counts_side_by_side")
def q_side_by_side(spark, sf):
    from monthlens.plans import analyses as A
    y = A.read_outcomes(spark, sf, ["mret"])
    c, t = (A.lasso_ols(spark, sf, f, ks=(5,), y=y) for f in V.monthly_counts_and_tfidf(S.articles(spark, sf)))
    return A.side_by_side(c, t, "counts", "tfidf")


@query("representation_table")
def q_representation_table(spark, sf):
    """Five representations side by side: k = 5 on mret, with the size of each."""
    from monthlens.plans import analyses as A
    return A.representation_table(spark, sf)


@query("generated_topics_mret")
def q_generated_mret(spark, sf):
    from monthlens.plans import analyses as A
    return A.order_terms_by_abs_coef(A.lasso_ols(spark, sf, "generated", ks=(5,), outcomes=["mret"]))


@query("persona_lasso")
def q_persona_lasso(spark, sf):
    """k = 5 on mret for each instruction variant: the topics are written as a table by variant,
    and the variants found there are read back one by one."""
    import os
    import uuid

    from monthlens.plans import analyses as A
    from monthlens.session import ensure_checkpoint_dir
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", f"topics-by-variant-{uuid.uuid4().hex}")
    A.write_variants(spark, sf, ("base", "bull", "bear"), path)
    return A.variant_lasso(spark, sf, path).select("variant", F.upper("variant").alias("label"), "outcome", "k", "nnz", "r2",
                                                   "adj_r2", "f_pvalue", "terms")


@query("embeddings_k_sweep")
def q_embeddings_k_sweep(spark, sf):
    from monthlens.plans import analyses as A
    return A.k_sweep_table(A.lasso_ols(spark, sf, "embeddings", ks=A.K_SWEEP, outcomes=["mret"]))


# ----------------------------------------------------------- inference layer
def _gen(spark, sf, **kw):
    from monthlens.plans import analyses as A
    return A.generated_articles(spark, sf, **kw)


@query("batch_prompts")
def q_batch_prompts(spark, sf):
    from monthlens.operators import inference as I
    items = I.batches(S.articles(spark, sf), 50)
    return I.prompts(items).select("batch_id", F.col("n").cast("bigint").alias("n"), F.md5("prompt").alias("prompt_md5"))


@query("head_prompts")
def q_head_prompts(spark, sf):
    """The prompts of the first 100 articles (a trial run: the limit is the feature)."""
    from monthlens.operators import inference as I
    first = S.articles(spark, sf).orderBy("article_id").limit(100)
    return I.prompts(I.batches(first, 50)).select("batch_id", F.col("n").cast("bigint").alias("n"), F.md5("prompt").alias("prompt_md5"))


@query("remaining_prompts")
def q_remaining_prompts(spark, sf):
    """The prompts of all articles after those first 100, by position."""
    from monthlens.operators import inference as I
    rest = I.positions_from(S.articles(spark, sf), ["article_id"], 100)
    return I.prompts(I.batches(rest, 50)).select("batch_id", F.col("n").cast("bigint").alias("n"), F.md5("prompt").alias("prompt_md5"))


@query("generated_topics")
def q_generated_topics(spark, sf):
    return _gen(spark, sf).select("article_id", "generated_topics")


@query("turn_stability")
def q_turn_stability(spark, sf):
    """Run-to-run stability on given texts: a conversation's turns of one role
    as the runs, the first such turn as the first run."""
    from pyspark.sql import Window

    from monthlens.operators import audit as AU
    c = S.read_table(spark, sf, "conversations")
    run = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) - 1
    g = c.select(F.col("conv_id").alias("article_id"), "role", run.alias("run"), F.col("text").alias("generated_topics"))
    return AU.stability(g, "role")


@query("empty_share_by_source")
def q_empty_share(spark, sf):
    """Documents, texts without a word of two letters or digits, and their share, per source."""
    d = S.read_table(spark, sf, "documents").select("source", (~F.coalesce(F.col("text"), F.lit("")).rlike("[\\p{L}\\p{N}]{2}")).alias("e"))
    return d.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if("e").alias("n_empty"),
                                   r(F.avg(F.col("e").cast("double")), 6).alias("empty_share"))


@query("lookahead_audit")
def q_lookahead(spark, sf):
    from monthlens.operators import audit as AU
    g = _gen(spark, sf, variants=("base", "constrained"))
    return AU.lookahead(g, "base", "constrained")


# ----------------------------------------------------------- time series
@query("target_moments")
def q_target_moments(spark, sf):
    """Sample, span, mean and population standard deviation of every outcome."""
    return S.outcomes(spark, sf).groupBy("outcome").agg(
        F.count("*").alias("n"), F.min("period").alias("first_period"), F.max("period").alias("last_period"),
        r(F.avg("y"), 8).alias("mean"), r(F.stddev_pop("y"), 8).alias("std"))


def _indprol1(spark, sf):
    return S.outcomes(spark, sf, complete_months_only=False, names=["indprol1"]).select("period", "y")


@query("hist_mean_forecast")
def q_hist_mean_forecast(spark, sf):
    from monthlens.operators import timeseries as TS
    fc = TS.expanding_mean_forecast(_indprol1(spark, sf)).where("is_test")
    fc = TS.running_r2(fc)
    return fc.select("period", F.col("t").cast("bigint").alias("t"), r("y").alias("y"),
                     r("forecast").alias("forecast"), r("running_r2", 6).alias("running_r2"))


@query("hist_mean_oos")
def q_hist_mean_oos(spark, sf):
    from monthlens.operators import timeseries as TS
    fc = TS.expanding_mean_forecast(_indprol1(spark, sf))
    return fc.where("is_test").agg(F.count("*").alias("n_test"), r(TS.r2("y", "forecast"), 6).alias("oos_r2"),
                                   r(TS.mse("y", "forecast"), 10).alias("mse"))


@query("chrono_split_folds")
def q_split_folds(spark, sf):
    from monthlens.operators import timeseries as TS
    y = S.outcomes(spark, sf, complete_months_only=False, names=["mret"]).select("period", "y")
    al = y.join(S.topics_long(spark, sf).select("period").distinct(), "period")
    sp = TS.chrono_split(al, 0.8)
    folds = TS.contiguous_folds(sp.where(F.col("split") == "train").select("period"), 5)
    return sp.join(folds, "period", "left").select("period", "split", F.col("fold").cast("bigint").alias("fold"))


# ----------------------------------------------------------- ridge
@query("gram_embeddings")
def q_gram_embeddings(spark, sf):
    from monthlens.operators import ridge as R
    g = R.centred_gram(V.monthly_embeddings(S.article_vectors(spark, sf)))
    return g.select("period_a", "period_b", r("k", 6).alias("k"))


@query("recover_topics")
def q_recover_topics(spark, sf):
    from monthlens.plans import ridge_plans as RP
    return RP.recover_topics(spark, sf)


@query("recover_topics_report")
def q_recover_report(spark, sf):
    """The 20 best and the 10 worst recovered topics (the limits are the report)."""
    from monthlens.plans import ridge_plans as RP
    return RP.best_and_worst(RP.recover_topics(spark, sf), 20, 10)


@query("recover_topics_featured")
def q_recover_featured(spark, sf):
    """Topics looked up by name, with their rank among all."""
    from monthlens.plans import ridge_plans as RP
    return RP.featured(RP.recover_topics(spark, sf), RP.FEATURED)


@query("recover_terms_top50")
def q_recover_top50(spark, sf):
    from monthlens.plans import ridge_plans as RP
    return RP.recover_generated_terms(spark, sf, top=50)


@query("recover_terms_all")
def q_recover_all(spark, sf):
    from monthlens.plans import ridge_plans as RP
    return RP.recover_generated_terms(spark, sf, top=None)


@query("expanding_ridge_terms")
def q_expanding_terms(spark, sf):
    from monthlens.plans import ridge_plans as RP
    return RP.expanding_forecast(spark, sf, "generated")


@query("expanding_ridge_embeddings")
def q_expanding_emb(spark, sf):
    from monthlens.plans import ridge_plans as RP
    return RP.expanding_forecast(spark, sf, "embeddings")


@query("kernel_ridge_compare")
def q_kernel_ridge(spark, sf):
    from monthlens.plans import ridge_plans as RP
    return RP.kernel_ridge_compare(spark, sf)


@query("oos_ridge_lasso_compare")
def q_oos_ridge_lasso(spark, sf):
    from monthlens.plans import ridge_plans as RP
    return RP.oos_ridge_lasso_compare(spark, sf)


@query("oos_lasso_words")
def q_oos_lasso_words(spark, sf):
    from monthlens.plans import ridge_plans as RP
    return RP.lasso_cv_words(spark, sf)


@query("recover_topics_summary")
def q_recover_summary(spark, sf):
    from monthlens.plans import ridge_plans as RP
    return RP.recovery_summary(RP.recover_topics(spark, sf))


@query("recover_terms_top50_summary")
def q_recover_top50_summary(spark, sf):
    from monthlens.plans import ridge_plans as RP
    return RP.recovery_summary(RP.recover_generated_terms(spark, sf, top=50))


@query("recover_terms_all_summary")
def q_recover_all_summary(spark, sf):
    from monthlens.plans import ridge_plans as RP
    return RP.recovery_summary(RP.recover_generated_terms(spark, sf, top=None))


@query("expanding_ridge_terms_months")
def q_expanding_terms_rows(spark, sf):
    from monthlens.plans import ridge_plans as RP
    return RP.forecast_rows(spark, sf, "generated").select("period", "t", "y", "pred", "alpha", "hist_mean",
                                                           "running_r2")


@query("counts_vs_topics_summary")
def q_counts_vs_topics_summary(spark, sf):
    from monthlens.plans import analyses as A
    return A.comparison_summary(QUERIES["counts_vs_topics"](spark, sf), "topics", "counts")


@query("embedded_articles_monthly")
def q_embedded_monthly(spark, sf):
    """Batch embedding map (stand-in hashing model, 100 items per call) ->
    failed-vector counts and the monthly element-wise mean, long form."""
    from monthlens.functions.standin import hashed_embedding_model
    from monthlens.operators import inference as I
    a = S.articles(spark, sf)
    e = I.embed(a, hashed_embedding_model(64), batch_size=100)
    v = e.join(a.select("article_id", "display_date"), "article_id")
    return V.monthly_embeddings(v).values


@query("lookahead_audit_sample")
def q_lookahead_sample(spark, sf):
    """Look-ahead audit on a seeded sample of 10 articles from the last months of
    the data, from the month a year before the last article's on (the sample is
    the feature of this audit). Picked first; only they are sent to the model."""
    from monthlens.functions.standin import keyword_model
    from monthlens.operators import audit as AU
    from monthlens.operators import inference as I
    a = S.articles(spark, sf)
    last = a.agg(F.max("display_date")).first()[0]
    start = f"{last.year - 1}-{last.month:02d}-01"
    pick = AU.seeded_sample(AU.in_window(a, start, str(last.date())), 10, 123)
    g = I.generate_topics(pick, keyword_model, variants=("base", "constrained"),
                          store_path=I.stable_store_path(spark, "lookahead sample", "batch=50"))
    return AU.flagged_rows(g).select("article_id", "variant", "generated_topics",
                                     F.size("flags").cast("bigint").alias("n_flags"))


@query("gram_counts")
def q_gram_counts(spark, sf):
    """Centred Gram of the standardised monthly term counts."""
    from monthlens.operators import ridge as R
    g = R.centred_gram(V.monthly_counts(S.articles(spark, sf)))
    return g.select("period_a", "period_b", r("k", 4).alias("k"))


@query("article_term_counts")
def q_article_term_counts(spark, sf):
    """Document-term counts (article_id, term, tf), zeros absent."""
    return V.dtm(S.articles(spark, sf)).select("article_id", "term", "tf")


@query("vector_failure_summary")
def q_vector_failures(spark, sf):
    """Vectors, all-zero (failed) vectors and dimensionality."""
    s = V.vectors_failed_summary(S.article_vectors(spark, sf))
    return s.select(F.col("n_vectors").cast("bigint"), F.col("n_failed").cast("bigint"),
                    F.col("dims").cast("bigint"))


@query("generated_term_counts")
def q_generated_term_counts(spark, sf):
    """Monthly counts of the tokens of the generated topics (base variant):
    the 'generated' feature representation."""
    from monthlens.plans import analyses as A
    return A.features(spark, sf, "generated").values


@query("macro_table")
def q_macro_table(spark, sf):
    """One row per month, one column per outcome (display edge; NULLs kept)."""
    w = S.macro_wide(spark, sf)
    return w.select("period", *[r(c).alias(c) for c in w.columns if c != "period"])
