"""Composite analyses: feature representation -> aligned design -> models.

Every function takes ``(spark, sf_dir, ...)`` and returns a DataFrame; the
heavy parts (tokenising, aggregation, moments, screening, optimality checks)
run as Spark jobs, the per-outcome solves in grouped Arrow tasks.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monthlens.functions.standin import keyword_model
from monthlens.functions.text import log_grid, stars
from monthlens.operators import design as D
from monthlens.operators import inference as I
from monthlens.operators import lasso as L
from monthlens.operators import ols as O
from monthlens.operators import vectorize as V
from monthlens.session import cut_lineage, ship_package
from monthlens.sources import tables as S

# --- fixed values: k sweeps and grids ----------------------
K_SWEEP = (3, 5, 7, 10, 14, 15, 19, 20, 25, 30)
LASSO_GRID = (-6, 1, 200)        # k selection
LASSO_FINE_GRID = (-7, 1, 300)   # smallest k reaching a target R²
VARIANTS_AT_ONCE = 3
# --- end fixed values ---------------------------------------------------------


# ------------------------------------------------------------------ features
def features(spark: SparkSession, sf: str, rep: str, drop_failed: bool = False) -> V.Features:
    if rep == "counts":
        return V.monthly_counts(S.articles(spark, sf))
    if rep == "tfidf":
        return V.monthly_tfidf(S.articles(spark, sf))
    if rep == "topics":
        t = cut_lineage(S.topics_long(spark, sf))              # months by brands
        return V.Features("topics", t, t.select("period").distinct(), True)
    if rep == "embeddings":
        return V.monthly_embeddings(S.article_vectors(spark, sf), drop_failed=drop_failed)
    if rep.startswith("generated"):
        variant = rep.split(":", 1)[1] if ":" in rep else "base"
        g = generated_articles(spark, sf, variants=(variant,))
        return V.monthly_counts(g.select("article_id", "display_date", F.col("generated_topics").alias("headline")),
                                rep="generated")
    raise ValueError(f"unknown representation {rep!r}")


def generated_articles(spark: SparkSession, sf: str, variants=("base",), temperatures=(0.3,), runs: int = 1,
                       model=keyword_model, store_path: str | None = None) -> DataFrame:
    """Articles with model-generated topics (stand-in model by default).

    ``store_path``: where replies are kept, a folder of the caller's; by default
    one store per model below ``spark.checkpoint.dir``. Later analyses and other
    applications resume from it instead of calling the model again."""
    a = S.articles(spark, sf)
    store = store_path or I.stable_store_path(spark, I.model_version(model), "batch=50")
    g = I.generate_topics(a, model, variants=variants, temperatures=temperatures, runs=runs, store_path=store)
    return g.join(a.select("article_id", "display_date"), "article_id")


def write_variants(spark: SparkSession, sf: str, variants, path: str, **kw) -> None:
    """Generated topics as a table partitioned by variant: article_id, display_date, generated_topics."""
    g = generated_articles(spark, sf, variants=tuple(variants), **kw)
    S.write_partitioned(g.select("article_id", "display_date", "generated_topics", "variant"), path, ["variant"])


def variant_articles(spark: SparkSession, path: str, variant: str) -> DataFrame:
    """One variant's articles; only its files are read."""
    return (spark.read.parquet(path).where(F.col("variant") == variant)
                 .select("article_id", "display_date", F.col("generated_topics").alias("headline")))


def variant_lasso(spark: SparkSession, sf: str, path: str, wanted=None, outcomes=("mret",), k: int = 5) -> DataFrame:
    """Lasso to OLS on each variant that the table at ``path`` has (of ``wanted``, if given); a
    variant that is not there is left out. The jobs of ``VARIANTS_AT_ONCE`` variants run side by side:
    a path's rounds are small jobs that leave most cores idle."""
    found = [v for v in S.partition_values(spark, path, "variant") if wanted is None or v in wanted]
    if not found:
        raise ValueError(f"no variant of {wanted} in {path}")
    y = read_outcomes(spark, sf, outcomes)
    ship_package(spark)

    def fitted(v: str) -> DataFrame:
        f = V.monthly_counts(variant_articles(spark, path, v), rep="generated")
        return lasso_ols(spark, sf, f, ks=(k,), y=y).withColumn("variant", F.lit(v))

    with ThreadPoolExecutor(VARIANTS_AT_ONCE) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(fitted), v) for v in found]
        return reduce(DataFrame.unionByName, [x.result() for x in waiting])


# ------------------------------------------------------------------ lasso -> ols
def lasso_ols(spark: SparkSession, sf: str, rep: str | V.Features | D.Design, ks=(5,), outcomes=None,
              complete_months_only: bool = False, y: DataFrame | None = None) -> DataFrame:
    """Lasso-select exactly k features per outcome over the whole grid, then
    OLS on the raw selected columns. One row per (outcome, k)."""
    des = rep if isinstance(rep, D.Design) else design(spark, sf, rep, outcomes, complete_months_only, y)
    return select_and_fit(des, L.lasso_path(des, log_grid(*LASSO_GRID)), ks, des.features.rep)


def design(spark: SparkSession, sf: str, rep: str | V.Features, outcomes=None,
           complete_months_only: bool = False, y: DataFrame | None = None) -> D.Design:
    """Materialised design of one representation against the outcomes (build
    once, reuse for several selections). ``y``: the outcomes, where they were read before."""
    f = rep if isinstance(rep, V.Features) else features(spark, sf, rep)
    return D.build_design(f, read_outcomes(spark, sf, outcomes, complete_months_only) if y is None else y)


def read_outcomes(spark: SparkSession, sf: str, outcomes=None, complete_months_only: bool = False) -> DataFrame:
    """The outcomes written as a table, months by outcomes."""
    return cut_lineage(S.outcomes(spark, sf, complete_months_only, list(outcomes) if outcomes else None))


def select_and_fit(des: D.Design, path: L.LassoPath, ks, rep: str) -> DataFrame:
    picks = L.select_k(path, list(ks))
    sel = L.selected_features(path, picks)
    res = O.ols_groups(picks.select("outcome", "k"), sel, path.cells(), des.y, ["outcome", "k"])
    res = res.join(picks.select("outcome", "k", "alpha", "nnz"), ["outcome", "k"])
    return (O.with_stars(res)
            .select(F.lit(rep).alias("rep"), "outcome", "k", "alpha", "nnz", "n", "n_features", "r2", "adj_r2",
                    "fstat", "f_pvalue", "intercept", "terms"))


def order_terms_by_abs_coef(df: DataFrame) -> DataFrame:
    return df.withColumn("terms", F.array_sort(
        "terms", lambda a, b: F.when(F.abs(a["coef"]) > F.abs(b["coef"]), -1)
                                .when(F.abs(a["coef"]) < F.abs(b["coef"]), 1)
                                .when(a["feature"] < b["feature"], -1).otherwise(1)))


def r2_summary(res: DataFrame) -> DataFrame:
    """Mean / median / min / max R², best and worst outcome, per outcome family
    and overall (rollup; family NULL = all)."""
    fam = F.when(F.col("outcome").endswith("_vol"), "industry_vol").otherwise("macro")
    return (res.withColumn("family", fam).rollup("family")
               .agg(F.count("*").alias("n_models"), F.avg("r2").alias("mean_r2"),
                    F.median("r2").alias("median_r2"), F.min("r2").alias("min_r2"), F.max("r2").alias("max_r2"),
                    F.max_by("outcome", "r2").alias("best_outcome"), F.min_by("outcome", "r2").alias("worst_outcome"))
               .withColumn("family", F.coalesce("family", F.lit("all"))))


def selection_frequency(res: DataFrame, top: int = 25) -> DataFrame:
    """How often each feature is selected across outcomes (top-n report)."""
    return (res.select(F.explode("terms").alias("t")).groupBy(F.col("t.feature").alias("feature"))
               .agg(F.count("*").alias("times_selected"))
               .orderBy(F.desc("times_selected"), "feature").limit(top))


# ------------------------------------------------------------------ k to match
def k_to_match(spark: SparkSession, sf: str, rep: str | V.Features | D.Design, targets: DataFrame,
               complete_months_only: bool = False, path: L.LassoPath | None = None) -> DataFrame:
    """Smallest support size k (fine grid, smallest alpha per k) whose OLS R²
    reaches the outcome's target R². ``targets(outcome, target_r2)``.
    -> (outcome, target_r2, k_match, matched_r2); NULL when never reached.

    One path over the whole grid (``path``, where it was solved before): every
    support size that occurs is tried."""
    targets = cut_lineage(targets)
    names = [r[0] for r in targets.select("outcome").collect()]   # outcome names only
    if path is None:
        des = rep if isinstance(rep, D.Design) else design(spark, sf, rep, names, complete_months_only)
        path = L.lasso_path(des, log_grid(*LASSO_FINE_GRID))
    path, des = path.on(log_grid(*LASSO_FINE_GRID)), path.design
    found = O.first_reaching(L.selected_features(path, L.exact_k_points(path)), path.columns, des.y, targets)
    return targets.join(found, "outcome", "left").select("outcome", "target_r2", "k_match", "matched_r2")


def compare_reps(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """Side by side R² per outcome with the winner."""
    j = a.select("outcome", F.col("r2").alias(f"r2_{name_a}")).join(
        b.select("outcome", F.col("r2").alias(f"r2_{name_b}")), "outcome")
    ra, rb = F.col(f"r2_{name_a}"), F.col(f"r2_{name_b}")
    return j.withColumn("winner", F.when(ra > rb, name_a).when(rb > ra, name_b).otherwise("tie"))


def report(cmp: DataFrame) -> DataFrame:
    """A comparison's columns as printed: '>max' where no size matches, 'N/A' for a missing R²."""
    shown = lambda c: F.when(F.col(c).isNull(), F.lit("N/A")).otherwise(F.format_string("%.4f", F.col(c)))
    return cmp.select("outcome", *[shown(c).alias(c) for c in cmp.columns if c.startswith("r2_")], "winner",
                      F.coalesce(F.col("k_match").cast("string"), F.lit(">max")).alias("k_to_match"), shown("matched_r2").alias("matched_r2"))


def side_by_side(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """Pair two ranked term lists per outcome by rank (|coef| desc), padding
    the shorter with NULLs (full outer join on rank)."""
    def ranked(df, nm):
        e = df.select("outcome", F.explode("terms").alias("t"))
        w = Window.partitionBy("outcome").orderBy(F.desc(F.abs("t.coef")), "t.feature")
        return e.select("outcome", F.row_number().over(w).alias("rank"),
                        F.col("t.feature").alias(f"{nm}_feature"), F.col("t.coef").alias(f"{nm}_coef"),
                        stars(F.col("t.p")).alias(f"{nm}_stars"))
    return ranked(a, name_a).join(ranked(b, name_b), ["outcome", "rank"], "full")


def representation_table(spark: SparkSession, sf: str, outcome: str = "mret", k: int = 5) -> DataFrame:
    """One row per representation: number of features, R², adjusted R², picks."""
    out, y = None, read_outcomes(spark, sf, [outcome])
    counts, tfidf = V.monthly_counts_and_tfidf(S.articles(spark, sf))
    for rep in ("topics", counts, tfidf, "generated", "embeddings"):
        des = design(spark, sf, rep, y=y)
        size = des.features.values.agg(F.count_distinct("feature").alias("p"))
        row = lasso_ols(spark, sf, des, ks=(k,)).withColumn("p", F.lit(size.first()["p"]))
        out = row if out is None else out.unionByName(row)
    return out.select("rep", "outcome", "k", "p", "nnz", "n", "r2", "adj_r2", "f_pvalue")


def k_sweep_table(res: DataFrame) -> DataFrame:
    return res.select("rep", "outcome", "k", "alpha", "nnz", "n_features", "r2", "adj_r2", "f_pvalue")


def comparison_summary(cmp: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """Mean / median R² per representation, wins of each, and (when present)
    the k needed by ``name_b`` to match ``name_a``: mean, median, min, max and
    the count of outcomes never matched."""
    ra, rb = F.col(f"r2_{name_a}"), F.col(f"r2_{name_b}")
    aggs = [F.count("*").alias("n_outcomes"),
            F.avg(ra).alias(f"mean_r2_{name_a}"), F.median(ra).alias(f"median_r2_{name_a}"),
            F.avg(rb).alias(f"mean_r2_{name_b}"), F.median(rb).alias(f"median_r2_{name_b}"),
            F.count_if(ra > rb).alias(f"wins_{name_a}"), F.count_if(rb > ra).alias(f"wins_{name_b}"),
            F.count_if(ra == rb).alias("ties")]
    if "k_match" in cmp.columns:
        aggs += [F.avg("k_match").alias("mean_k_match"), F.median("k_match").alias("median_k_match"),
                 F.min("k_match").alias("min_k_match"), F.max("k_match").alias("max_k_match"),
                 F.count_if(F.col("k_match").isNull()).alias("n_unmatched")]
    return cmp.agg(*aggs)
