"""Audits over generated outputs: run-to-run stability and look-ahead keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: look-ahead indicative keywords (lower-case substrings) ----
LOOKAHEAD_KEYWORDS = ("crash", "crisis", "lehman", "collapse", "recession", "tarp",
                      "bailout", "meltdown", "contagion", "systemic", "subprime",
                      "great recession", "2008", "financial crisis")
# --- end fixed values ---------------------------------------------------------


def stability(g: DataFrame, setting: str = "temperature") -> DataFrame:
    """Per setting: articles whose runs all agree, mean distinct outputs
    per article, and (article, run) cells that differ from the first run.

    ``g(article_id, <setting>, run, generated_topics)``."""
    per = g.groupBy(setting, "article_id").agg(F.countDistinct("generated_topics").alias("n_unique"))
    first = F.first_value("generated_topics").over(Window.partitionBy(setting, "article_id").orderBy("run"))
    changed = (g.withColumn("first", first).groupBy(setting)
                .agg(F.count_if((F.col("run") > 0) & (F.col("generated_topics") != F.col("first"))).alias("n_changed_vs_first")))
    s = per.groupBy(setting).agg(
        F.count("*").alias("n_articles"),
        F.count_if(F.col("n_unique") == 1).alias("n_identical"),
        F.round(F.avg("n_unique"), 6).alias("avg_unique"))
    return (s.join(changed, setting)
             .select(setting, "n_articles", "n_identical",
                     F.round(F.col("n_identical") / F.col("n_articles"), 6).alias("share_identical"),
                     "avg_unique", "n_changed_vs_first"))


def flags(topics: F.Column) -> F.Column:
    low = F.lower(topics)
    kws = F.array(*[F.lit(k) for k in LOOKAHEAD_KEYWORDS])
    return F.filter(kws, lambda k: F.instr(low, k) > 0)


def lookahead(g: DataFrame, a: str = "base", b: str = "constrained") -> DataFrame:
    """Flagged articles per variant and how many outputs differ between the
    two variants (articles aligned by key, not by position)."""
    ga = g.where(F.col("variant") == a).select("article_id", F.col("generated_topics").alias("ta"))
    gb = g.where(F.col("variant") == b).select("article_id", F.col("generated_topics").alias("tb"))
    j = ga.join(gb, "article_id")
    return j.agg(
        F.count("*").alias("n_articles"),
        F.count_if(F.size(flags(F.col("ta"))) > 0).alias(f"n_flagged_{a}"),
        F.count_if(F.size(flags(F.col("tb"))) > 0).alias(f"n_flagged_{b}"),
        F.count_if(F.col("ta") != F.col("tb")).alias("n_different"))


def flagged_rows(g: DataFrame) -> DataFrame:
    """Per generated row, the keywords it contains."""
    return g.withColumn("flags", flags(F.col("generated_topics")))


def seeded_sample(df: DataFrame, n: int, seed: int, key: str = "article_id") -> DataFrame:
    """Deterministic sample of ``n`` rows without replacement: the n smallest
    md5(key:seed) values (top-n per task, then merged).
    Independent of partitioning and row order."""
    return (df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
              .orderBy("_h", key).limit(n).drop("_h"))


def in_window(df: DataFrame, start: str, end: str, col: str = "display_date") -> DataFrame:
    """Inclusive date-range filter (pushed to the Parquet scan when ``col`` is a stored column)."""
    lo = F.to_timestamp_ntz(F.lit(start))
    hi = F.to_timestamp_ntz(F.lit(end + " 23:59:59.999999"))
    return df.where(F.col(col).between(lo, hi))
