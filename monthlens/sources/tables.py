"""Input views built from the driver tables, plus file readers / writers.

Derived views (all deterministic and expressible in plain SQL):

``articles``        documents JOIN orders ON doc_id = o_orderkey
                    -> (article_id, display_date, headline)
``article_vectors`` embeddings JOIN orders ON vec_id = o_orderkey
                    -> (article_id, display_date, embedding)
``macro``           one row per month from orders (+ customer segments)
``topics``          monthly share of l_quantity per p_brand (lineitem JOIN part)

Month-level tables have one row per calendar month, so their size is bounded
by the calendar, not by the data volume; windows over them without a
partition key are acceptable and documented where used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a scan on ``key`` when it yields fewer partitions than the
    shuffle parallelism (e.g. a file with one row group). A large input already
    has many splits and is returned unchanged, so no extra shuffle is added at
    scale. The partition count comes from planning only (no job)."""
    spark = df.sparkSession
    want = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, key)


def month(col: str | F.Column) -> F.Column:
    """Month start as DATE (``trunc`` gives a date; ``date_trunc`` a timestamp)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trunc(c, "MM")


# ---------------------------------------------------------------- articles
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"), F.col("text").alias("headline")), "article_id")
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("article_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("display_date"))
    return docs.join(orders, "article_id").select("article_id", "display_date", "headline")


def article_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = spread(read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("article_id"), "embedding"), "article_id")
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("article_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("display_date"))
    return emb.join(orders, "article_id").select("article_id", "display_date", "embedding")


# ---------------------------------------------------------------- macro
def _complete_orders(orders: DataFrame) -> DataFrame:
    """Drop the trailing month when the data stops before its last day."""
    # a single scalar (one aggregate row) comes back to the driver
    cut = orders.agg(
        F.when(F.to_date(F.max("o_orderdate")) == F.last_day(F.max("o_orderdate")), F.lit(None).cast("date"))
        .otherwise(month(F.max("o_orderdate")))).first()[0]
    if cut is None:
        return orders
    return orders.where(month("o_orderdate") < F.lit(cut))


def macro_long(spark: SparkSession, sf_dir: str, complete_months_only: bool = False, segments: bool = True) -> DataFrame:
    """Outcomes in long form ``(period date, outcome string, y double)``, NULLs kept.

    mret      ln(total price / previous month's total price)
    vol       population std of ln(order price) in the month
    indpro    growth of the monthly order count
    indprol1  next month's indpro
    <seg>_vol the same per customer market segment (with ``segments``)
    """
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    if complete_months_only:
        orders = _complete_orders(orders)
    orders = orders.withColumn("period", month("o_orderdate"))
    m = orders.groupBy("period").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("c"),
                                     F.stddev_pop(F.ln("o_totalprice")).alias("vol"))
    w = Window.orderBy("period")  # month-level table: one small task
    m = (m.withColumn("mret", F.ln(F.col("s") / F.lag("s").over(w)))
          .withColumn("indpro", F.col("c") / F.lag("c").over(w) - 1.0)
          .withColumn("indprol1", F.lead("indpro").over(w)))
    base = m.select("period", F.expr(
        "stack(4, 'mret', mret, 'vol', vol, 'indpro', indpro, 'indprol1', indprol1) as (outcome, y)"))
    if not segments:
        return base.select("period", "outcome", F.col("y").cast("double").alias("y"))
    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    seg = (orders.join(cust, "o_custkey")
           .groupBy("period", "c_mktsegment")
           .agg(F.stddev_pop(F.ln("o_totalprice")).alias("y"))
           .select("period", F.concat(F.lower("c_mktsegment"), F.lit("_vol")).alias("outcome"), "y"))
    return base.unionByName(seg).select("period", "outcome", F.col("y").cast("double").alias("y"))


def outcomes(spark: SparkSession, sf_dir: str, complete_months_only: bool = False,
             names: list[str] | None = None) -> DataFrame:
    """Non-null outcome values ``(period, outcome, y)``; ``names`` filters outcomes."""
    # customers are read only where an outcome by segment is asked for
    segments = not names or any(n.endswith("_vol") for n in names)
    o = macro_long(spark, sf_dir, complete_months_only, segments).where(F.col("y").isNotNull() & ~F.isnan("y"))
    if names:
        o = o.where(F.col("outcome").isin(*names))
    return o


def macro_wide(spark: SparkSession, sf_dir: str, complete_months_only: bool = False) -> DataFrame:
    """One row per month with one column per outcome (display edge only)."""
    lng = macro_long(spark, sf_dir, complete_months_only)
    names = [r[0] for r in lng.select("outcome").distinct().orderBy("outcome").collect()]
    return lng.groupBy("period").pivot("outcome", names).agg(F.first("y"))


# ---------------------------------------------------------------- topics
def topics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(period, feature, value)``: share of the month's l_quantity per brand.

    Zero shares are absent (long sparse form)."""
    li = spread(read_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_quantity", month(F.col("l_shipdate").cast("timestamp_ntz")).alias("period")), "l_partkey")
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    cell = li.join(part, "l_partkey").groupBy("period", "p_brand").agg(F.sum("l_quantity").alias("q"))
    tot = Window.partitionBy("period")
    return cell.select("period", F.col("p_brand").alias("feature"),
                       (F.col("q") / F.sum("q").over(tot)).alias("value")).where(F.col("value") != 0)


# ---------------------------------------------------------------- file IO
def read_csv_series(spark: SparkSession, path: str, value_columns: list[str] | None = None,
                    date_column: str = "date") -> DataFrame:
    """CSV with a date column and double columns -> long ``(period, name, value)``.

    With ``value_columns`` the schema is explicit (no inference pass)."""
    if value_columns:
        schema = T.StructType([T.StructField(date_column, T.DateType())] +
                              [T.StructField(c, T.DoubleType()) for c in value_columns])
        df = spark.read.option("header", True).schema(schema).csv(path)
    else:
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    cols = [c for c in df.columns if c != date_column]
    return (df.select(month(F.col(date_column)).alias("period"),
                      *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
              .unpivot("period", cols, "name", "value"))


def write_partitioned(df: DataFrame, path: str, partition_by: list[str] | None = None,
                      mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a partition column that a table has, from its folder names; none where there is no table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()]
    return sorted(n[len(column) + 1:] for n in names if n.startswith(f"{column}="))
