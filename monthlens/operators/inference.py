"""Batched model inference around a caller-supplied function, as Spark jobs.

The network call itself is the caller's; this module does the table work
around it: number the articles, cut fixed-size batches, assemble prompts per
instruction variant and parameter setting, call the model per batch inside
``mapInPandas``, parse replies with SQL expressions, retry invalid batches in
rounds (one job per round, finished batches appended to an incremental store
and skipped on rerun), fall back to a lenient parse or a filler, and join the
items back to articles.

Stored replies are keyed by what was asked (a hash of instruction and prompt),
not by a batch's number: after articles were inserted or changed, a batch with
another prompt is asked anew and an unchanged one keeps its reply.

Model interface: ``model(batch: pandas.DataFrame) -> pandas.Series[str|None]``
with columns ``batch_id, variant, temperature, run, attempt, system, prompt, n``;
``None`` means the call failed.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from monthlens.functions.parse import parse_lenient, parse_strict
from monthlens.session import cut_lineage, ship_package
from monthlens.streaming.incremental import COMPACT_AT, IncrementalTable, default_path

# --- fixed values: instructions and prompt template --------------------------
SYSTEM_BASE = "You are a financial analyst summarizing potential economic or market risks from news articles."
SYSTEM = {
    "base": SYSTEM_BASE,
    "bull": SYSTEM_BASE + " You are an overly optimistic investor who sees opportunity in every situation.",
    "bear": SYSTEM_BASE + " You are a deeply skeptical investor who sees risk and danger in market developments.",
    "constrained": (
        "You are a financial analyst working in the year the article was published. "
        "Identify economic or financial risks based ONLY on information that was available at the exact time "
        "of publication. You absolutely must NOT reference, mention, or allude to ANY future events such as the "
        "2008 financial crisis, the Lehman Brothers collapse, the housing market crash, TARP, the Great Recession, "
        "or any other events that occurred AFTER the article's publication date. Analyze ONLY what the headline "
        "says at face value, as if you have no knowledge of what happens next."),
}
PROMPT_HEAD = ("Below are {n} newspaper headlines, numbered 1 to {n}.\n\n"
               "For EACH headline, extract exactly 1-3 keyword topics about the economic or financial risk/theme.\n\n"
               "RULES:\n"
               "- Output exactly {n} lines, numbered 1 to {n}.\n"
               "- Each line must be: <number>. <1-3 keywords>\n"
               "- Do NOT skip any line. Do NOT add extra lines.\n"
               "- Do NOT repeat the headline -- only output keywords.\n\n"
               "Headlines:\n")
PROMPT_TAIL = "\n\nOutput:"
# --- end fixed values --------------------------------------------------------

KEYS = ["variant", "temperature", "run", "asked"]
REPLY_SCHEMA = ("variant string, temperature double, run int, asked string, n int, attempt int, "
                "text string, error string")
#: Calls whose replies are committed together: what a failed job loses at most.
CALLS_PER_COMMIT = 5000
#: Prompts are dealt over so many places, and each commit takes a stretch of them.
PLACES = 1 << 30


# ------------------------------------------------------------------ numbering
def global_row_number(df: DataFrame, order_cols: list[str], name: str = "rn") -> DataFrame:
    """0-based position in ``order_cols`` order without a single-task window.

    Range-partitioned sort, then per-partition record numbers (JVM
    ``monotonically_increasing_id`` encodes partition and record) plus the
    running count of the preceding partitions (one row per partition)."""
    s = (df.orderBy(*order_cols)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id()))
    s = cut_lineage(s)
    counts = s.groupBy("_pid").agg(F.count("*").alias("_c"))
    offs = counts.select("_pid", F.coalesce(F.sum("_c").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offs), "_pid")
             .withColumn(name, F.col("_off") + F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33))
             .drop("_pid", "_mid", "_off"))


def first_places(ids: DataFrame) -> DataFrame:
    """(article_id, first): how many rows lie before each id; ``ids`` (article_id, rows). As
    ``global_row_number``: running sums within range partitions, and what lies before each."""
    s = cut_lineage(ids.orderBy("article_id").withColumn("_pid", F.spark_partition_id()))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offs = s.groupBy("_pid").agg(F.sum("rows").alias("_c")).select("_pid", before.alias("_off"))
    within = Window.partitionBy("_pid").orderBy("article_id").rowsBetween(Window.unboundedPreceding, 0)
    return (s.withColumn("_run", F.sum("rows").over(within) - F.col("rows")).join(F.broadcast(offs), "_pid")
             .select("article_id", (F.col("_off") + F.col("_run")).alias("first")))


def positions_from(df: DataFrame, order_cols: list[str], start: int, stop: int | None = None) -> DataFrame:
    """Rows at positions start (0-based) to before stop in that order; the columns of df."""
    numbered = global_row_number(df, order_cols, "_at")
    inside = F.col("_at") >= start if stop is None else (F.col("_at") >= start) & (F.col("_at") < stop)
    return numbered.where(inside).select(*df.columns)


def batches(articles: DataFrame, batch_size: int = 50, text_col: str = "headline") -> DataFrame:
    """``(batch_id, pos, article_id, item)``: consecutive article_id order,
    ``pos`` 1-based inside the batch, item text on one line. Ids alone are sorted and numbered, not
    texts; rows of one id lie side by side, in the order of their texts."""
    ids = first_places(articles.select("article_id").groupBy("article_id").agg(F.count("*").alias("rows")))
    same = Window.partitionBy("article_id").orderBy(text_col)
    a = (articles.select("article_id", text_col, (F.row_number().over(same) - 1).alias("_of_id"))
                 .join(ids, "article_id").withColumn("rn", F.col("first") + F.col("_of_id")))
    return a.select(
        F.floor(F.col("rn") / batch_size).cast("bigint").alias("batch_id"),
        (F.col("rn") % batch_size + 1).cast("int").alias("pos"),
        "article_id",
        F.trim(F.regexp_replace(F.col(text_col), r"\s+", " ")).alias("item"))


def prompts(items: DataFrame) -> DataFrame:
    """One prompt per batch: ``(batch_id, n, prompt)``. Groups hold one batch
    (at most batch_size rows)."""
    g = items.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("it"))
    numbered = F.array_join(F.transform("it", lambda x: F.concat(x["pos"].cast("string"), F.lit(". "), x["item"])), "\n")
    n = F.size("it")
    head = F.replace(F.lit(PROMPT_HEAD), F.lit("{n}"), n.cast("string"))
    return g.select("batch_id", n.cast("int").alias("n"), F.concat(head, numbered, F.lit(PROMPT_TAIL)).alias("prompt"))


def settings(variants: list[str], temperatures: list[float], runs: int) -> list[tuple]:
    return [(v, float(t), r) for v in variants for t in temperatures for r in range(runs)]


def work_items(pr: DataFrame, grid: list[tuple]) -> DataFrame:
    """Prompts x (variant, temperature, run) settings, generated per row (no join)."""
    arr = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(t).alias("temperature"), F.lit(r).alias("run"))
                    for v, t, r in grid])
    sysmap = F.create_map(*[x for k, v in SYSTEM.items() for x in (F.lit(k), F.lit(v))])
    return (pr.withColumn("s", F.explode(arr))
              .select(F.col("s.variant").alias("variant"), F.col("s.temperature").alias("temperature"),
                      F.col("s.run").alias("run"), "batch_id", "n",
                      F.coalesce(sysmap[F.col("s.variant")], F.lit(SYSTEM_BASE)).alias("system"), "prompt")
              .withColumn("asked", F.md5(F.concat_ws("\n", "system", "prompt"))))


# ------------------------------------------------------------------ model map
@contextlib.contextmanager
def _arrow_rows(spark: SparkSession, rows: int):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def call_model(calls: DataFrame, model: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """One model call per setting of each row (batch_id, n, prompt, settings array<struct<variant,
    temperature, run, asked, attempt>>): the grid is streamed inside the map, over one copy of the
    prompt. A call that raises fails alone."""
    def run(it):
        for pdf in it:
            out = []
            for row in pdf.itertuples(index=False):
                for s in row.settings:
                    one = {"variant": s["variant"], "temperature": s["temperature"], "run": s["run"], "asked": s["asked"], "batch_id": row.batch_id,
                           "n": row.n, "system": SYSTEM.get(s["variant"], SYSTEM_BASE), "prompt": row.prompt, "attempt": s["attempt"]}
                    try:
                        reply = list(model(pd.DataFrame([one])))[0]
                        error = "no reply" if reply is None or pd.isna(reply) else None
                    except Exception as e:
                        reply, error = None, f"{type(e).__name__}: {e}"[:500]
                    out.append((s["variant"], s["temperature"], s["run"], s["asked"], row.n, s["attempt"], reply if error is None else None, error))
            yield pd.DataFrame(out, columns=["variant", "temperature", "run", "asked", "n", "attempt", "text", "error"])
    return calls.select("batch_id", "n", "prompt", "settings").mapInPandas(run, REPLY_SCHEMA)


def place(batch_id: str):
    """A number below PLACES that stands for a batch."""
    return F.pmod(F.xxhash64(batch_id), F.lit(PLACES))


def generate(work: DataFrame, model: Callable[[pd.DataFrame], pd.Series], max_attempts: int = 5,
             store_path: str | None = None, rows_per_call_batch: int = 16,
             calls_per_commit: int = CALLS_PER_COMMIT) -> DataFrame:
    """Retry rounds: each round calls the model for work rows without a valid
    reply yet (attempts counted per key) and appends the replies to the store,
    ``calls_per_commit`` at a time, so an interrupted round keeps what was
    committed; returns the latest reply of each work row: its columns and
    ``attempt, text, error, valid``. A rerun with the same ``store_path``, in
    this or another application, resumes: finished keys are skipped, failed
    ones continue their attempt count. Equal prompts are asked once.

    Prompts are written once each, whatever the number of settings; the settings are
    narrow rows that meet them again in the call itself."""
    spark = work.sparkSession
    ship_package(spark)
    store = IncrementalTable(spark, store_path or default_path(spark, "replies"), KEYS, "attempt", partition_by="variant")
    store.compact(REPLY_SCHEMA, at=COMPACT_AT)
    # the copies of a prompt meet in the task that made them, before anything is shuffled; each file
    # is in order of place, so that a part of the calls reads its own pages of the prompts alone
    texts = work.groupBy("batch_id", "n").agg(F.any_value("prompt").alias("prompt"), F.collect_list(F.struct(*KEYS)).alias("asks"))
    texts = cut_lineage(texts.withColumn("place", place("batch_id")).sortWithinPartitions("place"))
    work = cut_lineage(texts.select(F.inline("asks"), "batch_id", "n"))
    for _ in range(max_attempts):
        done = store.read(REPLY_SCHEMA)
        if done is None:
            pending = work.withColumn("attempt", F.lit(0))
        else:
            st = done.select(*KEYS, F.col("attempt").alias("last"),
                             parse_strict("text", "n").isNotNull().alias("ok"))
            pending = (work.join(st, KEYS, "left").where(F.col("ok").isNull() | ~F.col("ok"))
                           .withColumn("attempt", F.coalesce(F.col("last") + 1, F.lit(0)))
                           .where(F.col("attempt") < max_attempts).drop("last", "ok"))
        # the round's keys are fixed before the first commit changes the store
        pending = cut_lineage(pending.dropDuplicates(KEYS))
        calls = pending.count()
        if not calls:
            break
        parts = -(-calls // calls_per_commit)
        ends = [PLACES * k // parts for k in range(parts + 1)]
        with _arrow_rows(spark, rows_per_call_batch):
            for k in range(parts):
                inside = lambda x, k=k: (x >= ends[k]) & (x < ends[k + 1])
                own = pending.where(inside(place("batch_id"))).groupBy("batch_id").agg(F.collect_list(F.struct("variant", "temperature", "run", "asked", "attempt")).alias("settings"))
                prompts_of = texts.where(inside(F.col("place"))).select("batch_id", "n", "prompt")
                store.append(call_model(prompts_of.join(own, "batch_id"), model))
    replies = store.read(REPLY_SCHEMA)
    if replies is None:                                # no work at all
        replies = spark.createDataFrame([], REPLY_SCHEMA)
    # of its own, so that a later call may compact the store
    out = cut_lineage(work.select(*KEYS, "batch_id").join(replies, KEYS))
    return out.withColumn("valid", parse_strict("text", "n").isNotNull())


def parsed_items(replies: DataFrame) -> DataFrame:
    """One row per batch item: strict parse when valid, else lenient parse of
    the last reply text, else '' (failed). ``status`` says which."""
    items = (F.when(F.col("valid"), parse_strict("text", "n"))
              .when(F.col("text").isNotNull(), parse_lenient("text", "n"))
              .otherwise(F.array_repeat(F.lit(""), F.col("n"))))
    status = F.when(F.col("valid"), "ok").when(F.col("text").isNotNull(), "lenient").otherwise("failed")
    keys = ["variant", "temperature", "run", "batch_id"]
    return replies.select(*keys, status.alias("status"),
                          F.posexplode(items).alias("p0", "generated_topics")) \
                  .select(*keys, (F.col("p0") + 1).cast("int").alias("pos"), "generated_topics", "status")


def to_articles(parsed: DataFrame, items: DataFrame) -> DataFrame:
    """``(article_id, variant, temperature, run, generated_topics, status)``."""
    return parsed.join(items.select("batch_id", "pos", "article_id"), ["batch_id", "pos"]) \
                 .select("article_id", "variant", "temperature", "run", "generated_topics", "status")


def stable_store_path(spark: SparkSession, *key: str) -> str:
    """Store location for a model and its batching below ``spark.checkpoint.dir``
    itself (not below the application's own folder), so another application
    resumes from it. Replies are keyed by content, so inputs may share it."""
    import hashlib
    import os

    from monthlens.session import checkpoint_root, ensure_checkpoint_dir
    h = hashlib.sha1("|".join(key).encode()).hexdigest()[:16]
    return os.path.join(checkpoint_root(spark) or ensure_checkpoint_dir(spark), "incremental", f"replies-{h}")


def model_version(model: Callable) -> str:
    """What stands for a model in the key of its replies: its name and its ``version`` or, where it
    has none, a digest of its code, so that a changed model does not get old replies."""
    import hashlib
    import inspect

    version = getattr(model, "version", None)
    if version is None:
        try:
            version = hashlib.sha1(inspect.getsource(inspect.getmodule(model) or model).encode()).hexdigest()[:12]
        except (OSError, TypeError):
            version = "-"
    return f"{getattr(model, '__module__', '')}.{getattr(model, '__qualname__', type(model).__name__)}@{version}"


def generate_topics(articles: DataFrame, model: Callable[[pd.DataFrame], pd.Series], variants=("base",),
                    temperatures=(0.3,), runs: int = 1, batch_size: int = 50, max_attempts: int = 5,
                    store_path: str | None = None) -> DataFrame:
    items = cut_lineage(batches(articles, batch_size))
    work = work_items(prompts(items), settings(list(variants), list(temperatures), runs))
    replies = generate(work, model, max_attempts, store_path)
    return to_articles(parsed_items(replies), items)


def embed(articles: DataFrame, model: Callable[[pd.DataFrame], pd.Series], batch_size: int = 100,
          dims: int = 64, text_col: str = "headline") -> DataFrame:
    """Batch embedding map: one model call per batch of ``batch_size`` items;
    the model returns one vector per item (None -> zero-vector filler,
    ``status='failed'``). -> (article_id, embedding array<float>, status)"""
    spark = articles.sparkSession
    ship_package(spark)
    items = cut_lineage(batches(articles, batch_size, text_col))

    def run(it):
        for pdf in it:
            try:
                vecs = list(model(pdf))
            except Exception:
                vecs = [None] * len(pdf)
            ok = [v is not None for v in vecs]
            yield pd.DataFrame({"article_id": pdf["article_id"],
                                "embedding": [list(map(float, v)) if v is not None else [0.0] * dims for v in vecs],
                                "status": ["ok" if o else "failed" for o in ok]})
    with _arrow_rows(spark, batch_size):
        # much work on little data: a number of partitions that is not coalesced by size
        lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
        out = (items.repartition(lanes, "batch_id").sortWithinPartitions("batch_id", "pos")
                    .mapInPandas(run, "article_id bigint, embedding array<float>, status string"))
        return cut_lineage(out)
