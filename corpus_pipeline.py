"""From raw documents to token ids: five stages, each on all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next one's docs.  All but the last
return the columns of ``documents``.  Rows of a null doc_id go through every stage; the
near-duplicate stage cannot tell them apart and keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthlens.llm import langid, tokens
from monthlens.llm.common import fold, free, stored, table, with_text_hash
from monthlens.llm.decontaminate import decontaminate
from monthlens.llm.lines import OUT, dedup_lines
from monthlens.llm.minhash import near_duplicates
from monthlens.llm.queries import PIECE_MODEL

#: Texts whose language is less likely than this are rejected, as are those without a letter.
LEAST_SCORE = 0.4
#: Percent of their five-word shingles that near-duplicates of the pipeline share (op9 alone: 85).
NEAR_PERCENT = 80
#: Rows (24 bytes each) of ids that go or are given twice up to which they are sent to every task.
BROADCAST_ROWS = 1_000_000
ORACLE_SQL = None  # no stage but the line stage is expressible in SQL at this cost


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learns as op8 does.

    Null texts and those without a letter go, as does everything where no row has a lang to
    learn from.  Rows given twice stay or go alike."""
    langid.ship(spark)
    learnt = docs.filter((fold(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull())
    lang, score = free(docs, "_lang"), free(docs, "_score")
    found = langid.predict(docs, langid.learn(learnt.select("doc_id", "text", "lang")), lang, score)
    return found.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand earlier; one of which nothing is left goes."""
    names = {c: free(docs, c) for c in OUT}
    kept = dedup_lines(docs, keep=names)
    kept = kept.filter((F.col(names["n_removed"]) == 0) | (F.trim(names["kept_text"]) != ""))
    return kept.withColumn("text", F.col(names["kept_text"])).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; a row given twice counts once.

    Rows go by doc_id and text, so of rows with one doc_id and different texts only those go
    that are like an earlier document.  Texts stay where they lie: the ids that go, and those
    of rows given twice, come to them (by shuffle beyond ``BROADCAST_ROWS`` of them), and only
    the rows given twice are shuffled."""
    found = stored(near_duplicates(docs, percent=NEAR_PERCENT, hashed=True))
    mark, id_, n = (free(docs, c) for c in ("_text_hash", "_id", "_n"))
    told = found.groupBy(F.col("doc_id").alias(id_), F.col("thash").alias(mark)).agg(F.count("*").alias(n), F.bool_and(F.col("kept") | F.col("doc_id").isNull()).alias("stays"))
    told = stored(told.filter((F.col(n) > 1) | ~F.col("stays")).withColumn(n, F.when(F.col("stays"), F.col(n)).otherwise(0)).select(id_, mark, n))
    if told.count() <= BROADCAST_ROWS:
        told = F.broadcast(told)
    there = free(docs, "_there")
    told = told.withColumnRenamed(mark, there)
    hashed = with_text_hash(docs, mark)
    rows = hashed.join(told, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(there)), "left")
    once = rows.filter(F.col(n).isNull()).select(docs.columns)
    return once.unionAll(rows.filter(F.col(n) > 1).select(docs.columns).dropDuplicates(["doc_id", "text"]))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark question.

    Null and empty texts hold none.  Rows go by doc_id (null too) and text, so rows given twice
    stay or go alike; without questions all stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of what they decode to.  A null
    text is the empty one; rows given twice each get a row."""
    out = tokens.encoded_with_digests(docs.select("doc_id", "lang", "source", "text"), PIECE_MODEL)
    return out.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near), ("benchmark decontamination", benchmark), ("sentence pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
