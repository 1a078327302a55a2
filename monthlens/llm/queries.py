"""The registered ``opN_*`` queries: each applies its operator to the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthlens.llm import decontaminate, langid, oracle, quality, tokens, toxicity, vectors
from monthlens.llm.common import table
from monthlens.llm.fingerprint import fingerprints
from monthlens.llm.infill import fill_in_middle, restored
from monthlens.llm.lines import dedup_lines
from monthlens.llm.minhash import near_duplicates
from monthlens.llm.packing import pack, token_pieces
from monthlens.llm.suffix import dedup_bytes
from monthlens.llm.superkmer import dedup_substrings

#: Where the public vocabulary files lie; a parameter of the operators.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents")).drop("removed")


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark question that it holds."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("thash")


def op4_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("removed")


def op5_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2(F.coalesce("kept_text", F.lit("")), 256)).drop("kept_text")


def op7_parsing_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.summary(docs, PIECE_MODEL).drop("text")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(token_pieces(docs, WORD_TOKENIZER, ids=False))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vectors.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    out = vectors.with_group_error(codes, "label")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vectors.digest(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_toxic_spans, op2_suffix_dedup, op3_template_decontamination, op4_superkmer_dedup, op5_quality_ranking,
    op6_line_dedup, op7_parsing_fingerprint, op8_language_id, op9_minhash_near_dedup, op10_sentence_pieces, op11_best_fit_packing,
    op12_fill_in_middle, op13_vector_codes)}
ORACLE_SQL = oracle.SQL
