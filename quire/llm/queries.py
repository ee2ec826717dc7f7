"""The queries of this subpackage, each over its whole table with the parameters meant for production, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, codes, decontamination, fingerprints, jaccard, language, lines, mixing, pieces, quality, secrets, sharding, warc
from ._native import table
from .oracles import ORACLES


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).drop("row_number")


def _remainder(divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo divisor; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(_remainder(3) == 1, F.lit(False)))
    return language.identify(docs, docs.filter(~F.col("held_out")), keep=["doc_id", "held_out"])


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    number = lambda c: F.col(c).cast("long").alias(c)
    return back.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), best=True).select("doc_id", "n_pieces", "ids_crc32", "n_best", "best_crc32", "round_trip")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), short="go").select("doc_id", "n_lines", "n_dropped", "text_crc32")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", _remainder(10) == 0)
    return mixing.score_texts(docs, "held_out")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.labelled_findings(spark)).drop("value")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress_vectors(table(spark, sf_dir, "embeddings"))[0]


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))[0]


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_warc, op3_language_id, op4_jaccard_join, op5_sentencepiece, op6_secret_scan, op7_lm_scoring, op8_line_dedup, op9_quality_rules, op10_sharding, op11_vector_codes, op12_centroid_clustering, op13_fingerprints)}
ORACLE_SQL = {k: v for k, v in ORACLES.items() if k in QUERIES}
