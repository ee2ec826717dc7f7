"""The corpus pipeline: language, repeated lines, near duplicates, benchmark passages, then pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontamination, jaccard, language, lines, pieces
from quire.llm._native import table
from quire.llm._shared import written

#: A text whose language is less sure than this is rejected, as is one without letters.
LEAST_SCORE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; learned from the labelled ones among them."""
    scored = language.identify(docs, docs, keep=docs.columns)
    return scored.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that came before, in them or elsewhere; one with nothing else left goes.

    A line too short for edits goes if an equal one came before in another document; repeats inside the document where
    it first stands are left.
    """
    out = lines.dedup_lines(docs, short="elsewhere")
    left = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")) != ""
    return out.filter(left | (F.col(out.columns[len(docs.columns) + 1]) == 0)).select(*docs.columns)


def by_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of id and text, and the name of that column, which docs did not have: ids may be null or repeated,
    so stages decide by this."""
    name = "_key"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return docs.withColumn(name, F.xxhash64("doc_id", "text")), name


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id, a null one last, then the smallest key.

    Rows that share an id, null or not, but are not near each other all stay; of rows equal in id and text one stays.
    """
    keyed, key = by_row(docs)
    classes = jaccard.jaccard_classes(keyed, key).select(key, "component_id").distinct()
    spot = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)
    stays = keyed.select("doc_id", key).join(classes, key).groupBy("component_id").agg(F.min(spot)[key].alias(key)).select(key).distinct()
    return keyed.join(stays, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a trace of benchmark passages, each judged by its own text whatever its id."""
    keyed, key = by_row(docs)
    bad = decontamination.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col=key).filter("contaminated").select(key).distinct()
    return keyed.join(bad, key, "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document."""
    return pieces.encode(docs).select("doc_id", "ids", "n_pieces", "round_trip")


STAGES = [
    ("language", identified),
    ("line_dedup", fresh_lines),
    ("jaccard_join", one_of_each),
    ("decontamination", decontaminated),
    ("sentencepiece", encoded),
]
#: Learned languages and components are beyond plain SQL; a brute-force version is in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
