"""Corpus pipeline: language identification, near-duplicates, decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm import decontaminate, langid, near_copies, packing, secrets
from docgraph.llm.common import materialize, table
from docgraph.session import ship_package

#: Least probability of the predicted language; evenly spread probabilities over four languages are 0.25.
MIN_LANG_SCORE = 0.35
#: Near-duplicates: sets of five-word shingles of this Jaccard similarity or more. Of the candidates, some have one of two 64-bit
#: lanes within five bits and both within 24 of 128; the others share a MinHash band. The sets themselves decide.
SIMILARITY = 0.8
WORDS, LANES, LANE_BITS, VERIFY_LANES, VERIFY_BITS = 5, 2, 5, 2, 24


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a clear language, go. With no labelled document there is no model: all stay."""
    ship_package(spark)
    model = langid.fit(langid.training_rows(docs))
    if not model.langs:
        return docs
    return langid.keep_known(docs, model, MIN_LANG_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the first in the order of the written rows; null and repeated ids do no harm."""
    ship_package(spark)
    row = "row"
    while row in docs.columns:
        row += "_"
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_copies.near_copies(keyed.select(F.col(row).alias("doc_id"), "text"), WORDS, SIMILARITY, LANE_BITS, LANES, VERIFY_LANES, VERIFY_BITS)
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(row))
    return keyed.join(first, row, "left_semi").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a paraphrase of it, go. Null and empty texts hold none; repeated rows and null ids
    are judged each by its text; very long texts are searched whole, passage by passage."""
    ship_package(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; n_chars follows. Null texts stay null, with their n_chars; all rows stay, repeated ones too."""
    ship_package(spark)
    masked = secrets.mask_secrets(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return masked.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece with its sequence and offset. Null texts are empty ones; repeated rows and null ids are packed each; long texts are cut."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: No stage is expressible in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
