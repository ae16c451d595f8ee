"""One query for each text operator, over whole tables, and oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import table
from docgraph.session import ship_package


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgraph.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgraph.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgraph.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgraph.llm.simhash import hex_fingerprint, near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), words=4, max_diff=4)
    return out.select("doc_id", hex_fingerprint(out["f0"]).alias("fingerprint"), "component_id")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgraph.llm.sstable import token_shards

    return token_shards(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgraph.llm.substrings import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgraph.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgraph.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgraph.llm.lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgraph.llm.main_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgraph.llm.hamerly import cluster_vectors, clusters_with_totals

    return clusters_with_totals(cluster_vectors(table(spark, sf_dir, "embeddings")))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgraph.llm.pii import BASE_KINDS, find_personal

    out = find_personal(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["base"]))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    of_kind = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docgraph.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    query.__name__ = f.__name__
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in (op1_pack_sequences, op2_quality_rules, op3_decontaminate, op4_simhash, op5_token_shards, op6_substring_dedup, op7_language_id, op8_secret_scan, op9_lm_score, op10_main_text, op11_centroid_clusters, op12_personal_data, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {}
