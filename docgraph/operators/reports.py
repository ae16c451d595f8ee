"""Summaries of files, runs and schema trees, and searches over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_outcomes(files: DataFrame, issues: DataFrame) -> DataFrame:
    """(file, errors, warnings, successful): a file without an error is successful, also one without any issue."""
    per_file = issues.groupBy("file").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return files.select(F.col("source_file").alias("file")).distinct().join(per_file, "file", "left").fillna(0, ["errors", "warnings"]).withColumn("successful", F.col("errors") == 0)


def batch_totals(outcomes: DataFrame) -> DataFrame:
    """One row: files, successful, failed, errors, warnings."""
    return outcomes.agg(F.count("*").alias("files"), F.count_if("successful").alias("successful"), F.count_if(~F.col("successful")).alias("failed"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))


def source_files(rows: DataFrame, *columns: str) -> DataFrame:
    """The different files that rows come from, in order; the first of ``columns`` that is not null names one."""
    return rows.select(F.coalesce(*columns).alias("file")).filter("file IS NOT NULL").distinct().orderBy("file")


def stored_counts(listing: DataFrame) -> DataFrame:
    """(folders, files, xsd, xml, json) of a listing (path): folders are first steps of the paths."""
    low = F.lower("path")
    ends = lambda *e: F.count_if(low.rlike(r"\.(" + "|".join(e) + ")$"))
    return listing.agg(F.countDistinct(F.when(F.col("path").contains("/"), F.split("path", "/")[0])).alias("folders"), F.count("*").alias("files"), ends("xsd").alias("xsd"), ends("xml").alias("xml"), ends("json", "jsonld").alias("json"))


def type_shapes(tree: DataFrame) -> DataFrame:
    """(element, properties, objects): how many plain and how many nested children each element of a schema tree has."""
    parent = F.element_at(F.split("path", "/"), -2)
    one = tree.filter("depth > 0").select(parent.alias("element"), F.col("element").alias("child"), "kind").distinct()
    return one.groupBy("element").agg(F.count_if(F.col("kind") == "property").alias("properties"), F.count_if(F.col("kind") != "property").alias("objects"))


def search_tree(tree: DataFrame, term: str) -> DataFrame:
    """Rows of a schema tree whose element holds ``term`` in any case, and all that stand above one of them."""
    hit = tree.filter(F.lower("element").contains(term.lower()))
    steps = F.split("path", "/")
    above = hit.select("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("path")).distinct()
    return tree.join(above, ["root", "path"], "left_semi")


def search_types(types: DataFrame, term: str) -> DataFrame:
    """Rows (qname, category, ..) that hold ``term`` in name or category, in any case."""
    return types.filter(F.lower("qname").contains(term.lower()) | F.lower("category").contains(term.lower()))
