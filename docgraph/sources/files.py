"""Reading documents and their listings with Spark's file sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def document_id(path: Column, upload_id: Column) -> Column:
    """The whole digest of a whole path and upload: files of one name in two folders are two documents."""
    return F.sha1(F.concat_ws("_", path, upload_id))


def path_below(spark: SparkSession, folder: str, path: Column, otherwise: Column | None = None) -> Column:
    """The part of ``path`` below ``folder``; of a path that isn't, ``otherwise`` or its last part."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    base = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(F.element_at(F.split(path, "/"), -1) if otherwise is None else otherwise)


def read_documents(spark: SparkSession, paths: str | list[str], upload_id: str, pattern: str | None = None) -> DataFrame:
    """Whole files as documents, their content as bytes. ``source_file`` is the path below the folder that was given.

    doc_id depends on path and upload alone, so a repeated load gives the same ids.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    name = None
    for given in [paths] if isinstance(paths, str) else paths:
        name = path_below(spark, given, F.col("path"), name)
    return reader.load(paths).select(name.alias("source_file"), F.lit(upload_id).alias("upload_id"), "content", document_id(F.col("path"), F.lit(upload_id)).alias("doc_id"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def purge(spark: SparkSession, path: str, prefix: str = "") -> int:
    """Delete what lies in a folder under names that begin with ``prefix``, and leave the folder; the number of entries gone."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.listStatus(folder)] if files.exists(folder) else []
    gone = sum(files.delete(x, True) for x in found if x.getName().startswith(prefix))
    files.mkdirs(folder)
    return gone


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Stored files, the last modified first. ``timestamp_hash_name`` is taken apart; other names stay whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    stored = F.element_at(F.split("path", "/"), -1)
    parts = F.split(stored, "_", 3)
    return files.select(
        stored.alias("stored_name"), F.when(F.size(parts) == 3, parts[2]).otherwise(stored).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), content_type(stored).alias("content_type")
    ).orderBy(F.col("last_modified").desc_nulls_last(), "stored_name")


def content_type(name):  # noqa: ANN001, ANN201
    low = F.lower(name)
    return F.when(low.endswith(".xml"), "application/xml").when(low.endswith(".json") | low.endswith(".jsonld"), "application/json").when(low.endswith(".xsd"), "application/xml").otherwise("application/octet-stream")


def namespaces(docs: DataFrame) -> DataFrame:
    """(doc_id, prefix, uri) of the namespace declarations in the documents' text; the default one has an empty prefix."""
    found = F.regexp_extract_all(F.col("content").cast("string"), F.lit(r"xmlns(?::[\w.-]+)?\s*=\s*[\"'][^\"']*[\"']"), F.lit(0))
    one = docs.select("doc_id", F.explode(found).alias("d"))
    return one.select("doc_id", F.regexp_extract("d", r"xmlns:?([\w.-]*)", 1).alias("prefix"), F.regexp_extract("d", "=\\s*[\"']([^\"']*)", 1).alias("uri")).distinct()


def store(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Documents with the digest their stored name carries, by kind of file."""
    kind = F.when(F.lower("source_file").rlike(r"\.json(ld)?$"), "json").when(F.lower("source_file").endswith(".xsd"), "schema").otherwise("xml")
    docs.withColumn("file_type", kind).withColumn("digest", F.substring(F.md5("content"), 1, 8)).write.mode(mode).partitionBy("file_type").parquet(path)
