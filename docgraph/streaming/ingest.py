"""Documents from a folder as a stream: each micro-batch is shredded, built, and merged into a stored graph as one version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from docgraph.operators.build import build_graph
from docgraph.operators.store import GraphStore, merge_graph
from docgraph.sources.files import document_id, path_below
from docgraph.sources.shred import shred


def append_graph(docs: DataFrame, target: str, **options: object) -> int:
    """Merge the graph of ``docs`` into the store at ``target``, all of it or nothing; the number of the new version.

    Issues carry document and upload, so files of one name in two uploads, or in two folders, stay apart.
    """
    g = build_graph(shred(docs), **options)
    return merge_graph(GraphStore(docs.sparkSession, target), g, docs)


def published(spark: SparkSession, target: str, table: str) -> DataFrame:
    """Rows of ``nodes``, ``edges`` or ``issues`` of the newest version."""
    rows = GraphStore(spark, target).table(table)
    if rows is None:
        raise ValueError(f"nothing is published in {target}")
    return rows


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 100, **options: object) -> StreamingQuery:
    """Runs over what is there and ends. A batch that is repeated after a failure adds nothing twice."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(source)
    name = path_below(spark, source, F.col("path"))

    def batch(rows: DataFrame, number: int) -> None:
        upload = F.lit(f"batch-{number}")
        docs = rows.select(name.alias("source_file"), upload.alias("upload_id"), "content", document_id(F.col("path"), upload).alias("doc_id"))
        append_graph(docs, target, **options)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a stream's event types by window of event time; what comes later than ``late`` is left out."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
