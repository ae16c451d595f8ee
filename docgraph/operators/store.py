"""A stored graph that uploads are merged into, first writer first, with readers that see whole versions alone.

Tables are sets of immutable folders. A merge writes what is new into folders of its own and then, last, a manifest with the
next number that lists all folders of all tables. Readers take the manifest with the highest number: they see the graph
before or after, never a mixture, and a run that dies leaves folders that no manifest names. Since the first writer stays,
a merge never rewrites what is stored: it is the delta of an upload without the keys that some earlier upload has brought.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.operators.build import Graph

#: Tables of a store and the columns that tell their rows apart; those without keep every row.
KEYS = {"nodes": ("label", "id"), "edges": ("src", "dst", "rel_type"), "issues": (), "commits": (), "deletions": ()}
#: The column of which a row's bucket is the hash.
BUCKETED = {"nodes": "id", "edges": "src"}
COMMITS = "upload_id string, files long, failed long, at timestamp, version long"
DELETIONS = "upload_id string, version long"


class Conflict(RuntimeError):
    """Another writer has published this version number; merge again."""


@dataclass
class Manifest:
    """``folders``: of each table, its folders with their schemas; one that nothing was written to has no file to tell it."""

    version: int = 0
    folders: dict[str, list[tuple[str, dict]]] = field(default_factory=lambda: {t: [] for t in KEYS})


class GraphStore:
    """``path``: a folder that all executors reach. ``buckets``: folders by hash of the key below each delta, for look-ups."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ----------------------------------------------------------------------------------------------------- manifests

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in self._files.listStatus(at)] if self._files.exists(at) else []

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of ``version``; an empty one before the first."""
        numbers = [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and n[0].isdigit()]
        if version is None and not numbers:
            return Manifest()
        number = max(numbers) if version is None else version
        text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{number:012d}.json", wholetext=True).collect())  # one small file
        return Manifest(number, json.loads(text)["folders"])

    def _publish(self, now: Manifest) -> None:
        """Write under a name that readers pass over, then rename: that is the switch. A number is given out once."""
        folder = self._hadoop(f"{self.path}/manifests")
        self._files.mkdirs(folder)
        draft, final = self._hadoop(folder, f"_draft-{uuid.uuid4().hex}"), self._hadoop(folder, f"{now.version:012d}.json")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps({"folders": now.folders}).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise Conflict(f"version {now.version} is there already")

    # --------------------------------------------------------------------------------------------------------- tables

    def _read(self, table: str, at: Manifest) -> DataFrame | None:
        out = None
        for folder, schema in at.folders[table]:
            part = self.spark.read.schema(T.StructType.fromJson(schema)).parquet(f"{self.path}/{folder}")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _write(self, df: DataFrame, table: str) -> tuple[str, dict]:
        folder = f"{table}/{uuid.uuid4().hex}"
        if table in BUCKETED:
            bucket = F.pmod(F.xxhash64(BUCKETED[table]), F.lit(self.buckets)).cast("int")
            df = df.withColumn("bucket", bucket)
            df.repartition("bucket", F.pmod(F.xxhash64(F.concat_ws("\x1f", *KEYS[table])), F.lit(8))).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        else:
            df.write.parquet(f"{self.path}/{folder}")
        return folder, json.loads(df.schema.json())

    def _small(self, table: str, schema: str, at: Manifest) -> DataFrame:
        found = self._read(table, at)
        return self.spark.createDataFrame([], schema) if found is None else found

    def _live(self, rows: DataFrame, at: Manifest) -> DataFrame:
        """Without the rows of uploads that were deleted after these came."""
        if not at.folders["deletions"]:
            return rows
        gone = self._small("deletions", DELETIONS, at).groupBy("upload_id").agg(F.max("version").alias("deleted"))
        return rows.join(gone, "upload_id", "left").filter("deleted IS NULL OR version > deleted").drop("deleted")

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        """``nodes``, ``edges`` or ``issues`` of a version; None before the first merge. Issues are those of an upload's last run."""
        at = self.manifest(version)
        rows = self._read(name, at)
        if rows is None:
            return None
        if name == "issues":
            last = self.commits(version).select("upload_id", "version")
            return rows.join(last, ["upload_id", "version"], "left_semi").drop("version")
        rows = self._live(rows, at)
        return rows.drop("bucket", "version") if name in BUCKETED else rows

    def nodes_by_id(self, ids: list[str]) -> DataFrame | None:
        """The nodes with one of ``ids``: other buckets' folders are not read."""
        at = self.manifest()
        rows = self._read("nodes", at)
        if rows is None:
            return None
        wanted = self.spark.range(1).select(F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(i)), F.lit(self.buckets)).cast("int") for i in ids]))).first()[0] if ids else []
        return self._live(rows.filter(F.col("bucket").isin(wanted) & F.col("id").isin(ids)), at).drop("bucket", "version")

    def commits(self, version: int | None = None) -> DataFrame:
        """The last run of each upload: files, failed, at, version."""
        at = self.manifest(version)
        rows = self._live(self._small("commits", COMMITS, at), at)
        return rows.groupBy("upload_id").agg(F.max_by(F.struct("files", "failed", "at", "version"), "version").alias("c")).select("upload_id", "c.*")

    # ---------------------------------------------------------------------------------------------------------- writing

    def _new_rows(self, delta: DataFrame, table: str, at: Manifest) -> DataFrame:
        """Rows of ``delta``, whose keys are distinct, that no live row has the key of. The delta's keys go to the stored ones, which
        are read in these columns alone: where the delta is small Spark sends it to them and shuffles nothing stored."""
        stored = self._read(table, at)
        if stored is None:
            return delta
        keys = list(KEYS[table])
        live = self._live(stored.select(*keys, "upload_id", "version"), at)
        met = live.join(delta.select(*keys), keys, "left_semi").select(*keys).distinct()
        return delta.join(met, keys, "left_anti")

    def merge(self, nodes: DataFrame, edges: DataFrame, issues: DataFrame | None = None, files: DataFrame | None = None) -> int:
        """Publish one batch; the number of its version.

        ``nodes`` (label, id, upload_id, ord, ...) and ``edges`` (src, dst, rel_type, upload_id, ord, ...): of rows of one key
        the first in order stays, and none comes if the store has one. A key with a null in it is no key: such rows go.
        ``files`` (upload_id, failed: boolean), one row a document, gives the commits; without it uploads of the nodes do.
        A repeated batch adds nothing, and its issues and commits take the place of the last ones.
        """
        at = self.manifest()
        version = at.version + 1
        now = Manifest(version, {t: list(f) for t, f in at.folders.items()})
        for table, rows in (("nodes", nodes), ("edges", edges)):
            delta = first_rows(rows, KEYS[table]).withColumn("version", F.lit(version).cast("long"))
            now.folders[table].append(self._write(self._new_rows(delta, table, at), table))
        if issues is not None:
            now.folders["issues"].append(self._write(issues.withColumn("version", F.lit(version).cast("long")), "issues"))
        outcomes = nodes.select("upload_id", F.lit(False).alias("failed")).distinct() if files is None else files.select("upload_id", "failed")
        done = outcomes.groupBy("upload_id").agg(F.count("*").alias("files"), F.count_if("failed").alias("failed"), F.current_timestamp().alias("at"))
        now.folders["commits"].append(self._write(done.withColumn("version", F.lit(version).cast("long")), "commits"))
        self._publish(now)
        return version

    def delete_upload(self, upload_id: str) -> int:
        """From the next version on, rows that ``upload_id`` brought first are gone. It may be merged again."""
        at = self.manifest()
        now = Manifest(at.version + 1, {t: list(f) for t, f in at.folders.items()})
        row = self.spark.createDataFrame([(upload_id, now.version)], DELETIONS)
        now.folders["deletions"].append(self._write(row, "deletions"))
        self._publish(now)
        return now.version

    def compact(self) -> int:
        """The same graph in one folder a table: deltas joined, what was deleted left out."""
        at = self.manifest()
        now = Manifest(at.version + 1, {t: [] for t in KEYS})
        for table in KEYS:
            rows = self._read(table, at)
            if rows is not None and table != "deletions":
                now.folders[table] = [self._write(self._live(rows, at).drop("bucket") if table != "issues" else rows, table)]
        self._publish(now)
        return now.version

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that none of the newest ``keep`` manifests names, and the older manifests; the number of folders gone.
        Not while a merge or a reader of an older version runs."""
        numbers = sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and n[0].isdigit())
        held = {f for n in numbers[-keep:] for folders in self.manifest(n).folders.values() for f, _ in folders}
        gone = 0
        for table in KEYS:
            for name in self._names(table):
                if f"{table}/{name}" not in held:
                    gone += bool(self._files.delete(self._hadoop(f"{self.path}/{table}/{name}"), True))
        for n in numbers[:-keep]:
            self._files.delete(self._hadoop(f"{self.path}/manifests/{n:012d}.json"), False)
        return gone


def _rank(columns: list[str], schema) -> Column:  # noqa: ANN001
    """An order of rows that all agree on: ord, then the other columns as text."""
    rest = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in columns if c != "ord"]
    return F.struct(F.col("ord") if "ord" in columns else F.lit(0), *rest)


def first_rows(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row a key, the first in order; combined before the shuffle. Rows with a null in the key go."""
    rest = [c for c in rows.columns if c not in keys]
    whole = rows.dropna(subset=list(keys))
    first = whole.groupBy(*keys).agg(F.min_by(F.struct(*rest), _rank(rest, rows.schema)).alias("x"))
    return first.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest]).select(*rows.columns)


def merge_graph(store: GraphStore, graph: Graph, documents: DataFrame) -> int:
    """Merge a built graph; ``documents`` (doc_id, upload_id) are all it was built from, failed ones included."""
    bad = graph.issues.filter("severity = 'error'").select("doc_id", F.lit(True).alias("bad")).distinct()
    files = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "upload_id").distinct().join(bad, "doc_id", "left").select("upload_id", F.col("bad").isNotNull().alias("failed"))
    return store.merge(graph.nodes, graph.edges, graph.issues, files)
