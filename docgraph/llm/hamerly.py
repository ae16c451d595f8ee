"""Centroid clustering of integer vectors with Hamerly's bounds (Hamerly, 2010).

Each vector keeps its centroid, one upper bound of its distance to it and one lower bound of its distance to any other.
When centroids move, the bounds are loosened by how far they moved; only a vector whose bounds then cross, and still cross
after its own distance is computed anew, is compared with all centroids. Distances are exact integers; the bounds are
floats widened by more than their rounding error, so a skipped scan never changes the result.

A round is one pass: tasks read the vectors with their bounds, and write them again beside the changes of the clusters' sums.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.llm.common import arrow_schema, drop_scratch, guarded, materialize

#: Up to this size of a component, all sums of squares of 64 differences are integers that a double holds exactly.
EXACT = 1 << 22
#: Relative widening of bounds; far above the rounding of a square root and a sum.
SLACK = 1e-9
LONG_MAX = (1 << 63) - 1
#: Sums of any size pass through Spark as digits of this many bits.
DIGIT = 40

PART = "part array<struct<cluster:int,place:int,digit:int,value:bigint>>"


@dataclass
class Clustering:
    """``assigned``: (vec_id, cluster, distance). ``centroids``: components as integers. ``scans``: full scans of each assignment."""

    assigned: DataFrame
    centroids: list[list[int]]
    scans: list[int] = field(default_factory=list)


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component: doubles while they are exact in all sums, else Python integers."""
    if not len(values) or np.abs(values).max() < EXACT / scale:
        return np.floor(values * float(scale))
    whole = [[math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale for v in row] for row in values.tolist()]
    return np.array(whole, object).reshape(values.shape)


def _matching(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if both are exact so, else as Python integers."""
    if x.dtype != object and (not centroids.size or max(abs(int(c)) for c in centroids.flat) < EXACT):
        return x, centroids.astype(np.float64)
    if x.dtype != object:
        x = np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return x, centroids


def all_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to each centroid, exact."""
    x, c = _matching(x, centroids)
    return (x * x).sum(1)[:, None] - 2 * x.dot(c.T) + (c * c).sum(1)[None, :]


def own_distances(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    x, c = _matching(x, centroids)
    diff = x - c[cluster]
    return (diff * diff).sum(1)


def root(squares: np.ndarray) -> np.ndarray:
    """Square roots as doubles; infinite where a double does not reach, which only costs a scan."""
    if squares.dtype != object:
        return np.sqrt(squares)
    roots = [math.isqrt(v) if v > 1 << 1000 else math.sqrt(v) for v in squares.ravel().tolist()]
    return np.array([float(v) if v < 1 << 1023 else np.inf for v in roots], np.float64).reshape(squares.shape)


class Assignment:
    """What tasks need for one assignment: centroids, how far each moved, half the distance from each to its nearest other."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None) -> None:
        self.centroids = np.array(centroids, object).reshape(len(centroids), -1)
        k = len(centroids)
        apart = root(all_distances(self.centroids, self.centroids)) if k > 1 else np.full((k, k), np.inf)
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(1) / 2 * (1 - SLACK) if k else np.zeros(0)
        self.first = before is None
        moved = np.zeros(k) if self.first else root(np.array([sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(centroids, before, strict=True)], object))
        self.moved = moved * (1 + SLACK)
        order = np.argsort(self.moved)
        self.farthest = int(order[-1]) if k else -1
        self.most, self.second = (self.moved[order[-1]] if k else 0.0), (self.moved[order[-2]] if k > 1 else 0.0)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New clusters and bounds, and the number of full scans."""
        cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
        if self.first:
            scan = np.arange(len(x))
        else:
            upper = upper * (1 + SLACK) + self.moved[cluster]
            lower = lower - np.where(cluster == self.farthest, self.second, self.most)
            lower -= SLACK * np.abs(lower)
            sure = np.maximum(lower, self.half[cluster])
            near = np.flatnonzero(~(upper < sure))
            if len(near):
                upper[near] = root(own_distances(x[near], self.centroids, cluster[near])) * (1 + SLACK)
            scan = near[~(upper[near] < sure[near])]
        if len(scan):
            d = all_distances(x[scan], self.centroids)
            best = d.argmin(1)  # the first of the smallest
            rows = np.arange(len(scan))
            cluster[scan], upper[scan] = best, root(d[rows, best]) * (1 + SLACK)
            if d.shape[1] > 1:
                rest = root(d)
                rest[rows, best] = np.inf
                lower[scan] = rest.min(1) * (1 - SLACK)
            else:
                lower[scan] = np.inf
        return cluster, upper, lower, len(scan)


def digits(place: tuple[int, int], value: int) -> Iterator[dict]:
    sign, rest, k = (1 if value > 0 else -1), abs(value), 0
    while rest:
        if low := rest & ((1 << DIGIT) - 1):
            yield {"cluster": place[0], "place": place[1], "digit": k, "value": sign * low}
        rest, k = rest >> DIGIT, k + 1


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), dims)


def kept_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, embedding) of the rows with exactly ``dims`` components, none of them null or not finite."""
    kind = vectors.schema["embedding"].dataType
    if not isinstance(kind, T.ArrayType):
        raise ValueError("embedding must be an array of numbers")
    exact = isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if not exact else kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).filter(finite)


def first_centroids(kept: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>``, in that order; equal ids are told apart by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.filter("vec_id IS NOT NULL").select(key.alias("key"), "embedding").orderBy("key", "embedding").limit(k).collect()
    if not rows:
        return []
    return [[int(v) for v in row] for row in quantised(np.array([r["embedding"] for r in rows], np.float64), scale)]


def _pass(state: DataFrame, work: Assignment, scale: int, dims: int) -> DataFrame:
    """Assigns every vector once. Rows with a null ``part`` are vectors, the others what this pass changes in the clusters' sums."""
    struct = T.StructType.fromDDL(f"vec_id long, cluster int, upper double, lower double, {PART}").add("embedding", state.schema["embedding"].dataType)
    arrow = arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changed: Counter = Counter()
        for b in batches:
            if not b.num_rows:
                continue
            x = quantised(matrix(b.column("embedding"), dims), scale)
            old = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            cluster, upper, lower, scans = work.assign(x, old, b.column("upper").to_numpy(zero_copy_only=False), b.column("lower").to_numpy(zero_copy_only=False))
            changed[-1, dims + 1] += scans
            for c in np.unique(np.concatenate([cluster[cluster != old], old[cluster != old]])).tolist():
                if c < 0:
                    continue
                came, left = np.flatnonzero((cluster == c) & (old != c)), np.flatnonzero((old == c) & (cluster != c))
                changed[c, dims] += len(came) - len(left)
                for place, value in enumerate((x[came].sum(0) - x[left].sum(0)).tolist()):
                    changed[c, place] += int(value)
            columns = {"vec_id": b.column("vec_id"), "cluster": pa.array(cluster, pa.int32()), "upper": pa.array(upper), "lower": pa.array(lower), "part": pa.nulls(b.num_rows, arrow.field("part").type), "embedding": b.column("embedding")}
            yield pa.RecordBatch.from_arrays([columns[n].cast(arrow.field(n).type) for n in arrow.names], schema=arrow)
        part = [d for place, value in sorted(changed.items()) for d in digits(place, value)]
        if part:
            yield pa.RecordBatch.from_pylist([{"part": part}], schema=arrow)

    return state.mapInArrow(guarded(run), struct)


def _add_changes(written: DataFrame, sums: list[list[int]], dims: int) -> int:
    """Adds what a pass changed to ``sums`` (components and a count for each cluster); gives its number of full scans."""
    parts = written.filter("part IS NOT NULL").select(F.explode("part").alias("p")).select("p.*")
    scans = 0
    for r in parts.groupBy("cluster", "place", "digit").agg(F.sum("value").alias("value")).collect():  # at most clusters x (dims + 1) x digits
        value = r["value"] << (DIGIT * r["digit"])
        if r["cluster"] < 0:
            scans += value
        else:
            sums[r["cluster"]][r["place"]] += value
    return scans


def cluster_vectors(vectors: DataFrame, k: int = 40, dims: int = 64, rounds: int = 5, scale: int = 256, seed: str = "2") -> Clustering:
    """k-means over floor(scale * x): ``rounds`` times assignment and componentwise floor of the means, then one more assignment.

    Vectors with another number of components, or with one that is null or not finite, are left out. Ties of distance go to
    the smaller centroid number, an empty cluster keeps its centroid. Repeated rows are vectors of their own; a null vec_id
    stays null and never begins a centroid. With no vector, or none with an id, there is no centroid and no row. Columns
    other than vec_id and embedding are not read. Distances over 2^63 - 1 are given as that.
    """
    kept = kept_vectors(vectors, dims)
    centroids = first_centroids(kept, k, seed, scale)
    if not centroids:
        none = kept.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clustering(none, [])
    sums = [[0] * (dims + 1) for _ in centroids]
    state = kept.select("vec_id", "embedding", F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    before, scans, last = None, [], None
    for _ in range(rounds + 1):
        work = Assignment(centroids, before)
        new = materialize(_pass(state, work, scale, dims), "bounds")
        scans.append(_add_changes(new, sums, dims))
        if last is not None:
            drop_scratch(last)
        last, state = new, new.filter("part IS NULL").drop("part")
        if len(scans) <= rounds:
            before, centroids = centroids, [[s // row[dims] for s in row[:dims]] if row[dims] else c for row, c in zip(sums, centroids, strict=True)]
    final = np.array(centroids, object)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster = b.column("cluster").to_numpy(zero_copy_only=False)
            d = own_distances(quantised(matrix(b.column("embedding"), dims), scale), final, cluster) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array([min(int(v), LONG_MAX) for v in d], pa.int64())], names=["vec_id", "cluster", "distance"])

    return Clustering(state.select("vec_id", "embedding", "cluster").mapInArrow(guarded(measure), "vec_id long, cluster int, distance long"), centroids, scans)


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clusters_with_totals(found: Clustering) -> DataFrame:
    """``assigned`` with the sum of distances over the cluster and over all, and the digest of the cluster's centroid."""
    spark = found.assigned.sparkSession
    assigned = materialize(found.assigned, "assigned")
    by = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, min(s, LONG_MAX), min(sum(by.values()), LONG_MAX), centroid_digest(found.centroids[c])) for c, s in sorted(by.items())]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster
