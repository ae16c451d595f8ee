"""Near copies by the exact Jaccard similarity of shingle sets.

Candidates come from the Gray index over SimHash lanes (``simhash``), as spanning links of its groups, and from MinHash bands,
which complete it where similar sets have distant fingerprints: first the link from each row of a band to the band's first
row. What passes the exact check joins most copies, large clusters among them. Then the bands give the pairs of rows that share
one and are not joined yet; but where a band has many such pairs, which are mostly alike and not similar enough, its rows are
joined by prefixes of their sets instead, rarest shingles first (Xiao et al., 2008), which loses no similar pair, after links to
the row whose shingles are the commonest in the band. Each candidate is compared by its sets of shingles (64-bit hashes, repeats once) and links only if it reaches the similarity. With 20 bands
of 5 a pair at similarity 0.8 shares a band with probability 0.9996.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import drop_scratch, guarded, map_slices, materialize, mix64
from docgraph.llm.components import connected_components
from docgraph.llm.simhash import lanes_of, shingle_hashes, similar_links

BANDS, BAND_ROWS = 20, 5
PAIRS_PER_ROW = 2  # more in a band, and its rows are joined by prefixes
#: Odd multipliers: each gives another order of the shingles' hashes, of which 32 bits decide here.
SEEDS = (mix64(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def set_key(h: np.ndarray) -> int:
    """A hash of the set; sets of different sizes have their sizes compared as well."""
    with np.errstate(over="ignore"):
        return int(mix64(h + np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64).view(np.int64))


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of the band's smallest scrambled hashes. An empty set has none."""
    if not len(h):
        return np.zeros(0, np.int64)
    least, low = np.full(len(SEEDS), np.iinfo(np.uint32).max, np.uint32), h.astype(np.uint32)
    for at in range(0, len(low), 256):
        least = np.minimum(least, (low[at : at + 256, None] * SEEDS).min(0))
    least = least.astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = mix64(key ^ least[k::BAND_ROWS])
    return key.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / max(1, len(a) + len(b) - both)


def prints(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    def hashed(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
        got = [lanes_of(h, lanes) for h in sets]
        out = {"doc_id": batch.column("doc_id"), "set": [set_key(h) for h in sets], "n": [len(h) for h in sets], "bands": [band_keys(h) for h in sets]}
        return out | {f"f{k}": [x[k] for x in got] for k in range(lanes)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(rows, hashed, "doc_id long, set long, n long, bands array<long>, " + ", ".join(f"f{k} long" for k in range(lanes)))


PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def ordered(pairs: DataFrame) -> DataFrame:
    """Each pair of different ids once, the smaller first."""
    return pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def band_stars(nodes: DataFrame, least: float) -> DataFrame:
    """(u, v): each row of ``nodes`` (id, n, bands) with the first one of each of its bands, if their sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None
        for b in batches:
            if not b.num_rows:
                continue
            key, ids, n = (b.column(c).to_numpy() for c in ("key", "id", "n"))
            if centre is not None:
                key, ids, n = (np.append(x, y) for x, y in zip(centre, (key, ids, n)))
            first = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), np.arange(len(key)), 0))
            near = (first != np.arange(len(key))) & (np.minimum(n, n[first]) >= least * np.maximum(n, n[first]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[first][near]), pa.array(ids[near])], schema=PAIRS)
            centre = tuple(x[first[-1] : first[-1] + 1] for x in (key, ids, n))

    keyed = nodes.select(F.explode("bands").alias("key"), "id", "n")
    return keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(guarded(run), "u long, v long")


def crowded_bands(nodes: DataFrame) -> DataFrame:
    """(key, crowded) of the bands that rows of different parts share, and whether they have over PAIRS_PER_ROW such pairs a row."""
    parts = nodes.select(F.explode("bands").alias("key"), "part").groupBy("key", "part").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    pairs = (F.col("n") * F.col("n") - F.col("own")) / 2
    return sizes.filter(pairs > 0).select("key", (pairs > PAIRS_PER_ROW * F.col("n")).alias("crowded"))


def prefixes(nodes: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """(id, n, at, short, h, common), written: the first shingles of the sets of ``nodes`` (id) and their places, without those
    that no other set holds; common is the mean number of sets that hold one of the whole set's shingles.

    Shingles are ordered by the number of sets that hold them. Two similar sets share a shingle among the first of both, the
    larger set's prefix being n - ceil(least n) + 1 long and the smaller one's, marked short, n - ceil(2 least n / (1 + least)) + 1.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(nodes.select("id"), "id", "left_semi")

    def hashed(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
        return {"id": np.repeat(batch.column("id").to_numpy(), [len(x) for x in sets]), "h": np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)}

    rows = materialize(map_slices(texts, hashed, "id long, h long", limit=2 << 20).distinct(), "shingles")
    known = rows.join(rows.groupBy("h").agg(F.count("*").alias("df")), "h")
    sets = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))  # a document's own shingles
    n = F.size("s")
    long = F.greatest(n - F.ceil(n * least) + 1, F.lit(1)).cast("int")
    short = n - F.ceil(n * (2 * least / (1 + least)) - 1e-9) + 1
    common = F.aggregate("s", F.lit(0).cast("long"), lambda total, x: total + x["df"]) / n
    first = sets.select("id", n.alias("n"), short.alias("short"), common.alias("common"), F.posexplode(F.slice("s", F.lit(1), long)).alias("at", "x")).filter("x.df > 1")
    out = materialize(first.select("id", "n", (F.col("at") + 1).alias("at"), (F.col("at") < F.col("short")).alias("short"), F.col("x.h").alias("h"), "common"), "prefixes")
    drop_scratch(rows)
    return out


def common_stars(members: DataFrame, first: DataFrame, least: float) -> DataFrame:
    """(u, v): each row of ``members`` (key, id, n) with the row of its band whose shingles are the commonest, if their sizes
    allow the similarity: variants of one text are seldom similar to each other, but to that text."""
    held = members.join(first.select("id", "common").distinct(), "id")
    centre = held.groupBy("key").agg(F.max(F.struct("common", F.col("id").alias("u"), F.col("n").alias("m"))).alias("c")).select("key", "c.u", "c.m")
    near = F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9
    return ordered(held.join(centre, "key").filter(near).select("u", F.col("id").alias("v")))


def prefix_pairs(first: DataFrame, least: float) -> DataFrame:
    """(u, v) of ``prefixes`` (with part) in different parts whose sets may be similar: every similar pair is there. The places
    of a shared shingle, the first one of a pair at least, leave room for the overlap that the pair needs."""
    a = first.select("h", *[F.col(c).alias(f"a_{c}") for c in ("id", "n", "at", "part")])
    b = first.filter("short").select("h", *[F.col(c).alias(f"b_{c}") for c in ("id", "n", "at", "part")])
    needs = least / (1 + least) * (F.col("a_n") + F.col("b_n")) - 1e-9
    room = 1 + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    test = (F.struct("b_n", "b_id") < F.struct("a_n", "a_id")) & (F.col("a_part") != F.col("b_part")) & (F.col("b_n") >= least * F.col("a_n") - 1e-9) & (room >= needs)
    return ordered(a.join(b, "h").filter(test).select(F.col("a_id").alias("u"), F.col("b_id").alias("v")))


def band_pairs(nodes: DataFrame, keys: DataFrame, least: float) -> DataFrame:
    """(u, v) of ``nodes`` (id, part, n, bands) in different parts that share one of ``keys`` and whose sizes allow the similarity."""
    arrow = PAIRS
    names = ["key", "part", "id", "n"]

    def solved(cols: dict) -> Iterator[pa.RecordBatch]:
        key = cols["key"]
        edge = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        us, vs, held = [], [], 0
        for a, b in zip(edge[:-1][np.diff(edge) > 1].tolist(), edge[1:][np.diff(edge) > 1].tolist()):
            part, ids, n = cols["part"][a:b], cols["id"][a:b], cols["n"][a:b]
            if part[0] == part[-1]:  # sorted by part: one part alone
                continue
            for i in range(b - a - 1):
                j = np.searchsorted(part, part[i], "right")
                j = j + np.flatnonzero(np.minimum(n[j:], n[i]) >= least * np.maximum(n[j:], n[i]))
                us.append(np.full(len(j), ids[i]))
                vs.append(ids[j])
                held += len(j)
                if held > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=arrow)
                    us, vs, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if rest is not None:
                cols = {c: np.concatenate([rest[c], cols[c]]) for c in names}
            cut = int(np.searchsorted(cols["key"], cols["key"][-1]))
            if cut:
                yield from solved({c: x[:cut] for c, x in cols.items()})
            rest = {c: x[cut:] for c, x in cols.items()}
        if rest is not None:
            yield from solved(rest)

    keyed = nodes.select(F.explode("bands").alias("key"), "part", "id", "n")
    return ordered(keyed.join(keys, "key", "left_semi").repartition("key").sortWithinPartitions("key", "part").mapInArrow(guarded(run), "u long, v long"))


def checked(pairs: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """The (u, v) of a written table whose sets of shingles are similar, written. The sets of its ids alone are moved."""
    wanted = materialize(pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct(), "compared")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(wanted, "id", "left_semi")

    def sets_of(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column("id"), "set": pa.array([shingle_set(t, words).tobytes() for t in batch.column("text").to_pylist()], pa.binary())}

    sets = materialize(map_slices(texts, sets_of, "id long, set binary", limit=2 << 20).dropDuplicates(["id"]), "compared-sets")
    u, v = sets.select(F.col("id").alias("u"), F.col("set").alias("a")), sets.select(F.col("id").alias("v"), F.col("set").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c) for c in "ab")
            keep = [jaccard(np.frombuffer(a[k].as_buffer(), np.uint64), np.frombuffer(b[k].as_buffer(), np.uint64)) >= least for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], schema=PAIRS).filter(pa.array(keep, pa.bool_()))

    # Dealt by both ids: the many pairs of a large cluster's first row are no single task.
    dealt = pairs.join(u, "u").join(v, "v").repartition("u", "v").select("u", "v", "a", "b")
    out = materialize(dealt.mapInArrow(guarded(run), "u long, v long"), "similar")
    drop_scratch(wanted, sets)
    return out


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (id, part, ..), written, with the parts that ``links`` (u, v) join made one: the smallest."""
    of = lambda c: known.select(F.col("id").alias(c), F.col("part").alias(f"part_{c}"))
    joined = connected_components(links.join(of("u"), "u").join(of("v"), "v").select(F.col("part_u").alias("u"), F.col("part_v").alias("v")))
    rest = [c for c in known.columns if c != "part"]
    return materialize(known.join(joined.select(F.col("id").alias("part"), "component"), "part", "left").select(*rest, F.coalesce("component", "part").alias("part")), "parts")


def near_copies(docs: DataFrame, words: int, least: float, lane_bits: int, lanes: int, verify: int, max_total: int) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over links) for each row of ``docs``, whose ids are whole numbers.

    Rows link if the Jaccard similarity of their sets of shingles is ``least`` or more. Texts with equal sets are one node;
    so are all without words, or null.
    """
    rows = materialize(prints(docs, words, lanes), "fingerprints")
    fps = [f"f{k}" for k in range(lanes)]
    same = rows.groupBy("set", "n").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in (*fps, "bands")])
    nodes = materialize(same, "fingerprint-nodes")
    gray = similar_links(nodes.select("id", *fps), lanes, lane_bits, verify, max_total)
    early = materialize(ordered(gray.unionByName(band_stars(nodes, least))), "candidates")
    known = merged(nodes.select("id", "set", "n", "bands", F.col("id").alias("part")), checked(early, docs, words, least))
    drop_scratch(nodes, early)
    bands = materialize(crowded_bands(known), "bands")
    crowd = materialize(known.select("id", "n", F.explode("bands").alias("key")).join(bands.filter("crowded"), "key", "left_semi"), "crowd")
    found = None
    if not crowd.isEmpty():
        first = prefixes(crowd.select("id").distinct(), docs, words, least)
        known = merged(known, checked(materialize(common_stars(crowd, first, least), "candidates"), docs, words, least))
        found = prefix_pairs(first.join(known.select("id", "part"), "id"), least)
    near = band_pairs(known, bands.filter("NOT crowded"), least)
    late = materialize(near if found is None else near.unionByName(found).distinct(), "candidates")
    known = merged(known, checked(late, docs, words, least))
    out = materialize(rows.select("doc_id", "set", "n").join(known.select("set", "n", F.col("part").alias("component_id")), ["set", "n"]).select("doc_id", "component_id"), "near-copies")
    drop_scratch(rows, known, bands, crowd, late)
    return out
