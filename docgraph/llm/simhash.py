"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint has one or more lanes of 64 bits. Fingerprints link when some lane differs in at most ``max_diff``
bits and, where asked, the first ``verify`` lanes together in at most ``max_total``. Two lanes within d bits agree on at least one of d + 1 blocks,
so every distinct fingerprint is dealt by each block's value; a group above ``group_rows`` is dealt again by blocks of
its other bits, which agree on one for the same reason, so no link is lost at any depth. Dealing goes on while it helps: a
group that is hardly smaller than the one it came from holds like fingerprints, which the index itself handles well.

In a group, fingerprints stand in Gray rank order, in which neighbours share bit patterns. The index factors the bits
that all fingerprints of a node share into that node; pairs of nodes are followed from the top, differences on
shared bits add up, and a pair whose sum is above the limit is pruned with all that is below it. A pair of nodes that
lie in one component already is pruned too: only links that span components leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import guarded, map_slices, materialize, mix64, utf8
from docgraph.llm.components import connected_components

FULL = (1 << 64) - 1
#: A group: fingerprints of one lane that agree on the fixed bits, whose values are the key.
GROUP = ["lane", "fixed", "key"]


def shingle_hashes(text: str | None, words: int, lower: bool = True) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words joined by a space, repeats included; of all words if fewer."""
    import xxhash

    raw = utf8(text)
    tokens = (raw.lower() if lower else raw).split()  # bytes.lower changes A to Z alone
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    starts, at = [], 0
    for w in tokens:
        starts.append(at)
        at += len(w) + 1
    ends = [b - 1 for b in starts[words:]] + [len(joined)] if len(tokens) > words else [len(joined)]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, ends)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """Bit i is set if it is in over half the hashes; none give 0."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.ascontiguousarray(hashes[at : at + 8192]).view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * count > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int, lanes: int = 1, lower: bool = True, distinct: bool = False) -> list[int]:
    """One lane for each rescrambling of the shingle hashes; the first takes them as they are. Signed, as Spark holds them.

    ``distinct``: a repeated shingle counts once.
    """
    h = shingle_hashes(text, words, lower)
    return lanes_of(np.unique(h) if distinct else h, lanes)


def lanes_of(h: np.ndarray, lanes: int) -> list[int]:
    out = []
    for _ in range(lanes):
        f = majority_bits(h)
        out.append(f - (1 << 64) if f >> 63 else f)
        h = mix64(h + np.uint64(0x9E3779B97F4A7C15)) if lanes > 1 else h
    return out


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1, lower: bool = True, distinct: bool = False) -> DataFrame:
    """doc_id, f0 .. f<lanes-1> of each row; texts without words, or null, have zeros."""

    def hashed(batch: pa.RecordBatch) -> dict:
        got = [fingerprint(t, words, lanes, lower, distinct) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id")} | {f"f{k}": [x[k] for x in got] for k in range(lanes)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(rows, hashed, "doc_id long, " + ", ".join(f"f{k} long" for k in range(lanes)))


def gray_rank(x: Column) -> Column:
    """Place of a bit pattern in the reflected Gray order."""
    for n in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, n))
    return x


def block_masks(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` in ``n`` runs of about equal length."""
    cuts = [len(bits) * k // n for k in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


class GrayIndex:
    """Index of one group: ``codes`` in Gray rank order, and their ``verify`` lanes as rows of an array (none: no further test)."""

    FANOUT = 8

    def __init__(self, codes: np.ndarray, verify: np.ndarray, max_diff: int, max_total: int) -> None:
        self.codes, self.verify, self.max_diff, self.max_total = codes, verify, max_diff, max_total
        ones, zeros = codes, ~codes
        self.levels = [(ones, ones | zeros)]
        while len(ones) > 1:
            at = np.arange(0, len(ones), self.FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            self.levels.append((ones, ones | zeros))
        self.root = np.arange(len(codes))

    def _union(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def _uniform(self, level: int) -> np.ndarray:
        """The component of each node of ``level`` that lies in one whole, else -1 - node."""
        lo = hi = self.root
        for _ in range(level):
            at = np.arange(0, len(lo), self.FANOUT)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
        return np.where(lo == hi, lo, -1 - np.arange(len(lo)))

    def components(self, step: int = 1 << 16) -> np.ndarray:
        """For each code the first code of its component."""
        top = len(self.levels) - 1
        zero = np.zeros(1, np.int64)
        todo = [(top, zero, zero, np.zeros(1, np.uint8), np.zeros(1, np.uint64))]
        f = self.FANOUT
        grid_i, grid_j = np.repeat(np.arange(f), f), np.tile(np.arange(f), f)
        while todo:
            level, i, j, acc, seen = todo.pop()
            if level and len(self.codes) > 64:
                same = self._uniform(level)
                live = (same[i] != same[j]) | ((i == j) & (same[i] < 0))
                i, j, acc, seen = i[live], j[live], acc[live], seen[live]
            if not len(i):
                continue
            if level == 0:
                apart = self.root[i] != self.root[j]
                i, j = i[apart], j[apart]
                if len(i):
                    if len(self.verify):
                        near = np.bitwise_count(self.verify[:, i] ^ self.verify[:, j]).sum(0, dtype=np.int64) <= self.max_total
                        i, j = i[near], j[near]
                    self._union(i, j)
                continue
            if len(i) > step // (f * f):
                half = max(1, step // (f * f))
                for at in range((len(i) - 1) // half * half, -1, -half):
                    part = slice(at, at + half)
                    todo.append((level, i[part], j[part], acc[part], seen[part]))
                continue
            ones, mask = self.levels[level - 1]
            a, b = (i[:, None] * f + grid_i).ravel(), (j[:, None] * f + grid_j).ravel()
            acc, seen = np.repeat(acc, f * f), np.repeat(seen, f * f)
            real = (a < len(ones)) & (b < len(ones)) & ((a < b) | ((a == b) & (level > 1)))
            a, b, acc, seen = a[real], b[real], acc[real], seen[real]
            shared = mask[a] & mask[b]
            acc = acc + np.bitwise_count((ones[a] ^ ones[b]) & shared & ~seen)
            near = acc <= self.max_diff
            a, b, acc, seen = a[near], b[near], acc[near], shared[near]
            inner = a == b
            for part in (~inner, inner):  # the last pushed comes first: pairs inside a node join it up before others look
                if part.any():
                    todo.append((level - 1, a[part], b[part], acc[part], seen[part]))
        return self.root


def _group_links(n_verify: int, max_diff: int, max_total: int):  # noqa: ANN202
    """Links inside each group of a sorted partition, from every linked fingerprint to the first of its component."""
    checks = [f"f{k}" for k in range(n_verify)]
    names = [*GROUP, "id", "own", *checks]
    arrow = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def solved(cols: dict) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.any([np.diff(cols[c]) != 0 for c in GROUP], axis=0)) + 1
        us, vs = [], []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(cols["id"])]):
            if b - a > 1:
                verify = np.stack([cols[c][a:b].view(np.uint64) for c in checks]) if checks else np.zeros((0, b - a), np.uint64)
                root = GrayIndex(cols["own"][a:b].view(np.uint64), verify, max_diff, max_total).components()
                moved = np.flatnonzero(root != np.arange(b - a))
                us.append(cols["id"][a:b][moved])
                vs.append(cols["id"][a:b][root[moved]])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
            if rest is not None:
                cols = {n: np.concatenate([rest[n], cols[n]]) for n in names}
            before = np.flatnonzero(np.any([cols[c] != cols[c][-1] for c in GROUP], axis=0))
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield from solved({n: c[:cut] for n, c in cols.items()})
            rest = {n: c[cut:] for n, c in cols.items()}
        if rest is not None:
            yield from solved(rest)

    return run


def _deal(max_diff: int, checks: list[str]):  # noqa: ANN202
    """Rows of large groups, each once for every block of the bits that its group does not share yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fixed, own = b.column("fixed").to_numpy(), b.column("own").to_numpy()
            for mask in np.unique(fixed).tolist():
                rows = pa.array(np.flatnonzero(fixed == mask))
                mine = b.take(rows)
                codes = own[rows.to_numpy()]
                for block in block_masks([x for x in range(64) if not mask >> x & 1], max_diff + 1):
                    new = _signed((mask & FULL) | sum(1 << x for x in block))
                    columns = {c: mine.column(c) for c in ("lane", "id", "own", "above", *checks)}
                    columns |= {"fixed": pa.array(np.full(len(codes), new)), "key": pa.array(codes & new)}
                    yield pa.RecordBatch.from_arrays([columns[n] for n in b.schema.names], schema=b.schema)

    return guarded(run)


def similar_links(nodes: DataFrame, n_lanes: int, max_diff: int, verify: int = 0, max_total: int = 0, group_rows: int = 2000, shrink: int = 8) -> DataFrame:
    """(u, v): links that connect exactly what the similarity connects. ``nodes``: id, f0.. with distinct fingerprints.

    A group of over ``group_rows`` is dealt again if it is not above a ``shrink``-th of the group that it came from.
    """
    checks = [f"f{k}" for k in range(verify)]
    places = []
    for lane in range(n_lanes):
        code = F.col(f"f{lane}")
        for block in block_masks(list(range(64)), max_diff + 1):
            mask = F.lit(_mask(block)).cast("long")
            places.append(F.struct(F.lit(lane).cast("long").alias("lane"), mask.alias("fixed"), code.bitwiseAND(mask).alias("key"), code.alias("own")))
    now = nodes.select("id", *checks, F.explode(F.array(*places)).alias("at")).select("at.lane", "at.fixed", "at.key", "id", "at.own", F.lit(1 << 62).alias("above"), *checks)
    run, found = guarded(_group_links(verify, max_diff, max_total)), []
    while True:
        sizes = now.groupBy(*GROUP).agg(F.count("*").alias("n"), F.max("above").alias("above"))
        large = materialize(sizes.filter((F.col("n") > group_rows) & (F.col("n") * shrink <= F.col("above"))).select(*GROUP, "n"), "large-groups")
        more = not large.isEmpty()
        rest = now.join(large, GROUP, "left_anti") if more else now
        work = rest.repartition(*GROUP).withColumn("rank", gray_rank(F.col("own"))).sortWithinPartitions(*GROUP, "rank", "id")
        found.append(work.select(*GROUP, "id", "own", *checks).mapInArrow(run, "u long, v long"))
        if not more:
            break
        again = now.join(large, GROUP).select(*GROUP, "id", "own", F.col("n").alias("above"), *checks)
        now = materialize(again.mapInArrow(_deal(max_diff, checks), again.schema), "split-groups")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(
    docs: DataFrame, words: int = 4, max_diff: int = 4, lanes: int = 1, verify: int = 0, max_total: int = 0, lower: bool = True, group_rows: int = 2000, distinct: bool = False
) -> DataFrame:
    """doc_id, f0.., component_id (smallest doc_id reachable over links, itself included) for each row of ``docs``.

    Equal fingerprints are linked, so exact copies, and all texts without words or null, share a component. Rows with a
    null doc_id get the component of their fingerprint, which is null if no row with an id is in it. Repeated rows stay.
    An empty table gives an empty result. Other columns are not read.
    """
    fps = [f"f{k}" for k in range(lanes)]
    prints = materialize(fingerprints(docs, words, lanes, lower, distinct), "fingerprints")
    nodes = materialize(prints.groupBy(*fps).agg(F.min("doc_id").alias("id")), "fingerprint-nodes")
    links = similar_links(nodes.filter("id IS NOT NULL"), lanes, max_diff, verify, max_total, group_rows)
    parts = connected_components(links)
    known = nodes.join(parts, "id", "left").select(*[F.col(f).alias(f"n_{f}") for f in fps], F.coalesce("component", "id").alias("component_id"))
    same = [F.col(f) == F.col(f"n_{f}") for f in fps]
    return prints.join(known, same, "left").select("doc_id", *fps, "component_id")


def hex_fingerprint(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))
