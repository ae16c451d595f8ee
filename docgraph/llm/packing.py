"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Token ids are counted where the text is read; from there on only small piece rows move. Pieces are dealt at
random to tasks of bounded size. A task packs best-fit decreasing, then exchanges pieces between underfull
bins (moves, one or two pieces for one or two), taking only exchanges that raise the sum of squared fills, until
none is left. All bins that stay underfull are dealt anew in the next round, with as many tasks as their pieces
need, until one task packs the last of them or a round saves hardly a bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import arrow_schema, guarded, map_slices, materialize, to_batch
from docgraph.llm.tokens import default_tokenizer, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLICE = 2 << 20  # bytes of text that are encoded at once
WIDER = 8  # times the pieces that a task of the later rounds takes


def pieces(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Token pieces of each document: whole, or cut into ``capacity``-token pieces of which the first may be shorter.

    A null text is an empty one and gives a piece with the end id alone. Repeated rows are packed one by one;
    a null doc_id is kept. Other columns of ``docs`` are not read.
    """
    path = tokenizer or default_tokenizer()

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).encode(texts)):
            ids = np.append(ids, ids.dtype.type(end_id)).astype("<u4")
            n = len(ids)
            head = n if n <= capacity else n % capacity or capacity
            starts = [0, *range(head, n, capacity)]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                out["doc_id"].append(doc_id)
                out["piece"].append(k)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
        return out

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, PIECES, limit=SLICE)


class Bins:
    """Bins of one task. Pieces are known by index into ``size``.

    The search looks exchanges up by size: for each amount of free space it holds which sizes, of one piece or of two, lie in
    bins with that much room. So the best exchange of a group of pieces is found among all bins at once, and the cost of a
    look-up depends on the capacity alone.
    """

    def __init__(self, size: np.ndarray, capacity: int) -> None:
        self.size, self.capacity = size, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Best-fit decreasing: each piece to the fullest bin that takes it; a bit set of free spaces finds that bin."""
        by_free: dict[int, list[int]] = {}
        frees = 0
        for i in np.argsort(-self.size, kind="stable").tolist():
            s = int(self.size[i])
            rest = frees >> s
            if rest:
                free = s + (rest & -rest).bit_length() - 1
                stack = by_free[free]
                b = stack.pop()
                if not stack:
                    frees &= ~(1 << free)
                self.items[b].append(i)
                self.fill[b] += s
            else:
                b = len(self.items)
                self.items.append([i])
                self.fill.append(s)
            free = self.capacity - self.fill[b]
            if free:
                by_free.setdefault(free, []).append(b)
                frees |= 1 << free

    def least(self) -> int:
        return -(-int(self.size.sum()) // self.capacity)

    def groups(self, b: int) -> dict[int, tuple[int, ...]]:
        """A group of one piece or two for each total size that bin ``b`` has."""
        first: dict[int, list[int]] = {}
        for i in self.items[b]:
            first.setdefault(int(self.size[i]), []).append(i)
        out = {s: (same[0],) for s, same in first.items()}
        sizes = sorted(first)
        for k, s in enumerate(sizes):
            if len(first[s]) > 1:
                out.setdefault(2 * s, tuple(first[s][:2]))
            for t in sizes[k + 1 :]:
                out.setdefault(s + t, (first[s][0], first[t][0]))
        return out

    def _count(self, b: int, sign: int) -> None:
        """Enter bin ``b`` in the index, or take it out."""
        free = self.capacity - self.fill[b]
        row, sums = self._held[free], np.array(list(self.groups(b)), np.int64)
        row[sums] += sign
        (self._with[free].add if sign > 0 else self._with[free].discard)(b)
        # the least held size that is not below each size; the last entry stands for none
        known = np.where(row > 0, np.arange(len(row)), self._none)
        self._next[free, :-1] = np.minimum.accumulate(known[::-1])[::-1]

    def local_search(self) -> None:
        """Exchanges between underfull bins that raise the sum of squared fills, until none is left or no bin can be saved.

        The emptiest bin gives: a group of one or two of its pieces moves to a bin with room, or is exchanged for a smaller
        group of one or two of a fuller bin. Each exchange raises the sum, so the search ends; the packing is complete and
        valid at any point.
        """
        c, live = self.capacity, sum(map(bool, self.items))
        if live <= self.least():
            return
        self._none = 2 * c + 1
        self._held = np.zeros((c + 1, c + 1), np.int32)
        self._next = np.full((c + 1, c + 2), self._none, np.int64)
        self._with: list[set[int]] = [set() for _ in range(c + 1)]
        open_ = [b for b, f in enumerate(self.fill) if 0 < f < c]
        for b in open_:
            self._count(b, 1)
        frees = np.arange(1, c + 1)
        moved = True
        while moved and live > self.least():
            moved = False
            for a in sorted(open_, key=lambda b: self.fill[b]):
                if not 0 < self.fill[a] < c:
                    continue
                self._count(a, -1)
                while self.items[a] and (found := self._best(a, frees)) is not None:
                    self._exchange(a, *found)
                    moved = True
                if self.items[a]:
                    self._count(a, 1)
                else:
                    live -= 1
                    if live <= self.least():
                        return

    def _best(self, a: int, frees: np.ndarray) -> tuple[tuple[int, ...], int, int] | None:
        """(group of bin ``a``, free space of the other bin, size that comes back or 0) with the highest gain, if any has one."""
        mine, fill = self.groups(a), self.fill[a]
        sums = np.array(sorted(mine), np.int64)
        rooms = frees[np.array([bool(x) for x in self._with[1:]])]
        rooms = rooms[rooms <= self.capacity - fill]  # bins that are no emptier
        if not len(rooms):
            return None
        # what is given up in return: the least group that makes room, or nothing
        back = self._next[rooms[None, :], np.maximum(sums[:, None] - rooms, 0)]
        back = np.where(sums[:, None] <= rooms, 0, back)
        shift = sums[:, None] - back
        gain = np.where(shift > 0, shift * (self.capacity - rooms - fill + shift), 0)
        at = int(gain.argmax())
        s, r = divmod(at, len(rooms))
        return (mine[int(sums[s])], int(rooms[r]), int(back[s, r])) if gain[s, r] > 0 else None

    def _exchange(self, a: int, group: tuple[int, ...], free: int, back: int) -> None:
        for b in self._with[free]:
            theirs = self.groups(b).get(back, ()) if back else ()
            if theirs or not back:
                break
        self._count(b, -1)
        for source, target, pieces_ in ((a, b, group), (b, a, theirs)):
            for i in pieces_:
                self.items[source].remove(i)
                self.items[target].append(i)
                self.fill[source] -= int(self.size[i])
                self.fill[target] += int(self.size[i])
        if self.fill[b] < self.capacity:
            self._count(b, 1)


def pack_sizes(size: np.ndarray, capacity: int = 1024) -> list[list[int]]:
    """Bins as lists of indices, emptiest last."""
    bins = Bins(np.asarray(size, np.int64), capacity)
    bins.best_fit()
    bins.local_search()
    return [x for _, x in sorted(((-f, x) for f, x in zip(bins.fill, bins.items) if x))]


def pack(rows: DataFrame, capacity: int = 1024, pieces_per_task: int = 20_000) -> DataFrame:
    """Place the pieces of ``rows`` (columns of PIECES; a written table) in sequences; adds sequence_id and offset.

    Every row is placed once, equal rows too. All bins that are not full go to the next round, whose tasks take WIDER times as
    many pieces; rounds end with one task, or when one saves less than a thousandth of the bins that went into it.
    """
    schema = rows.limit(0).selectExpr("*", "0L AS sequence_id", "0L AS offset", "true AS final").schema
    arrow, names = arrow_schema(schema), rows.columns

    def in_task(level: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            t = pa.Table.from_batches(got)
            t = t.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "length", "ids_crc32")]).combine_chunks()
            size = t.column("length").to_numpy()
            bins = pack_sizes(size, capacity)
            full = [int(size[x].sum()) == capacity for x in bins]
            first = (level << 56) + (TaskContext.get().partitionId() << 28)
            order = np.concatenate(bins).astype(np.int64)
            n = np.array([len(x) for x in bins])
            lengths = size[order]
            ends = np.cumsum(lengths)
            begin = np.concatenate([[0], ends[:-1]])
            heads = np.concatenate([[0], np.cumsum(n)[:-1]])
            out = t.take(pa.array(order))
            columns = {c: out.column(c) for c in names}
            columns |= {"sequence_id": first + np.repeat(np.arange(len(bins)), n), "offset": begin - np.repeat(begin[heads], n), "final": np.repeat(np.array(full), n)}
            for b in pa.Table.from_batches([to_batch(columns, arrow)]).to_batches(50_000):
                yield b

        return guarded(run)

    done: list[DataFrame] = []
    left, level, n_left, bins_in = rows, 0, rows.count(), None
    while True:
        n = max(1, -(-n_left // (WIDER * pieces_per_task if level else pieces_per_task)))
        dealt = left.repartition(n, F.xxhash64(F.monotonically_increasing_id(), F.lit(level)))
        placed = materialize(dealt.mapInArrow(in_task(level), schema), "packed")
        head = F.col("offset") == 0
        n_left, bins, open_bins = placed.agg(F.count_if(~F.col("final")), F.count_if(head), F.count_if(head & ~F.col("final"))).first()
        if n == 1 or not n_left or (bins_in is not None and 1000 * (bins_in - bins) < bins_in):
            done.append(placed)
            break
        done.append(placed.filter("final"))
        left, level, bins_in = placed.filter("NOT final").select(*names), level + 1, open_bins
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("final")


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """All documents as gapless sequences of at most ``capacity`` tokens. An empty table gives an empty result."""
    return pack(materialize(pieces(docs, capacity, tokenizer), "pieces"), capacity)
