"""Substring dedup: word windows that repeat across documents, found level by level at doubling lengths.

A window of w words repeats only if each run of words inside it does. So the search starts at a short length, and only
windows whose run at one length repeats are looked at with runs of twice that length, until the runs are the windows
themselves or no candidate is left. At each length a window is stood for by the smallest hash among its runs of that
length, which equal windows share; this leaves a fraction of the runs to count. What passes a level is kept in a bit
table of bounded size, whose errors only let windows through to the last level, and that one is exact up to equal 64-bit
hashes: for every window that comes so far, the smallest doc_id that has it. Grouped by that doc_id, this tells each
document which of its windows are first seen in it; its other windows that came so far are repeats. So the many
copies of a window are combined before they are shuffled, and are never joined one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.bitset import collect_bits
from docgraph.llm.common import bounds, drop_scratch, map_slices, materialize, mix64, rolling, split_words, word_hashes

SHORTEST = 8
SLICE = 4 << 20  # bytes of text at once


def lengths(window: int) -> list[int]:
    """Run lengths, each at most twice the one before; the last is the window."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` neighbours."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def stand_ins(hashes: np.ndarray, window: int, run: int) -> np.ndarray:
    """For each window of ``window`` words the smallest hash of its runs of ``run`` words."""
    if len(hashes) < window:
        return hashes[:0]
    return sliding_min(rolling(hashes, run), window - run + 1)


class Windows:
    """The windows of a slice of documents that are inside one document."""

    def __init__(self, texts: list[str | None], window: int) -> None:
        words = split_words(texts)
        self.edges = bounds(map(len, words))
        self.window = window
        self.hashes = word_hashes().of([w for ws in words for w in ws])
        self.words = words
        doc = np.repeat(np.arange(len(texts)), np.diff(self.edges))
        self.at = np.flatnonzero(doc[: max(0, len(doc) - window + 1)] == doc[window - 1 :]) if len(doc) >= window else np.zeros(0, np.int64)
        self.doc = doc[self.at]

    def values(self, run: int) -> np.ndarray:
        return stand_ins(self.hashes, self.window, run)[self.at]

    def passing(self, levels: list[int], tables: list) -> np.ndarray:
        """Windows whose runs passed all levels so far."""
        live = np.ones(len(self.at), bool)
        for run, bits in zip(levels, tables):
            if live.any():
                live[live] = bits.value.has(self.values(run)[live])
        return live


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _level(rows: DataFrame, window: int, done: list[int], tables: list, run: int) -> DataFrame:
    """(h, doc_id): values at length ``run`` of the windows that passed the levels ``done``."""

    def emit(batch: pa.RecordBatch) -> dict:
        w = Windows(batch.column("text").to_pylist(), window)
        live = w.passing(done, tables)
        h, doc = w.values(run)[live], w.doc[live]
        ids = np.array(batch.column("doc_id").to_numpy(zero_copy_only=False), np.int64)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return {"h": h[new].view(np.int64), "doc_id": ids[doc[new]]}

    return map_slices(rows, emit, "h long, doc_id long", limit=SLICE)


def passed_levels(rows: DataFrame, window: int) -> tuple[list[int], list]:
    """The lengths below the window and, for each, the broadcast bit table of what repeats at it."""
    steps, tables = lengths(window)[:-1], []
    for k, run in enumerate(steps):
        seen = _level(rows, window, steps[:k], tables, run).groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        twice = materialize(seen.filter("a < b").select("h"), "repeated-runs")
        n = twice.count()
        tables.append(rows.sparkSession.sparkContext.broadcast(collect_bits(twice, n)))
        drop_scratch(twice)
        if not n:  # no candidate is left: the empty table stops all windows
            break
    return steps[: len(tables)], tables


def first_seen(rows: DataFrame, window: int, done: list[int], tables: list) -> DataFrame:
    """(m_id, firsts): for each document the hashes of its windows that no document with a smaller id has."""
    least = _level(rows, window, done, tables, window).groupBy("h").agg(F.min("doc_id").alias("m_id"))
    return least.groupBy("m_id").agg(F.collect_list("h").alias("firsts"))


def covered(w: Windows, marked: np.ndarray) -> np.ndarray:
    """Words of the slice that lie in a marked window."""
    out = np.zeros(len(w.hashes) + 1, np.int64)
    at = w.at[marked]
    out[at] += 1  # starts are distinct
    np.add.at(out, at + w.window, -1)
    return np.cumsum(out)[:-1] > 0


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for each row of ``docs``.

    A word goes if a window over it also starts in a document with a smaller doc_id. Rows that share a doc_id, and
    rows with a null doc_id, do not touch each other; a null doc_id loses nothing. Null text has no words. Texts of
    fewer words than a window, and an empty table, have no windows. Columns other than doc_id and text are not read.
    """
    rows = _rows(docs)
    known = rows.filter("doc_id IS NOT NULL")
    done, tables = passed_levels(known, window)
    marks = first_seen(known, window, done, tables)
    both = rows.join(marks, rows["doc_id"] == marks["m_id"], "left").select("doc_id", "text", "firsts")

    def strip(batch: pa.RecordBatch) -> dict:
        w = Windows(batch.column("text").to_pylist(), window)
        marked = w.passing(done, tables)
        marked &= batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[w.doc]
        lists = batch.column("firsts")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        firsts = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        owner = mix64(np.arange(1, batch.num_rows + 1, dtype=np.uint64))
        at = np.flatnonzero(marked)
        own = w.values(window)[at] ^ owner[w.doc[at]]
        marked[at] = ~np.isin(own, firsts ^ np.repeat(owner, sizes))
        gone = covered(w, marked)
        kept, removed = [], []
        for k, words in enumerate(w.words):
            g = gone[w.edges[k] : w.edges[k + 1]]
            n = int(g.sum())
            removed.append(n)
            kept.append(b" ".join(x for x, y in zip(words, g) if not y) if n else b" ".join(words))
        return {"doc_id": batch.column("doc_id"), "n_words": np.diff(w.edges), "n_removed": removed, "kept_text": pa.array([x.decode() for x in kept], pa.string())}

    return map_slices(both, strip, "doc_id long, n_words long, n_removed long, kept_text string", limit=SLICE)
