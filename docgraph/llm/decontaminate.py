"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages of words. Over the benchmark's own terms, with document frequencies counted
in all passages, a randomised SVD (range finder with power iterations, products summed over tasks) of the TF-IDF blocks of
all documents and of the benchmark gives a latent space; the terms that stand together in them are counted once. Every passage of every document is projected and
compared by cosine with the benchmark passages, block by block of items. Candidates are then checked by longest common
subsequences of words, over all words and over the rarer ones, and by the item's last sentence, taken as its answer. Where a
run of an item's words stands in a document, the words around are compared whatever became of the rarer ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import bounds, chunks, drop_scratch, guarded, map_slices, materialize, mix64, rolling, utf8

HALF = 16  # a passage is two neighbouring blocks of so many words
RANK = 96
#: A candidate's cosine with an item's passage, and the share of that passage's own length that its projection reaches: what
#: holds common words alone has a high cosine with other such text, but is short beside a passage with rarer words.
MIN_COSINE, MIN_REACH = 0.35, 0.35
#: A leak has this share of the item's words in order, or the smaller share and the answer; and of its rarer words.
FULL_SHARE, ANSWERED_SHARE, RARE_SHARE, ANSWER_SHARE = 0.75, 0.55, 0.5, 0.8
#: Where a run of RUN of the item's words is: a leak whatever became of its rarer words, with this share of its words in order, or
#: FULL_SHARE in a stretch that is not longer than the item by over a quarter, or with its answer. At CLOSE_SHARE with no words
#: put in between there always is such a run.
RUN, CLOSE_SHARE = 5, 0.9
#: Rarer words: in at most this share of all blocks.
RARE_DF = 0.02
PUNCTUATION = b".,;:!?\"'()"
CELLS = 4 << 20  # cosines, or words beside candidates, that are held at once
HINT_BITS = 22
SLICE = 1 << 18  # weighted words whose pairs are counted at once


def terms(text: str | None) -> list[bytes]:
    """Words in ASCII lower case without punctuation marks; marks alone are no word."""
    return utf8(text).lower().translate(None, PUNCTUATION).split()


def last_sentence(text: str) -> list[bytes]:
    parts = [p for p in re.split(r"[.!?\n]+", text) if p.strip()]
    return terms(parts[-1]) if parts else []


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of ``a`` at a time (Hyyro, 2004)."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if m := where.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


@dataclass
class Index:
    """Benchmark items of one block, their vocabulary and the latent space. Sent to the workers."""

    vocabulary: dict[bytes, int]
    items: list[tuple[int, list[int], list[int]]]  # item_id, words, answer
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    rare: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    space: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    passages: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    norms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    runs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of runs of words
    run_at: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))  # place of the item and of the run in it
    hints: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # by a hash of item and word: may the word be a rarer one of the item


def make_index(rows: list[tuple[int, str]]) -> Index:
    vocabulary: dict[bytes, int] = {}
    items = []
    for item_id, text in rows:
        words = [vocabulary.setdefault(w, len(vocabulary)) for w in terms(text)]
        if words:
            items.append((item_id, words, [vocabulary.setdefault(w, len(vocabulary)) for w in last_sentence(text)]))
    index = Index(vocabulary, items)
    hashes = [rolling(mix64(np.array(w, np.uint64) + np.uint64(1)), RUN) for _, w, _ in items]
    if items:
        runs = np.concatenate(hashes)
        order = np.argsort(runs, kind="stable")
        index.runs = runs[order]
        index.run_at = np.array([(i, k) for i, h in enumerate(hashes) for k in range(len(h))], np.int64).reshape(-1, 2)[order]
    return index


def run_places(index: Index, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(document, item, word where the item would begin) of each run of an item's words, near places once."""
    known = np.append(0, np.cumsum(ids < len(index.vocabulary)))
    at = np.flatnonzero(known[RUN:] - known[:-RUN] == RUN)
    doc = np.searchsorted(edges, at, "right") - 1
    inside = at + RUN <= edges[doc + 1]
    at, doc = at[inside], doc[inside]
    h = rolling(mix64(ids.astype(np.uint64) + np.uint64(1)), RUN)[at]
    first, last = np.searchsorted(index.runs, h), np.searchsorted(index.runs, h, "right")
    n = last - first
    which = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(at, n) - index.run_at[which, 1]
    rows = np.column_stack([np.repeat(doc, n), index.run_at[which, 0], begin])
    _, one = np.unique(np.column_stack([rows[:, :2], begin // 4]), axis=0, return_index=True)
    return rows[one]


def run_leaks(index: Index, ids: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int, float, bool]]:
    """(document, item's place, first word, share, answered) of leaks around a run of an item's words."""
    done: set[tuple[int, int]] = set()
    for d, item, begin in run_places(index, ids, edges).tolist():
        if (d, item) in done:
            continue
        _, words, answer = index.items[item]
        n, low, high = len(words), int(edges[d]), int(edges[d + 1])
        near = ids[max(low, begin - n // 2) : min(high, begin + n + n // 2)].tolist()
        if sum((Counter(words) & Counter(near)).values()) < FULL_SHARE * n:  # no less than the words in order
            continue
        share = lcs(words, near) / n
        if share < FULL_SHARE:
            continue
        answered = bool(answer) and lcs(answer, near) >= ANSWER_SHARE * len(answer)
        side = n // 8
        if share >= CLOSE_SHARE or answered or lcs(words, ids[max(low, begin - side) : min(high, begin + n + side)].tolist()) >= FULL_SHARE * n:
            done.add((d, item))
            yield d, item, max(low, begin), share, answered


def hint_place(item: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(64 - HINT_BITS)).astype(np.int64)


def word_ids(vocabulary: dict[bytes, int], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, len(vocabulary) for the others, and the documents' bounds."""
    words = [terms(t) for t in texts]
    edges = bounds(map(len, words))
    return np.fromiter(map(vocabulary.get, chain.from_iterable(words), repeat(len(vocabulary))), np.int64, int(edges[-1])), edges


def block_starts(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each block and the document it is in."""
    n = -(-np.diff(edges) // HALF)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    return edges[doc] + HALF * (np.arange(len(doc)) - first[doc]), doc


def projected(ids: np.ndarray, edges: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of the words' rows of ``weights`` for each passage; its first word; its document. A lone block is a passage."""
    starts, doc = block_starts(edges)
    sums = np.zeros((len(starts), weights.shape[1]), np.float32)
    told = np.flatnonzero(weights.any(1)[ids])  # words with a weight; most have none
    if len(told):
        block = np.searchsorted(starts, told, "right") - 1
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        sums[block[first]] = np.add.reduceat(weights[ids[told]], first, axis=0)
    joined = sums.copy()
    follows = np.flatnonzero(doc[1:] == doc[:-1])
    joined[follows] += sums[follows + 1]
    last_of_many = np.flatnonzero((np.concatenate([doc[1:] != doc[:-1], [True]])) & np.concatenate([[False], doc[1:] == doc[:-1]]))
    keep = np.ones(len(starts), bool)
    keep[last_of_many] = False  # the passage before covers it
    return joined[keep], starts[keep], doc[keep]


def block_terms(ids: np.ndarray, edges: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """In how many blocks each of the ``n`` terms is, and the number of blocks."""
    starts, _ = block_starts(edges)
    grid = np.full((len(starts), HALF), n, np.int64)
    if len(ids):
        block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
        grid[block, np.arange(len(ids)) - starts[block]] = ids
    grid.sort(axis=1)
    new = np.ones(grid.shape, bool)
    new[:, 1:] = grid[:, 1:] != grid[:, :-1]
    return np.bincount(grid[new], minlength=n + 1)[:n], len(starts)


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many blocks of all documents each term is, and the number of blocks."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total, blocks = np.zeros(len(known), np.int64), 0
        for batch in chunks(batches, limit=2 << 20):
            ids, edges = word_ids(known, batch.column("text").to_pylist())
            here, n = block_terms(ids, edges, len(known))
            total += here
            blocks += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], blocks))], names=["term", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(guarded(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows.toLocalIterator():  # a row for each benchmark term of the block at most
        out[r["term"]] = r["n"]
    shared.destroy()
    return out[:-1], int(out[-1])


def term_pairs(ids: np.ndarray, edges: np.ndarray, weighted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of (key, n) of the weighted terms that stand together in blocks: entry (i, j), i <= j, of the sum over all blocks of
    x x^T, where x counts a block's terms, has the key i * len(weighted) + j."""
    starts, _ = block_starts(edges)
    told = np.flatnonzero(weighted[ids])
    block, width, low = np.searchsorted(starts, told, "right"), len(weighted), 0
    while low < len(told):
        high = int(np.searchsorted(block, block[min(low + SLICE, len(told)) - 1], "right"))  # whole blocks
        term, of = ids[told[low:high]], block[low:high]
        keys, counts = [term * (width + 1)], [np.ones(len(term), np.int64)]
        for k in range(1, HALF):
            at = np.flatnonzero(of[k:] == of[:-k])
            if not len(at):  # further apart there is none either
                break
            x, y = term[at], term[at + k]
            keys.append(np.minimum(x, y) * width + np.maximum(x, y))
            counts.append(1 + (x == y))
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        yield key, np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)
        low = high


def pair_counts(docs: DataFrame, index: Index) -> DataFrame:
    """(key, n) of ``term_pairs`` over the blocks of all documents: whole numbers, the same however documents are dealt."""
    shared = docs.sparkSession.sparkContext.broadcast((index.vocabulary, np.append(index.idf > 0, False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weighted = shared.value
        for batch in chunks(batches, limit=2 << 20):
            for key, n in term_pairs(*word_ids(vocabulary, batch.column("text").to_pylist()), weighted):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    each = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(guarded(run), "key long, n long")
    out = materialize(each.groupBy("key").agg(F.sum("n").alias("n")), "pairs")
    shared.destroy()
    return out


def gram_product(pairs: DataFrame, index: Index, basis: np.ndarray) -> np.ndarray:
    """(A^T A) basis, where A has the TF-IDF blocks of all documents, from ``pair_counts``. Partial products are summed by Spark."""
    shared = pairs.sparkSession.sparkContext.broadcast((index.idf.astype(np.float64), basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, base = shared.value
        width, out = len(idf) + 1, np.zeros_like(base)
        for batch in batches:
            key, n = (batch.column(c).to_numpy() for c in ("key", "n"))
            x, y = key // width, key % width
            v = n * idf[x] * idf[y]
            for a, b, w in ((x, y, v), (y[x != y], x[x != y], v[x != y])):
                order = np.argsort(a, kind="stable")
                a, b, w = a[order], b[order], w[order]
                for at in range(0, len(a), 1 << 14):
                    term = a[at : at + (1 << 14)]
                    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                    out[term[first]] += np.add.reduceat(w[at : at + (1 << 14), None] * base[b[at : at + (1 << 14)]], first, axis=0)
        at = np.flatnonzero(np.abs(out).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(out[at]), pa.list_(pa.float64()))], names=["term", "v"])

    parts = pairs.mapInArrow(guarded(run), "term long, v array<double>")
    width = basis.shape[1]
    summed = parts.groupBy("term").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(width)]).alias("v"))
    total = np.zeros_like(basis)
    for r in summed.toLocalIterator():  # a row for each benchmark term at most
        total[r["term"]] = r["v"]
    shared.destroy()
    return total


def fit(docs: DataFrame, index: Index, rank: int = RANK, powers: int = 1, seed: int = 11) -> Index:
    """IDF and the latent space from all documents, the latter from the benchmark passages too."""
    df, blocks = document_frequencies(docs, index.vocabulary)
    idf = np.log((1 + blocks) / (1 + df))
    # Words in more than RARE_DF of the blocks have no weight, else they would fill the leading dimensions; but those of an
    # item with hardly any rarer word keep a little, so that it can be found at all.
    weak = np.zeros(len(idf), bool)
    for _, words, _ in index.items:
        if (df[words] <= RARE_DF * blocks).sum() < 3:
            weak[words] = True
    index.idf = np.where(df <= RARE_DF * blocks, np.maximum(idf + np.log(RARE_DF), 0.05 * idf), np.where(weak, 0.05 * idf, 0)).astype(np.float32)
    index.rare = np.append(df <= RARE_DF * blocks, False)
    index.hints = np.zeros(1 << HINT_BITS, bool)
    for k, (_, words, _) in enumerate(index.items):
        own = np.array([w for w in set(words) if index.rare[w]], np.int64)
        index.hints[hint_place(np.full(len(own), k), own)] = True
    pairs = pair_counts(docs, index)
    n = len(index.vocabulary)
    rank = max(1, min(rank, n))
    own_ids = np.concatenate([np.array(w, np.int64) for _, w, _ in index.items])
    own_edges = bounds(len(w) for _, w, _ in index.items)
    starts, _ = block_starts(own_edges)
    block = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(own_ids)]])))

    def product(basis: np.ndarray) -> np.ndarray:
        out = gram_product(pairs, index, basis)
        y = np.add.reduceat((index.idf[:, None] * basis)[own_ids], starts, axis=0)
        np.add.at(out, own_ids, index.idf[own_ids, None] * y[block])
        return out

    basis = np.random.default_rng(seed).normal(size=(n, rank))
    for _ in range(powers + 1):
        basis, _ = np.linalg.qr(product(basis))
    small = basis.T @ product(basis)
    drop_scratch(pairs)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    space = basis @ turn[:, np.argsort(-values)]
    index.space = np.vstack([index.idf[:, None] * space, np.zeros((1, rank))]).astype(np.float32)
    vectors, _, owner = projected(own_ids, own_edges, index.space)
    index.norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9).astype(np.float32)
    index.passages = (vectors / index.norms[:, None]).astype(np.float32)
    index.owner = owner
    return index


def candidates(index: Index, ids: np.ndarray, edges: np.ndarray, vectors: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """(passage, item's place, cosine, first and last word around) of each passage and item that are near in the latent
    space, where the words around hold enough of the item's rarer ones for a leak."""
    length = np.array([len(w) for _, w, _ in index.items])
    least = np.array([RARE_SHARE * len({x for x in w if index.rare[x]}) for _, w, _ in index.items])
    rare_at = np.flatnonzero(index.rare[ids])
    rare_ids = ids[rare_at]
    norms = np.linalg.norm(vectors, axis=1)
    live = np.flatnonzero((norms > 0) & (norms >= MIN_REACH * index.norms.min()))  # no projection is longer than its vector
    step = max(64, CELLS // max(1, len(index.owner)))
    for at in range(0, len(live), step):
        chosen = live[at : at + step]
        reach = vectors[chosen] @ index.passages.T
        rows, cols = np.nonzero((reach >= MIN_COSINE * norms[chosen, None]) & (reach >= MIN_REACH * index.norms))
        if not len(rows):
            continue
        item = index.owner[cols]
        new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (item[1:] != item[:-1])]))  # an item's passages are neighbours
        cosine = np.maximum.reduceat(reach[rows, cols], new)
        place, item = chosen[rows[new]], item[new]
        cosine /= norms[place]
        a = np.maximum(edges[doc[place]], starts[place] - length[item])
        b = np.minimum(edges[doc[place] + 1], starts[place] + 2 * HALF + length[item])
        first, last = np.searchsorted(rare_at, a), np.searchsorted(rare_at, b)
        able = np.flatnonzero(last - first >= least[item])
        around = np.append(0, np.cumsum((last - first)[able]))
        low = 0
        while low < len(able):
            high = max(low + 1, int(np.searchsorted(around, around[low] + CELLS, "right")) - 1)
            mine = able[low:high]
            n = (last - first)[mine]
            word = rare_ids[np.repeat(first[mine] - (around[low:high] - around[low]), n) + np.arange(around[high] - around[low])]
            hits = np.append(0, np.cumsum(index.hints[hint_place(np.repeat(item[mine], n), word)]))
            ends = around[low : high + 1] - around[low]
            for k in mine[hits[ends[1:]] - hits[ends[:-1]] >= least[item[mine]]].tolist():
                yield int(place[k]), int(item[k]), float(cosine[k]), int(a[k]), int(b[k])
            low = high


def leaks(texts: list[str | None], index: Index) -> list[tuple[int, int, float, float, bool]]:
    """(place of the text, item_id, cosine, share of the item's words in order, whether its answer is there)."""
    ids, edges = word_ids(index.vocabulary, texts)
    vectors, starts, doc = projected(ids, edges, index.space)
    found: dict[tuple[int, int], tuple[float, float, bool]] = {}
    rare_of: dict[int, tuple[list[int], set[int]]] = {}
    for p, item, cosine, a, b in candidates(index, ids, edges, vectors, starts, doc):
        item_id, words, answer = index.items[item]
        d = int(doc[p])
        if (d, item_id) in found and found[d, item_id][1] >= FULL_SHARE:
            continue
        if item not in rare_of:
            own = [w for w in words if index.rare[w]]
            rare_of[item] = own, set(own)
        rare, rare_set = rare_of[item]
        near = ids[a:b].tolist()
        if rare:
            here = [w for w in near if w in rare_set]
            if len(rare_set.intersection(here)) < RARE_SHARE * len(rare_set) or lcs(rare, here) < RARE_SHARE * len(rare):
                continue
        share = lcs(words, near) / len(words)
        answered = bool(answer) and lcs(answer, near) >= ANSWER_SHARE * len(answer)
        if share >= FULL_SHARE or (share >= ANSWERED_SHARE and answered):
            old = found.get((d, item_id))
            if old is None or share > old[1]:
                found[d, item_id] = (cosine, share, answered)
    for d, item, begin, share, answered in run_leaks(index, ids, edges):
        key = (d, index.items[item][0])
        if key not in found or share > found[key][1]:
            p = max(0, int(np.searchsorted(starts, begin, "right")) - 1)
            norm = float(np.linalg.norm(vectors[p]))
            cosine = float((index.passages[index.owner == item] @ vectors[p]).max()) / norm if norm else 0.0
            found[key] = (cosine, share, answered)
    return [(d, item_id, *x) for (d, item_id), x in sorted(found.items(), key=lambda kv: kv[0])]


def _indexes(docs: DataFrame, benchmark: DataFrame, block_items: int) -> Iterator[Index]:
    """Fitted indexes of ``block_items`` items each: what is held on the driver and broadcast is bounded by a block."""
    rows: list[tuple[int, str]] = []

    def fitted() -> Iterator[Index]:
        index = make_index(rows)
        if index.items:
            yield fit(docs, index)

    for r in benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        if len(rows) == block_items:
            yield from fitted()
            rows = []
    yield from fitted()


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = 5000) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_found for each document row and item that it leaks.

    Null and blank texts leak nothing; items without a word or with a null id can't be found. Repeated rows are searched
    one by one; a null doc_id stays null; of equal shares the first place counts. Texts of any length are searched whole.
    Other columns are not read. An empty table on either side gives an empty result.
    """
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for k, index in enumerate(_indexes(rows, benchmark, block_items)):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batch: pa.RecordBatch, shared=shared) -> dict:  # noqa: ANN001
            found = leaks(batch.column("text").to_pylist(), shared.value)
            at, item, cos, share, answered = zip(*found) if found else ((), (), (), (), ())
            return {"doc_id": batch.column("doc_id").take(pa.array(at, pa.int64())), "item_id": item, "cosine": cos, "lcs_share": share, "answer_found": answered}

        part = materialize(map_slices(rows, search, schema, limit=1 << 20), "leaks")
        shared.destroy()
        out = part if k == 0 else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = 5000) -> DataFrame:
    """``docs`` without the rows that leak an item; all columns stay. Null texts stay."""
    before = None
    for index in _indexes(docs, benchmark, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batch: pa.RecordBatch, shared=shared) -> dict:  # noqa: ANN001
            keep = np.ones(batch.num_rows, bool)
            for found in leaks(batch.column("text").to_pylist(), shared.value):
                keep[found[0]] = False
            kept = batch.filter(pa.array(keep))
            return {n: kept.column(n) for n in kept.schema.names}

        docs = materialize(map_slices(docs, clean, docs.schema, limit=1 << 20), "kept")
        shared.destroy()
        if before is not None:
            drop_scratch(before)
        before = docs
    return docs
