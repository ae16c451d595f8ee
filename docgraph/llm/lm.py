"""Language-model scores from a log-frequency Bloom filter of n-gram counts (Talbot and Osborne, 2007).

A count c is held as q = 1 + floor(log2 c): the pairs (n-gram, 1) .. (n-gram, q) are members of the filter. A look-up
probes level after level until one is missing, so an n-gram's count is read, too high by a level at a known small rate,
never too low. Training counts are summed in each slice of documents before they are shuffled, by ranges of the keys'
hashes; a range's task builds that range's piece of the filter, sized by its own keys. The pieces are broadcast where
their sum is within ``most_bytes``. Beyond it the probes go to the pieces: each slice of documents sends the distinct keys
that fall in a range to the task that holds the range's piece, and the levels come back to the slice. Both ways give the
same scores. Exact word counts, for the base score, are broadcast for the most frequent words alone and joined for the rest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import arrow_schema, chunks, doc_bucket, guarded, map_slices, materialize, mix64, sums, tasks_for, text_bytes, to_batch, utf8, word_hashes

END_HASH, BEGIN_HASH = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
UNIGRAM = np.uint64(0xA0761D6478BD642F)
FIRST_PROBES, LATER_PROBES = 4, 2
BITS_PER_MEMBER_PROBE = 1.6  # bits for each bit set: a fill near one half
ADD = 0.1
#: Weight of a context seen c times against the word's own frequency: c / (c + TRUST).
TRUST = 200.0
BUCKETS_PER_TASK = 4
SLICE = 2 << 20  # bytes of text at once, beside the filter


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level; 0 for level 0."""
    return np.where(level > 0, 1.5 * np.exp2(np.maximum(level, 1) - 1.0) - 0.5, 0.0)


def probe_bits(keys: np.ndarray, level: int, n_bits: np.ndarray) -> list[np.ndarray]:
    a = mix64(keys + np.uint64(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    b = mix64(a) | np.uint64(1)
    return [(a + np.uint64(k) * b) % n_bits for k in range(FIRST_PROBES if level == 1 else LATER_PROBES)]


def build_piece(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bit table (bytes) of distinct ``keys``."""
    levels = level_of(counts)
    set_bits = FIRST_PROBES * len(keys) + LATER_PROBES * int((levels - 1).sum())
    n_bits = max(64, -(-int(set_bits * BITS_PER_MEMBER_PROBE) // 8) * 8)
    flags = np.zeros(n_bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in probe_bits(keys[levels >= level], level, np.uint64(n_bits)):
            flags[at] = True
    return np.packbits(flags, bitorder="little")


class CountFilter:
    """Pieces by range of the key's top bits."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, log_buckets: int) -> None:
        self.data, self.starts, self.sizes, self.log_buckets = data, starts, sizes, log_buckets

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        bucket = bucket_of(keys, self.log_buckets)
        live = np.flatnonzero(self.sizes[bucket] > 0)
        level = 1
        while len(live):
            k, b = keys[live], bucket[live]
            hit = np.ones(len(live), bool)
            for at in probe_bits(k, level, self.sizes[b].astype(np.uint64) * np.uint64(8)):
                place = self.starts[b] + (at >> np.uint64(3)).astype(np.int64)
                hit &= (self.data[place] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live = live[hit]
            out[live] = level
            level += 1
            if level > 63:
                break
        return out


def bucket_of(keys: np.ndarray, log_buckets: int) -> np.ndarray:
    return (keys >> np.uint64(64 - log_buckets)).astype(np.int64) if log_buckets else np.zeros(len(keys), np.int64)


class Tokens:
    """Word and pair keys of a slice; each document ends with the end token."""

    def __init__(self, texts: list[str | None]) -> None:
        words = [utf8(t).lower().split() for t in texts]
        n = np.array([len(w) + 1 for w in words], np.int64)
        self.edges = np.concatenate([[0], np.cumsum(n)])
        total = int(self.edges[-1])
        hashes = np.full(total, END_HASH, np.uint64)
        is_word = np.ones(total, bool)
        is_word[self.edges[1:] - 1] = False
        hashes[is_word] = word_hashes().of([w for ws in words for w in ws])
        self.hashes = hashes
        before = np.empty(total, np.uint64)
        before[1:] = hashes[:-1]
        before[self.edges[:-1]] = BEGIN_HASH
        self.before = before

    @property
    def pairs(self) -> np.ndarray:
        return mix64(self.before * np.uint64(0x9E3779B97F4A7C15) + self.hashes)


def word_key(hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes ^ UNIGRAM)


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def train(docs: DataFrame) -> DataFrame:
    """For each range of keys: its piece of the filter, and words with exact counts. Written to the shared folder."""
    n_tasks = tasks_for(docs, text_bytes(docs), 32 << 20)
    log_buckets = max(0, math.ceil(math.log2(n_tasks * BUCKETS_PER_TASK)))

    def emit(batch: pa.RecordBatch) -> dict:
        t = Tokens(batch.column("text").to_pylist())
        out: dict = {"bucket": [], "kind": [], "keys": [], "words": [], "counts": []}
        words, word_counts = counted(t.hashes)
        begins, n_begins = np.array([BEGIN_HASH]), np.array([batch.num_rows])
        known = word_key(np.concatenate([words, begins]))
        order = np.argsort(known)
        sets = [(0, known[order], np.concatenate([words, begins])[order], np.concatenate([word_counts, n_begins])[order])]
        pairs, pair_counts = counted(t.pairs)
        sets.append((1, pairs, pairs[:0], pair_counts))
        for kind, keys, own, counts in sets:
            bucket = bucket_of(keys, log_buckets)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else []
            for a, b in zip(cut[:-1], cut[1:]):
                out["bucket"].append(int(bucket[a]))
                out["kind"].append(kind)
                out["keys"].append(keys[a:b].tobytes() if kind else b"")
                out["words"].append(own[a:b].tobytes())
                out["counts"].append(counts[a:b].astype(np.uint32).tobytes())
        return out

    blobs = map_slices(docs.select(F.col("text").cast("string").alias("text")), emit, "bucket long, kind int, keys binary, words binary, counts binary", limit=2 * SLICE)

    def piece(rows: list[tuple]) -> pa.RecordBatch:
        """``rows``: (bucket, kind, keys, words, counts), the last three as views of the batches' own memory."""
        sums: list[tuple[np.ndarray, np.ndarray]] = []
        for kind, at in ((1, 2), (0, 3)):  # pairs by key, words by hash
            mine = [r for r in rows if r[1] == kind]
            keys = [r[at] for r in mine] or [np.zeros(0, np.uint64)]
            sums.append(counted(np.concatenate(keys), np.concatenate([r[4] for r in mine] or [np.zeros(0, np.uint32)]).astype(np.int64)))
        (pk, pc), (wh, wc) = sums
        data = build_piece(np.concatenate([pk, word_key(wh)]), np.concatenate([pc, wc]))
        real = wh != BEGIN_HASH
        arrays = [pa.array([rows[0][0]], pa.int64()), pa.array([data.tobytes()], pa.binary()), pa.array([wh[real].astype(np.int64)], pa.list_(pa.int64())), pa.array([wc[real]], pa.list_(pa.int64())), pa.array([int(wc[real].sum())], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["bucket", "data", "words", "counts", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            buckets, kinds = b.column("bucket").to_numpy(), b.column("kind").to_numpy()
            for k in range(b.num_rows):
                if held and held[0][0] != buckets[k]:
                    yield piece(held)
                    held = []
                view = [np.frombuffer(b.column(c)[k].as_buffer(), kind) for c, kind in (("keys", np.uint64), ("words", np.uint64), ("counts", np.uint32))]
                held.append((int(buckets[k]), int(kinds[k]), *view))
        if held:
            yield piece(held)

    dealt = blobs.repartition(n_tasks, "bucket").sortWithinPartitions("bucket")
    out = dealt.mapInArrow(guarded(run), "bucket long, data binary, words array<long>, counts array<long>, tokens long")
    return materialize(out.withColumn("log_buckets", F.lit(log_buckets)), "lm")


def assemble(model: DataFrame) -> CountFilter:
    """The filter's pieces in one array. The caller has checked their size."""
    parts = {r["bucket"]: np.frombuffer(r["data"], np.uint8) for r in model.select("bucket", "data").toLocalIterator()}
    log_buckets = model.select("log_buckets").first()[0] if parts else 0
    sizes = np.zeros(1 << log_buckets, np.int64)
    for b, p in parts.items():
        sizes[b] = len(p)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.zeros(int(sizes.sum()), np.uint8)
    for b, p in parts.items():
        data[starts[b] : starts[b] + len(p)] = p
    return CountFilter(data, starts, sizes, log_buckets)


def frequent_words(counts: DataFrame, most_words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes in order, counts, and the least count held: a power of two that ``most_words`` words at most reach."""
    sizes = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("c")).cast("int")).count().collect()}
    total, least = 0, 64
    for p in sorted(sizes, reverse=True):
        if total + sizes[p] > most_words:
            break
        total, least = total + sizes[p], p
    rows = counts.filter(F.col("c") >= 2**least) if least < 63 else counts.limit(0)
    hashes, values = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in rows.repartition(F.col("h") % 256).groupBy((F.col("h") % 256).alias("part")).agg(F.collect_list(F.struct("h", "c")).alias("x")).toLocalIterator():
        hashes.append(np.array([y[0] for y in r["x"]], np.int64).view(np.uint64))
        values.append(np.array([y[1] for y in r["x"]], np.int64))
    h, c = np.concatenate(hashes), np.concatenate(values)
    order = np.argsort(h)
    return h[order], c[order], 2**least


def mixture(pair: np.ndarray, context: np.ndarray, word: np.ndarray, tokens: int, kinds: int) -> np.ndarray:
    """log10 of the smoothed probabilities from counts read from the filter."""
    own = (word + ADD) / (tokens + ADD * (kinds + 1))
    trust = context / (context + TRUST)
    return np.log10(trust * np.minimum(pair / np.maximum(context, 1.0), 1.0) + (1 - trust) * own)


def by_bucket(keys: np.ndarray, log_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(range, its keys in order) of the distinct ``keys``."""
    keys = np.unique(keys)
    bucket = bucket_of(keys, log_buckets)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else []
    for a, b in zip(cut[:-1], cut[1:]):
        yield int(bucket[a]), keys[a:b]


def probe_keys(t: Tokens) -> np.ndarray:
    """All keys whose counts a slice needs."""
    return np.concatenate([t.pairs, word_key(np.unique(np.append(t.hashes, BEGIN_HASH)))])


def scored_by_shuffle(rows: DataFrame, model: DataFrame, log_buckets: int, score: Callable, schema: str, slice_bytes: int = 8 << 20) -> DataFrame:
    """``score`` of each slice of ``rows``, with levels that the tasks of the filter's pieces have read.

    One pass writes the documents with the number of their slice, and beside them each slice's distinct keys by range. What
    meets in a task is a range's piece with its keys, or a slice's documents with their levels, both of bounded size.
    """
    table = "slice long, bucket long, data binary, doc_id long, held_out boolean, text string"
    arrow = arrow_schema(rows.sparkSession.createDataFrame([], table).schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, b in enumerate(chunks(batches, limit=slice_bytes)):
            empty = [None] * b.num_rows
            yield to_batch({"slice": [first + k] * b.num_rows, "bucket": empty, "data": empty} | {c: b.column(c) for c in ("doc_id", "held_out", "text")}, arrow)
            found = list(by_bucket(probe_keys(Tokens(b.column("text").to_pylist())), log_buckets))
            empty = [None] * len(found)
            yield to_batch({"slice": [first + k] * len(found), "bucket": [x for x, _ in found], "data": [x.tobytes() for _, x in found], "doc_id": empty, "held_out": empty, "text": empty}, arrow)

    dealt = materialize(rows.mapInArrow(guarded(deal), table), "lm-slices")
    keys, texts = dealt.filter("bucket IS NOT NULL").select("slice", "bucket", "data"), dealt.filter("bucket IS NULL").select("slice", "doc_id", "held_out", "text")

    def probe(asked: pa.Table, piece: pa.Table) -> pa.Table:
        got = [np.frombuffer(x, np.uint8) for x in piece.column("data").to_pylist()]
        out = []
        for raw in asked.column("data").to_pylist():
            k = np.frombuffer(raw, np.uint64)
            levels = CountFilter(got[0], np.zeros(1, np.int64), np.array([len(got[0])]), 0).levels(k) if got else np.zeros(len(k))
            out.append(levels.astype(np.uint8).tobytes())
        return pa.table({"slice": asked.column("slice"), "bucket": asked.column("bucket"), "levels": pa.array(out, pa.binary())})

    answers = keys.groupBy("bucket").cogroup(model.select("bucket", "data").groupBy("bucket")).applyInArrow(probe, "slice long, bucket long, levels binary")
    out_arrow = arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def finish(docs: pa.Table, levels: pa.Table) -> pa.Table:
        batch = docs.combine_chunks().to_batches()[0]
        t = Tokens(batch.column("text").to_pylist())
        asked = dict(by_bucket(probe_keys(t), log_buckets))
        told = {b: np.frombuffer(x, np.uint8) for b, x in zip(levels.column("bucket").to_pylist(), levels.column("levels").to_pylist())}
        known = np.concatenate([asked[b] for b in sorted(asked)])
        values = np.concatenate([told[b] for b in sorted(asked)]).astype(np.int64)
        return pa.Table.from_batches([to_batch(score(batch, t, lambda k: values[np.searchsorted(known, k)]), out_arrow)])

    return texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(finish, schema)


def score_documents(docs: DataFrame, most_bytes: int = 128 << 20, most_words: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    Learns from rows with crc32(doc_id as text) mod 10 not 0 (a null doc_id counts as held out). A null or blank text
    is its end token alone. Texts of any length are scored whole. Repeated rows are counted in training and scored one by
    one. If no row may be learnt from, all counts are 0. Columns other than doc_id and text are not read; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", doc_bucket(F.col("doc_id"), 10) == 0)
    spark = docs.sparkSession
    model = train(rows.filter("NOT held_out"))
    counts = model.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("h"), F.col("x.counts").alias("c"))
    size, tokens, kinds, log_buckets = (x or 0 for x in model.agg(F.sum(F.octet_length("data")), F.sum("tokens"), F.sum(F.size("words")), F.max("log_buckets")).first())
    heads, head_counts, _ = frequent_words(counts, most_words)
    fits = size <= most_bytes
    shared = spark.sparkContext.broadcast((assemble(model) if fits else None, heads, head_counts))
    floor = tokens + ADD * (kinds + 1)

    def score(batch: pa.RecordBatch, t: Tokens, levels: Callable[[np.ndarray], np.ndarray]) -> dict:
        _, heads, head_counts = shared.value
        here, where = np.unique(t.hashes, return_inverse=True)
        held, c = np.zeros(len(here), bool), np.zeros(len(here), np.int64)
        if len(heads):
            at = np.minimum(np.searchsorted(heads, here), len(heads) - 1)
            held = heads[at] == here
            c = np.where(held, head_counts[at], 0)
        base = np.where(held, np.log10((c + ADD) / floor), 0.0)[where]
        own = count_of(levels(word_key(here)))[where]
        context = np.empty(len(own))
        context[1:] = own[:-1]
        context[t.edges[:-1]] = count_of(levels(word_key(np.array([BEGIN_HASH]))))[0]
        scores = sums(mixture(count_of(levels(t.pairs)), context, own, tokens, kinds), t.edges)
        rest, tf, cut = rare_words(t, ~held[where])
        return {
            "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": np.diff(t.edges),
            "known": sums(held[where].astype(np.int64), t.edges), "base": sums(base, t.edges), "score": scores,
            "rest": pa.ListArray.from_arrays(cut, pa.array(rest)), "tf": pa.ListArray.from_arrays(cut, pa.array(tf)),
        }

    def first_pass(batch: pa.RecordBatch) -> dict:
        return score(batch, Tokens(batch.column("text").to_pylist()), shared.value[0].levels)

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rest array<long>, tf array<long>"
    scored = map_slices(rows, first_pass, schema, limit=SLICE) if fits else scored_by_shuffle(rows, model, log_buckets, score, schema)
    main = materialize(scored, "lm-rows").withColumn("row", F.monotonically_increasing_id())
    shared.destroy()
    # Words beyond the broadcast ones.
    pairs = main.filter(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "tf")).alias("x")).select("row", F.col("x.rest").alias("h"), F.col("x.tf").alias("tf"))
    c = F.coalesce(F.col("c"), F.lit(0))
    tail = pairs.join(counts, "h", "left").groupBy("row").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("t_known"), F.sum(F.col("tf") * F.log10((c + ADD) / floor)).alias("t_base"))
    out = main.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "score").join(tail, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("t_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("t_base", F.lit(0.0))).alias("base_score"), "score",
    )


def rare_words(t: Tokens, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Hashes and frequencies, document by document, of the tokens that ``rest`` marks; and where each document's begin."""
    n = len(t.edges) - 1
    doc, own = np.repeat(np.arange(n), np.diff(t.edges))[rest], t.hashes[rest]
    order = np.lexsort((own, doc))
    doc, own = doc[order], own[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])])) if len(own) else np.zeros(0, np.int64)
    tf = np.diff(np.concatenate([new, [len(own)]])) if len(own) else new
    cut = pa.array(np.searchsorted(doc[new], np.arange(n + 1)).astype(np.int32))
    return own[new].view(np.int64), tf.astype(np.int64), cut
