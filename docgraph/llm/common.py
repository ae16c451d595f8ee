"""Helpers that the text operators share: scratch tables, words, hashing, bounded Arrow slices."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgraph.scratch import drop_written as drop_scratch  # noqa: F401
from docgraph.scratch import scratch_path  # noqa: F401
from docgraph.scratch import written as materialize  # noqa: F401

#: Bytes of text that a task handles at once; bounds a Python worker's memory.
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def tasks_for(docs: DataFrame, n_bytes: int, per_task: int) -> int:
    """Partitions for ``n_bytes``: the session's shuffle partitions, and more where a task would get over ``per_task``."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // per_task))


def doc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(n)), F.lit(0))


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices with about ``limit`` bytes of text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        begin, done = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(sizes, done + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin, done = end, int(sizes[end - 1])


def map_slices(
    df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str | T.StructType, text: str = "text", limit: int = CHUNK_BYTES
) -> DataFrame:
    """``mapInArrow`` in bounded slices. ``f`` gets a slice and gives equally long columns by name."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, text, limit):
            yield to_batch(f(piece), arrow)

    return df.mapInArrow(guarded(run), struct)


def arrow_schema(struct: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


def to_batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    def column(value, kind):  # noqa: ANN001, ANN202
        if isinstance(value, pa.ChunkedArray):
            value = value.combine_chunks()
        return value.cast(kind) if isinstance(value, pa.Array) else pa.array(value, kind)

    return pa.RecordBatch.from_arrays([column(columns[f.name], f.type) for f in arrow], schema=arrow)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix finaliser constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hash of each word's UTF-8 bytes, remembered while a task runs; memory is bounded by ``limit`` words."""

    def __init__(self, limit: int = 250_000) -> None:
        import xxhash

        self._hash, self._limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._limit:
            self.clear()
        value = self[word] = self._hash(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HELD: dict[object, object] = {}
_STAGE: list[object] = [None]


def _forget() -> None:
    if _HELD:
        _HELD.clear()
        gc.collect()  # an encoder and what it has learnt refer to each other


def worker_cache(key: object, make: Callable[[], object]) -> object:
    """What a Python worker remembers between the tasks of a stage. ``guarded`` forgets it when the next stage begins."""
    if key not in _HELD:
        _forget()
        _HELD[key] = make()
    return _HELD[key]


def begin_stage() -> None:
    stage = TaskContext.get().stageId()
    if stage != _STAGE[0]:
        _STAGE[0] = stage
        _forget()


def give_back() -> None:
    """Return freed memory to the system: workers live on for later stages, beside the JVM's."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def guarded(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for mapInArrow: a worker first drops what an earlier stage left in it, and returns freed memory at the end."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_stage()
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def word_hashes() -> WordHashes:
    return worker_cache("word hashes", WordHashes)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8")


def split_words(texts: list[str | None]) -> list[list[bytes]]:
    """The maximal runs outside ASCII white space (20, 09 to 0D) of each text; bytes.split cuts at just these."""
    return [utf8(t).split() for t in texts]


def bounds(lengths: Iterable[int]) -> np.ndarray:
    """Start of each document in the concatenation, and the end."""
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))]).astype(np.int64)


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document of ``bounds``; empty documents give 0."""
    total = np.concatenate([np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


#: Odd multiplier of the rolling hashes.
BASE = 0x9E3779B97F4A7C15


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of each run of ``n`` neighbours of ``h``, built by doubling; shorter input gives an empty array."""
    if len(h) < n:
        return h[:0]
    out, done = None, 0
    part, width, factor = h, 1, BASE
    while True:  # binary expansion of n: append blocks whose widths are powers of two
        if n & width:
            if out is None:
                out, done = part, width
            else:
                m = len(h) - done - width + 1
                out, done = out[:m] * np.uint64(factor) + part[done : done + m], done + width
        if width * 2 > n:
            break
        m = len(part) - width
        part, width, factor = part[:m] * np.uint64(factor) + part[width:], width * 2, factor * factor & (1 << 64) - 1
    return mix64(out[: len(h) - n + 1])
