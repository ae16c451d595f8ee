"""Sorted-string-table shards of token ids: prefix-compressed blocks, sparse index, Bloom filter, footer.

File: data blocks, then the index, the Bloom filter and a footer of fixed size. A key is a byte that is 0 for a
null id and else 1, the document id (8 bytes, big endian, sign bit flipped, so bytes sort as numbers) and its
ordinal among rows with that id (4 bytes). An entry is varint(shared key bytes), varint(own key bytes), varint(value bytes), own key bytes, value;
every RESTART-th entry of a block shares nothing. A block ends with its restart offsets and their number; it is compressed
with zstd and followed by its length before that and a crc32. The index holds last key, place and size of each block, so a look-up is a Bloom probe, a binary search in
the index, a binary search over restarts and at most RESTART entries.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import arrow_schema, chunks, drop_scratch, guarded, map_slices, materialize, scratch_path, tasks_for, to_batch
from docgraph.llm.tokens import SegmentEncoder, default_tokenizer, encoder

MAGIC = b"DGSST003"
FOOTER = struct.Struct("<QQQQIIQQ8s")  # index at, size; bloom at, size; hashes, id bytes; docs, ids; magic
RESTART = 16
BLOCK_BYTES = 64 << 10
LEVEL = 1  # of compression
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
KEY = struct.Struct(">BQI")
ID_BYTES = 9  # of a key, without the ordinal
SLICE = 2 << 20  # bytes of text that are encoded at once


def key_of(doc_id: int | None, ordinal: int = 0) -> bytes:
    return KEY.pack(0, 0, ordinal) if doc_id is None else KEY.pack(1, doc_id + (1 << 63), ordinal)


def id_of(key: bytes) -> int | None:
    there, doc_id, _ = KEY.unpack(key)
    return doc_id - (1 << 63) if there else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key_id: bytes, n_bits: int) -> list[int]:
    import xxhash

    a, b = xxhash.xxh3_64_intdigest(key_id, 1), xxhash.xxh3_64_intdigest(key_id, 2) | 1
    return [(a + k * b & (1 << 64) - 1) % n_bits for k in range(BLOOM_HASHES)]


class Writer:
    """Keys must come in ascending order. Memory: one block, the index and 10 bits a document."""

    def __init__(self, stream, id_bytes: int) -> None:  # noqa: ANN001
        self._out, self._at, self._id_bytes, self._codec = stream, 0, id_bytes, pa.Codec("zstd", LEVEL)
        self._block, self._restarts, self._n, self._last = bytearray(), [], 0, b""
        self._index: list[tuple[bytes, int, int]] = []
        self._keys: list[bytes] = []
        self.docs = self.ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        if key <= self._last:
            raise ValueError("keys must ascend")
        shared = 0
        if self._n % RESTART == 0:
            self._restarts.append(len(self._block))
        else:
            while shared < len(key) and key[shared] == self._last[shared]:
                shared += 1
        self._block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self._last, self._n = key, self._n + 1
        self.docs += 1
        self.ids += len(value) // self._id_bytes
        self._keys.append(key[:ID_BYTES])
        if len(self._block) >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> int:
        at = self._at
        self._out.write(data)
        self._at += len(data)
        return at

    def _flush(self) -> None:
        if self._n:
            tail = struct.pack(f"<{len(self._restarts)}II", *self._restarts, len(self._restarts))
            plain = bytes(self._block) + tail
            body = self._codec.compress(plain, asbytes=True) + struct.pack("<I", len(plain))
            body += struct.pack("<I", zlib.crc32(body))
            self._index.append((self._last, self._write(body), len(body)))
            self._block, self._restarts, self._n = bytearray(), [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self._index)
        index_at = self._write(index)
        n_bits = max(64, -(-len(self._keys) * BLOOM_BITS_PER_KEY // 8) * 8)
        bits = bytearray(n_bits // 8)
        for key in self._keys:
            for p in _bloom_places(key, n_bits):
                bits[p >> 3] |= 1 << (p & 7)
        bloom_at = self._write(bytes(bits))
        self._write(FOOTER.pack(index_at, len(index), bloom_at, len(bits), BLOOM_HASHES, self._id_bytes, self.docs, self.ids, MAGIC))


class Reader:
    """Over a seekable stream; keeps index and Bloom filter, reads one block at a time."""

    def __init__(self, stream, size: int) -> None:  # noqa: ANN001
        self._in, self._codec = stream, pa.Codec("zstd")
        f = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if f[-1] != MAGIC:
            raise ValueError("not a token shard")
        self._hashes, self.id_bytes, self.docs, self.ids = f[4:8]
        self.dtype = np.dtype(f"<u{self.id_bytes}")
        self._bloom = self._read(f[2], f[3])
        raw, at, self.index = self._read(f[0], f[1]), 0, []
        while at < len(raw):
            n, at = read_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QI", raw, at + n)))
            at += n + 12
        self._lasts = [k for k, _, _ in self.index]

    def _read(self, at: int, n: int) -> bytes:
        self._in.seek(at)
        return self._in.read(n)

    def _block(self, k: int) -> tuple[bytes, list[int]]:
        _, at, n = self.index[k]
        body = self._read(at, n)
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("damaged block")
        (length,) = struct.unpack("<I", body[-8:-4])
        plain = self._codec.decompress(body[:-8], length, asbytes=True)
        (count,) = struct.unpack("<I", plain[-4:])
        end = length - 4 - 4 * count
        return plain[:end], list(struct.unpack_from(f"<{count}I", plain, end))

    @staticmethod
    def _entries(data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            yield key, data[at + own : at + own + n]
            at += own + n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, value in self._entries(self._block(k)[0], 0):
                yield id_of(key), np.frombuffer(value, self.dtype)

    def may_have(self, doc_id: int | None) -> bool:
        key = key_of(doc_id)[:ID_BYTES]
        return bool(self._bloom) and all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, len(self._bloom) * 8))

    def get(self, doc_id: int | None, ordinal: int = 0) -> np.ndarray | None:
        """Token ids of a document, or None."""
        key = key_of(doc_id, ordinal)
        if not self.may_have(doc_id):
            return None
        k = bisect.bisect_left(self._lasts, key)
        if k == len(self.index):
            return None
        data, restarts = self._block(k)
        at = bisect.bisect_right(restarts, key, key=lambda r: next(self._entries(data, r))[0]) - 1
        for found, value in self._entries(data, restarts[max(at, 0)]):
            if found >= key:
                return np.frombuffer(value, self.dtype) if found == key else None
        return None


def opened(uri: str, mode: str):  # noqa: ANN201
    """A stream on any file system that Arrow knows, and for reading its size."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return files.open_input_file(path), files.get_file_info(path).size
    files.create_dir(path.rpartition("/")[0], recursive=True)
    return files.open_output_stream(path), 0


SHARDS = "shard int, path string, docs long, ids long"


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """doc_id and ids (binary, little endian, end id included) of each row; a null text is an empty one."""

    def encode(batch: pa.RecordBatch) -> dict:
        end = np.array([end_id], encoder(tokenizer).dtype).tobytes()
        ids = encoder(tokenizer).encode([t or "" for t in batch.column("text").to_pylist()])
        return {"doc_id": batch.column("doc_id"), "ids": pa.array([x.tobytes() + end for x in ids], pa.binary())}

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), encode, "doc_id long, ids binary", limit=SLICE)


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, shard_bytes: int = 32 << 20) -> list[dict]:
    """Encode ``docs`` and write one file per range of doc_id below ``folder``; gives the manifest, in key order.

    Texts are encoded where they are read, whatever their length, and only ids are moved, in files of about ``shard_bytes``.
    A null text is an empty one; a null doc_id sorts first; rows with equal doc_id keep apart by an ordinal, in
    order of a hash of their ids and counted in each file, so equal rows stay as many as they are. A file's name holds the attempt that wrote it and only files
    of finished tasks are in the manifest, so lost or repeated tasks leave no trace in the result. An empty table gives no
    shard. Other columns are not read.
    """
    path = tokenizer or default_tokenizer()
    width = SegmentEncoder(path).dtype.itemsize
    arrow = arrow_schema(docs.sparkSession.createDataFrame([], SHARDS).schema)
    rows = materialize(token_rows(docs, path, end_id), "token-rows")
    size = rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    by = ["doc_id", F.xxhash64("ids")]  # so that many rows with one id, a null one say, are no single file
    dealt = rows.repartitionByRange(tasks_for(rows, size, shard_bytes), *by).sortWithinPartitions(*by, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        uri = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.sst"
        writer = stream = None
        last, ordinal = object(), 0
        for batch in chunks(batches, "ids"):
            if writer is None:
                stream, _ = opened(uri, "w")
                writer = Writer(stream, width)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ordinal = ordinal + 1 if doc_id == last else 0
                last = doc_id
                writer.add(key_of(doc_id, ordinal), ids.as_buffer().to_pybytes())
        if writer is not None:
            writer.close()
            stream.close()
            yield to_batch({"shard": [task.partitionId()], "path": [uri], "docs": [writer.docs], "ids": [writer.ids]}, arrow)

    manifest = sorted((r.asDict() for r in dealt.mapInArrow(guarded(run), SHARDS).collect()), key=lambda r: r["shard"])
    drop_scratch(rows)
    return manifest


def read_shards(spark, manifest: list[dict]) -> DataFrame:  # noqa: ANN001
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit)."""
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    before = np.concatenate([[0], np.cumsum([m["ids"] for m in manifest])]).tolist()
    rows = [(m["path"], before[k]) for k, m in enumerate(manifest)]
    arrow = arrow_schema(spark.createDataFrame([], out).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                stream, size = opened(path, "r")
                cols: dict = {k: [] for k in arrow.names}
                with stream:
                    for doc_id, ids in Reader(stream, size).scan():
                        cols["doc_id"].append(doc_id)
                        cols["start"].append(start)
                        cols["n_tokens"].append(len(ids))
                        cols["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                        start += len(ids)
                        if len(cols["start"]) >= 20_000:
                            yield to_batch(cols, arrow)
                            cols = {k: [] for k in arrow.names}
                yield to_batch(cols, arrow)

    return spark.createDataFrame(rows, "path string, before long").mapInArrow(guarded(run), out)


def token_shards(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, scratch_path(spark, "tokens"), tokenizer))
