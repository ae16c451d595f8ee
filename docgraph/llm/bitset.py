"""A set of 64-bit hashes as one bit table of bounded size: no false negatives, few false positives while it is sparse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import guarded

SEGMENT_BITS = 19  # 64 KB a segment


class HashBits:
    """``bits``: log2 of the table's size; a hash sets the bit that its top bits number."""

    def __init__(self, table: np.ndarray, bits: int) -> None:
        self.table, self.bits = table, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def collect_bits(hashes: DataFrame, n: int, per_hash: int = 32, most: int = 29) -> HashBits:
    """Bits of the one long column of ``hashes`` with ``n`` rows. The table has about ``per_hash`` bits a hash and at most
    2**most bits (64 MB): beyond that it fills up and lets more hashes pass, which callers must be able to bear."""
    bits = min(most, max(SEGMENT_BITS, int(np.ceil(np.log2(max(1, n) * per_hash)))))
    column = hashes.columns[0]
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = hashes.select(place.alias("at"), F.shiftrightunsigned(place, SEGMENT_BITS).alias("segment"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[int, np.ndarray] = {}
        for b in batches:
            at, seg = b.column("at").to_numpy(zero_copy_only=False), b.column("segment").to_numpy(zero_copy_only=False)
            for s in np.unique(seg).tolist():
                mine = segments.setdefault(s, np.zeros(1 << SEGMENT_BITS, bool))
                mine[at[seg == s] & ((1 << SEGMENT_BITS) - 1)] = True
        for s, flags in segments.items():
            data = np.packbits(flags, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([data], pa.binary())], names=["segment", "data"])

    table = np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (SEGMENT_BITS - 3)
    for r in rows.repartition("segment").mapInArrow(guarded(run), "segment long, data binary").toLocalIterator():
        table[r["segment"] * step : (r["segment"] + 1) * step] |= np.frombuffer(r["data"], np.uint8)
    return HashBits(table, bits)
