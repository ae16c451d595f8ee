"""The first writer of a key over micro-batches, with state that times out: an upsert on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that arbitrary state needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _First(StatefulProcessor):
    """A key's state is that it was seen, for ``ttl_ms``; 0: for good. Of the rows of one batch the smallest in ``order`` is first."""

    def __init__(self, order: list[str], ttl_ms: int) -> None:
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long", self.ttl_ms or None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        if self.seen.exists():
            return
        first = None
        for batch in rows:  # a key's rows come in pieces; one row is held
            best = batch.sort_values(self.order, kind="stable").head(1)
            first = best if first is None else pd.concat([first, best]).sort_values(self.order, kind="stable").head(1)
        if first is not None and len(first):
            self.seen.update((1,))
            yield first

    def close(self) -> None:
        pass


def first_writers(stream: DataFrame, keys: list[str], order: list[str], ttl_ms: int = 0) -> DataFrame:
    """Rows of ``stream`` whose ``keys`` no earlier micro-batch brought (within ``ttl_ms``, if given); of those of one batch the first in ``order``.

    Late and repeated rows of a known key give nothing. Keys with nulls are keys like others. State is by key and partitioned
    by it; a time-out bounds it. The session must use ``STATE_STORE``.
    """
    return stream.groupBy(*keys).transformWithStateInPandas(_First(order, ttl_ms), stream.schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
