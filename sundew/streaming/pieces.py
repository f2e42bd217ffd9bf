"""Rows of a stateful processor in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

#: Rows that leave a task's Python at a time.
PIECE_ROWS = 8192


class InPieces(StatefulProcessor):
    """A processor of rows, fed from frames. Its rows leave by PIECE_ROWS; as rows, Spark gathers all of a key, or of all timers of a task, before the first leaves.

    ``numbers`` are columns that come as text: frames have no whole numbers beside nulls.
    """

    def __init__(self, own: StatefulProcessor, names: Sequence[str], numbers: Sequence[str]):
        self.own, self.names, self.numbers = own, list(names), frozenset(numbers)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own.init(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        return self._pieces(self.own.handleInputRows(key, self._rows(rows), timerValues))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._pieces(self.own.handleExpiredTimer(key, timerValues, expiredTimerInfo))

    def _rows(self, frames: Iterator[pd.DataFrame]) -> Iterator[Row]:
        for frame in frames:
            made = Row(*frame.columns)
            columns = [[None if v is None else int(v) for v in frame[c]] if c in self.numbers else list(frame[c]) for c in frame.columns]
            yield from (made(*values) for values in zip(*columns, strict=True))

    def _pieces(self, rows: Iterator[Row]) -> Iterator[pd.DataFrame]:
        rows = iter(rows)
        while some := list(islice(rows, PIECE_ROWS)):
            yield pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in zip(self.names, zip(*some, strict=True), strict=True)})


def stateful(rows: DataFrame, keys: Sequence[str], processor: StatefulProcessor, out: StructType, time: str, numbers: Sequence[str]) -> DataFrame:
    """``rows`` by ``keys`` through a processor of rows, in append mode."""
    texts = rows.withColumns({n: F.col(n).cast("string") for n in numbers})
    return texts.groupBy(*keys).transformWithStateInPandas(InPieces(processor, out.names, numbers), out, "Append", time)
