"""The items of a drawn stream as a data source: numbers in order, as a table or as a stream that stops and resumes.

Register it with ``spark.dataSource.register(DrawnItems)``; ``schedule.live`` does. Options:

* ``first``, ``total``: items from first up to total; a stream without total never ends;
* ``rate``, ``since``: items a second since a time (seconds of the epoch) at which the stream began; without rate, and for
  tables, all items are there at once;
* ``partitions``: parts of a batch.

An offset is the number of items before it, and depends on nothing but the options and the clock, so a query that is stopped,
or fails, goes on from its checkpoint with the item after the last one; a part that is lost is read again.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

_BATCH = 1 << 16


class Stretch(InputPartition):
    """Items from lo up to hi."""

    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi


def stretches(lo: int, hi: int, parts: int) -> list[Stretch]:
    """[lo, hi) in at most as many parts, of about one size."""
    bounds = [lo + (hi - lo) * i // parts for i in range(parts + 1)]
    return [Stretch(a, b) for a, b in zip(bounds, bounds[1:]) if a < b]


def _numbers(part: Stretch) -> Iterator[pa.RecordBatch]:
    for at in range(part.lo, part.hi, _BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(range(at, min(at + _BATCH, part.hi)), pa.int64())], names=["idx"])


class DrawnItems(DataSource):
    @classmethod
    def name(cls) -> str:
        return "drawn-items"

    def schema(self) -> str:
        return "idx long"

    def _settings(self) -> tuple[int, int | None, float | None, float, int]:
        """first, total, rate, since, partitions"""
        get = self.options.get
        total, rate = get("total"), get("rate")
        if total is None and rate is None:
            raise ValueError("drawn-items needs a total or a rate")
        return int(get("first", 0)), total if total is None else int(total), rate if rate is None else float(rate), float(get("since", 0)), max(1, int(get("partitions", 1)))

    def reader(self, schema: StructType) -> DataSourceReader:
        first, total, _, _, parts = self._settings()
        if total is None:
            raise ValueError("a table of drawn items needs a total")
        return _Table(first, total, parts)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(*self._settings())


class _Table(DataSourceReader):
    def __init__(self, first: int, total: int, parts: int) -> None:
        self.first, self.total, self.parts = first, total, parts

    def partitions(self) -> Sequence[InputPartition]:
        return stretches(self.first, self.total, self.parts)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _numbers(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, first: int, total: int | None, rate: float | None, since: float, parts: int) -> None:
        self.first, self.total, self.rate, self.since, self.parts = first, total, rate, since, parts

    def initialOffset(self) -> dict:  # noqa: N802
        return {"items": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        due = self.total if self.rate is None else self.first + max(0, int((time.time() - self.since) * self.rate))
        return {"items": max(self.first, due if self.total is None else min(due, self.total))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return stretches(start["items"], end["items"], self.parts)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _numbers(partition)
