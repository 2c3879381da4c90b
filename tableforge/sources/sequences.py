"""A stream of consecutive ids that ends: a Python data source with offsets of its own."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# The source travels with the plan, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEQUENCE_FORMAT = "tableforge_sequence"
_BATCH = 1 << 16


class _Range(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class _SequenceReader(DataSourceStreamReader):
    """Offsets are the next id, so a batch that is run again has the same ids.

    Spark tells a restarted reader where the stream was by planning the empty range there; ids are admitted
    from that place on. The first offset after a start differs from the one before in ``run``: a stream
    that is restarted at its end runs one empty batch, by which a listener sees that it is done.
    """

    def __init__(self, start: int, end: int, per_batch: int, per_second: float, partitions: int) -> None:
        self.first, self.stop = start, max(end + 1, start)
        self.per_batch, self.per_second, self.partitions_wanted = per_batch, per_second, partitions
        self.run = time.time_ns()
        self.next, self.origin, self.began = start, start, time.monotonic()

    def _offset(self, place: int) -> dict:
        return {"next": place, "stop": self.stop, "run": self.run}

    def initialOffset(self) -> dict:
        return {"next": self.first, "stop": self.stop, "run": 0}

    def latestOffset(self) -> dict:
        if self.per_batch:
            place = self.next + self.per_batch
        elif self.per_second:
            place = self.origin + int((time.monotonic() - self.began) * self.per_second)
        else:
            place = self.stop
        return self._offset(min(max(place, self.next), self.stop))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, stop = start["next"], end["next"]
        if stop > self.next or (first == stop and stop != self.next):
            if first == stop:
                # Told at a restart: the pace goes on from here.
                self.origin, self.began = stop, time.monotonic()
            self.next = stop
        if first >= stop:
            return [_Range(stop, stop)]
        count = min(self.partitions_wanted, stop - first)
        edges = [first + (stop - first) * i // count for i in range(count + 1)]
        return [_Range(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        for start in range(partition.start, partition.stop, _BATCH):
            ids = np.arange(start, min(start + _BATCH, partition.stop), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids)], ["id"])


class SequenceSource(DataSource):
    """``spark.readStream.format("tableforge_sequence")``: a column ``id`` from ``start`` to ``end``.

    Options: ``start``, ``end``; ``rowsPerBatch`` ids per micro-batch, or ``rowsPerSecond`` by the clock since the query
    began, or neither for all that are left at once; ``numPartitions`` tasks per batch. Ids never go beyond ``end``:
    a query with the trigger ``availableNow`` and neither rate takes them all and ends.
    """

    @classmethod
    def name(cls) -> str:
        return SEQUENCE_FORMAT

    def schema(self) -> str:
        return "id bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        get = self.options.get
        per_batch, per_second = int(get("rowsPerBatch", 0)), float(get("rowsPerSecond", 0))
        if per_batch and per_second:
            raise ValueError("give rowsPerBatch or rowsPerSecond, not both")
        return _SequenceReader(
            int(get("start", 1)), int(get("end", 1)), per_batch, per_second, max(int(get("numPartitions", 1)), 1)
        )


def register_sequence(spark: SparkSession) -> str:
    """Make the format known to a session; returns its name."""
    spark.dataSource.register(SequenceSource)
    return SEQUENCE_FORMAT
