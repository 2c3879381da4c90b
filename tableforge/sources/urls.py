"""Lines behind URLs as a batch data source, whose planned partitions are byte ranges."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tableforge.sources.lines import LINE_SCHEMA, _piece_lines, _record_batches, open_url, url_extent

# The source travels with the plan, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

URL_FORMAT = "tableforge_urls"
PIECE_BYTES = 64 * 1024 * 1024
# Requests for a size that are open at a time.
_PROBES = 16


class _Piece(InputPartition):
    def __init__(self, url: str, start: int, end: int | None, size: int | None, tag: str | None) -> None:
        self.url, self.start, self.end, self.size, self.tag = url, start, end, size, tag


class _UrlReader(DataSourceReader):
    def __init__(self, source: type[UrlSource], urls: list[str], piece_bytes: int) -> None:
        self.source, self.urls, self.piece_bytes = source, urls, piece_bytes

    def _pieces(self, url: str) -> list[InputPartition]:
        extent = self.source.extent(url) if url.startswith(("http://", "https://")) else None
        if extent is None:
            return [_Piece(url, 0, None, None, None)]
        size, tag = extent
        starts = range(0, size, self.piece_bytes)
        return [_Piece(url, s, min(s + self.piece_bytes, size), size, tag) for s in starts]

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(_PROBES) as probes:
            found = [piece for pieces in probes.map(self._pieces, self.urls) for piece in pieces]
        # Spark wants a partition even of nothing.
        return found or [_Piece("", 0, 0, 0, None)]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        if not partition.url:
            return
        last = None if partition.size is None else partition.size - 1
        tag = () if partition.tag is None else (partition.tag,)
        with self.source.opener(partition.url, max(partition.start - 1, 0), last, *tag) as stream:
            yield from _record_batches(_piece_lines(stream, partition.start, partition.end, partition.size))


class UrlSource(DataSource):
    """``spark.read.format("tableforge_urls")``: the column ``value``, a row per line of some URLs.

    Options: ``urls``, a JSON list (or a ``path``, one URL); ``pieceBytes``, the size of a range. Sizes are asked for when the
    scan is planned, and each range is a partition, so the lines need no shuffle. A URL
    whose server gives no ranges is one partition. A URL that can't be read fails the job.
    """

    opener = staticmethod(open_url)
    extent = staticmethod(url_extent)

    @classmethod
    def name(cls) -> str:
        return URL_FORMAT

    def schema(self) -> str:
        return LINE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        urls = json.loads(self.options["urls"]) if "urls" in self.options else [self.options["path"]]
        piece_bytes = int(self.options.get("pieceBytes", PIECE_BYTES))
        if piece_bytes < 1:
            raise ValueError("pieceBytes must be positive")
        return _UrlReader(type(self), [u for u in urls if u], piece_bytes)


def read_urls(spark: SparkSession, urls: Sequence[str | None], piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The lines of URLs that the caller has at hand; for a column of very many use ``fetch_lines``.

    Null and empty URLs have no lines; a repeated one is read again.
    """
    spark.dataSource.register(UrlSource)
    reader = spark.read.format(URL_FORMAT).option("pieceBytes", piece_bytes)
    return reader.option("urls", json.dumps(list(urls))).load()
