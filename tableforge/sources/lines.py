"""Line sources: one row per line in a column named ``value``."""

from __future__ import annotations

import re
import sys
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableforge.workspace import file_sizes

# The fetching functions travel with the plan, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINE_SCHEMA = "value string"
# Bytes of a row group, as writers make them by default.
ROW_GROUP = 128 * 1024 * 1024

# An opener gets (url, first byte, last byte or None for a whole read, and the resource's tag if
# it has one) and returns a stream.
Opener = Callable[..., BinaryIO]
_BLOCK = 64 * 1024
_LINE_END = re.compile(rb"\r\n|\r|\n")


def spread(scan: DataFrame) -> DataFrame:
    """Deal a scan's rows out to all cores where its files keep less than half of them busy.

    A table kept in a few files would leave most of a cluster idle: a file smaller than a row group is
    read by one task, whatever its splits. With more files or row groups the scan is left
    alone, so at scale there is no shuffle here. Rows are dealt in turn and not by hash: any number of
    copies of one text spread evenly. Call it on a plain scan.
    """
    spark = scan.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, scan.inputFiles()
    if not files:
        return scan.repartition(cores) if 2 * scan.rdd.getNumPartitions() < cores else scan
    # Sizes are looked up for fewer files than there are cores.
    readers = len(files)
    if readers < cores:
        readers = sum(max(1, -(-size // ROW_GROUP)) for f in files for _, size in file_sizes(spark, f))
    return scan.repartition(cores) if 2 * readers < cores else scan


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text path; an http(s) URL is fetched on the executors."""
    if path.startswith(("http://", "https://")):
        return fetch_lines(spark.createDataFrame([(path,)], "url string"))
    return spark.read.text(path)


def lines_from_values(spark: SparkSession, values: Iterable[str | None]) -> DataFrame:
    """Lines the caller already holds in memory."""
    return spark.createDataFrame([(v,) for v in values], LINE_SCHEMA)


def open_url(url: str, first: int, last: int | None, tag: str | None = None) -> BinaryIO:
    """Open a URL, whole or (where ``url_extent`` found that ranges are served) from a byte on.

    With its tag, a resource that has changed since is answered as a whole, which is an error.
    """
    request = urllib.request.Request(url)
    if last is not None:
        request.add_header("Range", f"bytes={first}-{last}")
        if tag is not None:
            request.add_header("If-Range", tag)
    answer = urllib.request.urlopen(request, timeout=60)
    if last is not None and answer.status != 206:
        raise OSError(f"byte range not served, or changed since it was measured: {url}")
    return answer


def url_extent(url: str) -> tuple[int, str | None] | None:
    """The size and tag of a URL whose server answers byte ranges, else None (read it in one piece).

    The tag, a strong ETag or a date, tells whether the resource is still the same.
    """
    head = urllib.request.Request(url, method="HEAD")
    try:
        with urllib.request.urlopen(head, timeout=60) as answer:
            size = answer.headers.get("Content-Length")
            ranged = answer.headers.get("Accept-Ranges", "").lower() == "bytes"
            tag = answer.headers.get("ETag")
            if tag is None or tag.startswith("W/"):
                tag = answer.headers.get("Last-Modified")
    except urllib.error.HTTPError:  # the server may refuse HEAD alone; the read will tell
        return None
    return (int(size), tag) if ranged and size else None


def _piece_lines(stream: BinaryIO, start: int, end: int | None, size: int | None) -> Iterator[str]:
    """The lines whose first byte lies in ``[start, end)``.

    The stream begins one byte before ``start``: dropping everything up to the first line
    end then leaves it at the first line that starts in the piece. The last line is
    read to its end, wherever that is. Lines end at ``\\n``, ``\\r\\n`` or a lone ``\\r``. Blocks are read
    until the piece is done, and no more than one line is held.
    """
    position, first, done = max(start - 1, 0), start > 0, False
    held, seen = bytearray(), 0
    while first or end is None or position < end:
        found = _LINE_END.search(held, seen)
        # A carriage return at the end of a block may have its line feed in the next.
        if found is None or (found.group() == b"\r" and found.end() == len(held) and not done):
            if not done:
                seen = len(held) if found is None else found.start()
                block = stream.read(_BLOCK)
                done = not block
                held += block
                continue
            # The stream is at its end, which must be the end of the resource too.
            position += len(held)
            if getattr(stream, "length", None) or (size is not None and position < size):
                raise OSError("download ended before the announced size")
            if held and not first:
                yield held.decode("utf-8", "replace")
            return
        if not first:
            yield held[: found.start()].decode("utf-8", "replace")
        position += found.end()
        del held[: found.end()]
        first, seen = False, 0


def _record_batches(lines: Iterator[str], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    while held := list(islice(lines, rows)):
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])


def fetch_lines(
    urls: DataFrame,
    url_column: str = "url",
    piece_bytes: int = 64 * 1024 * 1024,
    partitions: int | None = None,
    opener: Opener = open_url,
    size_of: Callable[[str], "tuple[int, str | None] | int | None"] = url_extent,
) -> DataFrame:
    """The lines behind a column of URLs, downloaded by the tasks and never by the driver.

    A big http(s) resource is cut into byte ranges that different tasks read, so one
    URL does not end up in one task. A URL that cannot be read fails the job.
    """
    partitions = partitions or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces_type = "array<struct<start:bigint,end:bigint,size:bigint,tag:string>>"

    def cut(url: str) -> list[dict]:
        extent = size_of(url)
        if extent is None:
            return [{"start": 0, "end": None, "size": None, "tag": None}]
        size, tag = extent if isinstance(extent, tuple) else (extent, None)
        starts = range(0, size, piece_bytes)
        return [{"start": s, "end": min(s + piece_bytes, size), "size": size, "tag": tag} for s in starts]

    @F.pandas_udf(pieces_type)
    def ranges(column: pd.Series) -> pd.Series:
        return column.map(cut)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, last = row["start"], None if row["size"] is None else row["size"] - 1
                tag = () if row["tag"] is None else (row["tag"],)
                with opener(row["url"], max(start - 1, 0), last, *tag) as stream:
                    yield from _record_batches(
                        _piece_lines(stream, start, row["end"], row["size"])
                    )

    url = F.col(url_column)
    asked = urls.filter(url.isNotNull()).select(url.alias("url"))
    over_http = F.col("url").like("http://%") | F.col("url").like("https://%")
    whole = F.expr(f"cast(array(struct(0L, null, null, null)) as {pieces_type})")
    # Only what a server has to be asked about is dealt out before it is cut. A piece is up to
    # piece_bytes to read, so all are dealt out: to a fixed count of tasks, which AQE keeps, and in
    # turn, so that copies do not meet.
    probed = asked.filter(over_http).repartition(partitions).withColumn("cut", ranges("url"))
    others = asked.filter(~over_http).withColumn("cut", whole)
    pieces = probed.union(others).select("url", F.explode("cut").alias("piece"))
    return pieces.select("url", "piece.*").repartition(partitions).mapInArrow(fetch, LINE_SCHEMA)
