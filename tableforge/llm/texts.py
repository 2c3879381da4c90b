"""What the text operators share: words, native column helpers, hashes, written tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableforge.workspace import fresh_folder

# Blanks as the contracts list them, and what follows from them.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CHUNK = 4 * 1024 * 1024
# An odd multiplier for polynomial hashes modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write are removed when it ends, so that steps one after another don't add up on disk."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)


def stored(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder and read again.

    This cuts the lineage with a table that survives lost executors.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark, label)
    with _shuffles_removed(spark):
        df.write.partitionBy(*by).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, label: str, buckets: int, key: str) -> tuple[str, DataFrame]:
    """``df`` written once as a table with a file per bucket of ``key``, by which it is grouped without a shuffle.

    Returns the table's name besides; drop it when nothing reads it any more.
    """
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid4().hex}"
    with _shuffles_removed(spark):
        (
            df.repartition(buckets, key)
            .write.bucketBy(buckets, key)
            .option("path", fresh_folder(spark, label))
            .option("compression", "zstd")
            .saveAsTable(name)
        )
    return name, spark.table(name)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lines_of(text: Column) -> Column:
    r"""The lines of a text, split at ``\n`` alone; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def words_of(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    inner = stripped(F.coalesce(text, F.lit("")))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK, -1))


def wide_hash(*columns: Column) -> tuple[Column, Column]:
    """128 bits of hash in two longs."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(0x5EED), *columns)


def constant(table: np.ndarray) -> Column:
    """A small table of whole numbers as a constant array."""
    return F.split(F.lit(",".join(map(str, table.tolist()))), ",").cast("array<bigint>")


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base."""
    global _POWERS
    if len(_POWERS) < n:
        factors = np.full(max(n, 2 * len(_POWERS), 4096), _BASE, np.uint64)
        factors[0] = 1
        _POWERS = np.cumprod(factors)
    return _POWERS[:n]


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text cut between words into pieces of a few megabytes."""
    start = 0
    while len(data) - start > _CHUNK:
        cut = start + _CHUNK
        while cut < len(data) and data[cut] not in b" \t\n\x0b\f\r":
            cut += 1
        yield data[start:cut]
        start = cut
    yield data[start:]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a UTF-8 text, in order."""
    out = []
    for piece in _pieces(data):
        a = np.frombuffer(piece, np.uint8)
        inside = np.empty(len(a) + 2, bool)
        inside[0] = inside[-1] = False
        np.not_equal(a, 32, out=inside[1:-1])
        inside[1:-1] &= (a < 9) | (a > 13)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            continue
        lengths = ends - starts
        letters = a[inside[1:-1]].astype(np.uint64) + np.uint64(1)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(len(letters)) - np.repeat(first, lengths)
        sums = np.add.reduceat(letters * powers(int(lengths.max()))[place], first)
        out.append(mixed(sums + lengths.astype(np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` words, in order."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    runs = len(words) - n + 1
    total = np.full(runs, np.uint64(n), np.uint64)
    for i in range(n):
        total = total * _BASE + words[i : i + runs]
    return mixed(total)
