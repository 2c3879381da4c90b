"""Reproducible generated rows, in batch and as a stream.

Rows are made on the executors from ids, and every value is a function of the id: the
same ids give the same rows whatever the partitioning, and again after a task is retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableforge.functions.columns import bounded_decimal, bounded_int
from tableforge.sources.sequences import register_sequence

# Fixed values of the generated table.
SEQUENCE_START, SEQUENCE_END = 1, 1_000_000
ITEM_MIN, ITEM_MAX = 1, 1000
PRICE_MIN_CENTS, PRICE_MAX_CENTS = 100, 999_999
ROWS_PER_SECOND = 5


def demo_columns(df: DataFrame, id_column: str = "id") -> DataFrame:
    """``id, name, score`` for each id: ``name_<id>`` and ``id * 1.5``."""
    ids = F.col(id_column).cast("bigint")
    return df.select(
        ids.alias("id"),
        F.concat(F.lit("name_"), ids.cast("string")).alias("name"),
        (ids.cast("double") * F.lit(1.5)).alias("score"),
    )


def demo_rows(spark: SparkSession, rows: int = 5) -> DataFrame:
    """Demo rows for ids 1 to ``rows``; zero rows give an empty frame of the same schema."""
    return demo_columns(spark.range(1, rows + 1))


def datagen_columns(df: DataFrame, id_column: str = "id") -> DataFrame:
    """``id, item_id, price`` for each id, batch or streaming."""
    ids = F.col(id_column).cast("bigint")
    return df.select(
        ids.alias("id"),
        bounded_int(ids, ITEM_MIN, ITEM_MAX, slot=0).alias("item_id"),
        bounded_decimal(ids, PRICE_MIN_CENTS, PRICE_MAX_CENTS, slot=1).alias("price"),
    )


def datagen_batch(
    spark: SparkSession, start: int = SEQUENCE_START, end: int = SEQUENCE_END
) -> DataFrame:
    """Generated rows for the whole sequence ``start..end``."""
    return datagen_columns(spark.range(start, end + 1))


def datagen_stream(
    spark: SparkSession,
    rows_per_second: int = ROWS_PER_SECOND,
    start: int = SEQUENCE_START,
    end: int = SEQUENCE_END,
    replayable: bool = False,
    whole: bool = False,
) -> DataFrame:
    """Generated rows as a stream, with ``order_time`` to the millisecond.

    By default the wall clock sets the pace. ``replayable=True`` gives
    ``rows_per_second`` rows per micro-batch instead, and ``whole=True`` all ids that are left in one. Which ids a batch has is
    in the stream's own offsets, so they come once across restarts. The ids stop at ``end``: a bounded query over the whole
    sequence ends by itself, and ``await_sequence_end`` stops one that is paced.
    """
    reader = (
        spark.readStream.format(register_sequence(spark))
        .option("start", start)
        .option("end", end)
        .option("numPartitions", spark.sparkContext.defaultParallelism)
    )
    if not whole:
        reader = reader.option("rowsPerBatch" if replayable else "rowsPerSecond", rows_per_second)
    order_time = F.date_trunc("MILLISECOND", F.localtimestamp()).cast("timestamp_ntz")
    return datagen_columns(reader.load()).withColumn("order_time", order_time)
