"""Words of a text column: tokenise, count, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: words are separated by runs of whitespace.
WORD_BREAK = r"\s+"


def tokens(df: DataFrame, column: str = "value") -> DataFrame:
    """One row per word in ``word``; empty words and null texts give no rows."""
    words = F.explode(F.split(F.col(column), WORD_BREAK)).alias("word")
    return df.select(words).filter(F.col("word") != "")


def word_count(df: DataFrame, column: str = "value") -> DataFrame:
    """``word, count``. Words are counted before the shuffle, so a hot word costs one row per task."""
    return tokens(df, column).groupBy("word").count()


def by_frequency() -> list[Column]:
    """Most frequent first, equal counts by word."""
    return [F.col("count").desc(), F.col("word")]


def top_words(counts: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent words of ``word, count``."""
    return counts.orderBy(*by_frequency()).limit(k)


def distinct_words(df: DataFrame, column: str = "value") -> DataFrame:
    """One row ``n``: the exact number of different words."""
    return tokens(df, column).agg(F.count_distinct("word").alias("n"))
