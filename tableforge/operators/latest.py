"""The latest row per key, and tables that hold it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tableforge.functions.columns import named
from tableforge.operators.tables import save_table


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def latest_by_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Per key the row with the highest ``order_by`` values; nulls are lowest.

    An aggregate, not a window: each task first keeps one row per key, so a key with a
    third of all rows reaches its reducer as one row per task. Rows that tie on
    ``order_by`` are decided by their other columns, so a retried task decides the same.
    """
    if not order_by:
        raise ValueError("order_by names no column")
    ordering = [c for c in order_by if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    if not ordering and not rest:
        return df.select(*named(*keys)).distinct()
    types = {f.name: f.dataType for f in df.schema.fields}
    ties = [c for c in rest if _orderable(types[c])]
    newest = F.struct(*named(*ordering, *rest))
    if ties == rest:
        newest = F.max(newest)
    else:
        newest = F.max_by(newest, F.struct(*named(*ordering, *ties)))
    latest = df.groupBy(*named(*keys)).agg(newest.alias("_newest"))
    return latest.select(*named(*keys), "_newest.*").select(*named(*df.columns))


def write_keyed(
    df: DataFrame, table: str, keys: Sequence[str], order_by: Sequence[str], fmt: str = "parquet"
) -> int:
    """Replace a table by the latest row per key; returns the rows that landed."""
    return save_table(latest_by_key(df, keys, order_by), table, fmt)
