"""Column builders for filters, casts and reproducible generated values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """One column name, or one part of a table name, quoted for SQL."""
    return "`" + name.replace("`", "``") + "`"


def named(*names: str) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col(quoted(name)) for name in names]


def any_like(conditions: Sequence[tuple[str, str]]) -> Column:
    """True where at least one ``(column, LIKE pattern)`` pair matches."""
    return reduce(lambda a, b: a | b, [F.col(name).like(pattern) for name, pattern in conditions])


def starts_with_any(column: str, prefixes: Sequence[str]) -> Column:
    """True where the trimmed value (null read as empty) starts with one of the prefixes."""
    cleaned = F.trim(F.coalesce(F.col(column), F.lit("")))
    return reduce(lambda a, b: a | b, [cleaned.startswith(p) for p in prefixes])


def to_money(column: str | Column) -> Column:
    """Cast to ``decimal(10,2)``, the money type of every generated table."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(10,2)")


def _hash_slot(id_column: Column, slot: int) -> Column:
    # 32 bits of the id's md5. It depends on the id alone, so lost executors,
    # retries and another partitioning all give the same value again (rand() does not).
    digits = F.substring(F.md5(id_column.cast("string")), 1 + 8 * slot, 8)
    return F.conv(digits, 16, 10).cast("bigint")


def bounded_int(id_column: Column, low: int, high: int, slot: int = 0) -> Column:
    """A reproducible int in ``[low, high]`` per id; ``slot`` (0-3) picks independent values."""
    return (_hash_slot(id_column, slot) % F.lit(high - low + 1) + F.lit(low)).cast("int")


def bounded_decimal(id_column: Column, low_cents: int, high_cents: int, slot: int = 1) -> Column:
    """A reproducible ``decimal(10,2)`` between two amounts given in cents."""
    cents = _hash_slot(id_column, slot) % F.lit(high_cents - low_cents + 1) + F.lit(low_cents)
    return (cents.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(10,2)")
