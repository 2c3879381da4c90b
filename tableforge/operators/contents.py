"""Whether what landed is what was written: counts and fingerprints of whole tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DoubleType,
    FloatType,
    MapType,
    StructType,
    VariantType,
)

from tableforge.functions.columns import quoted

# How much of a table is compared: its row count; a hash of every cell by the engine; or the same by
# MD5 over a written form that any other engine can compute too.
ROWS, CONTENT, PORTABLE = "rows", "content", "portable"
_PIECES, _BITS = 3, 21
_DIGITS = 5
_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


class Contents(NamedTuple):
    """Rows of a table and, where asked for, its fingerprint."""

    rows: int
    fingerprint: str | None = None


def _nested(kind: DataType) -> bool:
    return isinstance(kind, (ArrayType, MapType, StructType, VariantType))


def _engine_hash(schema: StructType) -> Column:
    """64 bits of a row. Nulls are hashed as such, since the hash function passes over them."""
    parts = []
    for field in schema.fields:
        column = F.col(quoted(field.name))
        parts += [F.to_json(column, _JSON) if _nested(field.dataType) else column, column.isNull()]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")


def _written(column: Column, kind: DataType) -> Column:
    """A value as text: its length and its digits; floating point numbers exactly, in hex."""
    if isinstance(kind, (DoubleType, FloatType)):
        text = F.replace(F.format_string("%a", column.cast("double")), F.lit(".0p"), F.lit("p"))
    elif isinstance(kind, ArrayType):
        text = F.array_join(F.transform(column, lambda x: _written(x, kind.elementType)), "")
    elif isinstance(kind, StructType):
        text = F.concat(F.lit(""), *[_written(column[f.name], f.dataType) for f in kind.fields])
    elif isinstance(kind, MapType):
        entry = lambda e: F.concat(_written(e["key"], kind.keyType), _written(e["value"], kind.valueType))
        text = F.array_join(F.array_sort(F.transform(F.map_entries(column), entry)), "")
    elif isinstance(kind, VariantType):
        text = F.to_json(column)
    else:
        text = column.cast("string")
    told = F.concat(F.length(text).cast("string"), F.lit(":"), text)
    return F.when(column.isNull(), F.lit("-")).otherwise(told)


def fingerprint(schema: StructType, portable: bool = False) -> Column:
    """An aggregate over rows of this schema: sums of pieces of a hash of every row, as text.

    It does not depend on the order of rows or on partitions, and counts repeated rows as often as they
    occur. Tasks add up their own rows, so a few numbers per task are all that is shuffled. Pieces are short enough
    for sums over 4 * 10**12 rows.

    The portable form takes the MD5 of the columns' written values. A null is ``-``, any other value its length in
    characters, ``:``, and the value as text; floating point numbers are in hex (``0x1.8p0``), and lists and structs
    the same of each part. Four pieces of five hex digits are summed.
    """
    if portable:
        columns = [_written(F.col(quoted(f.name)), f.dataType) for f in schema.fields]
        digest = F.md5(F.concat(F.lit(""), *columns))
        pieces = [
            F.conv(F.substring(digest, 1 + _DIGITS * i, _DIGITS), 16, 10).cast("long") for i in range(4)
        ]
    else:
        mask = (1 << _BITS) - 1
        pieces = [
            F.shiftrightunsigned(_engine_hash(schema), _BITS * i).bitwiseAND(F.lit(mask))
            for i in range(_PIECES)
        ]
    return F.concat_ws("-", *[F.coalesce(F.sum(p), F.lit(0)).cast("string") for p in pieces])


def _measures(schema: StructType, check: str) -> list[Column]:
    if check not in (ROWS, CONTENT, PORTABLE):
        raise ValueError(f"unknown check {check!r}")
    rows = [F.count(F.lit(1)).alias("rows")]
    return rows if check == ROWS else [*rows, fingerprint(schema, check == PORTABLE).alias("fingerprint")]


def contents(df: DataFrame, check: str = CONTENT) -> Contents:
    """The rows and the fingerprint of a frame, in one pass."""
    return Contents(**df.agg(*_measures(df.schema, check)).first().asDict())


class Written:
    """Measures a frame while it is written, and compares it with what landed."""

    def __init__(self, df: DataFrame, check: str = ROWS) -> None:
        self._seen, self.check, self._schema = Observation(), check, df.schema
        self.df = df.observe(self._seen, *_measures(df.schema, check))

    def matched(self, landed: DataFrame, table: str) -> Contents:
        """What landed, which must be what was written; a difference raises."""
        # By the schema of what was written: a reader may call columns otherwise than they were.
        found = Contents(**landed.toDF(*self._schema.names).agg(*_measures(self._schema, self.check)).first().asDict())
        written = Contents(**self._seen.get)
        if found.rows != written.rows:
            raise RuntimeError(f"{table}: wrote {written.rows} rows but read back {found.rows}")
        if found != written:
            raise RuntimeError(f"{table}: the rows read back are not those written")
        return found
