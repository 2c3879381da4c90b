"""Schema rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from tableforge.functions.columns import quoted


def relaxed_type(kind: DataType) -> DataType:
    """A type in which everything inside may be null: fields of structs, elements of arrays, values of maps.

    Keys of maps are never null and stay so; what is inside a key may be.
    """
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, relaxed_type(f.dataType), True, f.metadata) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(relaxed_type(kind.elementType), True)
    if isinstance(kind, MapType):
        return MapType(relaxed_type(kind.keyType), relaxed_type(kind.valueType), True)
    return kind


def _nullable(field: StructField, kind: DataType) -> Column:
    # Nullable when analysed; the optimizer folds it back to the bare column, so no row
    # is touched. A cast is needed only where something inside a column changes.
    column = F.expr(f"if(true, {quoted(field.name)}, null)")
    if kind != field.dataType:
        column = column.cast(kind)
    return column.alias(field.name, metadata=field.metadata)


def relax_nullability(df: DataFrame) -> DataFrame:
    """The same rows with every top-level column nullable; types and field metadata stay.

    This rewrites the schema only. Where a source marks a column required and
    still stores nulls in it, relax at the read (``read_relaxed``).
    """
    return df.select(*[_nullable(f, f.dataType) for f in df.schema.fields])


def relax_nested(df: DataFrame) -> DataFrame:
    """``relax_nullability`` for what is inside the columns too, at any depth."""
    return df.select(*[_nullable(f, relaxed_type(f.dataType)) for f in df.schema.fields])


def read_relaxed(reader, schema: StructType, path: str) -> DataFrame:
    """Files read by ``reader`` (``spark.read`` with its format and options) as ``schema`` with nothing required.

    The reader then believes no column to be free of nulls, at any depth, so files that break their own schema can be read
    and copied.
    """
    return relax_nested(reader.schema(relaxed_type(schema)).load(path))
