"""Databases, tables and files: create, replace, register, look up.

A table is replaced by writing a fresh folder, counting what landed there, and only then
pointing the table at it. A failed or repeated attempt leaves the old table as it was,
and a query may read the table it replaces. Superseded folders stay until ``vacuum``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tableforge.functions.columns import quoted
from tableforge.operators.contents import CONTENT, ROWS, Contents, Written
from tableforge.workspace import delete_folder, file_sizes, folder_names, join_files, replace_folder

UNKNOWN_LOCATION = "<unknown>"
# Fixed value: the folder name of a partition whose value is null.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_PER_STATEMENT = 500
LOCATION_PATTERN = "^[A-Za-z][A-Za-z0-9+.-]*:/"

# Words survive a round trip only if quotes are doubled and blanks are kept.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
# Text formats would cut timestamps to milliseconds, and CSV values at a line break.
_TIMESTAMPS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
FORMAT_OPTIONS: dict[str, dict[str, str]] = {
    "csv": {**CSV_OPTIONS, **_TIMESTAMPS, "multiLine": "true"},
    "json": _TIMESTAMPS,
}


def _options(fmt: str, columns: int, given: Mapping[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """The options to write a format with, and those to read it back.

    In CSV a null is written as nothing and an empty text as "". The reader tells them apart only if
    its mark for null is not the empty text, so it gets a new random one that no text holds.
    A row that is nothing at all would not count as a row: one column has its nulls marked.
    """
    common = {**FORMAT_OPTIONS.get(fmt, {}), **given}
    if fmt != "csv" or "nullValue" in given:
        return common, common
    mark = {"nullValue": uuid.uuid4().hex}
    return {**common, **(mark if columns == 1 else {})}, {**common, **mark}


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _parts(name: str) -> list[str]:
    return re.findall(r"`(?:[^`]|``)+`|[^.`]+", name)


def database_of(table: str) -> str:
    """The database part of a ``database.table`` or ``catalog.database.table`` name."""
    parts = _parts(table)
    if len(parts) < 2:
        raise ValueError(f"expected a database.table name, got {table!r}")
    return ".".join(parts[:-1])


def in_session_catalog(table: str) -> bool:
    """Whether a 2- or 3-part name lives in the built-in catalog."""
    database = _parts(database_of(table))
    return len(database) == 1 or database[0].strip("`") == "spark_catalog"


def ensure_database(spark: SparkSession, database: str, location: str | None = None) -> str:
    """Create a database, plain or catalog-qualified, if it is absent; returns its name."""
    where = f" LOCATION {literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")
    return database


def drop_table(spark: SparkSession, table: str) -> None:
    """Drop a table if it exists."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def _database_location(spark: SparkSession, database: str) -> str:
    described = spark.sql(f"DESCRIBE DATABASE {database}").filter("info_name = 'Location'")
    return described.first()["info_value"].rstrip("/")


def fresh_table_folder(spark: SparkSession, table: str) -> str:
    """An unused folder for one attempt at writing ``table``, in its database's location.

    It lies beside the folder of a managed table of that name, which dropping would delete.
    """
    name = _parts(table)[-1].strip("`")
    return f"{_database_location(spark, database_of(table))}/{name}-{uuid.uuid4().hex}"


def _provider(spark: SparkSession, table: str) -> str:
    row = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Provider'").first()
    return row["data_type"].strip().lower() if row else ""


def _can_move(spark: SparkSession, table: str, fmt: str, schema: StructType) -> bool:
    """Whether the table would show plain files of this format and schema just as they are."""
    if fmt not in ("parquet", "orc") or _provider(spark, table) != fmt:
        return False
    columns = spark.catalog.listColumns(table)
    if any(c.isPartition or c.isBucket for c in columns):
        return False

    def shape(columns: StructType) -> list[tuple[str, str]]:
        # Files give every field back as nullable, so nullability is left out.
        return [(f.name, f.dataType.simpleString()) for f in columns]

    return shape(spark.table(table).schema) == shape(schema)


def point_table(
    spark: SparkSession,
    table: str,
    folder: str,
    fmt: str,
    schema: StructType,
    options: Mapping[str, str],
) -> None:
    """Make ``table`` show the files of ``folder``.

    With the same columns, format and layout that is one catalog update. Otherwise the
    table is dropped and created again, and its name is absent for a moment.
    """
    if spark.catalog.tableExists(table):
        if _can_move(spark, table, fmt, schema):
            spark.sql(f"ALTER TABLE {table} SET LOCATION {literal(folder)}")
            spark.catalog.refreshTable(table)
            return
        drop_table(spark, table)
    spark.catalog.createTable(table, path=folder, source=fmt, schema=schema, **options)


def save_table(
    df: DataFrame,
    table: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> int:
    """Write ``df`` as ``database.table``, replacing it if it exists; returns the rows that landed.

    Rows are counted on their way out and again in the written files. Should the two
    differ, the table is left as it was.
    """
    return save_checked(df, table, fmt, options, ROWS).rows


def save_checked(
    df: DataFrame,
    table: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    check: str = CONTENT,
) -> Contents:
    """``save_table`` with a comparison of every cell; returns rows and fingerprint of what landed.

    The fingerprint is taken while the rows are written and again from the written files, which
    reads them once more. Should the two differ, the table is left as it was.
    """
    if not in_session_catalog(table):
        raise ValueError(f"{table} is in a catalog of its own: use create_strict")
    spark, fmt = df.sparkSession, fmt.lower()
    folder, reading, landed = _write_folder(df, table, fmt, options or {}, check)
    point_table(spark, table, folder, fmt, df.schema, reading)
    return landed


def _write_folder(
    df: DataFrame, table: str, fmt: str, options: Mapping[str, str], check: str = ROWS
) -> tuple[str, dict[str, str], Contents]:
    """Write a fresh folder for a table and check what landed: folder, reading options, contents."""
    spark = df.sparkSession
    writing, reading = _options(fmt, len(df.columns), options)
    folder = fresh_table_folder(spark, table)
    written = Written(df, check)
    written.df.write.format(fmt).options(**writing).save(folder)
    landed = spark.read.format(fmt).schema(df.schema).options(**reading).load(folder)
    return folder, reading, written.matched(landed, table)


def vacuum(spark: SparkSession, table: str) -> int:
    """Delete the folders that earlier ``save_table`` calls for a table left behind.

    Returns how many. Call it while nobody writes the table or still reads an older state.
    """
    home = _database_location(spark, database_of(table))
    live = table_location(spark, table)
    if live == UNKNOWN_LOCATION:
        raise ValueError(f"{table} has no known location")
    attempt = re.compile(re.escape(_parts(table)[-1].strip("`")) + "-[0-9a-f]{32}")
    old = [
        name
        for name in folder_names(spark, home)
        if attempt.fullmatch(name) and not live.endswith(f"/{name}")
    ]
    for name in old:
        delete_folder(spark, f"{home}/{name}")
    return len(old)


def ctas(spark: SparkSession, table: str, query: str, fmt: str = "parquet") -> int:
    """``CREATE TABLE table USING fmt AS query``, replacing the table once the query succeeded."""
    return save_table(spark.sql(query), table, fmt)


def create_strict(df: DataFrame, table: str, fmt: str = "parquet", drop_first: bool = False) -> int:
    """Create a table that must not exist yet, in any catalog; returns the rows that landed.

    See ``create_checked``; here rows are counted only.
    """
    return create_checked(df, table, fmt, drop_first, ROWS).rows


def create_checked(
    df: DataFrame, table: str, fmt: str = "parquet", drop_first: bool = False, check: str = CONTENT
) -> Contents:
    """Create a table that must not exist yet, in any catalog; returns what landed.

    ``drop_first`` replaces one that exists. Rows are checked on their way out and again in the
    table; a difference raises. In the built-in catalog the files are written and counted
    first, with the same options as in ``save_table``, so a failure leaves an old table as it
    was. Another catalog replaces its table in one commit if it can; one that cannot has the
    old table dropped before the new one is written, and a failure then leaves none.
    """
    spark, fmt = df.sparkSession, fmt.lower()
    if in_session_catalog(table):
        exists = spark.catalog.tableExists(table)
        if exists and not drop_first:
            # Fails with the catalog's own error, before anything is written.
            spark.catalog.createTable(table, source=fmt, schema=df.schema)
        folder, reading, landed = _write_folder(df, table, fmt, {}, check)
        if drop_first:
            point_table(spark, table, folder, fmt, df.schema, reading)
        else:
            spark.catalog.createTable(table, path=folder, source=fmt, schema=df.schema, **reading)
        return landed
    written = Written(df, check)
    writer = written.df.writeTo(table).using(fmt)
    if not drop_first:
        writer.create()
    else:
        try:
            writer.createOrReplace()
        except AnalysisException as error:
            if "UNSUPPORTED" not in (error.getCondition() or ""):
                raise
            drop_table(spark, table)
            writer.create()
    return written.matched(spark.table(table), table)


def register_external(
    spark: SparkSession,
    table: str,
    folder: str,
    schema: StructType,
    fmt: str = "parquet",
    partitioned_by: Sequence[str] = (),
) -> None:
    """Register files written elsewhere as a table, with the partitions found in the folder."""
    database_of(table)
    partitions = ""
    if partitioned_by:
        partitions = f"PARTITIONED BY ({', '.join(quoted(c) for c in partitioned_by)})"
    spark.sql(
        f"CREATE TABLE {table} ({schema.toDDL()}) USING {fmt} {partitions} LOCATION {literal(folder)}"
    )
    if partitioned_by:
        add_new_partitions(spark, table)


def add_new_partitions(spark: SparkSession, table: str) -> int:
    """Register the partitions whose folders a table does not know yet; returns their number.

    The folder is listed by Spark's own parallel listing, no file is opened, and the partitions found are joined with
    those that the table has: only new ones reach the driver and the catalog, some hundreds per statement.
    ``table`` must have its database in its name. Partitions without a folder are left as they are.
    """
    database_of(table)
    columns = [c for c in spark.catalog.listColumns(table) if c.isPartition]
    if not columns:
        raise ValueError(f"{table} has no partition columns")
    # The details follow the columns, one of which may have the same name.
    described = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Provider'").collect()[-1]
    # A session of its own, so that the caller's settings stay as they are: partitions come from the listing alone.
    own = spark.newSession()
    own.conf.set("spark.sql.optimizer.metadataOnly", "true")
    files = own.read.schema(spark.table(table).schema).format(described["data_type"]).load(table_location(spark, table))
    names = [c.name for c in columns]
    found = files.select(*(F.col(quoted(n)) for n in names)).distinct()
    parts = F.split("partition", "/")

    def value(i: int) -> Column:
        escaped = F.substring_index(F.get(parts, F.lit(i)), "=", -1)
        plain = F.url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B")))
        return F.when(escaped != _NO_VALUE, plain).cast(columns[i].dataType)

    known = own.sql(f"SHOW PARTITIONS {table}").select(
        F.lit(True).alias("is known"), *(value(i).alias(f"known {i}") for i in range(len(names)))
    )
    same = reduce(and_, (F.col(quoted(n)).eqNullSafe(F.col(f"`known {i}`")) for i, n in enumerate(names)))
    # An anti-join would be pushed below the distinct, and the files be read for it.
    missing = found.join(known, same, "left").filter(F.col("`is known`").isNull())
    new = missing.select(*(F.col(quoted(n)).cast("string") for n in names)).collect()
    for at in range(0, len(new), _PER_STATEMENT):
        specs = (
            ", ".join(f"{quoted(n)} = {'null' if v is None else literal(v)}" for n, v in zip(names, row, strict=True))
            for row in new[at : at + _PER_STATEMENT]
        )
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {' '.join(f'PARTITION ({s})' for s in specs)}")
    return len(new)


def show_tables(spark: SparkSession, database: str) -> DataFrame:
    """``table_name`` of every table in a database; session views are left out."""
    tables = spark.sql(f"SHOW TABLES IN {database}").filter("not isTemporary")
    return tables.select(F.col("tableName").alias("table_name"))


def table_location(spark: SparkSession, table: str) -> str:
    """Where a table's files are, or ``<unknown>``."""
    try:
        described = spark.sql(f"DESCRIBE FORMATTED {table}")
    except AnalysisException:
        return UNKNOWN_LOCATION
    # The details of a table follow its columns, one of which may be called location too; a
    # type does not look like a path.
    found = described.filter(
        (F.lower("col_name") == "location") & F.trim("data_type").rlike(LOCATION_PATTERN)
    ).select(F.trim("data_type").alias("location")).first()
    return found.location if found else UNKNOWN_LOCATION


def write_csv(
    df: DataFrame, path: str, order_by: Sequence[Column] = (), single_file: bool = False
) -> None:
    """Overwrite a CSV folder with a header, in the given order.

    All tasks write files that follow each other in that order. ``single_file`` joins them into one file with
    one header: the tasks still sort and write their own ranges, and the files are put together
    afterwards, without reading rows. The old folder stays until the new file is whole.
    """
    out = df.orderBy(*order_by) if order_by else df
    if not single_file:
        out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
        return
    spark, path = df.sparkSession, path.rstrip("/")
    work = f"{path}.{uuid.uuid4().hex}"
    try:
        out.write.options(**{**CSV_OPTIONS, "header": "false"}).csv(f"{work}/parts")
        # A frame without rows is a file with the header alone.
        spark.createDataFrame([], df.schema).repartition(1).write.options(**CSV_OPTIONS).csv(f"{work}/header")
        parts = [
            f"{work}/{kind}/{name}"
            for kind in ("header", "parts")
            for name, size in sorted(file_sizes(spark, f"{work}/{kind}"), key=lambda f: _part_number(f[0]))
            if size and name.startswith("part-")
        ]
        join_files(spark, parts, f"{work}/part-00000.csv")
        delete_folder(spark, f"{work}/parts")
        delete_folder(spark, f"{work}/header")
        replace_folder(spark, work, path)
    except BaseException:
        delete_folder(spark, work)
        raise


def _part_number(name: str) -> tuple[int, ...]:
    """The numbers of the task and of its file, by which files follow each other."""
    found = re.match(r"part-(\d+)-.*?(?:-c(\d+))?(?:\.|$)", name)
    return tuple(int(n or 0) for n in found.groups()) if found else (-1,)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Read what ``write_csv`` wrote."""
    return spark.read.options(**CSV_OPTIONS, nullValue=uuid.uuid4().hex).schema(schema).csv(path)
