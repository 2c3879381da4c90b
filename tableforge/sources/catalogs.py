"""Source catalogs that hold one database per scale."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from tableforge.functions.columns import quoted
from tableforge.operators.contents import contents
from tableforge.operators.tables import UNKNOWN_LOCATION, show_tables, table_location
from tableforge.workspace import folder_names


class SourceCatalog(Protocol):
    """What ``materialize_catalog`` copies from."""

    def tables(self, scale: str) -> list[str]: ...

    def read(self, scale: str, table: str) -> DataFrame: ...

    def state(self, scale: str, table: str) -> str | None:
        """A text that changes when the table does, or None if that can't be told."""


def files_state(spark: SparkSession, path: str) -> str:
    """The names, sizes and times of the files below a path, as one fingerprint; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = contents(files.select("path", "length", "modificationTime"))
    return f"{found.rows} files {found.fingerprint}"


class ScaleCatalog:
    """Parquet tables ``<root>/sf<scale>/<table>.parquet``; ``prefix`` is what stands before a scale."""

    suffix = ".parquet"

    def __init__(self, spark: SparkSession, root: str, prefix: str = "sf") -> None:
        self.spark, self.root, self.prefix = spark, root.rstrip("/"), prefix

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> tuple[ScaleCatalog, str]:
        """The catalog and the scale that a folder ``<root>/sf<scale>`` belongs to.

        A folder of another name is a scale of that name.
        """
        root, _, name = folder.rstrip("/").rpartition("/")
        prefix = "sf" if name.startswith("sf") else ""
        return cls(spark, root, prefix), name.removeprefix(prefix)

    def folder(self, scale: str) -> str:
        return f"{self.root}/{self.prefix}{scale}"

    def tables(self, scale: str) -> list[str]:
        """Table names in order; one listing of the folder, not of the files in the tables."""
        names = folder_names(self.spark, self.folder(scale))
        return [n.removesuffix(self.suffix) for n in names if n.endswith(self.suffix)]

    def read(self, scale: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder(scale)}/{table}{self.suffix}")

    def state(self, scale: str, table: str) -> str:
        return files_state(self.spark, f"{self.folder(scale)}/{table}{self.suffix}")


class NamedCatalog:
    """Tables of ``<catalog>.sf<scale>``, a catalog configured in the session."""

    def __init__(self, spark: SparkSession, catalog: str) -> None:
        self.spark, self.catalog = spark, catalog

    def database(self, scale: str) -> str:
        return f"{quoted(self.catalog)}.{quoted(f'sf{scale}')}"

    def tables(self, scale: str) -> list[str]:
        return [r.table_name for r in show_tables(self.spark, self.database(scale)).collect()]

    def read(self, scale: str, table: str) -> DataFrame:
        return self.spark.table(f"{self.database(scale)}.{quoted(table)}")

    def state(self, scale: str, table: str) -> str | None:
        """That of the table's files, if the catalog says where they are."""
        location = table_location(self.spark, f"{self.database(scale)}.{quoted(table)}")
        return None if location == UNKNOWN_LOCATION else files_state(self.spark, location)
