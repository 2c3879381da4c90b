"""What copies have landed, kept so that a job that failed can be run again without repeating them."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableforge.operators.tables import UNKNOWN_LOCATION, table_location
from tableforge.workspace import folder_names

_ENTRY = (
    "target string, state string, manner string, rows bigint, fingerprint string, location string, landed_at timestamp"
)


class Landed(NamedTuple):
    """One copy that landed: from which state of its source, in which manner, and where."""

    target: str
    state: str
    manner: str
    rows: int
    fingerprint: str | None
    location: str


class Journal:
    """A table of landed copies in a folder that all runs of a job share.

    An entry is written after its copy is in place and never changed. Each is a folder of its own, so copies that land at
    the same time do not disturb each other, and a write that fails leaves no entry.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def entries(self) -> DataFrame:
        """All entries, of all runs."""
        try:
            names = folder_names(self.spark, self.folder)
        except Exception as error:
            if "FileNotFoundException" not in str(error) and "does not exist" not in str(error):
                raise
            names = []
        # Only an entry whose write was committed counts.
        if not any(n.startswith("entry=") for n in names):
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).parquet(f"{self.folder}/entry=*")

    def record(self, entry: Landed) -> None:
        row = self.spark.createDataFrame([tuple(entry)], _ENTRY.rpartition(",")[0])
        row.withColumn("landed_at", F.current_timestamp()).coalesce(1).write.parquet(
            f"{self.folder}/entry={uuid.uuid4().hex}"
        )

    def latest(self) -> dict[str, Landed]:
        """The newest entry of every target: as many as tables were ever copied."""
        newest = self.entries().groupBy("target").agg(
            F.max_by(F.struct(*Landed._fields), "landed_at").alias("e")
        )
        return {r.e.target: Landed(*r.e) for r in newest.collect()}

    def still_there(self, entry: Landed | None, state: str | None, manner: str) -> bool:
        """Whether a copy of this state of the source, made in this manner, is what the table shows now."""
        return (
            entry is not None
            and state is not None
            and (entry.state, entry.manner) == (state, manner)
            and entry.location != UNKNOWN_LOCATION
            and table_location(self.spark, entry.target) == entry.location
        )
