"""Streams into plain tables."""

from __future__ import annotations

import json
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import StreamingQueryProgress

from tableforge.operators.tables import literal, table_location
from tableforge.workspace import folder_names

# Fixed value: how often a running stream commits.
COMMIT_INTERVAL = "30 seconds"
_OWNER = "tableforge.stream"


def trigger_options(bounded: bool, interval: str = COMMIT_INTERVAL) -> dict:
    """A bounded run takes what is there and ends; otherwise a commit per interval."""
    return {"availableNow": True} if bounded else {"processingTime": interval}


def _names(spark: SparkSession, folder: str) -> list[str]:
    try:
        return folder_names(spark, folder)
    except Exception as error:
        if "FileNotFoundException" in str(error) or "does not exist" in str(error):
            return []
        raise


def _claim(spark: SparkSession, table: str, checkpoint: str, columns: str) -> None:
    """Make the table this checkpoint's, or raise if rows would be lost.

    A folder written by a stream lists its files in a log with the stream's batch numbers: a second
    stream's batches would count as written already, and files of a batch write are not listed.
    """
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"TBLPROPERTIES ('{_OWNER}' = {literal(checkpoint)})"
    )
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    files = _names(spark, table_location(spark, table))
    streamed = "_spark_metadata" in files
    if found.get(_OWNER) != checkpoint:
        if streamed or any(not f.startswith(("_", ".")) for f in files):
            raise ValueError(
                f"{table} holds rows of {found.get(_OWNER) or 'another writer'}: go on with that "
                "checkpoint, or insert into a keyed table, which any number of streams may feed"
            )
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_OWNER}' = {literal(checkpoint)})")
    elif streamed and "metadata" not in _names(spark, checkpoint):
        raise ValueError(f"{table} holds rows of a checkpoint that is no longer in {checkpoint}")


def stream_insert(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    bounded: bool = False,
    interval: str = COMMIT_INTERVAL,
) -> StreamingQuery:
    """Append a stream to a table, each row exactly once across restarts.

    The table is created if absent. Give a restart the same checkpoint folder, which
    must be one all machines share. A plain table belongs to one checkpoint: another one, or a table
    that a batch job has filled, is refused with a ``ValueError`` before anything is written.
    """
    checkpoint = checkpoint.rstrip("/")
    _claim(stream.sparkSession, table, checkpoint, stream.schema.toDDL())
    return (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_options(bounded, interval))
        .toTable(table)
    )


def _at_end(progress: StreamingQueryProgress, end: int) -> bool:
    """Whether a batch took the sequence beyond ``end``, by the source's own offsets."""
    for source in progress.sources:
        offset = json.loads(source.endOffset or "{}")
        if isinstance(offset, dict) and offset.get("next", end) > end:
            return True
    return False


class _EndOfSequence(StreamingQueryListener):
    """Sets an event when a query has committed an id, or has terminated."""

    def __init__(self, query: StreamingQuery, end: int) -> None:
        self.run, self.end = query.runId, end
        self.happened, self.reached = Event(), False

    def saw(self, progress: StreamingQueryProgress) -> None:
        if str(progress.runId) == self.run and _at_end(progress, self.end):
            self.reached = True
            self.happened.set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.saw(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.happened.set()


def await_sequence_end(query: StreamingQuery, end: int, timeout: float | None = None) -> bool:
    """Wait until a generated stream has committed id ``end``, then stop it.

    The wait is woken by the stream's progress events; nothing polls, and it does not matter how many
    batches the stream remembers. A stream that was restarted after its last id is done with its next batch. Returns
    False if the query ended or the time ran out before that; a failed query raises its error.
    """
    spark = SparkSession.active()
    listener = _EndOfSequence(query, end)
    spark.streams.addListener(listener)
    try:
        # What happened before the listener was there.
        for progress in query.recentProgress:
            listener.saw(progress)
        if query.isActive or listener.reached:
            listener.happened.wait(timeout)
        if not listener.reached:
            # The last events of a stream that ended may still be on their way.
            for progress in query.recentProgress:
                listener.saw(progress)
    finally:
        spark.streams.removeListener(listener)
    if listener.reached:
        query.stop()
        return True
    if not query.isActive and query.exception() is not None:
        raise query.exception()
    return False
