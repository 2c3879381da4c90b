"""Keyed tables fed by streams: one current row per key.

A keyed table is two catalog tables. ``<name>_log`` has one partition per stream and
micro-batch and ``<name>`` is the last published snapshot, bucketed by key. The current rows are
the latest per key over the snapshot and the batches that are not in it yet.

Streams number their batches each for itself, so a batch is known by its stream, which is the
query's id and lives with its checkpoint, and its number. Any number of streams may feed a table.

A micro-batch is written to a folder of its own and then added to the catalog as a
partition, so readers see all of it or none. A batch replayed after a crash points its
partition at the new folder and leaves no row of the first try behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tableforge.functions.columns import named, quoted
from tableforge.operators.latest import latest_by_key
from tableforge.operators.tables import drop_table, literal
from tableforge.streaming.inserts import COMMIT_INTERVAL, trigger_options
from tableforge.workspace import delete_folder, folder_names

_STREAM, _BATCH = "_stream", "_batch_id"
_DECLARATION = "tableforge.keyed"
_STATE = "tableforge.snapshot."
_EMPTY = "empty"
_NO_STREAM = "main"


def _running_stream(spark: SparkSession) -> str:
    """The id of the streaming query this thread works for."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or _NO_STREAM


def _upto(batches: Mapping[str, int]) -> Column:
    """The rows of each stream's batches up to a number."""
    known = [(F.col(_STREAM) == s) & (F.col(_BATCH) <= n) for s, n in sorted(batches.items())]
    return reduce(or_, known, F.lit(False))


def _unique_per_key(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch itself, failing at run time if a key occurs twice in it."""
    key_text = F.concat_ws(", ", *[k.cast("string") for k in named(*keys)])
    message = F.concat(F.lit("key occurs twice in a batch, and there is no order_by: "), key_text)
    counted = batch.groupBy(*named(*keys)).agg(
        F.any_value(F.struct(*named(*batch.columns))).alias("_row"), F.count("*").alias("_rows")
    )
    checked = F.when(F.col("_rows") > 1, F.raise_error(message)).otherwise(F.col("_row"))
    return counted.select(checked.alias("_row")).select("_row.*")


@dataclass(frozen=True)
class KeyedTable:
    """A table with a primary key, bucketed by it; declare with ``create_if_absent``.

    With ``order_by`` the row with the highest values wins, whenever it arrives and from whichever
    stream. Without, the last batch wins, a batch may hold a key once only, and there
    can be one stream only, since the batches of two have no order: another one is refused.
    """

    spark: SparkSession
    name: str
    path: str
    keys: tuple[str, ...]
    order_by: tuple[str, ...]
    buckets: int

    @classmethod
    def create_if_absent(
        cls,
        spark: SparkSession,
        name: str,
        schema: StructType,
        keys: Sequence[str],
        path: str,
        order_by: Sequence[str] = (),
        *,
        buckets: int,
    ) -> KeyedTable:
        """Declare the table, or open the one that is there.

        ``path`` is a folder that all machines share. ``buckets`` is how many tasks group or join
        the snapshot on its key without a shuffle, and the merge of later batches is one of these
        joins: take about as many as the cluster's shuffle partitions.
        """
        missing = sorted({*keys, *order_by} - set(schema.fieldNames()))
        if missing or not keys:
            raise ValueError(f"keys and order_by must name columns; unknown: {missing}")
        declared = {
            "path": path.rstrip("/"),
            "keys": list(keys),
            "order_by": list(order_by),
            "buckets": buckets,
        }
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({schema.toDDL()}) USING parquet "
            f"CLUSTERED BY ({', '.join(quoted(k) for k in keys)}) INTO {buckets} BUCKETS "
            f"LOCATION {literal(declared['path'] + '/snapshot/' + _EMPTY)} "
            f"TBLPROPERTIES ('{_DECLARATION}' = {literal(json.dumps(declared))})"
        )
        table = cls.open(spark, name)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table.log} "
            f"({schema.toDDL()}, {_STREAM} string, {_BATCH} bigint) USING parquet "
            f"PARTITIONED BY ({_STREAM}, {_BATCH}) LOCATION {literal(table.path + '/log')}"
        )
        return table

    @classmethod
    def open(cls, spark: SparkSession, name: str) -> KeyedTable:
        """Open a declared table by name."""
        value = spark.sql(f"SHOW TBLPROPERTIES {name} ('{_DECLARATION}')").first()["value"]
        d = json.loads(value)
        return cls(spark, name, d["path"], tuple(d["keys"]), tuple(d["order_by"]), d["buckets"])

    @property
    def log(self) -> str:
        return f"{self.name}_log"

    def _folder(self) -> str:
        described = self.spark.sql(f"DESCRIBE FORMATTED {self.name}")
        place = described.filter("col_name = 'Location' AND data_type LIKE '%/snapshot/%'").first()
        return place["data_type"].strip()

    def _state(self, folder: str) -> dict[str, int]:
        """The last batch of each stream in a snapshot."""
        key = _STATE + folder.rpartition("/")[2]
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").collect()
        return json.loads({r["key"]: r["value"] for r in rows}.get(key, "{}"))

    def _published(self) -> dict[str, int]:
        return self._state(self._folder())

    def _snapshot(self) -> tuple[DataFrame, dict[str, int]]:
        """The published rows and the batches in them."""
        while True:
            folder = self._folder()
            self.spark.catalog.refreshTable(self.name)
            rows = self.spark.table(self.name)
            # Rows and state belong together unless a publish came in between.
            if self._folder() == folder:
                return rows, self._state(folder)

    def write_batch(self, batch: DataFrame, batch_id: int, stream: str | None = None) -> None:
        """Add one micro-batch of a stream, or replace it if it was added before.

        The stream is the running query unless named. With ``order_by`` the rows go to the log as
        they come, without a shuffle; versions of a key are told apart when the log is read or
        published.
        """
        spark = batch.sparkSession
        stream = stream or _running_stream(spark)
        if not self.order_by:
            others = sorted({*self._published(), *self._last_batches()} - {stream})
            if others:
                raise ValueError(f"{self.name} has no order_by and is fed by stream {others[0]} already")
        columns = [c for c in spark.table(self.log).columns if c not in (_STREAM, _BATCH)]
        checked = [
            F.coalesce(column, F.raise_error(F.lit(f"null in key column {c}"))).alias(c)
            if c in self.keys
            else column
            for c, column in zip(columns, named(*columns))
        ]
        rows = batch.select(*checked)
        if not self.order_by:
            rows = _unique_per_key(rows, self.keys)
        folder = f"{self.path}/log/{_STREAM}={stream}/{_BATCH}={batch_id}/try-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        place = literal(folder)
        partition = f"PARTITION ({_STREAM} = {literal(stream)}, {_BATCH} = {batch_id})"
        spark.sql(f"ALTER TABLE {self.log} ADD IF NOT EXISTS {partition} LOCATION {place}")
        spark.sql(f"ALTER TABLE {self.log} {partition} SET LOCATION {place}")

    def current(self) -> DataFrame:
        """One row per key as of now; call it again to see later batches."""
        return self._merged(F.lit(True))

    def _merged(self, batches: Column) -> DataFrame:
        """The snapshot with the given later batches applied.

        Only the batches are aggregated. The snapshot holds a key once and joins them by
        its buckets, so with enough buckets for the cluster it is not shuffled at all.
        """
        snapshot, state = self._snapshot()
        later = self.spark.table(self.log).filter(~_upto(state) & batches)
        later = latest_by_key(later, self.keys, [*self.order_by, _BATCH, _STREAM]).drop(_BATCH, _STREAM)
        if not state:
            return later

        def old(name: str) -> Column:
            return F.col(f"old.{quoted(name)}")

        def new(name: str) -> Column:
            return F.col(f"new.{quoted(name)}")

        same_key = reduce(and_, [old(k) == new(k) for k in self.keys])
        keep_old = new(self.keys[0]).isNull()
        if self.order_by:
            ahead = F.struct(*map(old, self.order_by)) > F.struct(*map(new, self.order_by))
            keep_old = keep_old | (old(self.keys[0]).isNotNull() & ahead)
        columns = [F.when(keep_old, old(c)).otherwise(new(c)).alias(c) for c in snapshot.columns]
        joined = snapshot.alias("old").join(later.alias("new"), same_key, "full_outer")
        return joined.select(*columns)

    def _batches(self) -> DataFrame:
        """Stream and number of every batch in the log."""
        part = F.split(F.col("partition"), "/")
        value = lambda i: F.split_part(part[i], F.lit("="), F.lit(2))
        return self.spark.sql(f"SHOW PARTITIONS {self.log}").select(
            value(0).alias(_STREAM), value(1).cast("bigint").alias(_BATCH)
        )

    def _last_batches(self) -> dict[str, int]:
        rows = self._batches().groupBy(_STREAM).agg(F.max(_BATCH).alias("last")).collect()
        return {r[_STREAM]: r["last"] for r in rows}

    def _merging_session(self) -> SparkSession:
        """A session whose shuffles deal keys out as the buckets do.

        Its partitions are a multiple of the buckets and stay apart, so a task of the merge holds
        rows of one bucket and writes one file; a snapshot with at least as many buckets as
        the session has shuffle partitions is not shuffled.
        """
        session = self.spark.newSession()
        for key, value in self.spark.conf.getAll.items():
            if session.conf.isModifiable(key):
                session.conf.set(key, value)
        now = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        session.conf.set("spark.sql.shuffle.partitions", -(-now // self.buckets) * self.buckets)
        session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        return session

    def publish(self) -> int:
        """Fold the log into a new snapshot, which readers of the table see from then on.

        Returns the highest batch number in it. Reading the current rows costs as much as the
        batches since the last publish, so a running stream needs one now and then. Batches that
        the snapshot before this one held are taken out of the log, so its list of batches
        stays short; a frame that ``current`` made two publishes ago can no longer be read.
        """
        state = self._published()
        merged = {s: max(n, state.get(s, -1)) for s, n in self._last_batches().items()}
        if all(n <= state.get(s, -1) for s, n in merged.items()):
            return max(state.values(), default=-1)
        merged = {**state, **merged}
        number = uuid.uuid4().hex
        folder = f"{self.path}/snapshot/{number}"
        stage = f"{self.name}_stage_{number[:8]}"
        rows = replace(self, spark=self._merging_session())._merged(_upto(merged))
        bucketed = rows.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        bucketed.option("path", folder).saveAsTable(stage)
        if self._published() == state:  # else another publish was faster
            declared = f"'{_STATE}{number}' = {literal(json.dumps(merged))}"
            self.spark.sql(f"ALTER TABLE {self.name} SET TBLPROPERTIES ({declared})")
            self.spark.sql(f"ALTER TABLE {self.name} SET LOCATION {literal(folder)}")
            self._drop_batches(state)
        drop_table(self.spark, stage)
        return max(merged.values())

    def _drop_batches(self, state: Mapping[str, int]) -> int:
        """Take batches out of the log's list; their files stay until ``vacuum``."""
        merged = self._batches().filter(_upto(state)).collect()
        for first in range(0, len(merged), 500):
            parts = ", ".join(
                f"PARTITION ({_STREAM} = {literal(s)}, {_BATCH} = {n})" for s, n in merged[first : first + 500]
            )
            self.spark.sql(f"ALTER TABLE {self.log} DROP IF EXISTS {parts}")
        return len(merged)

    def trim_log(self) -> int:
        """Take the batches that the snapshot holds out of the log; returns how many.

        Call it once no frame that ``current`` made before the last publish is in use. The
        files stay until ``vacuum``.
        """
        return self._drop_batches(self._published())

    def vacuum(self) -> int:
        """Delete older snapshots and the merged batches; returns how many folders.

        Call it while nobody publishes and no older state is still being read.
        """
        self.trim_log()
        folder = self._folder()
        state, live = self._state(folder), folder.rpartition("/")[2]
        if not state:
            return 0
        snapshots = [n for n in folder_names(self.spark, f"{self.path}/snapshot") if n not in (live, _EMPTY)]
        old = [f"snapshot/{n}" for n in snapshots]
        for stream, upto in state.items():
            home = f"log/{_STREAM}={stream}"
            if f"{_STREAM}={stream}" not in folder_names(self.spark, f"{self.path}/log"):
                continue
            for name in folder_names(self.spark, f"{self.path}/{home}"):
                prefix, _, number = name.partition("=")
                if prefix == _BATCH and int(number) <= upto:
                    old.append(f"{home}/{name}")
        for name in old:
            delete_folder(self.spark, f"{self.path}/{name}")
        for number in snapshots:
            self.spark.sql(f"ALTER TABLE {self.name} UNSET TBLPROPERTIES IF EXISTS ('{_STATE}{number}')")
        return len(old)


def stream_upsert(
    stream: DataFrame,
    table: KeyedTable,
    checkpoint: str,
    bounded: bool = False,
    interval: str = COMMIT_INTERVAL,
    publish_every: int | None = None,
) -> StreamingQuery:
    """Keep a keyed table up to date from a stream; a batch counts once however often it runs.

    A restart with the same checkpoint goes on where the last run ended. One with a new
    checkpoint is another stream, whose rows are added to those that are there.

    ``publish_every=n`` publishes a snapshot after every n-th batch.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.write_batch(batch, batch_id)
        if publish_every and (batch_id + 1) % publish_every == 0:
            table.publish()

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**trigger_options(bounded, interval))
        .foreachBatch(apply)
        .start()
    )
