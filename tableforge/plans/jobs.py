"""Jobs over many tables or formats, each part kept apart from the others' failures."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from threading import Event, Lock, Thread
from typing import NamedTuple
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tableforge.functions.columns import quoted
from tableforge.functions.nullability import relax_nested
from tableforge.operators.contents import CONTENT, Written
from tableforge.operators.tables import (
    create_checked,
    create_strict,
    database_of,
    ensure_database,
    read_csv,
    save_checked,
    save_table,
    table_location,
    write_csv,
)
from tableforge.operators.words import by_frequency, top_words, word_count
from tableforge.plans.journal import Journal, Landed
from tableforge.sources.catalogs import SourceCatalog
from tableforge.sources.generated import ROWS_PER_SECOND, SEQUENCE_END, datagen_stream
from tableforge.streaming.inserts import COMMIT_INTERVAL
from tableforge.streaming.keyed import KeyedTable, stream_upsert

OK, FAIL, SKIP = "OK", "FAIL", "SKIP"
FAILED_ROWS = -1
# Seconds between two looks for jobs that a unit started after its deadline.
_CANCEL_AGAIN = 0.2
_RESULT = (
    "position int, {unit} string, rows bigint, status string, error string, location string, fingerprint string"
)


class MaterializeError(RuntimeError):
    """At least one unit failed; ``results`` tells which and why."""

    def __init__(self, results: DataFrame, failed: Sequence[str]) -> None:
        super().__init__(f"failed: {', '.join(failed)}")
        self.results = results


class Outcome(NamedTuple):
    rows: int
    status: str
    error: str | None = None
    location: str | None = None
    fingerprint: str | None = None


class Selection(NamedTuple):
    tables: list[str]
    missing: list[str]


def requested(request: str) -> list[str]:
    """The names in a comma list, in order and with repeats; empty ones don't count."""
    return re.findall(r"[^\s,](?:[^,]*[^\s,])?", request)


def resolved(spark: SparkSession, request: str, available: Sequence[str]) -> DataFrame:
    """``position, table_name, found``: a row for every name that a request means, in request order.

    ``all`` in any case, alone, means every available table. Blanks around names and empty names don't count.
    """
    asked = spark.createDataFrame([(request, list(available))], "request string, available array<string>")
    trimmed = F.transform(F.split("request", ","), lambda n: F.regexp_replace(n, r"^\s+|\s+$", ""))
    names = F.filter(trimmed, lambda n: n != "")
    everything = (F.size(names) == 1) & (F.lower(F.get(names, F.lit(0))) == "all")
    meant = F.when(everything, F.col("available")).otherwise(names)
    return asked.select("available", F.posexplode(meant).alias("position", "table_name")).select(
        "position", "table_name", F.array_contains("available", F.col("table_name")).alias("found")
    )


def select_tables(request: str, available: Sequence[str]) -> Selection:
    """The requested tables in request order, and the requested names that do not exist."""
    rows = resolved(SparkSession.active(), request, available).orderBy("position").collect()
    return Selection([r.table_name for r in rows if r.found], [r.table_name for r in rows if not r.found])


@contextmanager
def _deadline(spark: SparkSession, unit: str, seconds: float | None) -> Iterator[Event]:
    """Runs Spark jobs of this thread under a tag of their own, and cancels those once time is up.

    The event tells whether it was. Jobs started after that are cancelled too, so that no task is left.
    With fair scheduling every unit has its own pool.
    """
    context, over, done = spark.sparkContext, Event(), Event()
    tag = f"tableforge-{uuid4().hex}"
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    context.setLocalProperty("spark.scheduler.pool", unit)

    def watch() -> None:
        if not done.wait(seconds):
            over.set()
            while not done.wait(_CANCEL_AGAIN):
                context.cancelJobsWithTag(tag)

    watcher = Thread(target=watch, daemon=True) if seconds is not None else None
    if watcher:
        watcher.start()
    try:
        yield over
    finally:
        done.set()
        if watcher:
            watcher.join()
        context.setLocalProperty("spark.scheduler.pool", None)
        context.setInterruptOnCancel(False)
        context.removeJobTag(tag)


def _guarded(
    spark: SparkSession, work: Callable[[str], Outcome], units: Sequence[str], seconds: float | None
) -> Callable[[str], Outcome]:
    # A unit asked for twice runs twice, one after the other: both write the same table.
    turns = {unit: Lock() for unit in units}

    def run(unit: str) -> Outcome:
        with turns[unit], _deadline(spark, unit, seconds) as over:
            try:
                return work(unit)
            except Exception as error:  # one unit's failure must not stop the others
                reason = f"not done after {seconds} s" if over.is_set() else str(error)
                return Outcome(FAILED_ROWS, FAIL, reason)

    return run


def _run_units(
    spark: SparkSession,
    label: str,
    units: Sequence[str],
    work: Callable[[str], Outcome],
    parallel: int,
    raise_on_failure: bool,
    skipped: Sequence[tuple[str, str]] = (),
    deadline: float | None = None,
) -> DataFrame:
    # Spark schedules the jobs; the threads only keep several of them submitted.
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        run = inheritable_thread_target(spark)(_guarded(spark, work, units, deadline))
        outcomes = list(zip(units, pool.map(run, units)))
    outcomes += [(unit, Outcome(0, SKIP, reason)) for unit, reason in skipped]
    rows = [(i, unit, *outcome) for i, (unit, outcome) in enumerate(outcomes)]
    results = spark.createDataFrame(rows, _RESULT.format(unit=label))
    failed = [unit for unit, outcome in outcomes if outcome.status == FAIL]
    if failed and raise_on_failure:
        raise MaterializeError(results, failed)
    return results


def materialize_catalog(
    spark: SparkSession,
    source: SourceCatalog,
    scale: str = "1",
    database: str | None = None,
    tables: str = "all",
    fmt: str = "parquet",
    strict: bool = False,
    parallel: int = 8,
    raise_on_failure: bool = False,
    check: str = CONTENT,
    journal: str | None = None,
    deadline: float | None = None,
) -> DataFrame:
    """Copy tables of one scale into real tables and check what landed in each.

    The result has one row per requested table, in request order: ``position,
    table_name, rows, status, error, location, fingerprint``. A failed table has ``rows = -1`` and
    the message; a requested name the source lacks is a ``SKIP`` row and no failure.
    ``strict`` makes every column nullable and creates the target anew, which is what catalogs
    with their own table format need. A failed copy leaves the old table as it was, in either
    mode; see ``create_strict`` for catalogs that cannot replace a table. Columns are made nullable
    after the read: a source that fails because a column it calls required holds nulls must
    be read with a schema that allows them.

    ``check`` says what of a copy is compared with what was written: every cell (``content``, or ``portable`` for a fingerprint
    that other engines can compute), or the number of ``rows`` alone, which reads no column of parquet or ORC again.

    ``journal`` is a folder in which landed copies are noted. A later run with the same folder copies only what did not land, or
    whose source changed, or whose table no longer shows that copy; its result is that of one clean run. A source that can't tell
    its state is copied again.

    A copy that takes longer than ``deadline`` seconds has its tasks cancelled and fails; the others go on.
    """
    scale = scale.strip()
    database = database or quoted("tables_sf" + scale.replace(".", "_"))
    chosen = select_tables(tables, source.tables(scale))
    ensure_database(spark, database)

    notes = Journal(spark, journal) if journal else None
    known = notes.latest() if notes else {}
    manner = f"{fmt} {'strict' if strict else 'plain'} {check}"

    def copy(table: str) -> Outcome:
        target = f"{database}.{quoted(table)}"
        # Taken before the read: a source that changes meanwhile is copied again next time.
        state = source.state(scale, table) if notes else None
        if notes and notes.still_there(known.get(target), state, manner):
            there = known[target]
            return Outcome(there.rows, OK, None, there.location, there.fingerprint)
        df = source.read(scale, table)
        if strict:
            landed = create_checked(relax_nested(df), target, fmt, drop_first=True, check=check)
        else:
            landed = save_checked(df, target, fmt, check=check)
        location = table_location(spark, target)
        if notes and state is not None:
            entry = Landed(target, state, manner, *landed, location)
            known[target] = entry
            notes.record(entry)
        return Outcome(landed.rows, OK, None, location, landed.fingerprint)

    skipped = [(name, "not in the source catalog") for name in chosen.missing]
    return _run_units(
        spark, "table_name", chosen.tables, copy, parallel, raise_on_failure, skipped, deadline
    )


def totals(results: DataFrame) -> DataFrame:
    """One row ``ok, total, total_rows`` over the units that were tried."""
    tried = results.filter(F.col("status") != SKIP)
    landed = F.sum(F.when(F.col("status") == OK, F.col("rows")))
    return tried.agg(
        F.count_if(F.col("status") == OK).alias("ok"),
        F.count("*").alias("total"),
        F.coalesce(landed, F.lit(0)).cast("bigint").alias("total_rows"),
    )


@dataclass(frozen=True)
class FormatTarget:
    """How one format is written.

    ``catalog`` is where its tables live, the built-in one if unset. ``strict`` drops and
    creates the table. ``own_log`` leaves the replacing to the format, whose commit log does
    it; a plain file format gets a fresh folder instead.
    """

    catalog: str | None = None
    strict: bool = False
    own_log: bool = False
    options: dict[str, str] = field(default_factory=dict)


def format_targets(key: str = "id", ordering: str = "score") -> dict[str, FormatTarget]:
    """The known formats. The four lake formats need their jars and catalogs in the session."""
    # The option names of the keyed format, and the catalogs' usual names.
    keyed = {
        "hoodie.table.name": "t_hudi",
        "hoodie.datasource.write.recordkey.field": key,
        "hoodie.datasource.write.precombine.field": ordering,
        "hoodie.datasource.write.table.type": "COPY_ON_WRITE",
    }
    return {
        "parquet": FormatTarget(),
        "orc": FormatTarget(),
        "csv": FormatTarget(),
        "json": FormatTarget(),
        "iceberg": FormatTarget(catalog="ice", strict=True),
        "paimon": FormatTarget(catalog="paimon", strict=True),
        "delta": FormatTarget(own_log=True),
        "hudi": FormatTarget(own_log=True, options=keyed),
    }


def write_formats(
    df: DataFrame,
    database: str,
    formats: str = "iceberg,delta,hudi,paimon",
    targets: dict[str, FormatTarget] | None = None,
    parallel: int = 8,
    raise_on_failure: bool = False,
) -> DataFrame:
    """Write one frame as ``<database>.t_<format>`` in each requested format.

    The result has one row per request: ``position, format, rows, status, error,
    location``. An unknown format is a ``SKIP`` row and no failure; a format that cannot
    be written is a ``FAIL`` row with the reason, and the others are still written.
    """
    spark = df.sparkSession
    known = targets if targets is not None else format_targets()

    def write(fmt: str) -> Outcome:
        target = known.get(fmt)
        if target is None:
            return Outcome(0, SKIP, "unknown format")
        home = f"{target.catalog}.{database}" if target.catalog else database
        ensure_database(spark, home)
        table = f"{home}.{quoted(f't_{fmt}')}"
        if target.strict:
            rows = create_strict(df, table, fmt, drop_first=True)
        elif target.own_log:
            written = Written(df)
            written.df.write.format(fmt).options(**target.options).mode("overwrite").saveAsTable(table)
            rows = written.matched(spark.table(table), table).rows
        else:
            rows = save_table(df, table, fmt, target.options)
        return Outcome(rows, OK, None, table_location(spark, table))

    return _run_units(spark, "format", requested(formats.lower()), write, parallel, raise_on_failure)


def table_job(df: DataFrame, table: str, fmt: str = "parquet") -> DataFrame:
    """Write one table, creating its database, and report ``table_name, rows, location``."""
    spark = df.sparkSession
    ensure_database(spark, database_of(table))
    landed = save_table(df, table, fmt)
    row = (table, landed, table_location(spark, table))
    return spark.createDataFrame([row], "table_name string, rows bigint, location string")


def generated_stream_job(
    spark: SparkSession,
    table: str,
    path: str,
    checkpoint: str,
    rows_per_second: int = ROWS_PER_SECOND,
    end: int = SEQUENCE_END,
    buckets: int = 2,
    bounded: bool = False,
    interval: str = COMMIT_INTERVAL,
    publish_every: int | None = None,
) -> tuple[KeyedTable, StreamingQuery]:
    """Stream generated rows into a table keyed by ``id``; the newest ``order_time`` wins.

    Wait for the query with ``awaitTermination``, or with ``await_sequence_end`` to stop
    it after the last id. ``bounded`` runs one replayable micro-batch instead.
    """
    stream = datagen_stream(spark, rows_per_second, end=end, replayable=bounded)
    ensure_database(spark, database_of(table))
    keyed = KeyedTable.create_if_absent(
        spark, table, stream.schema, ["id"], path, ["order_time"], buckets=buckets
    )
    query = stream_upsert(stream, keyed, checkpoint, bounded, interval, publish_every)
    return keyed, query


@dataclass(frozen=True)
class WordCountReport:
    """What a word count job leaves: the whole result as written, its top words, its size."""

    path: str
    counts: DataFrame
    top: DataFrame
    distinct: DataFrame


def word_count_job(
    lines: DataFrame, path: str, column: str = "value", single_file: bool = False, k: int = 20
) -> WordCountReport:
    """Count the words of a column and write them, most frequent first, as CSV.

    The text is read once: the top words and the number of words come from the written
    result. Equal counts are ordered by word, which also cuts the many words that occur
    once into even ranges for the sort.
    """
    spark = lines.sparkSession
    write_csv(word_count(lines, column), path, by_frequency(), single_file)
    counts = read_csv(spark, path, "word string, count bigint")
    return WordCountReport(path, counts, top_words(counts, k), counts.agg(F.count("*").alias("n")))


__all__ = [
    "FAIL",
    "OK",
    "SKIP",
    "FormatTarget",
    "MaterializeError",
    "Selection",
    "WordCountReport",
    "format_targets",
    "generated_stream_job",
    "materialize_catalog",
    "resolved",
    "select_tables",
    "table_job",
    "totals",
    "word_count_job",
    "write_formats",
]
