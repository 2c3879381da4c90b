"""The registered queries: every operator, run over whole given tables.

Each takes a session and the folder of one scale's parquet tables. Whatever a query
writes goes to a fresh database or folder below the shared root and stays there, since
the result is read after the query has returned.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableforge.functions.columns import any_like, quoted, starts_with_any, to_money
from tableforge.functions.nullability import relax_nested, relax_nullability, relaxed_type
from tableforge.operators import tables as tb
from tableforge.operators import words as wd
from tableforge.operators.contents import CONTENT, PORTABLE
from tableforge.operators.latest import latest_by_key, write_keyed
from tableforge.plans import jobs
from tableforge.plans.journal import Journal
from tableforge.sources.catalogs import ScaleCatalog
from tableforge.sources.generated import datagen_columns, demo_columns
from tableforge.sources.generated import datagen_stream as datagen_rows
from tableforge.sources.lines import fetch_lines, lines_from_values, read_lines, spread
from tableforge.sources.urls import read_urls
from tableforge.streaming.inserts import stream_insert
from tableforge.streaming.keyed import KeyedTable, stream_upsert
from tableforge.workspace import fresh_folder

Query = Callable[[SparkSession, str], DataFrame]

REQUEST = " lineitem , nope, orders ,"
FORMATS = "parquet, ORC,json,csv,nope"
MEMORY_LINES = ("  leading blanks", "a\ttab", "", "two  blanks", "end ", "the end")
UPSERT_BATCHES = 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # As a pattern, the path may be a file as well as a folder of files.
    return (
        spark.readStream.schema(_table(spark, sf_dir, name).schema)
        .parquet(f"{sf_dir}/{name}.parque[t]")
    )


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select("text"))


def _database(spark: SparkSession, label: str) -> str:
    return tb.ensure_database(
        spark, f"{label}_{uuid.uuid4().hex[:12]}", fresh_folder(spark, label)
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.tokens(_texts(spark, sf_dir), "text")


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.word_count(_texts(spark, sf_dir), "text")


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.top_words(word_count(spark, sf_dir))


def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.distinct_words(_texts(spark, sf_dir), "text")


def word_count_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "word-count")
    return jobs.word_count_job(_texts(spark, sf_dir), path, "text").counts


def word_count_one_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "word-count-one")
    counts = jobs.word_count_job(_texts(spark, sf_dir), path, "text", single_file=True).counts
    return counts.withColumn("files", F.lit(len(counts.inputFiles())))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "text-lines")
    _table(spark, sf_dir, "documents").select("text").write.text(folder)
    return read_lines(spark, folder)


def memory_and_stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _table(spark, sf_dir, "documents").select(F.col("text").alias("value"))
    return lines_from_values(spark, MEMORY_LINES).unionByName(stored)


def fetched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The texts as files in the shared folder, each read as a URL of its own.
    folder = fresh_folder(spark, "fetch-lines")
    texts = _table(spark, sf_dir, "documents").select("text").filter("text IS NOT NULL")
    texts.write.option("maxRecordsPerFile", 1000).text(folder)
    files = spark.read.text(folder).inputFiles()
    return fetch_lines(spark.createDataFrame([(f,) for f in files], "url string"))


def url_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "url-source")
    texts = _table(spark, sf_dir, "documents").select("text").filter("text IS NOT NULL")
    texts.write.option("maxRecordsPerFile", 1000).text(folder)
    return read_urls(spark, spark.read.text(folder).inputFiles())


def demo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo_columns(_table(spark, sf_dir, "orders"), "o_orderkey")


def datagen_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datagen_columns(_table(spark, sf_dir, "orders"), "o_orderkey")


def datagen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The generator itself, up to the last order; the orders then say which ids are kept.
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    start, end = orders.agg(F.coalesce(F.min("o_orderkey"), F.lit(0)), F.coalesce(F.max("o_orderkey"), F.lit(0))).first()
    target = f"{_database(spark, 'datagen_stream')}.orders_stream"
    generated = datagen_rows(spark, start=start, end=end, whole=True)
    stream_insert(
        generated, target, fresh_folder(spark, "datagen-checkpoint"), bounded=True
    ).awaitTermination()
    whole = F.date_trunc("MILLISECOND", F.col("order_time")) == F.col("order_time")
    known = F.col("id") == F.col("o_orderkey")
    return spark.table(target).join(orders, known, "left_semi").select(
        "id", "item_id", "price", whole.alias("whole_ms")
    )


def cast_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", to_money("l_extendedprice").alias("price")
    )


def like_or_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.filter(any_like([("p_type", "%A%"), ("p_name", "%a%")]))


def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.filter(starts_with_any("url", ["http://", "https://m."]))


def save_table_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{_database(spark, 'save_table')}.orders"
    tb.save_table(_table(spark, sf_dir, "orders"), target)
    return spark.table(target)


def ctas_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{_database(spark, 'ctas')}.lineitem"
    tb.ctas(spark, target, f"SELECT * FROM parquet.{quoted(f'{sf_dir}/lineitem.parquet')}")
    return spark.table(target)


def create_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{_database(spark, 'create_strict')}.customer"
    customer = _table(spark, sf_dir, "customer")
    tb.create_strict(customer, target)
    tb.create_strict(customer, target, drop_first=True)
    return spark.table(target)


def register_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    folder = fresh_folder(spark, "external")
    events.write.partitionBy("event_type").parquet(folder)
    target = f"{_database(spark, 'register_external')}.events"
    tb.register_external(spark, target, folder, events.schema, partitioned_by=["event_type"])
    return spark.table(target)


def new_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Registered with the events of all types but the first; those come later, as a folder of their own.
    events = _table(spark, sf_dir, "events")
    first = events.agg(F.min("event_type").alias("t")).first()["t"]
    folder = fresh_folder(spark, "new-partitions")
    late = F.col("event_type").eqNullSafe(F.lit(first))
    events.filter(~late).write.partitionBy("event_type").parquet(folder)
    target = f"{_database(spark, 'new_partitions')}.events"
    tb.register_external(spark, target, folder, events.schema, partitioned_by=["event_type"])
    events.filter(late).write.mode("append").partitionBy("event_type").parquet(folder)
    added = tb.add_new_partitions(spark, target)
    return spark.table(target).withColumn("added", F.lit(added))


def _row_counts(named: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in named
    ]
    return reduce(DataFrame.unionByName, counts)


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, scale = ScaleCatalog.at(spark, sf_dir)
    return _row_counts((t, catalog.read(scale, t)) for t in catalog.tables(scale))


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, scale = ScaleCatalog.at(spark, sf_dir)
    database = _database(spark, "show_tables")
    for name in catalog.tables(scale):
        folder = f"{catalog.folder(scale)}/{name}.parquet"
        tb.register_external(spark, f"{database}.{name}", folder, catalog.read(scale, name).schema)
    names = [row.table_name for row in tb.show_tables(spark, database).collect()]
    return _row_counts((name, spark.table(f"{database}.{name}")) for name in names)


def catalog_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, scale = ScaleCatalog.at(spark, sf_dir)
    chosen = jobs.select_tables(REQUEST, catalog.tables(scale)).tables
    counts = _row_counts((name, catalog.read(scale, name)) for name in chosen)
    position = F.array_position(F.array(*[F.lit(name) for name in chosen]), F.col("table_name")) - 1
    return counts.withColumn("position", position.cast("int"))


def _materialized(spark: SparkSession, sf_dir: str, label: str, check: str = CONTENT) -> DataFrame:
    catalog, scale = ScaleCatalog.at(spark, sf_dir)
    return jobs.materialize_catalog(spark, catalog, scale, _database(spark, label), check=check)


def materialize_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _materialized(spark, sf_dir, "materialize", PORTABLE)
    return results.select("table_name", "rows", "status", "fingerprint")


def materialize_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.totals(_materialized(spark, sf_dir, "totals"))


class _BrokenSupplier(ScaleCatalog):
    """A source whose supplier table fails while its rows are read."""

    def read(self, scale: str, table: str) -> DataFrame:
        df = super().read(scale, table)
        if table != "supplier":
            return df
        broken = F.raise_error(F.lit("broken source")).cast("string")
        return df.withColumn("s_name", broken)


def materialize_with_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, scale = _BrokenSupplier.at(spark, sf_dir)
    database = _database(spark, "with_failure")
    try:
        jobs.materialize_catalog(
            spark, catalog, scale, database, tables="orders,supplier,lineitem", raise_on_failure=True
        )
    except jobs.MaterializeError as failed:
        return failed.results.select("table_name", "rows", "status")
    raise AssertionError("a failed table must fail the job")


def materialize_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The first run fails in one table; the second copies that one alone, which the journal shows.
    catalog, scale = ScaleCatalog.at(spark, sf_dir)
    broken, _ = _BrokenSupplier.at(spark, sf_dir)
    database, journal = _database(spark, "resumed"), fresh_folder(spark, "journal")
    jobs.materialize_catalog(spark, broken, scale, database, journal=journal)
    results = jobs.materialize_catalog(spark, catalog, scale, database, journal=journal)
    copies = Journal(spark, journal).entries().groupBy("target").agg(F.count("*").alias("copies"))
    target = F.concat(F.lit(f"{database}.`"), "table_name", F.lit("`"))
    return results.join(copies, F.col("target") == target, "left").select("table_name", "rows", "status", "copies")


def strict_csv_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, scale = ScaleCatalog.at(spark, sf_dir)
    database = _database(spark, "strict_csv")
    jobs.materialize_catalog(
        spark, catalog, scale, database, "documents", "csv", strict=True, raise_on_failure=True
    )
    return spark.table(f"{database}.documents")


def multi_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer")
    results = jobs.write_formats(customer, _database(spark, "multi_format"), FORMATS)
    return results.select("format", "rows", "status")


def table_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = _database(spark, "table_location")
    landed = tb.save_table(_table(spark, sf_dir, "orders"), f"{database}.orders")
    rows = [
        (name, tb.table_location(spark, f"{database}.{name}") != tb.UNKNOWN_LOCATION, count)
        for name, count in (("orders", landed), ("absent", 0))
    ]
    return spark.createDataFrame(rows, "table_name string, found boolean, rows bigint")


def relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relax_nullability(_table(spark, sf_dir, "lineitem"))


def relaxed_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders inside a struct, an array and a map that all call themselves required, copied strictly.
    orders = _table(spark, sf_dir, "orders")
    key, status = F.coalesce("o_orderkey", F.lit(0)), F.coalesce("o_orderstatus", F.lit(""))
    nested = orders.select(
        F.struct(key.alias("id"), F.array(status).alias("states")).alias("o"), F.create_map(status, key).alias("m")
    )
    target = f"{_database(spark, 'relax_nested')}.orders"
    tb.create_strict(relax_nested(nested), target)
    free = spark.table(target).schema == relaxed_type(nested.schema)
    return spark.table(target).select(
        F.col("o.id").alias("o_orderkey"), F.col("o.states")[0].alias("o_orderstatus"),
        F.map_values("m")[0].alias("again"), F.lit(free).alias("free"),
    )


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by_key(_table(spark, sf_dir, "events"), ["user_id"], ["value", "event_id"])


def keyed_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{_database(spark, 'keyed_write')}.latest_orders"
    orders = _table(spark, sf_dir, "orders")
    write_keyed(orders, target, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return spark.table(target)


def inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = f"events_{uuid.uuid4().hex[:12]}"
    _stream(spark, sf_dir, "events").createOrReplaceTempView(view)
    target = f"{_database(spark, 'stream_insert')}.events"
    stream_insert(
        spark.sql(f"SELECT event_id, ts, user_id, event_type, value, props FROM {view}"),
        target,
        fresh_folder(spark, "insert-checkpoint"),
        bounded=True,
    ).awaitTermination()
    return spark.table(target)


def _upserted(
    spark: SparkSession, sf_dir: str, streams: int = 1, publish_every: int | None = None
) -> KeyedTable:
    # The events again as files that make several micro-batches: no shuffle, and no file
    # holds more than its share of the rows.
    events = _table(spark, sf_dir, "events")
    table = KeyedTable.create_if_absent(
        spark,
        f"{_database(spark, 'keyed_upsert')}.events_by_user",
        events.schema,
        keys=["user_id"],
        path=fresh_folder(spark, "keyed"),
        order_by=["ts", "event_id"],
        buckets=int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
    for i in range(streams):
        fed = events.filter(F.pmod("event_id", F.lit(streams)) == i)
        feed = fresh_folder(spark, "upsert-feed")
        share = -(-fed.count() // UPSERT_BATCHES)
        fed.write.option("maxRecordsPerFile", max(share, 1)).parquet(feed)
        files_per_batch = -(-events.rdd.getNumPartitions() // UPSERT_BATCHES)
        stream = (
            spark.readStream.schema(events.schema)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(feed)
        )
        checkpoint = fresh_folder(spark, "upsert-checkpoint")
        stream_upsert(
            stream, table, checkpoint, bounded=True, publish_every=publish_every
        ).awaitTermination()
    return table


def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir, streams=2).current()


def keyed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Published between the batches, so later ones are merged into a snapshot.
    table = _upserted(spark, sf_dir, publish_every=2)
    table.publish()
    return spark.table(table.name)


QUERIES: dict[str, Query] = {
    "tokens": tokens,
    "word_count": word_count,
    "top_words": top_words,
    "distinct_words": distinct_words,
    "word_count_csv": word_count_csv,
    "word_count_one_csv": word_count_one_csv,
    "text_lines": text_lines,
    "lines_from_values": memory_and_stored_lines,
    "fetch_lines": fetched_lines,
    "url_source": url_source,
    "demo_rows": demo_rows,
    "datagen_batch": datagen_batch,
    "datagen_stream": datagen_stream,
    "cast_decimal": cast_decimal,
    "like_or_filter": like_or_filter,
    "prefix_filter": prefix_filter,
    "save_table_readback": save_table_readback,
    "ctas_parquet": ctas_parquet,
    "create_strict": create_strict,
    "register_external": register_external,
    "new_partitions": new_partitions,
    "catalog_tables": catalog_tables,
    "show_tables": show_tables,
    "catalog_subset": catalog_subset,
    "materialize_summary": materialize_summary,
    "materialize_with_failure": materialize_with_failure,
    "materialize_resumed": materialize_resumed,
    "strict_csv_copy": strict_csv_copy,
    "materialize_totals": materialize_totals,
    "multi_format": multi_format,
    "table_location": table_location,
    "relax_nullability": relaxed,
    "relax_nested": relaxed_nested,
    "latest_by_key": latest,
    "keyed_write": keyed_write,
    "stream_insert": inserted,
    "keyed_upsert": keyed_upsert,
    "keyed_snapshot": keyed_snapshot,
}
