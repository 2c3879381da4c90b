from __future__ import annotations

from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StringType, TimestampNTZType

from tableforge import (
    await_sequence_end,
    datagen_batch,
    datagen_columns,
    datagen_stream,
    demo_rows,
    generated_stream_job,
    stream_insert,
)
from tableforge.workspace import fresh_folder


@pytest.mark.parametrize("rows", [0, 1, 5, 100])
def test_demo_rows(spark, rows):
    df = demo_rows(spark, rows)
    assert [f.dataType for f in df.schema] == [LongType(), StringType(), DoubleType()]
    assert sorted(tuple(r) for r in df.collect()) == [(i, f"name_{i}", i * 1.5) for i in range(1, rows + 1)]


def test_generated_types_and_bounds(spark):
    df = datagen_batch(spark, 1, 20000)
    assert [f.dataType for f in df.schema] == [LongType(), IntegerType(), DecimalType(10, 2)]
    low_item, high_item, low, high, n, items = df.agg(
        F.min("item_id"), F.max("item_id"), F.min("price"), F.max("price"),
        F.count_distinct("id"), F.count_distinct("item_id"),
    ).first()
    assert (low_item, high_item, n, items) == (1, 1000, 20000, 1000)
    assert Decimal("1.00") <= low < Decimal("10") and Decimal("9990") < high <= Decimal("9999.99")


def test_values_depend_on_the_id_alone(spark):
    one = datagen_columns(spark.range(1, 501, 1, 1))
    many = datagen_columns(spark.range(1, 501, 1, 13).orderBy(F.col("id").desc()))
    assert Counter(one.collect()) == Counter(many.collect())


def test_replayable_stream_continues_after_a_restart(spark, database):
    table, checkpoint = f"{database}.orders_stream", fresh_folder(spark, "cp")
    for expected in (10, 20, 25, 25):
        stream = datagen_stream(spark, rows_per_second=10, end=25, replayable=True)
        stream_insert(stream, table, checkpoint, bounded=True).awaitTermination(60)
        rows = spark.table(table)
        assert rows.count() == expected
    assert rows.schema["order_time"].dataType == TimestampNTZType()
    assert rows.filter("date_trunc('MILLISECOND', order_time) <> order_time").count() == 0
    generated = rows.drop("order_time")
    assert Counter(generated.collect()) == Counter(datagen_batch(spark, 1, 25).collect())


def test_paced_stream_ends_with_its_sequence(spark, database):
    table = f"{database}.paced"
    stream = datagen_stream(spark, rows_per_second=200, start=5, end=404)
    query = stream_insert(stream, table, fresh_folder(spark, "cp"), interval="200 milliseconds")
    try:
        assert await_sequence_end(query, 404, timeout=60)
    finally:
        query.stop()
    assert not query.isActive
    ids = sorted(r.id for r in spark.table(table).select("id").collect())
    assert ids == list(range(5, 405))


def test_generated_stream_into_a_keyed_table(spark, database):
    place = (f"{database}.orders_stream", fresh_folder(spark, "keyed"), fresh_folder(spark, "cp"))
    for expected in (40, 80, 100):
        keyed, query = generated_stream_job(spark, *place, rows_per_second=40, end=100, bounded=True)
        query.awaitTermination(60)
        assert keyed.current().count() == expected
    assert keyed.publish() == 2
    rows = spark.table(keyed.name)
    types = [LongType(), IntegerType(), DecimalType(10, 2), TimestampNTZType()]
    assert [f.dataType for f in rows.schema] == types
    assert Counter(rows.drop("order_time").collect()) == Counter(datagen_batch(spark, 1, 100).collect())


def test_paced_stream_into_a_keyed_table_ends_too(spark, database):
    place = (f"{database}.paced", fresh_folder(spark, "keyed"), fresh_folder(spark, "cp"))
    keyed, query = generated_stream_job(
        spark, *place, rows_per_second=100, end=150, interval="500 milliseconds"
    )
    try:
        assert await_sequence_end(query, 150, timeout=60)
    finally:
        query.stop()
    assert sorted(r.id for r in keyed.current().select("id").collect()) == list(range(1, 151))


def test_waiting_gives_up_in_time(spark, database):
    query = stream_insert(
        datagen_stream(spark, rows_per_second=1), f"{database}.slow", fresh_folder(spark, "cp"),
        interval="200 milliseconds",
    )
    try:
        assert not await_sequence_end(query, 1_000_000, timeout=1)
    finally:
        query.stop()


def test_a_finished_sequence_ends_at_once(spark, database):
    table, checkpoint = f"{database}.finished", fresh_folder(spark, "cp")
    for _ in range(2):
        stream = datagen_stream(spark, rows_per_second=200, end=100)
        query = stream_insert(stream, table, checkpoint, interval="200 milliseconds")
        try:
            assert await_sequence_end(query, 100, timeout=60)
        finally:
            query.stop()
    assert sorted(r.id for r in spark.table(table).select("id").collect()) == list(range(1, 101))
