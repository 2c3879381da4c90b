from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tableforge import KeyedTable, latest_by_key, stream_insert, stream_upsert
from tableforge.workspace import fresh_folder

SCHEMA = "id bigint, score double, note string"


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_by_key_against_brute_force(spark):
    rng = random.Random(3)
    rows = [
        (rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, 1.0, 2.0, float(i)]), f"n{i}")
        for i in range(500)
    ]
    best = {}
    for key, score, note in rows:
        rank = (float("-inf") if score is None else score, note)
        if key not in best or rank > best[key][0]:
            best[key] = (rank, (key, score, note))
    got = latest_by_key(_frame(spark, rows).repartition(7), ["id"], ["score"])
    assert got.columns == ["id", "score", "note"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(v for _, v in best.values())


def test_latest_with_two_keys_and_two_orders(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, 5), (1, "a", 2, 1), (1, "a", 2, 0), (1, "b", 0, 0)], "k int, l string, o int, p int"
    )
    assert sorted(tuple(r) for r in latest_by_key(df, ["k", "l"], ["o", "p"]).collect()) == [
        (1, "a", 2, 1), (1, "b", 0, 0),
    ]


def test_latest_keeps_columns_that_cannot_be_ordered(spark):
    df = spark.range(10).selectExpr("id % 2 AS k", "id AS o", "map('a', id) AS m")
    assert {r.k: r.m["a"] for r in latest_by_key(df, ["k"], ["o"]).collect()} == {0: 8, 1: 9}


def test_latest_with_only_key_columns(spark):
    df = spark.range(10).selectExpr("id % 2 AS k")
    assert sorted(r.k for r in latest_by_key(df, ["k"], ["k"]).collect()) == [0, 1]


def test_latest_needs_an_order(spark):
    with pytest.raises(ValueError):
        latest_by_key(spark.range(3), ["id"], [])


def test_one_hot_key_is_combined_before_the_shuffle(spark):
    rows = 40000
    df = spark.range(0, rows, 1, 20).selectExpr("if(id % 3 = 0, -1, id) AS k", "id AS o", "'x' AS v")
    latest = latest_by_key(df, ["k"], ["o"])
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max") > plan.index("Exchange hashpartitioning")
    got = {r.k: r.o for r in latest.collect()}
    assert got[-1] == 39999 and len(got) == 1 + rows - len(range(0, rows, 3))


@pytest.fixture
def keyed(spark, database):
    schema = _frame(spark, []).schema

    def make(order_by=(), name="t"):
        return KeyedTable.create_if_absent(
            spark, f"{database}.{name}", schema, ["id"], fresh_folder(spark, "keyed"), order_by,
            buckets=2,
        )

    return make


def test_a_new_table_is_empty(keyed, spark):
    t = keyed(["score"])
    assert t.current().count() == 0 and t.publish() == -1
    assert spark.table(t.name).columns == ["id", "score", "note"]


def test_declared_once(keyed, spark):
    t = keyed(["score"])
    t.write_batch(_frame(spark, [(1, 1.0, "a")]), 0)
    again = KeyedTable.create_if_absent(
        spark, t.name, spark.table(t.name).schema, ["id"], fresh_folder(spark, "other"), ["note"],
        buckets=2,
    )
    assert again == t == KeyedTable.open(spark, t.name)
    assert again.current().count() == 1


def test_declaration_is_checked(keyed, spark, database):
    with pytest.raises(ValueError, match="nope"):
        keyed(["nope"])
    with pytest.raises(ValueError):
        KeyedTable.create_if_absent(spark, f"{database}.x", _frame(spark, []).schema, [], "/nowhere", buckets=2)


def test_highest_order_wins_whenever_it_arrives(keyed, spark):
    t = keyed(["score"])
    t.write_batch(_frame(spark, [(1, 5.0, "early high"), (1, 2.0, "b"), (2, 1.0, "c")]), 0)
    t.write_batch(_frame(spark, [(1, 3.0, "late low"), (2, 1.0, "tie, later batch"), (3, None, "d")]), 1)
    expected = [(1, 5.0, "early high"), (2, 1.0, "tie, later batch"), (3, None, "d")]
    assert _rows(t.current()) == expected
    assert t.publish() == 1
    assert _rows(spark.table(t.name)) == expected == _rows(t.current())


def test_last_batch_wins_without_an_order(keyed, spark):
    t = keyed()
    t.write_batch(_frame(spark, [(1, 5.0, "a"), (2, 1.0, "b")]), 0)
    t.write_batch(_frame(spark, [(1, 3.0, "c")]), 1)
    assert _rows(t.current()) == [(1, 3.0, "c"), (2, 1.0, "b")]
    with pytest.raises(Exception, match="key occurs twice"):
        t.write_batch(_frame(spark, [(9, 1.0, "x"), (9, 2.0, "y")]), 2)
    assert _rows(t.current()) == [(1, 3.0, "c"), (2, 1.0, "b")]


def test_a_replayed_batch_replaces_its_first_try(keyed, spark):
    t = keyed(["score"])
    t.write_batch(_frame(spark, [(1, 9.0, "first try"), (7, 1.0, "only in first try")]), 0)
    t.write_batch(_frame(spark, [(1, 4.0, "second try")]), 0)
    assert _rows(t.current()) == [(1, 4.0, "second try")]


def test_null_order_values_are_lowest_after_a_publish_too(keyed, spark):
    t = keyed(["score", "note"])
    t.write_batch(_frame(spark, [(1, None, "b"), (2, 1.0, None), (3, None, "z"), (4, 1.0, "a")]), 0)
    t.publish()
    t.write_batch(_frame(spark, [(1, None, "c"), (2, 1.0, "a"), (3, None, "y"), (4, None, "q")]), 1)
    assert _rows(t.current()) == [(1, None, "c"), (2, 1.0, "a"), (3, None, "z"), (4, 1.0, "a")]


def test_a_null_key_is_refused(keyed, spark):
    t = keyed(["score"])
    with pytest.raises(Exception, match="null in key column id"):
        t.write_batch(_frame(spark, [(None, 1.0, "a")]), 0)
    assert t.current().count() == 0


def test_two_part_key(spark, database):
    schema = "a int, b string, o int, v string"
    t = KeyedTable.create_if_absent(
        spark, f"{database}.two", spark.createDataFrame([], schema).schema, ["a", "b"],
        fresh_folder(spark, "keyed"), ["o"], buckets=4,
    )
    t.write_batch(spark.createDataFrame([(1, "x", 1, "p"), (1, "y", 1, "q")], schema), 0)
    t.publish()
    t.write_batch(spark.createDataFrame([(1, "x", 2, "r"), (2, "x", 0, "s")], schema), 1)
    expected = [(1, "x", 2, "r"), (1, "y", 1, "q"), (2, "x", 0, "s")]
    assert _rows(t.current()) == expected
    t.publish()
    assert _rows(spark.table(t.name)) == expected


def test_a_snapshot_with_enough_buckets_is_not_shuffled(spark, database):
    t = KeyedTable.create_if_absent(
        spark, f"{database}.wide", _frame(spark, []).schema, ["id"], fresh_folder(spark, "keyed"),
        ["score"], buckets=16,
    )
    t.write_batch(_frame(spark, [(i, 1.0, "a") for i in range(200)]), 0)
    t.publish()
    t.write_batch(_frame(spark, [(i, 2.0, "b") for i in range(150, 250)]), 1)
    plan = t.current()._jdf.queryExecution().executedPlan().toString()
    old = plan[plan.index("FullOuter"):plan.index("wide[id")]
    assert "Exchange" not in old and "Bucketed: true" in plan
    notes = Counter(r.note for r in t.current().collect())
    assert notes == {"a": 150, "b": 100}


def test_a_failed_batch_shows_no_row(keyed, spark):
    t = keyed(["score"])
    t.write_batch(_frame(spark, [(1, 1.0, "a")]), 0)
    bad = _frame(spark, [(2, 1.0, "b"), (3, 1.0, "c")]).withColumn(
        "note", F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise(F.col("note"))
    )
    with pytest.raises(Exception, match="boom"):
        t.write_batch(bad, 1)
    assert _rows(t.current()) == [(1, 1.0, "a")]


def test_publish_again_and_again(keyed, spark):
    t = keyed(["score"])
    state = {}
    rng = random.Random(5)
    for batch in range(6):
        rows = [(rng.randrange(8), float(rng.randrange(1000)), f"{batch}-{i}") for i in range(10)]
        for key, score, note in rows:
            rank = (score, batch, note)
            if key not in state or rank > state[key][0]:
                state[key] = (rank, (key, score, note))
        t.write_batch(_frame(spark, rows), batch)
        if batch % 2:
            assert t.publish() == batch == t.publish()
            assert _rows(spark.table(t.name)) == sorted(v for _, v in state.values())
        assert _rows(t.current()) == sorted(v for _, v in state.values())


def test_reading_while_a_new_snapshot_is_published(keyed, spark):
    t = keyed(["score"])
    t.write_batch(_frame(spark, [(1, 1.0, "a")]), 0)
    t.publish()
    t.write_batch(_frame(spark, [(2, 1.0, "b")]), 1)
    before = t.current()
    t.publish()
    assert _rows(before) == [(1, 1.0, "a"), (2, 1.0, "b")]


def test_trimming_the_log(keyed, spark):
    t = keyed(["score"])
    for batch in range(3):
        t.write_batch(_frame(spark, [(batch, 1.0, "a"), (9, float(batch), "b")]), batch)
    assert t.trim_log() == 0
    t.publish()
    t.write_batch(_frame(spark, [(9, 5.0, "c")]), 3)
    assert t.trim_log() == 3
    expected = [(0, 1.0, "a"), (1, 1.0, "a"), (2, 1.0, "a"), (9, 5.0, "c")]
    assert _rows(t.current()) == expected
    t.write_batch(_frame(spark, [(2, 1.0, "a"), (9, 2.0, "b")]), 2)  # a late replay
    assert _rows(t.current()) == expected
    assert t.publish() == 3 and t.trim_log() == 1 and t.publish() == 3  # publish has trimmed the replay
    assert _rows(t.current()) == expected


def test_vacuum_keeps_what_the_table_shows(keyed, spark):
    t = keyed(["score"])
    assert t.vacuum() == 0
    for batch in range(4):
        t.write_batch(_frame(spark, [(batch, 1.0, "a"), (9, float(batch), "b")]), batch)
        if batch < 3:
            t.publish()
    expected = [(0, 1.0, "a"), (1, 1.0, "a"), (2, 1.0, "a"), (3, 1.0, "a"), (9, 3.0, "b")]
    assert t.vacuum() == 5  # two older snapshots, three merged batches
    assert _rows(t.current()) == expected
    assert t.publish() == 3 and _rows(spark.table(t.name)) == expected
    assert t.vacuum() == 2 and t.vacuum() == 0
    assert _rows(t.current()) == expected


def test_snapshot_is_bucketed_by_key(keyed, spark):
    t = keyed(["score"])
    t.write_batch(_frame(spark, [(i, 1.0, "a") for i in range(100)]), 0)
    t.publish()
    plan = spark.table(t.name).groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan


def test_awkward_column_names(spark, database):
    df = spark.createDataFrame([(1, 2, "x"), (1, 3, "y"), (2, 1, "z")], "`a.b` int, `o p` int, `v-w` string")
    expected = [(1, 3, "y"), (2, 1, "z")]
    assert _rows(latest_by_key(df, ["a.b"], ["o p"])) == expected
    t = KeyedTable.create_if_absent(
        spark, f"{database}.awkward", df.schema, ["a.b"], fresh_folder(spark, "keyed"), ["o p"],
        buckets=2,
    )
    t.write_batch(df, 0)
    t.publish()
    t.write_batch(df, 1)
    assert _rows(t.current()) == expected


def test_a_column_named_location(spark, database):
    df = spark.createDataFrame([(1, "x")], "id bigint, Location string")
    t = KeyedTable.create_if_absent(
        spark, f"{database}.loc", df.schema, ["id"], fresh_folder(spark, "keyed"), ["Location"],
        buckets=2,
    )
    t.write_batch(df, 0)
    assert t.publish() == 0 and _rows(t.current()) == [(1, "x")]


def _feed(spark, df, files):
    feed = fresh_folder(spark, "feed")
    for i in range(files):
        df.filter(F.col("event_id") % files == i).coalesce(1).write.mode("append").parquet(feed)
    return feed


def _stream(spark, feed, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)


def _latest_events(df):
    return Counter(tuple(r) for r in latest_by_key(df, ["user_id"], ["ts", "event_id"]).collect())


@pytest.fixture
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _events_table(spark, database, events):
    return KeyedTable.create_if_absent(
        spark, f"{database}.by_user", events.schema, ["user_id"], fresh_folder(spark, "keyed"),
        ["ts", "event_id"], buckets=2,
    )


def test_upsert_in_four_batches_and_a_restart(spark, database, events):
    feed, checkpoint = _feed(spark, events, 4), fresh_folder(spark, "cp")
    t = _events_table(spark, database, events)
    stream_upsert(_stream(spark, feed, events.schema), t, checkpoint, bounded=True).awaitTermination(120)
    assert spark.sql(f"SHOW PARTITIONS {t.log}").count() == 4
    assert Counter(tuple(r) for r in t.current().collect()) == _latest_events(events)
    t.publish()
    late = events.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1000 DAYS")).filter("user_id < 20")
    late.coalesce(1).write.mode("append").parquet(feed)
    stream_upsert(_stream(spark, feed, events.schema), t, checkpoint, bounded=True).awaitTermination(120)
    assert spark.sql(f"SHOW PARTITIONS {t.log}").count() == 5
    assert Counter(tuple(r) for r in t.current().collect()) == _latest_events(events.unionByName(late))


def test_publishing_while_the_stream_runs(spark, database, events):
    feed, t = _feed(spark, events, 4), _events_table(spark, database, events)
    stream_upsert(
        _stream(spark, feed, events.schema), t, fresh_folder(spark, "cp"), bounded=True, publish_every=2
    ).awaitTermination(120)
    assert Counter(tuple(r) for r in spark.table(t.name).collect()) == _latest_events(events)
    assert t.publish() == 3


def test_a_crash_between_write_and_commit_leaves_no_duplicates(spark, database, events):
    feed, checkpoint = _feed(spark, events, 4), fresh_folder(spark, "cp")
    t = _events_table(spark, database, events)

    def crash_in_third(batch, batch_id):
        t.write_batch(batch, batch_id)
        if batch_id == 2:
            raise RuntimeError("lost the driver")

    query = (
        _stream(spark, feed, events.schema).writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(crash_in_third).start()
    )
    with pytest.raises(Exception, match="lost the driver"):
        query.awaitTermination(120)
    t.publish()
    stream_upsert(_stream(spark, feed, events.schema), t, checkpoint, bounded=True).awaitTermination(120)
    assert spark.table(t.log).count() == events.count()
    assert Counter(tuple(r) for r in t.current().collect()) == _latest_events(events)


def test_insert_restarts_with_new_rows_only(spark, database, events):
    feed, checkpoint, target = _feed(spark, events, 2), fresh_folder(spark, "cp"), f"{database}.plain"
    for expected in (10000, 10000, 10500):
        if expected > 10000:
            events.limit(500).coalesce(1).write.mode("append").parquet(feed)
        _stream(spark, feed, events.schema).createOrReplaceTempView("feed_view")
        fed = spark.sql("SELECT * FROM feed_view")
        stream_insert(fed, target, checkpoint, bounded=True).awaitTermination(120)
        assert spark.table(target).count() == expected


def test_insert_after_a_failed_run(spark, database, events):
    feed, checkpoint, target = _feed(spark, events, 4), fresh_folder(spark, "cp"), f"{database}.plain"

    def source(broken):
        stream = _stream(spark, feed, events.schema)
        if not broken:
            return stream
        boom = F.when(F.col("event_id") % 4 == 2, F.raise_error(F.lit("boom"))).otherwise(F.col("props"))
        return stream.withColumn("props", boom)

    query = stream_insert(source(True), target, checkpoint, bounded=True)
    with pytest.raises(Exception, match="boom"):
        query.awaitTermination(120)
    stream_insert(source(False), target, checkpoint, bounded=True).awaitTermination(120)
    got = spark.table(target).select(events.columns)
    assert Counter(got.collect()) == Counter(events.collect())


def test_two_streams_feed_one_table(spark, database):
    df = spark.range(200).selectExpr("id", "cast(id as double) AS score", "'x' AS note")
    t = KeyedTable.create_if_absent(
        spark, f"{database}.two_streams", df.schema, ["id"], fresh_folder(spark, "keyed"), ["score"], buckets=2
    )
    for part, publish in ((0, True), (1, False)):
        feed = fresh_folder(spark, "feed")
        df.filter(f"id div 100 = {part}").coalesce(1).write.parquet(feed)
        stream_upsert(
            _stream(spark, feed, df.schema), t, fresh_folder(spark, "cp"), bounded=True
        ).awaitTermination(60)
        if publish:
            assert t.publish() == 0
        assert t.current().count() == 100 * (part + 1)
    assert t.publish() == 0 and spark.table(t.name).count() == 200 == t.current().count()
    assert t.publish() == 0 and t.vacuum() > 0 and t.current().count() == 200


def test_two_unpublished_streams_and_a_replay(keyed, spark):
    t = keyed(["score"])
    t.write_batch(_frame(spark, [(1, 1.0, "a")]), 0, "one")
    t.write_batch(_frame(spark, [(2, 1.0, "b")]), 0, "two")
    t.write_batch(_frame(spark, [(2, 2.0, "c")]), 0, "two")
    assert _rows(t.current()) == [(1, 1.0, "a"), (2, 2.0, "c")]
    t.publish()
    t.write_batch(_frame(spark, [(3, 1.0, "d")]), 0, "three")
    t.write_batch(_frame(spark, [(9, 9.0, "late replay")]), 0, "one")
    assert _rows(t.current()) == [(1, 1.0, "a"), (2, 2.0, "c"), (3, 1.0, "d")]
    t.publish()
    assert _rows(spark.table(t.name)) == [(1, 1.0, "a"), (2, 2.0, "c"), (3, 1.0, "d")]


def test_without_an_order_a_second_stream_is_refused(keyed, spark):
    t = keyed()
    t.write_batch(_frame(spark, [(1, 1.0, "a")]), 0, "one")
    with pytest.raises(ValueError, match="no order_by"):
        t.write_batch(_frame(spark, [(2, 1.0, "b")]), 0, "two")
    t.publish()
    with pytest.raises(ValueError, match="no order_by"):
        t.write_batch(_frame(spark, [(2, 1.0, "b")]), 0, "two")


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_task_writes_one_bucket(spark, database, adaptive):
    import re

    from tableforge.workspace import folder_names

    t = KeyedTable.create_if_absent(
        spark, f"{database}.seven_{adaptive}", _frame(spark, []).schema, ["id"], fresh_folder(spark, "keyed"),
        ["score"], buckets=7,
    )
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        for batch in range(2):
            t.write_batch(_frame(spark, [(i, float(batch), "a") for i in range(500)]), batch)
            t.publish()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    parts = [re.match(r"part-(\d+)-.*_(\d+)\.c000", n) for n in folder_names(spark, t._folder())]
    files = [(m[1], m[2]) for m in parts if m]
    assert len({bucket for _, bucket in files}) == 7
    assert len({task for task, _ in files}) == len(files) <= 14
    assert t.current().count() == 500


def test_a_plain_table_belongs_to_one_checkpoint(spark, database):
    target = f"{database}.one_checkpoint"
    feed, schema = fresh_folder(spark, "feed"), spark.range(1).schema
    spark.range(100).coalesce(1).write.parquet(feed)
    first = fresh_folder(spark, "cp")
    stream_insert(_stream(spark, feed, schema), target, first, bounded=True).awaitTermination(60)
    with pytest.raises(ValueError, match="holds rows of"):
        stream_insert(_stream(spark, feed, schema), target, fresh_folder(spark, "cp"), bounded=True)
    spark.range(100, 200).coalesce(1).write.mode("append").parquet(feed)
    stream_insert(_stream(spark, feed, schema), target, first, bounded=True).awaitTermination(60)
    assert spark.table(target).count() == 200


def test_a_filled_table_is_not_hidden_by_a_stream(spark, database):
    spark.range(5).write.saveAsTable(f"{database}.filled")
    feed = fresh_folder(spark, "feed")
    spark.range(3).write.parquet(feed)
    with pytest.raises(ValueError, match="another writer"):
        stream_insert(
            _stream(spark, feed, spark.range(1).schema), f"{database}.filled", fresh_folder(spark, "cp"), bounded=True
        )
    assert spark.table(f"{database}.filled").count() == 5
