from __future__ import annotations

from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tableforge import (
    create_strict,
    ctas,
    demo_rows,
    ensure_database,
    register_external,
    relax_nullability,
    save_table,
    show_tables,
    table_location,
    vacuum,
)
from tableforge.operators.tables import drop_table
from tableforge.workspace import fresh_folder


def _failing(df):
    boom = F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise(F.col("name"))
    return df.withColumn("name", boom)


def test_save_creates_then_replaces(spark, database):
    t = f"{database}.demo"
    assert save_table(demo_rows(spark, 5), t) == 5
    first = table_location(spark, t)
    assert save_table(demo_rows(spark, 7), t) == 7
    assert spark.table(t).count() == 7
    assert table_location(spark, t) not in (first, "<unknown>")


def test_save_with_other_columns_or_format(spark, database):
    t = f"{database}.demo"
    save_table(demo_rows(spark, 5), t)
    save_table(demo_rows(spark, 4).select("id"), t)
    assert spark.table(t).columns == ["id"] and spark.table(t).count() == 4
    save_table(demo_rows(spark, 3), t, "orc")
    assert sorted(r.id for r in spark.table(t).collect()) == [1, 2, 3]


@pytest.mark.parametrize("layout", ["partitionBy", "bucketBy"])
def test_save_over_a_table_of_another_layout(spark, database, layout):
    t = f"{database}.demo"
    writer = demo_rows(spark, 5).select("name", "score", "id").write
    writer = writer.partitionBy("id") if layout == "partitionBy" else writer.bucketBy(2, "id")
    writer.saveAsTable(t)
    assert save_table(demo_rows(spark, 7).select("name", "score", "id"), t) == 7
    assert sorted(r.id for r in spark.table(t).collect()) == list(range(1, 8))


def test_save_over_a_csv_table_with_other_options(spark, database):
    t = f"{database}.demo"
    demo_rows(spark, 5).write.option("sep", "|").format("csv").saveAsTable(t)
    assert save_table(demo_rows(spark, 7), t, "csv") == 7
    assert sorted(r.name for r in spark.table(t).collect()) == sorted(f"name_{i}" for i in range(1, 8))


def test_nested_columns_are_replaced_in_one_update(spark, database):
    t = f"{database}.nested"
    df = demo_rows(spark, 5).selectExpr("id", "array(named_struct('a', id, 'b', name)) AS items")
    save_table(df, t)
    created = spark.sql(f"DESCRIBE FORMATTED {t}").filter("col_name = 'Created Time'").first()
    save_table(df.filter("id < 3"), t)
    assert spark.table(t).count() == 2
    assert spark.sql(f"DESCRIBE FORMATTED {t}").filter("col_name = 'Created Time'").first() == created


def test_a_failed_save_keeps_the_old_table(spark, database):
    t = f"{database}.demo"
    save_table(demo_rows(spark, 5), t)
    with pytest.raises(Exception, match="boom"):
        save_table(_failing(demo_rows(spark, 9)), t)
    assert spark.table(t).count() == 5
    assert save_table(demo_rows(spark, 9), t) == 9


def test_a_table_can_be_rewritten_from_itself(spark, database):
    t = f"{database}.demo"
    save_table(demo_rows(spark, 5), t)
    save_table(spark.table(t).filter("id > 2"), t)
    assert sorted(r.id for r in spark.table(t).collect()) == [3, 4, 5]


def test_vacuum_leaves_the_live_folder_and_other_tables(spark, database):
    t = f"{database}.demo"
    save_table(demo_rows(spark, 1), f"{database}.demo2")
    for rows in (1, 2, 3):
        save_table(demo_rows(spark, rows), t)
    with pytest.raises(Exception, match="boom"):
        save_table(_failing(demo_rows(spark, 9)), t)
    live = table_location(spark, t)
    assert vacuum(spark, t) == 3
    assert vacuum(spark, t) == 0
    assert table_location(spark, t) == live
    assert spark.table(t).count() == 3 and spark.table(f"{database}.demo2").count() == 1
    with pytest.raises(ValueError):
        vacuum(spark, f"{database}.absent")


def test_no_rows(spark, database):
    assert save_table(demo_rows(spark, 0), f"{database}.empty") == 0
    assert spark.table(f"{database}.empty").columns == ["id", "name", "score"]


def test_other_catalogs_need_a_strict_create(spark):
    with pytest.raises(ValueError, match="create_strict"):
        save_table(demo_rows(spark, 1), "ice.demo.t")


def test_a_name_needs_a_database(spark):
    with pytest.raises(ValueError, match="database.table"):
        save_table(demo_rows(spark, 1), "lonely")


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
@pytest.mark.parametrize("name", ["events", "documents", "orders", "lineitem"])
def test_formats_give_the_rows_back(spark, sf_dir, database, fmt, name):
    df = spark.read.parquet(f"{sf_dir.replace('0.01', '0.001')}/{name}.parquet")
    assert save_table(df, f"{database}.{name}", fmt) == df.count()
    assert Counter(spark.table(f"{database}.{name}").collect()) == Counter(df.collect())


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_formats_keep_awkward_values(spark, database, fmt):
    rows = [
        (1, None, None), (2, "", 0.1), (3, " pad ", 1e300), (4, 'q"uo\\te', -0.5), (5, "a\nb\r\nc", 2.5),
        (6, "\\", None), (7, "null", 1.0), (8, ",", 3.0), (9, '"', 4.0), (10, "x\r", 5.0),
    ]
    df = spark.createDataFrame(rows, "id bigint, s string, d double")
    assert save_table(df, f"{database}.t", fmt) == len(rows)
    assert sorted(tuple(r) for r in spark.table(f"{database}.t").collect()) == rows


def test_ctas(spark, database):
    save_table(demo_rows(spark, 6), f"{database}.src")
    assert ctas(spark, f"{database}.dst", f"SELECT * FROM {database}.src WHERE id <> 2") == 5
    assert spark.table(f"{database}.dst").schema == spark.table(f"{database}.src").schema


def test_a_failed_ctas_can_be_tried_again(spark, database):
    _failing(demo_rows(spark, 5)).createOrReplaceTempView("failing_source")
    with pytest.raises(Exception, match="boom"):
        ctas(spark, f"{database}.dst", "SELECT * FROM failing_source")
    assert not spark.catalog.tableExists(f"{database}.dst")
    assert ctas(spark, f"{database}.dst", "SELECT 1 AS id") == 1


def test_strict_create(spark, database):
    t = f"{database}.strict"
    assert create_strict(demo_rows(spark, 5), t) == 5
    with pytest.raises(AnalysisException):
        create_strict(demo_rows(spark, 5), t)
    assert create_strict(demo_rows(spark, 6), t, drop_first=True) == 6


def test_a_failed_strict_create_can_be_tried_again(spark, database):
    t = f"{database}.strict"
    with pytest.raises(Exception, match="boom"):
        create_strict(_failing(demo_rows(spark, 5)), t)
    assert create_strict(demo_rows(spark, 5), t, drop_first=True) == 5


def test_strict_create_with_a_catalog_name(spark, database):
    t = f"spark_catalog.{database}.strict"
    assert create_strict(demo_rows(spark, 5), t) == 5
    assert spark.table(f"{database}.strict").count() == 5


def test_register_external_with_partitions(spark, database):
    df = demo_rows(spark, 20).withColumn("part", (F.col("id") % 3).cast("int"))
    folder = fresh_folder(spark, "external")
    df.write.partitionBy("part").parquet(folder)
    register_external(spark, f"{database}.ext", folder, df.schema, partitioned_by=["part"])
    assert Counter(spark.table(f"{database}.ext").select(df.columns).collect()) == Counter(df.collect())
    assert spark.sql(f"SHOW PARTITIONS {database}.ext").count() == 3
    drop_table(spark, f"{database}.ext")
    assert spark.read.parquet(folder).count() == 20


def test_show_tables_leaves_views_out(spark, database):
    assert show_tables(spark, database).count() == 0
    save_table(demo_rows(spark, 1), f"{database}.a")
    demo_rows(spark, 1).createOrReplaceTempView("a_view")
    assert [r.table_name for r in show_tables(spark, database).collect()] == ["a"]


def test_location_unknown(spark, database):
    assert table_location(spark, f"{database}.absent") == "<unknown>"
    assert table_location(spark, "no_such_database.absent") == "<unknown>"


def test_location_is_not_fooled_by_a_column(spark, database):
    df = spark.range(3).selectExpr("id AS location", "id AS Location2")
    save_table(df, f"{database}.t")
    assert table_location(spark, f"{database}.t").startswith("file:")


def test_database_is_created_once(spark, database):
    assert ensure_database(spark, database) == database
    assert ensure_database(spark, f"spark_catalog.{database}") == f"spark_catalog.{database}"


REQUIRED = StructType(
    [
        StructField("id", LongType(), False, {"comment": "key"}),
        StructField("a.b", StringType(), False),
        StructField("s", StructType([StructField("x", LongType(), False)]), False),
    ]
)


def test_relax_nullability(spark, database):
    df = spark.createDataFrame([(1, "u", (2,)), (2, "v", (3,))], REQUIRED)
    relaxed = relax_nullability(df)
    assert all(f.nullable for f in relaxed.schema)
    assert [(f.name, f.dataType, f.metadata) for f in relaxed.schema] == [
        (f.name, f.dataType, f.metadata) for f in REQUIRED
    ]
    assert relaxed.collect() == df.collect()
    create_strict(relaxed, f"{database}.relaxed")
    assert spark.table(f"{database}.relaxed").count() == 2


def test_relax_nullability_touches_no_row(spark):
    df = spark.createDataFrame([(1, "u", (2,))], REQUIRED)
    plan = relax_nullability(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE" not in plan.upper() and "Project" not in plan


@pytest.mark.parametrize("fmt", ["csv", "json"])
@pytest.mark.parametrize("name", ["documents", "pages", "conversations", "events"])
def test_strict_copies_equal_their_source(spark, database, sf_dir, fmt, name):
    source = spark.read.parquet(f"{sf_dir.replace('sf0.01', 'sf0.001')}/{name}.parquet")
    target = f"{database}.{name}_{fmt}"
    assert create_strict(source, target, fmt) == source.count()
    copy = spark.table(target)
    assert copy.exceptAll(source).isEmpty() and source.exceptAll(copy).isEmpty()


def test_a_failed_strict_copy_keeps_the_old_table(spark, database):
    t = f"{database}.kept"
    create_strict(demo_rows(spark, 5), t)
    with pytest.raises(Exception):
        create_strict(_failing(demo_rows(spark, 7)), t, drop_first=True)
    assert spark.table(t).count() == 5


def test_any_word_and_a_lone_null_survive_csv(spark, database):
    from tableforge import save_table

    words = [("\x00null\x00",), (None,), ("",), (" a ",), ('"',), ("null",), ("a\nb",)]
    one = spark.createDataFrame(words, "w string")
    assert save_table(one, f"{database}.one_column", "csv") == len(words)
    assert set(spark.table(f"{database}.one_column").collect()) == set(one.collect())
    two = one.selectExpr("w", "1 AS n")
    save_table(two, f"{database}.two_columns", "csv")
    assert set(spark.table(f"{database}.two_columns").collect()) == set(two.collect())
