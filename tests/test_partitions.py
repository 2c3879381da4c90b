from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tableforge.operators.tables import add_new_partitions, register_external
from tableforge.workspace import fresh_folder


def test_one_new_folder_among_many(spark, database):
    folder = fresh_folder(spark, "many")
    rows = spark.range(301).select("id", F.col("id").cast("int").alias("day"))
    rows.filter("day < 300").coalesce(1).write.partitionBy("day").parquet(folder)
    register_external(spark, f"{database}.days", folder, rows.schema, partitioned_by=["day"])
    assert spark.table(f"{database}.days").count() == 300
    rows.filter("day = 300").write.mode("append").partitionBy("day").parquet(folder)
    assert add_new_partitions(spark, f"{database}.days") == 1
    assert add_new_partitions(spark, f"{database}.days") == 0
    assert spark.table(f"{database}.days").count() == 301
    assert spark.conf.get("spark.sql.optimizer.metadataOnly") == "false"


def test_awkward_values_and_two_levels(spark, database):
    names = ["a b", "x/y", "50%", "q=1", "it's", "+", "\\", None]
    rows = spark.createDataFrame([(i, n, i % 2) for i, n in enumerate(names)], "id long, name string, half int")
    folder = fresh_folder(spark, "awkward")
    rows.limit(0).write.parquet(folder)
    table = f"{database}.awkward"
    register_external(spark, table, folder, rows.schema, partitioned_by=["name", "half"])
    rows.write.mode("append").partitionBy("name", "half").parquet(folder)
    assert add_new_partitions(spark, table) == len(names)
    assert add_new_partitions(spark, table) == 0
    found = {(r.id, r.name, r.half) for r in spark.table(table).collect()}
    assert found == {(i, n, i % 2) for i, n in enumerate(names)}


def test_a_partition_of_an_empty_file_is_registered(spark, database):
    folder = fresh_folder(spark, "empty-file")
    rows = spark.createDataFrame([], "id long")
    rows.repartition(1).write.parquet(f"{folder}/day=7")
    register_external(spark, f"{database}.empties", folder, spark.createDataFrame([], "id long, day int").schema, partitioned_by=["day"])
    assert [r.partition for r in spark.sql(f"SHOW PARTITIONS {database}.empties").collect()] == ["day=7"]


def test_a_table_without_partition_columns_is_refused(spark, database):
    spark.sql(f"CREATE TABLE {database}.flat (id long) USING parquet")
    with pytest.raises(ValueError, match="partition columns"):
        add_new_partitions(spark, f"{database}.flat")
