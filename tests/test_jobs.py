from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tableforge import (
    MaterializeError,
    NamedCatalog,
    ScaleCatalog,
    demo_rows,
    ensure_database,
    materialize_catalog,
    save_table,
    select_tables,
    table_job,
    totals,
    write_formats,
)
from tableforge.plans.jobs import FormatTarget
from tableforge.plans.oracles import TABLES
from tableforge.workspace import fresh_folder


@pytest.mark.parametrize("request_text", ["all", "ALL", " All "])
def test_select_all(request_text):
    assert select_tables(request_text, ["b", "a"]).tables == ["b", "a"]


def test_select_some():
    chosen = select_tables(" region , nope, nation ,", ["nation", "part", "region"])
    assert chosen.tables == ["region", "nation"] and chosen.missing == ["nope"]


def test_select_keeps_case_and_repeats():
    chosen = select_tables("a,A,a", ["a"])
    assert chosen.tables == ["a", "a"] and chosen.missing == ["A"]


@pytest.mark.parametrize("request_text", ["", " , "])
def test_select_none(request_text):
    assert select_tables(request_text, ["a"]) == ([], [])


class Broken(ScaleCatalog):
    def read(self, scale, table):
        df = super().read(scale, table)
        if table == "nation":
            return df.withColumn("n_name", F.raise_error(F.lit("broken rows")).cast("string"))
        return df


@pytest.fixture(scope="module")
def root(sf_dir):
    return sf_dir.rpartition("/")[0]


def _by_table(results):
    return {r.table_name: r for r in results.orderBy("position").collect()}


def test_scale_catalog_lists_tables(spark, root):
    assert ScaleCatalog(spark, root).tables("0.001") == list(TABLES)


def test_empty_request_is_a_success(spark, root, database):
    results = materialize_catalog(
        spark, ScaleCatalog(spark, root), "0.001", database, "", raise_on_failure=True
    )
    assert tuple(totals(results).first()) == (0, 0, 0)


@pytest.mark.parametrize("strict", [False, True])
def test_failures_stay_apart(spark, root, database, strict):
    args = (spark, Broken(spark, root), "0.001", database, "region,nation, nope ,part")
    results = materialize_catalog(*args, strict=strict)
    found = _by_table(results)
    assert list(found) == ["region", "nation", "part", "nope"]
    assert [found[t].rows for t in found] == [5, -1, 200, 0]
    assert [found[t].status for t in found] == ["OK", "FAIL", "OK", "SKIP"]
    assert "broken rows" in found["nation"].error and found["part"].error is None
    assert found["part"].location.startswith("file:")
    assert tuple(totals(results).first()) == (2, 3, 205)
    assert not spark.catalog.tableExists(f"{database}.nation")
    with pytest.raises(MaterializeError, match="nation") as raised:
        materialize_catalog(*args, strict=strict, raise_on_failure=True)
    assert raised.value.results.count() == 4
    # The retry with a sound source succeeds, over what is already there.
    again = materialize_catalog(
        spark, ScaleCatalog(spark, root), "0.001", database, "region,nation", strict=strict,
        raise_on_failure=True,
    )
    assert tuple(totals(again).first()) == (2, 2, 30)
    assert spark.table(f"{database}.nation").count() == 25


def test_a_table_asked_for_twice_is_copied_twice(spark, root, database):
    results = materialize_catalog(
        spark, ScaleCatalog(spark, root), "0.001", database, "region,nation,region,region"
    )
    assert [(r.table_name, r.rows) for r in results.orderBy("position").collect()] == [
        ("region", 5), ("nation", 25), ("region", 5), ("region", 5),
    ]
    assert spark.table(f"{database}.region").count() == 5


def test_a_failed_copy_keeps_the_table_of_before(spark, root, database):
    materialize_catalog(spark, ScaleCatalog(spark, root), "0.001", database, "nation")
    materialize_catalog(spark, Broken(spark, root), "0.001", database, "nation")
    assert spark.table(f"{database}.nation").count() == 25


def test_a_scale_that_is_absent_fails(spark, root, database):
    with pytest.raises(Exception):
        materialize_catalog(spark, ScaleCatalog(spark, root), "77", database)


def test_table_job(spark, database):
    for rows in (5, 7):
        report = table_job(demo_rows(spark, rows), f"{database}.demo").first()
        assert (report.table_name, report.rows) == (f"{database}.demo", rows)
        assert report.location.startswith("file:")
    with pytest.raises(ValueError):
        table_job(demo_rows(spark, 5), "demo")


def test_named_catalog(spark, database):
    ensure_database(spark, "sf3", fresh_folder(spark, "sf3"))
    save_table(demo_rows(spark, 4), "sf3.one")
    save_table(demo_rows(spark, 5), "sf3.two")
    source = NamedCatalog(spark, "spark_catalog")
    assert source.tables("3") == ["one", "two"]
    results = materialize_catalog(spark, source, " 3 ", database)
    assert {t: r.rows for t, r in _by_table(results).items()} == {"one": 4, "two": 5}


def test_default_database(spark, root):
    results = materialize_catalog(spark, ScaleCatalog(spark, root), "0.001", tables="region")
    assert _by_table(results)["region"].status == "OK"
    assert spark.table("tables_sf0_001.region").count() == 5


def _by_format(results):
    return {r.format: r for r in results.orderBy("position").collect()}


def test_file_formats_and_unknown(spark, database):
    results = write_formats(
        demo_rows(spark, 5), database, " Parquet,orc,csv,json,wat,", raise_on_failure=True
    )
    found = _by_format(results)
    assert [(f, found[f].rows, found[f].status) for f in found] == [
        ("parquet", 5, "OK"), ("orc", 5, "OK"), ("csv", 5, "OK"), ("json", 5, "OK"), ("wat", 0, "SKIP"),
    ]
    for f in ("parquet", "orc", "csv", "json"):
        assert sorted(spark.table(f"{database}.t_{f}").collect()) == sorted(demo_rows(spark, 5).collect())


def test_lake_formats_without_their_jars(spark, database):
    # No lake format is installed here, so only the report of that can be checked.
    found = _by_format(write_formats(demo_rows(spark, 5), database, "iceberg,delta,hudi,paimon,orc"))
    assert [found[f].status for f in found] == ["FAIL"] * 4 + ["OK"]
    assert all(found[f].rows == -1 and found[f].error for f in list(found)[:4])
    with pytest.raises(MaterializeError, match="delta"):
        write_formats(demo_rows(spark, 5), database, "orc,delta", raise_on_failure=True)


def test_strict_target_in_a_named_catalog(spark, database):
    targets = {"parquet": FormatTarget(strict=True, catalog="spark_catalog")}
    for rows in (5, 6):
        results = write_formats(demo_rows(spark, rows), database, "parquet", targets)
        assert _by_format(results)["parquet"].rows == rows


def test_a_format_that_replaces_its_own_tables(spark, database):
    targets = {"orc": FormatTarget(own_log=True, options={"compression": "zlib"})}
    for rows in (5, 6):
        found = _by_format(write_formats(demo_rows(spark, rows), database, "orc", targets))
        assert (found["orc"].rows, found["orc"].status) == (rows, "OK")
        assert found["orc"].location.startswith("file:")
