from __future__ import annotations

import pytest

from tableforge import ScaleCatalog
from tableforge.plans.queries import QUERIES
from tableforge.workspace import fresh_folder

ROWS = {
    "documents": ([(1, "a b"), (2, "")], "doc_id bigint, text string"),
    "lineitem": ([(1, 1), (1, 2), (2, 1)], "l_orderkey bigint, l_linenumber int"),
    "orders": ([(1,), (2,)], "o_orderkey bigint"),
    "supplier": ([(7, "s")], "s_suppkey bigint, s_name string"),
}
COUNTS = sorted((name, len(rows)) for name, (rows, _) in ROWS.items())
COPIED = [(name, rows, "OK") for name, rows in COUNTS]
EXPECTED = {
    "catalog_subset": [("lineitem", 3, 0), ("orders", 2, 1)],
    "catalog_tables": COUNTS,
    "materialize_resumed": [(*copied, 1) for copied in COPIED],
    "materialize_summary": COPIED,
    "materialize_totals": [(4, 4, 8)],
    "materialize_with_failure": [("lineitem", 3, "OK"), ("orders", 2, "OK"), ("supplier", -1, "FAIL")],
    "show_tables": COUNTS,
    "strict_csv_copy": [(1, "a b"), (2, "")],
}


@pytest.fixture(scope="module", params=["check_t", "sf0.5"])
def folder(request, spark):
    folder = f"{fresh_folder(spark, 'folder-names')}/{request.param}"
    for name, (rows, schema) in ROWS.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("query", EXPECTED)
def test_any_folder_name(spark, folder, query):
    rows = QUERIES[query](spark, folder).drop("fingerprint").collect()
    assert sorted(map(tuple, rows)) == EXPECTED[query]


def test_catalog_keeps_the_folder(spark):
    for folder in ("/d/sf0.1", "/d/check_s", "/d/sf"):
        catalog, scale = ScaleCatalog.at(spark, folder)
        assert catalog.folder(scale) == folder
    assert ScaleCatalog.at(spark, "/d/sf0.1")[1] == "0.1"
