"""The text queries that SQL can express, against DuckDB, and the contract of all."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point
from tableforge.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    numbers = Counter(name.split("_")[0] for name in QUERIES)
    assert numbers == {f"op{n}": 1 for n in range(1, 14)}
    assert set(entry_point.queries()) > {*QUERIES, "pipeline"}
    assert set(entry_point.oracle_sql()) > set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    answer = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r) for r in df.select(names).collect()) == Counter(answer.fetchall())
