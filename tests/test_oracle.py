"""Every registered query against DuckDB, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

from tableforge.plans.oracles import ORACLE_SQL, TABLES
from tableforge.plans.queries import QUERIES


def _value(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    in_python = "Python" in plan or "MapInArrow" in plan
    assert in_python == (name in ("fetch_lines", "url_source"))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    answer = duck.execute(ORACLE_SQL[name])
    expected_names = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(expected_names)
    expected = _rows(answer.fetchall(), expected_names)
    actual = _rows(df.collect(), df.columns)
    assert sum(actual.values()) == sum(expected.values())
    assert actual == expected
