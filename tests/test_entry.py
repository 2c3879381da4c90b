from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from tableforge import recommended_conf
from tableforge import workspace


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["word", "count"] and df.count() == 20


def test_contract():
    assert set(entry_point.queries()) >= set(entry_point.oracle_sql())


def test_shared_root_is_the_configured_folder(spark):
    assert workspace.shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert workspace.fresh_folder(spark, "x") != workspace.fresh_folder(spark, "x")


class _Session:
    """A session stand-in with no shared folder configured."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = type("Context", (), {"master": master})


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_root(_Session("yarn"))
    assert workspace.shared_root(_Session("local[2]"))


def test_settings_follow_the_input():
    small = recommended_conf(10**9, 10**9, 8)
    big = recommended_conf(100 * 10**12, 5 * 10**12, 8000)
    assert small["spark.sql.shuffle.partitions"] == "8"
    assert int(big["spark.sql.shuffle.partitions"]) > 8000
    assert int(small["spark.sql.files.maxPartitionBytes"]) < int(big["spark.sql.files.maxPartitionBytes"])
