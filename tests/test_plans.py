"""The physical plans that must hold at scale."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tableforge import latest_by_key, spread, tokens, top_words, word_count
from tableforge.plans.queries import QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def texts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_top_words_keeps_k_rows_per_task(texts):
    plan = _plan(top_words(word_count(texts, "text")))
    assert "TakeOrderedAndProject(limit=20" in plan and "rangepartitioning" not in plan


def test_word_count_reads_one_column_and_counts_before_the_shuffle(texts):
    plan = _plan(word_count(texts, "text"))
    assert "ReadSchema: struct<text:string>" in plan
    assert plan.count("Exchange") == 1 and "partial_count" in plan


def test_tokens_do_not_shuffle(texts):
    assert "Exchange" not in _plan(tokens(texts, "text"))


def test_counting_sorted_counts_drops_the_sort(texts):
    ranked = word_count(texts, "text").orderBy(F.col("count").desc(), "word")
    plan = _plan(ranked.agg(F.count("*")))
    assert "Sort" not in plan and "rangepartitioning" not in plan


def test_spread_only_where_the_scan_is_narrow(spark, texts, tmp_path):
    assert "RoundRobin" in _plan(spread(texts))
    texts.repartition(40).write.parquet(f"{tmp_path}/wide")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64KB")
    try:
        assert "Exchange" not in _plan(spread(spark.read.parquet(f"{tmp_path}/wide")))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_copies_of_one_text_spread_evenly(spark, tmp_path):
    texts = spark.range(0, 4000, 1, 1).selectExpr("if(id % 3 = 0, 'copy', concat('t', id)) AS text")
    texts.write.parquet(f"{tmp_path}/c")
    dealt = spread(spark.read.parquet(f"{tmp_path}/c")).groupBy(F.spark_partition_id())
    sizes = [r.n for r in dealt.agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 8


def test_filters_reach_the_scan(spark, sf_dir):
    plan = _plan(QUERIES["like_or_filter"](spark, sf_dir))
    assert "PushedFilters: [Or(StringContains(p_type,A),StringContains(p_name,a))]" in plan
    assert "ReadSchema: struct<page_id:bigint,url:string>" in _plan(QUERIES["prefix_filter"](spark, sf_dir))


@pytest.mark.parametrize("name", ["demo_rows", "datagen_batch", "cast_decimal", "relax_nullability"])
def test_projections_are_one_generated_stage(spark, sf_dir, name):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert "Exchange" not in plan and plan.count("*(1)") >= 1 and "*(2)" not in plan


def test_latest_shuffles_once(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = _plan(latest_by_key(events, ["user_id"], ["value", "event_id"]))
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["tokens", "word_count", "top_words", "distinct_words"])
def test_registered_text_queries_leave_a_wide_scan_alone(spark, texts, tmp_path, name):
    # Four partitions for eight cores: half as many.
    texts.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "1GB")
    try:
        assert "RoundRobin" not in _plan(QUERIES[name](spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_later_batch_joins_the_snapshot(spark, sf_dir):
    from tableforge.plans.queries import _upserted

    table = _upserted(spark, sf_dir, publish_every=3)
    assert "FullOuter" in _plan(table.current())
