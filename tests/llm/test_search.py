from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableforge.llm.search import max_score, top_k

SCHEMA = "vec_id long, embedding array<double>, label int, score string, v string, block string"


def _brute(rows, every, k):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    asked = {}
    for i, v in vectors:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 40, "block_queries": 3}])
def test_top_k_against_brute_force(spark, sizes):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    common = [0.5] * 8
    rows += [(i, common) for i in range(200, 300)]
    rows += [(300, None), (301, [None, 1.0]), (302, [math.nan] * 8), (303, [math.inf] * 8), (None, common)]
    rows += [(400, []), (401, [2.0]), (402, [1.0] * 12), (50, [3.0] * 8), (7, common)]
    got = top_k(_frame(spark, rows).repartition(5), every=50, **sizes)
    assert sorted(tuple(r) for r in got.collect()) == _brute(rows, 50, 5)


def test_many_equal_rows_count_each(spark):
    rows = [(7, [1.0, 2.0])] * 90 + [(7, [1.0, 1.0])] * 3 + [(50, [1.0, 1.0])] * 2 + [(100, [0.5, 2.0]), (9, [1.0, 2.0])]
    got = top_k(_frame(spark, rows).repartition(4), shard_rows=10)
    assert sorted(tuple(r) for r in got.collect()) == _brute(rows, 50, 5)


def test_shards_do_not_depend_on_places_in_the_input(spark):
    plan = top_k(_frame(spark, [(50, [1.0]), (3, [2.0])]))._jdf.queryExecution().toString()
    assert "monotonically_increasing_id" not in plan


def test_few_and_no_vectors(spark):
    assert top_k(_frame(spark, [])).collect() == []
    assert top_k(_frame(spark, [(50, [1.0])])).collect() == []
    rows = [(50, [1.0]), (3, [-1.0]), (4, [2.0])]
    assert sorted(tuple(r) for r in top_k(_frame(spark, rows)).collect()) == _brute(rows, 50, 5)


def test_scores_beyond_a_long_count_as_the_nearest(spark):
    rows = [(50, [1e12, 1e12]), (1, [1e12, 1e12]), (2, [2e12, 2e12]), (3, [-2e12, -2e12])]
    got = sorted(tuple(r) for r in top_k(_frame(spark, rows)).collect())
    assert [r[2] for r in got] == [1, 2, 3]
    assert [r[3] for r in got] == [2**63 - 1, 2**63 - 1, -(2**63)]


@settings(deadline=None, max_examples=200)
@given(st.integers(1, 60), st.integers(1, 6), st.integers(1, 4), st.integers(0, 2**32 - 1))
def test_max_score_finds_the_best(n, width, k, seed):
    rng = np.random.default_rng(seed)
    postings = rng.integers(-4, 5, (width, n))
    query = rng.integers(-4, 5, width)
    ids = rng.permutation(n)
    own = int(rng.integers(0, n + 2))
    found, scores = max_score(postings, ids, postings.min(axis=1), postings.max(axis=1), query, own, k)
    want = sorted((-int(query @ postings[:, j]), int(i)) for j, i in enumerate(ids) if i != own)[:k]
    assert [(-int(s), int(i)) for i, s in zip(found, scores)] == want
