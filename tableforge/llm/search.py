"""Exact top-k inner products by MaxScore over blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LONG = (-(2**63), 2**63 - 1)


def _whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) for each component; null where the vector takes no part."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")),
    )
    return F.when(
        vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    )


def _matrix(vectors: pa.ChunkedArray, width: int, exact: bool) -> np.ndarray:
    """Vectors as columns of a matrix, a row per dimension, short ones filled with zeros."""
    lists = vectors.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((width, len(lengths)), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = values
    return out if exact else out.astype(object)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 8 * k and scores.dtype != object:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    order = sorted(range(len(scores)), key=lambda i: (-int(scores[i]), int(ids[i])))
    return np.array(order[:k], np.int64)


def max_score(
    postings: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray,
    query: np.ndarray, own: int, k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of one shard for one query.

    ``postings[d]`` holds the values of term d, ``low`` and ``high`` their least and greatest.
    A contribution less its least possible value is never negative, so the terms whose
    ranges together can't lift a vector over the k-th best score so far are non-essential. The
    essential postings are summed for all vectors; the others are probed, in order of falling
    bounds, for the vectors that can still reach the threshold.
    """
    least = np.minimum(query * low, query * high)
    most = np.maximum(query * low, query * high)
    order = np.argsort(-(most - least), kind="stable")
    order = order[query[order] != 0]
    rows = np.flatnonzero(ids != own)
    if not len(rows):
        return ids[:0], np.empty(0, np.int64)
    # What the terms from each place on can add at most, and their range.
    tail_most = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])
    tail_range = np.concatenate([np.cumsum((most - least)[order][::-1])[::-1], [0]])
    seed = rows[:: max(1, len(rows) // (16 * k))]
    first = query @ postings[:, seed]
    floor = first[_best(first, ids[seed], k)[-1]] if len(seed) >= k else None
    essential = len(order)
    if floor is not None:
        slack = floor - least[order].sum()
        essential = int(np.argmax(tail_range < slack)) if slack > 0 else len(order)
    partial = np.zeros(postings.shape[1], postings.dtype)
    for d in order[:essential]:
        partial += query[d] * postings[d]
    partial = partial[rows]
    if floor is not None and essential < len(order):
        # The leaders by what is known raise the threshold before the others are probed.
        lead = rows[_best(partial, ids[rows], 4 * k)]
        scores = query @ postings[:, lead]
        floor = max(floor, scores[_best(scores, ids[lead], k)[-1]])
    for place in range(essential, len(order)):
        if floor is not None:
            alive = partial + tail_most[place] >= floor
            if not alive.all():
                rows, partial = rows[alive], partial[alive]
        partial = partial + query[order[place]] * postings[order[place], rows]
    best = _best(partial, ids[rows], k)
    return ids[rows[best]], partial[best]


def top_k(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    every: int = 50,
    k: int = 5,
    scale: int = 256,
    shard_rows: int = 16384,
    block_queries: int = 4096,
) -> DataFrame:
    """The ``k`` highest integer inner products for each vector whose id ``every`` divides.

    Components count as floor(scale * x). Every vector but those with the query's id is a
    candidate. The candidates are dealt into shards by a hash of the row, of equal rows the first ``k``, the queries into
    blocks; each task gets one shard and one block, and MaxScore finds the shard's best
    for each query. The best of the shards are merged by query, k rows per shard each.

    Returns ``query_id``, ``rank`` (int, from 1), ``vec_id``, ``score`` (long); other columns are
    ignored. Equal scores go to the smaller id. Vectors that are null, hold null or non-finite
    components or have no id take no part. A shorter vector is filled up with zeros, so an empty one scores 0.
    Repeated rows are candidates each; an id that occurs more than once asks once, with its
    smallest vector. Scores are exact; one outside the range of a long counts as the nearest long.
    """
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"), _whole_numbers(F.col(embedding), scale).alias("v")
    ).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    queries = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    sizes = rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("asked")
    ).first()
    shards = max(1, -(-sizes["n"] // shard_rows))
    blocks = max(1, -(-sizes["asked"] // block_queries))
    # Rows of one id are split by their vectors, and of equal rows no more than k can be among the best. So
    # a row's shard does not depend on where it was read, and a row that is run again goes to the same one.
    kept = rows.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("times"))
    left = (
        kept.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .select("id", "v", F.pmod(F.xxhash64("id", "v", "copy"), F.lit(shards)).alias("shard"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    right = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    )

    def search(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if len(candidates) and len(asked):
            sides = [t["v"].combine_chunks() for t in (candidates, asked)]
            width = max(int(np.diff(s.offsets.to_numpy()).max()) for s in sides)
            values = [s.flatten().to_numpy(zero_copy_only=False) for s in sides]
            top = [max(int(v.max(initial=0)), -int(v.min(initial=0))) for v in values]
            exact = top[0] * top[1] * max(width, 1) < 2**61
            postings = _matrix(candidates["v"], width, exact)
            wanted = _matrix(asked["v"], width, exact)
            ids = candidates["id"].to_numpy()
            if width:
                low, high = postings.min(axis=1), postings.max(axis=1)
            else:
                low = high = np.zeros(0, np.int64)
            for i, own in enumerate(asked["id"].to_numpy()):
                if exact:
                    found, scores = max_score(postings, ids, low, high, wanted[:, i], own, k)
                else:
                    other = np.flatnonzero(ids != own)
                    scores = np.array([min(max(int(s), _LONG[0]), _LONG[1]) for s in wanted[:, i] @ postings[:, other]])
                    best = _best(scores, ids[other], k)
                    found, scores = ids[other][best], scores[best]
                out += [(int(own), int(f), int(s)) for f, s in zip(found, scores, strict=True)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        names = ("query_id", "vec_id", "score")
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    found = (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInArrow(search, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


TOP_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM vectors q, vectors c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
