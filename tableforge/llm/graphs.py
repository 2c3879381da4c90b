"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableforge.llm.texts import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """The smallest id reachable from each linked id: ``id``, ``component``, without the smallest.

    ``links`` has two long columns. Large-star and small-star steps alternate until nothing
    changes, which takes about log(n) rounds. Each step takes the smallest neighbour
    by a partial aggregate and joins it back, so a node of any degree is spread over tasks. Each
    round is written, and its files are all that the next one needs.
    """
    a, b = links.columns
    edges = stored(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    state = _state(edges)
    while True:
        # Large star: every larger neighbour of a node is tied to the node's smallest one.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        )
        # Small star: every smaller neighbour of a node, and the node, is tied to the smallest one.
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        tied = large.join(least, "u")
        edges = stored(
            tied.select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
            .filter("u <> v")
            .distinct(),
            "stars",
        )
        now = _state(edges)
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now
