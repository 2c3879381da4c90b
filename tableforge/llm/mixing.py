"""Mixing sources to target weights, by Sainte-Lague apportionment of equal blocks of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableforge.llm.texts import stored, words_of

SHARD_WORDS = 250_000
RESOLUTION = 200
SEED = 17


def apportion(parties: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Hand out ``seats`` within each group of ``by`` by the highest quotients of ``votes``.

    The quotients are votes / (k + 1/2) for the seats k = 0, 1, ...; equal quotients go to the
    first in ``order``. Adds ``won`` (long). Only the quotients near the last winning one
    are listed: for m parties, every quotient of at least total / (seats - m/2) wins and none under
    total / (seats + m/2), which leaves about two candidates per party, however many seats.
    """
    group = Window.partitionBy(*by)
    total, parties_in = F.sum("votes").over(group), F.count("*").over(group)
    sized = parties.withColumn("_total", total).withColumn("_m", parties_in)
    low = F.when(F.col("seats") > F.col("_m") / 2, F.col("_total") / (F.col("seats") - F.col("_m") / 2))
    high = F.col("_total") / (F.col("seats") + F.col("_m") / 2)
    some = (F.col("votes") > 0) & (F.col("seats") > 0)
    listed = sized.withColumn(
        "_sure",
        F.when(some & low.isNotNull(), F.greatest(F.lit(0), F.floor(F.col("votes") / low + 0.5) - 1))
        .otherwise(F.lit(0))
        .cast("long"),
    ).withColumn(
        "_most", F.when(some, F.floor(F.col("votes") / high + 0.5).cast("long") + 1).otherwise(F.lit(0))
    )
    left = listed.withColumn("_left", F.col("seats") - F.sum("_sure").over(group))
    quotients = left.filter(F.col("_most") > F.col("_sure")).select(
        *by, *order, "votes", "_left", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_k")
    )
    best = Window.partitionBy(*by).orderBy(
        F.desc(F.col("votes") / (F.col("_k") + 0.5)), *[F.col(c).asc_nulls_first() for c in order], "_k"
    )
    won = (
        quotients.withColumn("_rank", F.row_number().over(best))
        .filter(F.col("_rank") <= F.col("_left"))
        .groupBy(*[F.col(c).alias(f"_{c}") for c in (*by, *order)])
        .agg(F.count("*").alias("_more"))
    )
    same = None
    for c in (*by, *order):
        part = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = part if same is None else same & part
    return left.join(won, same, "left").select(
        *parties.columns, (F.col("_sure") + F.coalesce("_more", F.lit(0))).cast("long").alias("won")
    )


def _place(doc_id: Column) -> Column:
    """A seeded number of 60 bits for an id; it decides shard and order."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Words each source should give: ``source``, ``source_size``, ``target`` (double).

    ``share`` of all words is dealt out by weight, at most ``most`` times its size to a source,
    and what it can't take to the others: ``target = least(most * size, weight * level)``,
    with the level at which the targets add up. Sources are few beside documents: their
    one-row-each totals pass through one task, nothing else does.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (position % len(weights) + 1).cast("int"))
    by_need = Window.orderBy("need", F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_need.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("need", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    size = F.col("source_size").cast("double")
    level = (
        F.sum(size).over(whole) * share
        - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double")
    ) / F.sum("weight").over(rest).cast("double")
    return (
        sources.withColumn("weight", weight)
        .withColumn("need", most * size / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(whole))
        .select("source", "source_size", F.least(most * size, F.col("weight") * F.col("level")).alias("target"))
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    shard_words: int = SHARD_WORDS,
    resolution: int = RESOLUTION,
) -> DataFrame:
    """How many words of each document the mix takes.

    The size of a document is its number of words. Sources by code point, null last, get the
    weights in turn. Blocks are equal: a ``resolution``-th of the smallest target, one to 1024
    words. Sainte-Lague apportionment gives each source its number of blocks and, within it, each
    shard of about ``shard_words`` words, so a source of any share is spread over tasks. A shard's documents
    stand in seeded order on a line; its blocks are taken from the start of the line, and again from
    the start once the line is used up, so a document's words are taken in one run at the head of
    its text, and no document more than ``most`` times.

    Returns ``doc_id``, ``source``, ``print`` (a hash of the text), ``size`` and ``source_size`` (long),
    ``target`` (double) and ``taken`` (long) for every row; other columns are ignored. A null text has no words and gives
    none. A null id is one id like any other; rows with the same id stand next to each other.
    A source without words has target 0. An empty table gives an empty result.
    """
    sizes = stored(
        docs.select(
            F.col(doc_id).alias("id"),
            F.col(source).alias("source"),
            F.xxhash64(text).alias("print"),
            F.size(words_of(F.col(text))).cast("long").alias("size"),
            _place(F.col(doc_id)).alias("place"),
        ),
        "mix-sizes",
    )
    wanted = targets(sizes, weights, share, most)
    everywhere = Window.partitionBy("all")
    finest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everywhere)
    block = F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(finest / resolution))).cast("long")
    parties = (
        wanted.withColumn("all", F.lit(0))
        .withColumn("block", F.coalesce(block, F.lit(1)))
        .withColumn("votes", F.col("target"))
        .withColumn(
            # The targets add up to this; their own sum would depend on its order.
            "seats",
            F.floor(
                F.sum("source_size").over(everywhere).cast("double") * min(share, most) / F.col("block") + 0.5
            ).cast("long"),
        )
    )
    sources = stored(
        apportion(parties, ["all"], ["source"]).select(
            F.col("source").alias("of"),
            "source_size",
            "target",
            "block",
            F.col("won").alias("seats"),
            F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("shards"),
        ),
        "mix-sources",
    )
    placed = sizes.join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "shard", F.col("place") % F.col("shards")
    )
    # Equal rows differ in nothing, so their order on the line does not matter.
    shards = placed.groupBy("source", "shard", "block", "seats").agg(F.sum("size").alias("votes"))
    quotas = apportion(shards, ["source"], ["shard"]).select(
        F.col("source").alias("of"),
        F.col("shard").alias("of_shard"),
        F.col("votes").alias("line"),
        # A shard gives whole blocks, and at most all of its words ``most`` times.
        F.least(F.col("won") * F.col("block"), F.floor(F.col("votes") * most)).cast("long").alias("words"),
    )
    on = F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("of_shard"))
    line = Window.partitionBy("source", "shard").orderBy(
        "place", F.col("id").asc_nulls_first(), "size", "print"
    ).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("size").over(line)
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("words") % F.col("line") - F.col("end") + F.col("size")))
    return (
        placed.drop("of")
        .withColumn("end", end)
        .join(quotas, on)
        .select(
            F.col("id").alias(doc_id),
            F.col("source").alias(source),
            "print",
            "size",
            "source_size",
            "target",
            F.when(F.col("line") > 0, F.expr("words div line") * F.col("size") + part)
            .otherwise(F.lit(0))
            .cast("long")
            .alias("taken"),
        )
    )


def mixed_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often as ``mix`` takes it.

    Whole copies come first; what is left of the words taken is a row with the head of the text, cut
    after its last word. Documents of which nothing is taken are not in the mix. A column ``n_chars`` is
    set to the length of the text in a row that is cut. Equal rows share their words evenly.
    """
    takes = (
        mix(docs, doc_id, text, source, **options)
        .groupBy(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), F.col("print").alias("_print"))
        .agg(F.expr("sum(taken) div count(*)").alias("_taken"), F.first("size").alias("_size"))
        .filter("_taken > 0")
    )
    held = docs.select(F.struct("*").alias("doc"))
    same = (
        F.col(f"doc.`{doc_id}`").eqNullSafe(F.col("_id"))
        & F.col(f"doc.`{source}`").eqNullSafe(F.col("_source"))
        & (F.xxhash64(F.col(f"doc.`{text}`")) == F.col("_print"))
    )
    copies = held.join(takes, same).select(
        "doc", F.expr("_taken % _size").cast("int").alias("_rest"),
        F.explode(F.expr("sequence(1L, cast(ceil(_taken / _size) as bigint))")).alias("_copy"),
        F.expr("_taken div _size").alias("_whole"),
    )
    body = F.col(f"doc.`{text}`")
    head = F.array_join(
        F.slice(F.regexp_extract_all(body, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("_rest")), ""
    )
    cut = copies.withColumn("_text", F.when(F.col("_copy") <= F.col("_whole"), body).otherwise(head))
    columns = []
    for field in docs.schema.fields:
        value = F.col(f"doc.`{field.name}`")
        if field.name == text:
            value = F.col("_text")
        elif field.name == "n_chars":
            value = F.when(F.col("_copy") <= F.col("_whole"), value).otherwise(F.length("_text")).cast(field.dataType)
        columns.append(value.alias(field.name))
    return cut.select(*columns)


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _apportion_sql(parties: str, by: str, order: str) -> str:
    """The same apportionment in SQL."""
    return f"""
    SELECT p.*, p.sure + coalesce(w.more, 0) AS won FROM {parties}_left p LEFT JOIN (
      SELECT {by} AS g, {order} AS o, count(*) AS more FROM (
        SELECT *, row_number() OVER (PARTITION BY {by}
          ORDER BY votes / (k + 0.5::DOUBLE) DESC, {order} ASC NULLS FIRST, k) AS rank
        FROM (SELECT *, unnest(range(sure, most)) AS k FROM {parties}_left))
      WHERE rank <= rest GROUP BY ALL) w
    ON w.g IS NOT DISTINCT FROM p.{by} AND w.o IS NOT DISTINCT FROM p.{order}"""


def _left_sql(parties: str, by: str) -> str:
    return f"""
    SELECT *, seats - sum(sure) OVER (PARTITION BY {by}) AS rest FROM (
      SELECT *,
        CASE WHEN votes > 0 AND seats > m / 2.0::DOUBLE
             THEN greatest(0, floor(votes / (total / (seats - m / 2.0::DOUBLE)) + 0.5::DOUBLE) - 1)::BIGINT
             ELSE 0 END AS sure,
        CASE WHEN votes > 0 AND seats > 0
             THEN floor(votes / (total / (seats + m / 2.0::DOUBLE)) + 0.5::DOUBLE)::BIGINT + 1 ELSE 0 END AS most
      FROM (SELECT *, (sum(votes) OVER (PARTITION BY {by}))::DOUBLE AS total,
                   count(*) OVER (PARTITION BY {by}) AS m FROM {parties}))"""


MIX_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place
  FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sizes GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM weighed)::DOUBLE
             - 2.0::DOUBLE * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST)),
wanted AS (
  SELECT 0 AS one, source, source_size,
         least(2.0::DOUBLE * source_size, weight * (SELECT max(level) FROM levels)) AS target FROM levels),
parties AS (
  SELECT *, target AS votes, floor((SELECT sum(source_size) FROM wanted)::DOUBLE * 1.5::DOUBLE / block + 0.5::DOUBLE)::BIGINT AS seats
  FROM (SELECT *, greatest(1, least(1024, floor((SELECT min(target) FROM wanted WHERE target > 0) / {RESOLUTION})))::BIGINT
          AS block FROM wanted)),
parties_left AS ({_left_sql("parties", "one")}),
sources AS (
  SELECT source, source_size, target, block, won AS source_seats,
         greatest(1, ceil(source_size / {SHARD_WORDS}.0::DOUBLE))::BIGINT AS shards
  FROM ({_apportion_sql("parties", "one", "source")})),
placed AS (
  SELECT z.*, s.source_size, s.target, s.block, s.source_seats, z.place % s.shards AS shard
  FROM sizes z JOIN sources s ON z.source IS NOT DISTINCT FROM s.source),
shards AS (
  SELECT source, shard, block, source_seats AS seats, sum(size)::BIGINT AS votes FROM placed GROUP BY ALL),
shards_left AS ({_left_sql("shards", "source")}),
quotas AS (
  SELECT source, shard, votes AS line, least(won * block, 2 * votes)::BIGINT AS words
  FROM ({_apportion_sql("shards", "source", "shard")}))
SELECT p.doc_id, p.size, p.source_size, p.target,
       CASE WHEN line > 0 THEN (words // line) * size
            + least(size, greatest(0, words % line - "end" + size)) ELSE 0 END::BIGINT AS taken
FROM (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id NULLS FIRST, size
                                ROWS UNBOUNDED PRECEDING)::BIGINT AS "end" FROM placed) p
JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard
"""
