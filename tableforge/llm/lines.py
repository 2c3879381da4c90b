"""Line dedup: lines that many documents share stay in one of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableforge.llm.texts import UPPER, ascii_lower, lines_of, stored, stripped, wide_hash


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    carry: Sequence[str] = (),
) -> DataFrame:
    r"""Drop the lines that at least ``min_docs`` documents share, but for the largest id's.

    Lines are exploded, normalised (blanks stripped at both ends, A-Z in lower case) and hashed;
    distinct documents are counted per hash of a line with at least ``min_chars`` code points.
    A text gets its other lines back by position, joined by ``\n``.

    Returns one row per document: ``doc_id``, ``n_lines`` and ``n_dropped`` (long),
    ``kept_text``, and ``carried``, a struct of the ``carry`` columns. Other columns are ignored.

    A null or empty text is one empty line. Rows with the same id count as one document and lose
    the same lines; a null id is an id of its own, smaller than all others. A line that
    occurs several times in its last document keeps all its copies there. An empty table gives
    an empty result.
    """
    rows = docs.select(
        F.col(doc_id).alias("id"),
        F.col(text).alias("text"),
        F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("carried"),
    ).withColumn("th", F.xxhash64("text"))

    one, two = wide_hash(F.col("key"))
    lines = (
        rows.select("id", "th", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .filter(F.length("line") >= min_chars)
        .select("id", "th", "pos", ascii_lower(stripped(F.col("line"))).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("id", "th", "pos", one.alias("h1"), two.alias("h2"))
    )
    # Counted in two steps, first by line and document, so that a line of all documents is
    # spread over the tasks by its documents and arrives as one row per task.
    # Written, so that the join below is one of two plain shuffles: a partition that holds the
    # many rows of such a line is then split at run time.
    shared = stored(
        lines.groupBy("h1", "h2")
        .agg(F.count_distinct(F.struct("id")).alias("docs"), F.max(F.struct("id")).alias("last"))
        .filter(F.col("docs") >= min_docs)
        .select("h1", "h2", F.col("last.id").alias("last")),
        "shared-lines",
    )
    dropped = (
        lines.join(shared, ["h1", "h2"])
        .filter(~F.col("id").eqNullSafe(F.col("last")))
        .groupBy(F.col("id").alias("of"), F.col("th").alias("of_th"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return (
        rows.join(
            dropped, F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")), "left"
        )
        .withColumn("lines", lines_of(F.col("text")))
        .withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
        .select(
            F.col("id").alias(doc_id),
            F.size("lines").cast("long").alias("n_lines"),
            F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
            F.when(F.col("gone").isNull(), F.coalesce("text", F.lit("")))
            .otherwise(F.array_join(F.transform("kept", lambda i: F.col("lines")[i]), "\n"))
            .alias("kept_text"),
            "carried",
        )
    )


def with_lines_deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the texts that ``dedup_lines`` keeps; a null text stays null.

    A column ``n_chars`` is set to the length of a text that has lost lines.
    """
    out = dedup_lines(docs, doc_id, text, carry=docs.columns, **options)
    columns = []
    for field in docs.schema.fields:
        value = F.col(f"carried.`{field.name}`")
        if field.name == text:
            value = F.when(value.isNotNull(), F.col("kept_text"))
        elif field.name == "n_chars":
            value = F.when(F.col("n_dropped") > 0, F.length("kept_text")).otherwise(value).cast(field.dataType)
        columns.append(value.alias(field.name))
    return out.select(*columns)


def line_digest(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


LINE_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{UPPER}', '{UPPER.lower()}') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, shared.key IS NOT NULL AND keyed.doc_id <> shared.last AS gone
  FROM keyed LEFT JOIN shared ON keyed.key = shared.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
