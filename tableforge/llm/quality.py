"""Quality rules: plain rules, then the likelihood ratio of a trusted and a raw n-gram model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableforge.llm.texts import constant, lines_of, stored, stripped, words_of

BUCKETS = 1 << 16
# A log ratio of 1.0 as a whole number; whole numbers add up alike in any order.
UNIT = 1 << 16
THRESHOLD = -0.2
# Documents from which the trusted model is learnt, at most.
TRUSTED_DOCS = 20_000


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _head(array: str | Column, n: Column) -> Column:
    return F.slice(array, 1, F.greatest(n, F.lit(0)))


def _tail(array: str | Column, start: int, n: Column) -> Column:
    return F.slice(array, start, F.greatest(n, F.lit(0)))


def _hash_runs(left: str, right: str, step: int) -> Column:
    """A hash of ``left[i]`` and ``right[i + step]`` for every place i where ``right`` has one."""
    n = F.size(right) - step
    return F.zip_with(_head(left, n), _tail(right, step + 1, n), lambda a, b: F.xxhash64(a, b))


def _with_hashes(docs: DataFrame) -> DataFrame:
    """Adds ``h`` and ``pairs``, hashes of its words and word pairs, and ``grams``, both together."""
    return (
        docs.withColumn("h", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)))
        .withColumn("pairs", _hash_runs("h", "h", 1))
        .withColumn("grams", F.concat("h", "pairs"))
    )


def _gram_rows(df: DataFrame, words: str = "words") -> DataFrame:
    """A row for every word of an array column: ``gram``, its hash, and ``pair``, that with the next word, or null.

    These are the n-grams of ``_with_hashes``, one by one in compiled code. A row without words stays, with nulls.
    """
    rest = [c for c in df.columns if c != words]
    following = df.select(*rest, words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("next"))
    zipped = following.select(*rest, F.explode_outer(F.arrays_zip(F.col(words), F.col("next"))).alias("z"))
    word, after = F.col("z")[words], F.col("z")["next"]
    return zipped.select(
        *rest,
        word.alias("word"),
        F.when(word.isNotNull(), F.xxhash64(word)).alias("gram"),
        F.when(after.isNotNull(), F.xxhash64(F.xxhash64(word), F.xxhash64(after))).alias("pair"),
    )


def train(
    docs: DataFrame,
    trusted: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    prior: float = 1.0,
    trusted_docs: int = TRUSTED_DOCS,
) -> DataFrame:
    """The log ratio of each bucket: ``bucket``, ``ratio`` (long, in units of 1/65536).

    Words and word pairs of all documents are hashed into ``buckets`` and counted for the raw model;
    those of at most ``trusted_docs`` documents whose id ``trusted`` holds, the ones with the smallest
    hashes of their ids, are counted for the trusted model too. ``prior`` is added to each count. Where
    those have no words, or there are none, all ratios are 0: the rules alone decide.
    The ids chosen are few, whatever the corpus, and go to all tasks; the counts are
    summed in each task, so no text and only a row per bucket and task is shuffled.
    """
    known = (
        trusted.select(F.col(doc_id).alias("known")).filter("known IS NOT NULL").distinct()
        .orderBy(F.xxhash64("known"), "known")
        .limit(trusted_docs)
    )
    marked = docs.select(F.col(doc_id).alias("id"), words_of(F.col(text)).alias("words")).join(
        F.broadcast(known), F.col("id") == F.col("known"), "left"
    )
    grams = (
        _gram_rows(marked.select(F.col("known").isNotNull().cast("long").alias("good"), "words"))
        .select("good", F.explode(F.array(_bucket(F.col("gram"), buckets), _bucket(F.col("pair"), buckets))).alias("bucket"))
        .filter("bucket IS NOT NULL")
    )
    counts = stored(
        grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")), "quality-counts"
    )
    sums = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    if not sums["good"]:
        # Nothing is known of trusted documents, so nothing speaks against any.
        return counts.select("bucket", F.lit(0).cast("long").alias("ratio"))
    smooth = prior * buckets
    ratio = F.log((F.col("good") + prior) / ((sums["good"] or 0) + smooth)) - F.log(
        (F.col("raw") + prior) / ((sums["raw"] or 0) + smooth)
    )
    return counts.select("bucket", F.round(ratio * UNIT).cast("long").alias("ratio"))


def quality(
    docs: DataFrame,
    model: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    min_words: int = 10,
    max_repeats: int = 20,
) -> DataFrame:
    """The rules and the verdict for every document, in one pass; only their numbers are shuffled.

    Returns ``doc_id``; ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (long); ``base_failed``; ``kept``; ``ratio``, the mean log ratio per
    n-gram (double, null without words). A document is kept unless a rule fails it or its
    mean log ratio is below ``threshold``. ``model`` has at most one row for each of
    ``buckets``; it is held as an array, buckets it lacks count 0.

    A null or blank text has no words and fails the rules. Rows are judged each by itself,
    so repeated rows give repeated results. Other columns are ignored.
    """
    table = np.zeros(buckets, np.int64)
    # At most ``buckets`` rows, whatever the corpus.
    for row in model.filter(F.col("bucket").between(0, buckets - 1)).collect():
        table[row["bucket"]] = row["ratio"]
    ratios = constant(table)

    body = F.coalesce(F.col("text"), F.lit(""))
    real_lines = F.filter(lines_of(F.col("text")), lambda x: stripped(x) != "")
    staged = _with_hashes(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    )
    staged = staged.select(
        "row",
        "id",
        "h",
        words_of(F.col("text")).alias("words"),
        (F.size(F.split(body, "[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        real_lines.alias("real_lines"),
    )
    # A hash of the five words from each place on.
    following = [F.slice("h", i, F.greatest(F.size("h"), F.lit(1))).alias(f"h{i}") for i in range(2, 6)]
    zipped = staged.select("*", *following).withColumn(
        "five", _head(F.arrays_zip("h", "h2", "h3", "h4", "h5"), F.size("h") - 4)
    )
    staged = zipped.withColumn("windows", F.transform("five", lambda w: F.xxhash64(w))).drop(
        "five", "h2", "h3", "h4", "h5"
    )
    # The places of windows found twice or more: neighbours in order of their hash.
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    staged = staged.withColumn("by_hash", F.when(twice, placed))
    n = F.size("by_hash")
    staged = staged.withColumn(
        "same",
        F.zip_with(_head("by_hash", n - 1), _tail("by_hash", 2, n - 1), lambda a, b: a["w"] == b["w"]),
    )
    edge = F.array(F.lit(False))
    again = F.zip_with(F.concat(edge, "same"), F.concat("same", edge), lambda a, b: a | b)
    marked = F.zip_with("by_hash", again, lambda x, m: F.when(m, x["i"]))
    places = F.array_sort(F.array_compact(marked))
    staged = staged.withColumn("places", places)
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    judged = staged.select(
        "row",
        "id",
        "n_symbols",
        (F.size("real_lines") - F.size(F.array_distinct("real_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "words",
    )
    # The rows of a document follow each other in one task, which adds them up; a row per document is shuffled.
    value = lambda g: F.coalesce(F.get(ratios, _bucket(F.col(g), buckets)), F.lit(0))
    n_words = F.count("word")
    n_grams = F.greatest(2 * n_words - 1, F.lit(0))
    scored = (
        _gram_rows(judged)
        .groupBy("row", "id", "n_symbols", "n_dup_lines", "n_repeat_words")
        .agg(
            n_words.alias("n_words"),
            F.coalesce(F.sum(F.length("word")), F.lit(0)).cast("long").alias("word_chars"),
            F.when(n_grams > 0, F.sum(value("gram") + value("pair")) / F.lit(float(UNIT)) / n_grams).alias("ratio"),
        )
        .select(
            F.col("id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio"
        )
    )
    failed = (F.col("n_words") < min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeats
    )
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("ratio") >= threshold, F.lit(False))
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that all their labels call good and none calls toxic."""
    return (
        labels.filter("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        .filter((F.col("q") == 1) & (F.col("t") == 0))
        .select("doc_id")
    )


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(docs, train(docs, trusted_ids(labels))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "ratio",
    )
