"""Exact phrases and terms close together, from a positional inverted index of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tableforge.llm.texts import ascii_lower, stored

# Fixed value: what lies between two words; words are ASCII letters and digits and all beyond ASCII.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def build_index(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "phrase-index"
) -> DataFrame:
    """The positional index of whole texts, written to the shared folder.

    A row for each word: ``term``, ``row`` (a number for the document) and ``pos``. The row at a document's first place
    also has ``id`` (its ``doc_id``) and ``n_words``; a document without words has that row alone, with a
    null ``term``. Every task writes the postings of its own documents, sorted by term, so that
    a list's entries lie together in each shard. Building shuffles nothing, and a term that
    makes up a third of the corpus is spread like the documents are. Numbers of documents are given while
    the index is written, and nothing computes them a second time: a task that is run again writes all of
    its shard again. Null texts have no words; A-Z are lower-cased; repeated rows are documents of their own.
    """
    words = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("id"),
        F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), NO_WORD, -1).alias("words"),
    )
    # Only the first and the last part of a split can be empty.
    edges = (F.get("words", F.lit(0)) == "").cast("int") + (
        (F.size("words") > 1) & (F.element_at("words", -1) == "")
    ).cast("int")
    placed = words.select("row", "id", (F.size("words") - edges).alias("n"), F.posexplode("words").alias("pos", "word"))
    first = F.col("pos") == 0
    return stored(
        placed.filter((F.col("word") != "") | first)
        .select(
            F.when(F.col("word") != "", F.col("word")).alias("term"),
            "row",
            "pos",
            F.when(first, F.col("id")).alias("id"),
            F.when(first, F.col("n").cast("long")).alias("n_words"),
        )
        .sortWithinPartitions(F.xxhash64("term")),
        label,
    )


def documents_of(index: DataFrame) -> DataFrame:
    """``row, id, n_words`` of every document of an index."""
    return index.filter("n_words IS NOT NULL").select("row", "id", "n_words")


def _items(items: DataFrame) -> DataFrame:
    """``item, n, terms`` of every item with words; terms have their places ``off`` from 0 on."""
    place = F.row_number().over(W.partitionBy("row").orderBy("pos")) - 1
    return (
        items.filter("term IS NOT NULL")
        .select(F.col("row").alias("item"), "term", place.alias("off"))
    )


def _known_postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, row, pos`` of the terms asked for, written apart: all later steps read these alone."""
    wanted = terms.select("term").distinct()
    return stored(index.select("term", "row", "pos").join(wanted, "term", "left_semi"), "phrase-postings")


def _rarest_two(terms: DataFrame, postings: DataFrame, window: int) -> DataFrame:
    """The two rarest terms of every window of every item, without repeats: ``item, o1, t1, o2, t2``.

    A window of one word has a null second term. Equally rare terms go by place.
    """
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    # A term that no document has comes first: its windows end with the first join.
    ranked = terms.join(counts, "term", "left").select(
        "item", "off", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "term").alias("t")
    )
    # Every window that a term lies in, by the window's first place, and of each the two rarest.
    last = F.max("off").over(W.partitionBy("item"))
    starts = F.sequence(
        F.greatest(F.col("off") - (window - 1), F.lit(0)),
        F.least(F.col("off"), F.greatest(F.col("last") - (window - 1), F.lit(0))),
    )
    spread = ranked.withColumn("last", last).select("item", "t", F.explode(starts).alias("start"))
    two = spread.groupBy("item", "start").agg(F.slice(F.array_sort(F.collect_list("t")), 1, 2).alias("two"))
    one, other = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    return two.select(
        "item", one["off"].alias("o1"), one["term"].alias("t1"), other["off"].alias("o2"), other["term"].alias("t2")
    ).distinct()


def phrase_spans(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Where windows of items occur in documents: ``item, row, start, end, off``, ``end`` exclusive.

    ``index`` and ``items`` are indexes by ``build_index``; ``item`` and ``row`` are their row numbers, places those of the
    index. A window is ``window`` consecutive words of an item, or all words of a shorter one. A row is a
    longest stretch of a document that equals a stretch of an item, from its word ``off`` on, and holds a window.

    The list of a window's rarest term is intersected with the list of its second rarest, shifted
    by their distance; what is left are few alignments of an item and a document. Those are intersected with
    the lists of all the item's terms, shifted by their places, and runs of a window's length are
    kept. Rows grow with the lists of the rarest terms; a list is never held in one place. Words
    are compared as texts, not as hashes.
    """
    terms = stored(_items(items), "phrase-terms")
    postings = _known_postings(index, terms)
    pairs = stored(_rarest_two(terms, postings, window), "phrase-pairs")

    lone = pairs.filter("t2 IS NULL").join(postings.withColumnRenamed("term", "t1"), "t1")
    lone = lone.select("item", "row", (F.col("pos") - F.col("o1")).alias("shift"))
    begun = (
        pairs.filter("t2 IS NOT NULL")
        .join(postings.withColumnRenamed("term", "t1"), "t1")
        .select("item", "row", (F.col("pos") - F.col("o1")).alias("shift"), F.col("t2").alias("term"), "o2")
        .withColumn("pos", F.col("shift") + F.col("o2"))
    )
    second = postings.join(pairs.select(F.col("t2").alias("term")).distinct(), "term", "left_semi")
    both = begun.join(second, ["row", "pos", "term"], "left_semi").select("item", "row", "shift")
    aligned = stored(lone.union(both).distinct(), "phrase-alignments")

    here = postings.join(aligned.select("row").distinct(), "row", "left_semi")
    expected = aligned.join(terms, "item").withColumn("pos", F.col("shift") + F.col("off"))
    hits = expected.join(here, ["row", "pos", "term"], "left_semi")
    line = W.partitionBy("item", "row", "shift")
    runs = (
        hits.withColumn("run", F.col("off") - F.row_number().over(line.orderBy("off")))
        .groupBy("item", "row", "shift", "run")
        .agg(F.min("off").alias("off"), F.count("*").alias("n"))
    )
    least = terms.groupBy("item").agg(F.least(F.count("*"), F.lit(window)).alias("least"))
    return (
        runs.join(least, "item")
        .filter("n >= least")
        .select(
            "item", "row",
            (F.col("shift") + F.col("off")).cast("int").alias("start"),
            (F.col("shift") + F.col("off") + F.col("n")).cast("int").alias("end"),
            F.col("off").cast("int").alias("off"),
        )
    )


def near_spans(index: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """Where all different terms of an item lie within ``within`` words, in any order: ``item, row, start``.

    Each row is a stretch of ``within`` places from ``start`` on that holds every term of the item. It must
    hold the rarest one, so only places around that term's list are looked at: the other lists
    are shifted by each distance and intersected with it, term by term counted once. An item without words
    is found nowhere.
    """
    terms = stored(_items(items).select("item", "term").distinct(), "near-terms")
    postings = _known_postings(index, terms)
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    ranked = terms.join(counts, "term", "left").select("item", "term", F.coalesce("df", F.lit(0)).alias("df"))
    rarest = ranked.groupBy("item").agg(
        F.min(F.struct("df", "term"))["term"].alias("term"), F.count("*").alias("n")
    )
    # The stretches that the rarest term lies in, each once.
    stretches = lambda: F.explode(F.sequence(F.col("pos") - (within - 1), F.col("pos"))).alias("start")
    held = rarest.join(postings, "term").select("item", "n", "row", stretches()).distinct()
    found = held.join(terms, "item").join(
        postings.join(held.select("row").distinct(), "row", "left_semi").select("row", "term", stretches()).distinct(),
        ["row", "term", "start"],
        "left_semi",
    )
    return (
        found.groupBy("item", "row", "start", "n")
        .agg(F.count("*").alias("terms"))
        .filter("terms = n")
        .select("item", "row", "start")
    )


def _covered(spans: DataFrame) -> DataFrame:
    """How many places of each row its spans cover: ``row, n_hit``."""
    by_start = W.partitionBy("row").orderBy("start", "end")
    reached = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.col("end") - F.greatest(F.col("start"), F.coalesce(reached, F.col("start")))
    return (
        spans.select("row", "start", "end").distinct()
        .select("row", F.greatest(fresh, F.lit(0)).alias("fresh"))
        .groupBy("row")
        .agg(F.sum("fresh").cast("long").alias("n_hit"))
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """Which words of documents repeat windows of benchmark items.

    Returns per document ``doc_id``, ``n_words``, ``n_hit`` (its words inside an occurrence of a window),
    ``n_items`` and ``items`` (the ids of items with occurring windows, as sorted strings). A document without text or words has
    none of them. Repeated documents are judged each by itself; items of one id are one item with
    several texts, and an item without an id has the empty string. Other columns are ignored; an empty
    benchmark hits nothing.
    """
    index = build_index(docs, doc_id, text)
    items = build_index(benchmark, item_id, item_text, "phrase-items")
    spans = stored(phrase_spans(index, items, window).select("item", "row", "start", "end"), "phrase-spans")
    names = documents_of(items).select(
        F.col("row").alias("item"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name")
    )
    # Each item of a document once, before its name is looked up.
    named = (
        spans.select("row", "item").distinct().join(names, "item")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("name")).alias("items"))
    )
    found = _covered(spans).join(named, "row")
    none = F.array().cast("array<string>")
    return documents_of(index).join(found, "row", "left").select(
        F.col("id").alias(doc_id),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
    )


def decontamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    joined: Column = F.array_join("items", ",")
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(joined, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


# Windows as lists of words: the documents' by every place, joined to the items'.
PHRASE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, w[s : s + least(len(w), 10) - 1] AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM windows),
places AS (
  SELECT r, s, n, w[s : s + n - 1] AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT p.r, p.s, p.n, x.item FROM places p JOIN windows x ON p.g = x.g),
hit AS (SELECT r, count(DISTINCT place) AS n_hit
        FROM (SELECT r, unnest(range(s, s + n)) AS place FROM (SELECT DISTINCT r, s, n FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit,
       coalesce(named.n_items, 0) AS n_items, sha256(coalesce(named.items, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN named ON d.r = named.r
"""
