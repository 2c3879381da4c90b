"""MinHash near-dedup with tensored banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableforge.llm.graphs import components
from tableforge.llm.texts import UPPER, mixed, sequence_hashes, stored, word_hashes

HALVES = 12
DEPTH = 3
PERCENT = 80
_FAN = 256
# Documents compared with each other at a time: larger packs send each set to fewer of them.
_PACK = 256


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's runs of ``words`` words, sorted.

    A-Z count as a-z. A text with fewer words has one run, its whole sequence; one without
    words has none.
    """
    found = word_hashes((text or "").encode().lower())
    if not len(found):
        return found
    return np.unique(sequence_hashes(found, min(words, len(found))))


def _minima(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash function."""
    step = max(1, (1 << 18) // len(factors))
    out = np.full(len(factors), np.uint64(2**64 - 1))
    for start in range(0, len(shingles), step):
        part = shingles[start : start + step]
        values = np.multiply.outer(factors, part)
        values ^= part >> np.uint64(29)
        np.minimum(out, values.min(axis=1), out=out)
    return out


def _signer(words: int, halves: int, depth: int):
    rng = np.random.default_rng(20240917)
    factors = rng.integers(0, 2**63, 2 * halves * depth, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    seeds = rng.integers(0, 2**63, 2, dtype=np.int64).astype(np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes, prints = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
            keys = np.zeros((n, 2 * halves), np.uint64)
            for i, text in enumerate(batch.column(1)):
                found = shingle_set(text.as_py(), words)
                sizes[i] = len(found)
                if len(found):
                    for k in range(2):
                        prints[k, i] = mixed(found ^ seeds[k]).sum(dtype=np.uint64)
                    minima = _minima(found, factors).reshape(2 * halves, depth)
                    keys[i] = sequence_hashes_of_rows(minima)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array(prints[0].view(np.int64)),
                    pa.array(prints[1].view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(n + 1, dtype=np.int32) * 2 * halves), pa.array(keys.view(np.int64).ravel())
                    ),
                ],
                ["id", "n", "f1", "f2", "halves"],
            )

    return sign


def sequence_hashes_of_rows(rows: np.ndarray) -> np.ndarray:
    """One hash per row of a matrix."""
    total = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + column)
    return total


def _set_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return rows


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shingles = np.frombuffer(data, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(shingles), i, np.int64)), pa.array(shingles)], ["id", "shingle"]
            )


def _lone_shingles(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """How many shingles of each of these documents none of the others has: ``of``, ``lone``."""
    return (
        sets.join(ids, F.col("id") == F.col("rep"), "left_semi")
        .mapInArrow(_exploded, "id long, shingle long")
        .groupBy("shingle")
        .agg(F.count("*").alias("holders"), F.min("id").alias("of"))
        .filter("holders = 1")
        .groupBy("of")
        .agg(F.count("*").alias("lone"))
    )


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(one, two)
    at[at == len(one)] = 0
    both = int((one[at] == two).sum())
    return 100 * both >= percent * (len(one) + len(two) - both)


def _comparer(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, centres = None, []
        for batch in batches:
            found = []
            for centre, salt, own, member, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (centre, salt) != held:
                    held, centres = (centre, salt), []
                shingles = np.frombuffer(data, np.uint64)
                if own:
                    centres.append(shingles)
                    continue
                if any(_similar(other, shingles, percent) for other in centres):
                    found.append((centre, member))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

    return compare


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Each b goes to its a, whose set is there once for every 256 partners: a centre of any
    size is spread over tasks, and one set at a time is held against it.
    """
    fans = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / _FAN).cast("int").alias("fans")), "near-fans")
    to_centre = pairs.join(fans, "a").select(
        F.col("b").alias("of"), F.col("a").alias("centre"),
        F.pmod(F.xxhash64("b"), F.col("fans")).cast("int").alias("salt"), F.lit(False).alias("own"),
    )
    centres = fans.select(
        F.col("a").alias("of"), F.col("a").alias("centre"),
        F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("salt"), F.lit(True).alias("own"),
    )
    return (
        sets.join(to_centre.union(centres), F.col("id") == F.col("of"))
        .select("centre", "salt", "own", "id", "shingles")
        .repartition("centre", "salt")
        .sortWithinPartitions("centre", "salt", F.desc("own"))
        .mapInArrow(_comparer(percent), "a long, b long")
    )


def _candidates(halves: int, percent: int):
    names = ("rep", "n", "label", "lone")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packs, members, partners = [], [], []
            for row in batch.to_pylist():
                sides = []
                for side in (row["left"], row["right"]):
                    columns = [np.array([m[c] for m in side], np.int64) for c in names]
                    sides.append((*columns, np.array([m["halves"] for m in side], np.int64)))
                (rep, n, label, lone, keys), (other, m, other_label, other_lone, other_keys) = sides
                equal = keys[:, None, :] == other_keys[None, :, :]
                # Each pair meets once, at the first key of the first collection that both have.
                met = (equal[..., :halves].argmax(axis=2) == row["i"]) & equal[..., halves:].any(axis=2)
                met &= label[:, None] != other_label[None, :]
                shared = np.minimum.outer(n - lone, m - other_lone)
                met &= (100 + percent) * shared >= percent * np.add.outer(n, m)
                if row["same"]:
                    met &= rep[:, None] < other[None, :]
                for j in np.flatnonzero(met.any(axis=0)):
                    packs.append(row["pack"])
                    members.append(int(other[j]))
                    partners.append(rep[met[:, j]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(packs, pa.int64()), pa.array(members, pa.int64()), pa.array(partners, pa.list_(pa.int64()))],
                ["pack", "of", "partners"],
            )

    return candidates


def _pack_comparer(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, {}
        for batch in batches:
            found = []
            for pack, member, partners, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pack != held:
                    held, known = pack, {}
                shingles = np.frombuffer(data, np.uint64)
                if partners is None:
                    known.setdefault(member, []).append(shingles)
                    continue
                for partner in partners:
                    if any(_similar(other, shingles, percent) for other in known[partner]):
                        found.append((partner, member))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return compare


def _linked_across(open_: DataFrame, sets: DataFrame, halves: int, percent: int) -> DataFrame:
    """The links between documents of different labels: ``a``, ``b``.

    Documents that agree on a key of the first collection are put in packs of about 256. Two packs
    of one key meet in a row, which lists for each document of the second its possible partners in the first:
    those that agree on a key of the second collection too and are not too different in size.
    Then each such document's set goes once to the pack, where its partners' sets are. So of all pairs in a
    large group, none becomes a row but the links.
    """
    rows = open_.select(
        "rep", "n", "label", "lone", "halves", F.posexplode(F.slice("halves", 1, halves)).alias("i", "key")
    )
    parts = rows.groupBy("i", "key").agg(F.ceil(F.count("*") / _PACK).cast("int").alias("parts"), F.count("*").alias("of"))
    packed = stored(
        rows.join(parts.filter("of > 1").drop("of"), ["i", "key"])
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .groupBy("i", "key", "part")
        .agg(F.collect_list(F.struct("rep", "n", "label", "lone", "halves")).alias("members"))
        .withColumn("pack", F.xxhash64("i", "key", "part")),
        "near-packs",
    )
    left = packed.select("i", "key", "pack", "part", F.col("members").alias("left"))
    right = packed.select("i", "key", F.col("part").alias("other"), F.col("members").alias("right"))
    met = stored(
        left.join(right, ["i", "key"])
        .filter("part <= other")
        .select("i", "pack", (F.col("part") == F.col("other")).alias("same"), "left", "right")
        .mapInArrow(_candidates(halves, percent), "pack long, of long, partners array<long>"),
        "near-met",
    )
    used = met.select("pack").distinct()
    own = packed.join(used, "pack", "left_semi").select(
        "pack", F.explode("members.rep").alias("of"), F.lit(None).cast("array<bigint>").alias("partners")
    )
    return (
        sets.join(met.union(own), F.col("id") == F.col("of"))
        .select("pack", "of", "partners", "shingles")
        .repartition("pack")
        .sortWithinPartitions("pack", F.col("partners").isNotNull())
        .mapInArrow(_pack_comparer(percent), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 5,
    percent: int = PERCENT,
    halves: int = HALVES,
    depth: int = DEPTH,
) -> DataFrame:
    """Groups of documents linked by shingle sets of which they share ``percent`` of the union.

    Documents with the same set form a class, of which only the smallest id goes on. Each class has two
    collections of ``halves`` keys, each of ``depth`` MinHash values; a table key combines one of
    either, so halves**2 tables of 2 * depth values need only 2 * halves * depth values. At 80 % two
    classes share no table with a probability of about 0.0004.

    In every table bucket the classes are compared with its smallest id, on their full sets. The
    links' components are formed, and in buckets that still hold several components, neighbours
    in a hashed order and then the other pairs of different components are compared, but
    for those that cannot be similar enough: their sizes, less the shingles that none of the others
    in such buckets has, bound what they share. So every pair that shares a bucket is linked, directly or
    through others, if it is similar enough, while copies that are together cost nothing more.

    Returns ``doc_id``, ``n_shingles`` (long), ``component_id`` (the smallest id reachable) and ``kept``
    (whether that is the document's own). Other columns are ignored. A null or blank text has no
    shingles and is linked with nothing. A row without id is linked with nothing, has no component
    and is kept. Rows with the same id are one document: what is linked with one of
    them is linked with all, and repeated rows give repeated results.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = stored(
        rows.mapInArrow(_signer(words, halves, depth), "id long, n long, f1 long, f2 long, halves array<long>"),
        "near-signatures",
    )
    real = signed.filter("id IS NOT NULL AND n > 0")
    classes = stored(
        real.groupBy("f1", "f2").agg(
            F.min("id").alias("rep"), F.first("n").alias("n"), F.first("halves").alias("halves")
        ),
        "near-classes",
    )

    # Table keys; only buckets with two or more classes go on.
    key = f"""transform(sequence(0, {halves * halves - 1}),
        k -> xxhash64(k, halves[k div {halves}], halves[{halves} + k % {halves}]))"""
    keys = classes.select(F.expr(f"explode({key})").alias("key"), "rep", "n")
    # Written, as every table joined back to many rows of a key: a large partition of a join of two
    # plain shuffles is split at run time.
    full = stored(
        keys.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
        .filter("least <> most")
        .select("key", "least"),
        "near-full",
    )
    buckets = stored(keys.join(full, "key"), "near-buckets")
    members = buckets.select("rep").distinct()
    sets = stored(
        rows.join(members, F.col("id") == F.col("rep"), "left_semi")
        .filter("id IS NOT NULL")
        .mapInArrow(_set_rows(words), "id long, shingles binary"),
        "near-sets",
    )

    # Ids that stand for several classes are one document.
    own = real.join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).select("id", "rep").distinct()
    links = (
        own.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
        .select("id", "a").join(own, "id").select("a", F.col("rep").alias("b")).filter("a <> b")
    )
    tried = stored(
        buckets.filter("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct(),
        "near-pairs",
    )
    links = stored(links.union(_confirmed(tried, sets, percent)), "near-links")
    groups = components(links)

    def mixed_buckets() -> DataFrame:
        """Members of buckets with several components."""
        labelled = buckets.join(groups, F.col("rep") == F.col("id"), "left").select(
            "key", "rep", "n", F.coalesce("component", "rep").alias("label")
        )
        several = (
            labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"))
            .filter("x <> y").select("key")
        )
        return stored(labelled.join(several, "key"), "near-mixed")

    # Two documents share at most what each of them has in common with any other.
    common, other = "(n - lone)", "(m - other_lone)"
    fits = f"label <> other_label AND {100 + percent} * least({common}, {other}) >= {percent} * (n + m)"

    def hashed_neighbours(left: DataFrame) -> DataFrame:
        order = Window.partitionBy("key").orderBy(F.xxhash64("key", "rep"), "rep")
        before = left.select(
            "*", F.lag("rep").over(order).alias("b"), F.lag("n").over(order).alias("m"),
            F.lag("label").over(order).alias("other_label"), F.lag("lone").over(order).alias("other_lone"),
        )
        return before.filter(fits).select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b"))

    lone = None
    for last in (False, True):
        left = mixed_buckets()
        if lone is None:
            # An id of several sets has no one size that its lone shingles could be taken from.
            several = classes.groupBy("rep").agg(F.count("*").alias("sets")).filter("sets > 1")
            lone = stored(
                _lone_shingles(sets, left.select("rep")).join(several, F.col("of") == F.col("rep"), "left_anti"),
                "near-lone",
            )
        # A document whose own shingles alone are too many can't be linked with any.
        left = (
            left.join(lone, F.col("rep") == F.col("of"), "left")
            .select("key", "rep", "n", "label", F.coalesce("lone", F.lit(0)).alias("lone"))
            .filter(f"100 * {common} >= {percent} * n")
        )
        if last:
            open_ = left.select("rep", "n", "label", "lone").distinct()
            found = _linked_across(open_.join(classes.select("rep", "halves"), "rep"), sets, halves, percent)
        else:
            pairs = hashed_neighbours(left).distinct().join(tried, ["a", "b"], "left_anti")
            found = _confirmed(stored(pairs, "near-pairs"), sets, percent)
        found = stored(found, "near-links")
        if not found.isEmpty():
            links = links.union(found)
            groups = components(links)

    named = (
        classes.join(groups, F.col("rep") == F.col("id"), "left")
        .select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.coalesce("component", "rep").alias("component_id"))
    )
    mine = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") > 0) & F.col("id").isNotNull()
    component = F.coalesce("component_id", "id")
    return signed.join(named, mine, "left").select(
        F.col("id").alias(doc_id),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest id."""
    found = near_duplicates(docs, doc_id, text, **options)
    gone = found.filter("NOT kept").select(F.col(doc_id).alias("_gone")).distinct()
    return docs.join(gone, F.col(doc_id) == F.col("_gone"), "left_anti")


def near_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, words=2)


NEAR_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s
  WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * k >= 80 * (p.n + q.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other),
roots AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN roots USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
