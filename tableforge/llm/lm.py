"""LM scoring: stupid-backoff scores from n-gram counts of the whole corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableforge.llm.texts import bucketed, sequence_hashes, stored, word_hashes, words_of

ORDER = 3
MIN_COUNT = 2
BACKOFF = 0.4
BLOCK_BYTES = 8 << 20
# A count table is dealt out to at most so many parts at a time.
FAN = 256
# A natural logarithm of 1.0 as a whole number; whole numbers add up alike in any order.
UNIT = 1 << 20


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte in planes, so that the bytes that hardly change cost little.

    A plane is a frame of its own: bytes that look random would spoil the code of their neighbours.
    """
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    compressor = zstandard.ZstdCompressor(level=1)
    frames = [compressor.compress(np.ascontiguousarray(plane).tobytes()) for plane in planes]
    return np.array([len(f) for f in frames], "<u4").tobytes() + b"".join(frames)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    ends = np.cumsum(np.frombuffer(data, "<u4", size)) + 4 * size
    expander = zstandard.ZstdDecompressor()
    planes = [expander.decompress(data[x:y]) for x, y in zip([4 * size, *ends[:-1]], ends, strict=True)]
    return np.ascontiguousarray(np.frombuffer(b"".join(planes), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack_sorted(hashes: np.ndarray) -> bytes:
    """Sorted hashes as their distances."""
    return _pack(np.diff(hashes, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _grams(texts: list[str | None], order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each n the hashes of all n-grams of some texts, in order, and each text's number of them."""
    found: list[list[np.ndarray]] = [[] for _ in range(order)]
    for text in texts:
        words = word_hashes((text or "").encode())
        for n in range(1, order + 1):
            # The length is a part of the hash, so one table holds all orders.
            found[n - 1].append(sequence_hashes(words, n))
    sizes = [np.array([len(h) for h in hs], np.int64) for hs in found]
    empty = np.empty(0, np.uint64)
    return [np.concatenate([empty, *hs]) for hs in found], sizes


def _tables(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a block, sorted by hash, and how often it has each."""
    return np.unique(np.concatenate(_grams(texts, order)[0]), return_counts=True)


def _levels(places: int, fan: int) -> tuple[int, int]:
    """The fewest levels, and the narrowest fan of at most ``fan``, with which a tree has so many leaves."""
    levels, leaves = 1, fan
    while leaves < places:
        levels, leaves = levels + 1, leaves * fan
    width = 1
    while width**levels < places:
        width += 1
    return levels, width


def _cut(hashes: np.ndarray, part: int, fan: int, step: int) -> list[tuple[int, int, int]]:
    """Sorted hashes of a range, cut into its ``fan`` parts: (part, from, to) of those with any.

    Parts are ``step`` hashes wide and numbered from the least hash on.
    """
    first = part * fan
    starts = np.array([min((first + d) * step, 2**64 - 1) for d in range(1, fan)], np.uint64)
    edges = np.concatenate([[0], np.searchsorted(hashes, starts), [len(hashes)]])
    return [(first + d, x, y) for d, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]


_ASKED = "source long, part long, hashes binary, counts binary"
_TOLD = "source long, part long, totals binary"


def _rows(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)


def _asked_rows(source: int, part: int, hashes: np.ndarray, counts: np.ndarray, fan: int, step: int) -> pa.Table:
    rows = [(source, to, _pack_sorted(hashes[x:y]), _pack(counts[x:y])) for to, x, y in _cut(hashes, part, fan, step)]
    return _rows(rows, ["source", "part", "hashes", "counts"])


def _merged(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The count table of some rows: distinct hashes in order, their totals, and where each row's are in it."""
    hashes = [_unpack_sorted(h) for h in asked["hashes"].to_pylist()]
    counts = np.concatenate([_unpack(c, np.int64) for c in asked["counts"].to_pylist()])
    distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    return distinct, totals, np.split(at, np.cumsum([len(h) for h in hashes])[:-1])


def _told(asked: pa.Table, totals: np.ndarray, at: list[np.ndarray]) -> pa.Table:
    """Every row's n-grams joined with the totals."""
    sources, parts = asked["source"].to_pylist(), asked["part"].to_pylist()
    rows = [(s, p, _pack(totals[i])) for s, p, i in zip(sources, parts, at, strict=True)]
    return _rows(rows, ["source", "part", "totals"])


def _ask(order: int, fan: int, step: int):
    """Each block's n-grams, exploded into a row per part of the hashes."""

    def ask(key: tuple, block: pa.Table) -> pa.Table:
        hashes, counts = _tables(block["text"].to_pylist(), order)
        return _asked_rows(key[0].as_py(), 0, hashes, counts, fan, step)

    return ask


def _pass_on(fan: int, step: int):
    """Counts of ``fan`` sources and one part, added up and cut into finer parts."""

    def pass_on(key: tuple, asked: pa.Table) -> pa.Table:
        distinct, totals, _ = _merged(asked)
        return _asked_rows(key[0].as_py(), key[1].as_py(), distinct, totals, fan, step)

    return pass_on


def _answer(key: tuple, asked: pa.Table) -> pa.Table:
    """The whole corpus' counts of one finest part, joined back to those who asked."""
    _, totals, at = _merged(asked)
    return _told(asked, totals, at)


def _hand_down(asked: pa.Table, told: pa.Table) -> pa.Table:
    """What one source was told about its n-grams, joined back to those who had asked it."""
    if not len(asked):
        return _rows([], ["source", "part", "totals"])
    _, _, at = _merged(asked)
    totals = np.concatenate([_unpack(t, np.int64) for t in told.sort_by("part")["totals"].to_pylist()])
    return _told(asked, totals, at)


def _count(blocks: DataFrame, order: int, levels: int, fan: int) -> DataFrame:
    """For each block and part of its n-grams, in order, how often the corpus has each: ``source, part, totals``.

    Up: ``fan`` sources of a level become one of the next, which counts their n-grams in a part of the hashes that
    is ``fan`` times narrower, so that no task ever holds more than about a block's n-grams. Down: totals
    take the same way back. So each level has at most blocks * fan rows, however large the corpus is.
    """
    finest = -(-(2**64) // fan**levels)
    step = [finest * fan ** (levels - level - 1) for level in range(levels)]
    up = F.expr(f"source div {fan}").alias("up")
    asked = [blocks.groupBy("block").applyInArrow(_ask(order, fan, step[0]), _ASKED)]
    for level in range(1, levels):
        asked[-1] = stored(asked[-1], "lm-asked")
        asked.append(asked[-1].groupBy(up, "part").applyInArrow(_pass_on(fan, step[level]), _ASKED))
    told = stored(asked.pop().groupBy("part").applyInArrow(_answer, _TOLD), "lm-answers")
    while asked:
        below = asked.pop().groupBy(up, "part")
        above = told.groupBy(F.col("source"), F.expr(f"part div {fan}"))
        told = stored(below.cogroup(above).applyInArrow(_hand_down, _TOLD), "lm-answers")
    return told


def _scorer(order: int, min_count: int, backoff: float, words: int):
    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        texts = block["text"].to_pylist()
        grams, sizes = _grams(texts, order)
        hashes, _ = np.unique(np.concatenate(grams), return_counts=True)
        sums = np.zeros(len(texts), np.int64)
        if len(hashes):
            answers = answers.sort_by("part")
            counts = np.concatenate([_unpack(t, np.int64) for t in answers["totals"].to_pylist()])
            logs = np.log(counts)
            at = [np.searchsorted(hashes, g) for g in grams]
            # The n-gram that ends at each word, from the longest order down to the first seen often enough.
            ends = sizes[0]
            value = np.zeros(len(at[0]))
            open_ = np.ones(len(at[0]), bool)
            step = np.log(backoff)
            # Where the words of each text start, and the n-grams of each order.
            word_of = np.repeat(np.arange(len(texts)), ends)
            place = np.arange(len(at[0])) - np.repeat(np.cumsum(ends) - ends, ends)
            spent = np.zeros(len(at[0]))
            for n in range(order, 1, -1):
                starts = np.cumsum(sizes[n - 1]) - sizes[n - 1]
                has = np.flatnonzero(open_ & (place >= n - 1))
                gram = at[n - 1][starts[word_of[has]] + place[has] - (n - 1)]
                shorter = np.cumsum(sizes[n - 2]) - sizes[n - 2]
                context = at[n - 2][shorter[word_of[has]] + place[has] - (n - 1)]
                often = counts[gram] >= min_count
                value[has[often]] = logs[gram[often]] - logs[context[often]] + spent[has[often]]
                open_[has[often]] = False
                spent[has[~often]] += step
            rest = np.flatnonzero(open_)
            value[rest] = logs[at[0][rest]] - np.log(words) + spent[rest]
            np.add.at(sums, word_of, np.rint(value * UNIT).astype(np.int64))
        return pa.table(
            [block["id"], pa.array(sizes[0]), pa.array(sums)], ["id", "n_words", "total"]
        )

    return score


def backoff_scores(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    min_count: int = MIN_COUNT,
    backoff: float = BACKOFF,
    block_bytes: int = BLOCK_BYTES,
    fan: int = FAN,
) -> DataFrame:
    """Stupid-backoff scores of every document under the n-gram counts of all documents.

    A word after its n - 1 predecessors scores count(n-gram) / count(predecessors) if the n-gram
    occurs at least ``min_count`` times, else ``backoff`` times its score after one
    predecessor less; a word alone scores its share of all words. n runs down from ``order``, or
    from the number of words so far at the start of a text.

    Documents are dealt into blocks of about ``block_bytes`` of text, by a hash of id and text. A block explodes its n-grams and
    sends each distinct one once towards the count table of its hash range; there they are counted and joined
    back to the blocks' n-grams, over as many levels of ``fan`` sources and parts as the corpus needs
    (one for 256 blocks, three for 16 million); a block sums its documents' scores. Rows are
    packed, some thousands of n-grams each, so an n-gram costs about six bytes of shuffle a level. An n-gram of any
    frequency is one entry per block, and a level's rows number at most blocks times ``fan``.

    Returns ``doc_id``, ``n_words`` (long), ``log_score`` (double, the sum of natural logs) and
    ``mean_log_score`` (null without words). Other columns are ignored. A null or blank text has no words
    and a log score of 0. Rows are counted and scored each, so repeated rows count repeatedly and get
    the same score. Words are compared as they are written.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    size = rows.agg(
        F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.size(words_of(F.col("text")))).alias("words")
    ).first()
    blocks = max(1, -(-(size["bytes"] or 0) // block_bytes))
    spark = docs.sparkSession
    buckets = min(blocks, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    # Texts are shuffled once: both passes over a block read it where it is.
    name, placed = bucketed(placed, "lm-texts", buckets, "block")
    answers = _count(placed, order, *_levels(blocks, max(2, fan)))
    scores = stored(
        placed.groupBy("block")
        .cogroup(answers.groupBy("source"))
        .applyInArrow(_scorer(order, min_count, backoff, size["words"] or 0), "id long, n_words long, total long"),
        "lm-scores",
    )
    spark.sql(f"DROP TABLE {name}")
    return scores.select(
        F.col("id").alias(doc_id),
        "n_words",
        (F.col("total") / UNIT).alias("log_score"),
        F.when(F.col("n_words") > 0, F.col("total") / UNIT / F.col("n_words")).alias("mean_log_score"),
    )


def lm_query(docs: DataFrame) -> DataFrame:
    return backoff_scores(docs)


# The same from plain tables: a row per word, a count table per order, joined and summed.
LM_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM docs),
grams AS (
  SELECT r, p, a AS g1, lag(a) OVER seen AS c2, lag(a) OVER seen || ' ' || a AS g2,
         lag(a, 2) OVER seen || ' ' || lag(a) OVER seen AS c3,
         lag(a, 2) OVER seen || ' ' || lag(a) OVER seen || ' ' || a AS g3
  FROM words WINDOW seen AS (PARTITION BY r ORDER BY p)),
one AS (SELECT g1 AS g, count(*) AS n FROM grams GROUP BY ALL),
two AS (SELECT g2 AS g, count(*) AS n FROM grams WHERE g2 IS NOT NULL GROUP BY ALL),
three AS (SELECT g3 AS g, count(*) AS n FROM grams WHERE g3 IS NOT NULL GROUP BY ALL),
scored AS (
  SELECT r, CASE
      WHEN three.n >= 2 THEN ln(three.n) - ln(before.n)
      WHEN two.n >= 2 THEN ln(two.n) - ln(last.n) + CASE WHEN p > 2 THEN ln(0.4) ELSE 0 END
      ELSE ln(one.n) - ln((SELECT count(*) FROM words)) + least(p - 1, 2) * ln(0.4) END AS score
  FROM grams JOIN one ON one.g = g1 LEFT JOIN two ON two.g = g2 LEFT JOIN three ON three.g = g3
    LEFT JOIN one AS last ON last.g = c2 LEFT JOIN two AS before ON before.g = c3),
sums AS (SELECT r, sum(round(score * 1048576)::BIGINT)::BIGINT AS total FROM scored GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(total, 0) / 1048576 AS log_score,
       CASE WHEN len(w) > 0 THEN total / 1048576 / len(w) END AS mean_log_score
FROM docs LEFT JOIN sums USING (r)
"""
