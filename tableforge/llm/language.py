"""Language ID: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableforge.llm.texts import stored

UNKNOWN = "und"
BUCKETS = 1 << 15
DIMENSIONS = 16
SIZES = (2, 3)
PER_LANG = 1000
MAX_SAMPLE = 20_000
SAMPLE_BYTES = 1 << 30
HOLD_BACK = 5
REJECT = 0.001
_CHUNK = 1 << 20
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _subwords(text: str, buckets: int) -> Iterator[np.ndarray]:
    """The buckets of the character n-grams of one text, some at a time.

    They are taken from its letters, lower-cased in pieces of a million characters, with one 0 at the
    start and after each run of letters. No more than a piece is held.
    """
    reach = max(SIZES) - 1
    tail, after_letter = np.zeros(1, np.uint32), False
    for start in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[start : start + _CHUNK].lower().encode("utf-32-le"), np.uint32)
        letter = _letters()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= after_letter
        after_letter = letter[-1]
        fresh = np.where(letter, codes, np.uint32(0))[keep]
        if not len(fresh):
            continue
        joined = np.concatenate([tail, fresh])
        for n in SIZES:
            # Those that end in this piece.
            part = joined[max(len(tail) - n + 1, 0) :]
            runs = len(part) - n + 1
            if runs > 0:
                h = np.full(runs, n, np.uint32)
                for i in range(n):
                    h = (h + part[i : i + runs]) * _FACTORS[i % 3]
                    h ^= h >> np.uint32(15)
                yield (h & np.uint32(buckets - 1)).astype(np.int32)
        tail = joined[-reach:]


def _counted(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text uses, and how often it uses each."""
    total = np.zeros(buckets, np.int64)
    for b in _subwords(text, buckets):
        total += np.bincount(b, minlength=buckets)
    used = np.flatnonzero(total)
    return used.astype(np.int32), total[used]


@dataclass
class LanguageModel:
    """``table[b]`` is the embedding of bucket b times the output layer: the mean over a text's
    subwords gives the logits. ``floor`` is the least score that is accepted."""

    langs: list[str]
    table: np.ndarray
    temperature: float
    floor: float

    def logits(self, text: str) -> np.ndarray | None:
        """None for a text without a letter."""
        total, n = np.zeros(len(self.langs)), 0
        for b in _subwords(text, len(self.table)):
            total += self.table[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        return total / n if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        z = self.logits(text) if text is not None else None
        if z is None:
            return UNKNOWN, 0.0, False
        if not self.langs:  # nothing was learnt that could speak against a text
            return UNKNOWN, 0.0, True
        p = _softmax(z / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best]), bool(p[best] >= self.floor)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(
    samples: list[tuple[str, np.ndarray, np.ndarray]],
    buckets: int = BUCKETS,
    dimensions: int = DIMENSIONS,
    epochs: int = 8,
    rate: float = 0.5,
    reject: float = REJECT,
    seed: int = 7,
) -> LanguageModel:
    """Train on (lang, buckets, counts) by stochastic gradient descent, one text at a time.

    A step moves the mean of a text's embeddings by the whole gradient, whatever its length. The fifth, tenth
    and so on sample of each language is held back. On those a temperature is fitted by least log loss, and the
    score that all but a share ``reject`` of them reach becomes the floor. With fewer than five samples of
    every language none is held back: the temperature is 1 and no score is too low.
    """
    langs = sorted({s[0] for s in samples})
    if not langs:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), 1.0, 0.0)
    index = {lang: i for i, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions))
    output = np.zeros((dimensions, len(langs)))
    held, train, seen = [], [], Counter()
    for s in samples:
        seen[s[0]] += 1
        (train if seen[s[0]] % HOLD_BACK else held).append(s)
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            lang, b, counts = train[i]
            share = counts / counts.sum()
            x = share @ embedding[b]
            grad = _softmax(x @ output)
            grad[index[lang]] -= 1
            step = rate * (1 - done / steps)
            back = output @ grad
            output -= step * np.outer(x, grad)
            # A subword's own share is small; so scaled, the mean moves by the whole step.
            embedding[b] -= step * np.outer(share / (share @ share), back)
            done += 1
    table = (embedding @ output).astype(np.float32)
    if not held:
        return LanguageModel(langs, table, 1.0, 0.0)
    z = np.array([(c / c.sum()) @ table[b].astype(np.float64) for _, b, c in held])
    y = np.array([index[s[0]] for s in held])
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    temperature = min((float(t) for t in np.geomspace(0.1, 10, 41)), key=loss)
    scores = np.sort(_softmax(z / temperature).max(axis=1))
    floor = float(scores[int(reject * len(scores))])
    return LanguageModel(langs, table, temperature, floor)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _least_hashes(hashes: DataFrame, take: int) -> DataFrame:
    """``lang, order, place``: the ``take`` least different hashes of each language, placed from 1.

    Languages are not ranked whole: hashes are counted by their size, in steps of about one percent, and only the
    rows up to the step that holds the last place are ranked, which number hardly more than ``take``
    whatever the language's share of the input.
    """
    size = F.shiftrightunsigned("order", 1)
    different = hashes.distinct().withColumn("step", F.floor(F.log2(size + 1) * 64))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("step")) - F.col("n")
    last = (
        different.groupBy("lang", "step").agg(F.count("*").alias("n"))
        .withColumn("before", before)
        .filter(F.col("before") < take)
        .groupBy("lang")
        .agg(F.max("step").alias("last"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("order", 1), "order"))
    near = different.join(last, "lang").filter("step <= last")
    return near.select("lang", "order", place.alias("place")).filter(F.col("place") <= take)


def sample(
    docs: DataFrame, text: str = "text", lang: str = "lang",
    per_lang: int = PER_LANG, max_sample: int = MAX_SAMPLE, buckets: int = BUCKETS,
    sample_bytes: int = SAMPLE_BYTES,
) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """A bounded sample of labelled texts as counts of their subwords.

    For each language the ``per_lang`` different texts with the smallest hashes, or fewer of each, so that the
    sample has at most ``max_sample`` texts and ``sample_bytes`` bytes of counts, but always one of every
    language: all are learnt. Whole texts are counted, by the tasks; a text takes at most 12 bytes
    times ``buckets``, however long it is.
    """
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        "text IS NOT NULL AND lang IS NOT NULL"
    ).withColumn("order", F.xxhash64("text"))
    hashes = stored(labelled.select("lang", "order").distinct(), "language-hashes")
    langs = hashes.agg(F.count_distinct("lang")).first()[0]
    if not langs:
        return []
    take = max(1, min(per_lang, max_sample // langs))
    # At most max_sample rows, or one a language; as a written table their size is known to the planner.
    picked = stored(_least_hashes(hashes, take), "language-picked")
    chosen = labelled.join(picked, ["lang", "order"]).dropDuplicates(["lang", "order"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_counted(body, buckets) for body in batch["text"]]
            yield pd.DataFrame(
                {"lang": batch["lang"], "order": batch["order"], "place": batch["place"],
                 "b": [f[0].tobytes() for f in found], "n": [f[1].tobytes() for f in found]}
            )

    counts = stored(
        chosen.mapInPandas(count, "lang string, order long, place int, b binary, n binary"), "language-sample"
    )
    sizes = counts.groupBy("place").agg(F.sum(F.length("b") + F.length("n")).alias("bytes")).collect()
    places, spent = 1, 0
    for row in sorted(sizes, key=lambda r: r["place"]):
        spent += row["bytes"]
        if spent > sample_bytes:
            break
        places = row["place"]
    rows = counts.filter(F.col("place") <= places).collect()
    rows.sort(key=lambda r: (r["order"], r["lang"]))
    return [
        (r["lang"], np.frombuffer(r["b"], np.int32), np.frombuffer(r["n"], np.int64).astype(float))
        for r in rows
        if r["b"]
    ]


def detect(
    docs: DataFrame, model: LanguageModel, text: str = "text", label: str = "found"
) -> DataFrame:
    """``docs`` with ``label``, a struct of lang_pred, score and accepted; no shuffle.

    lang_pred is ``und``, with score 0 and not accepted, for a text that is null or has no
    letter. A model without languages calls all others ``und`` too, but accepts them. Else it is the language with the highest probability, the first by name on a tie.
    The whole text is read, in bounded pieces. Every row is judged by its text alone.
    """

    @F.pandas_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [model.predict(t) for t in texts], columns=["lang_pred", "score", "accepted"]
        )

    return docs.withColumn(label, judge(F.col(text)))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model from the documents that are not held out."""
    return fit(sample(docs.filter(~held_out(F.col(doc_id))), text, lang))


def accepted_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without those whose language is rejected: no letter, or a score below the floor."""
    label = "found"
    while label in docs.columns:
        label += "_"
    judged = detect(docs, train(docs, doc_id, text, lang), text, label)
    return judged.filter(F.col(f"{label}.accepted")).drop(label)


def language_query(docs: DataFrame) -> DataFrame:
    model = train(docs)
    only = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return detect(only, model).select("doc_id", "held_out", "found.*")
