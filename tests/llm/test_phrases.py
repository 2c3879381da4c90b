"""The positional index: exact phrases and terms close together, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tableforge.llm.phrases import build_index, contamination, decontamination_query, documents_of, near_spans
from tests.llm.helpers import awkward, bag, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, window):
    """Rows of the query for (id, text) lists, window by window."""
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            v = words(body)
            n = min(len(v), window)
            for s in range(len(v) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[s : s + n]:
                        hit.update(range(at, at + n))
                        found.add("" if item is None else str(item))
        listed = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


def random_tables(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("aabCé") + rng.choice([" ", "  ", ". ", "\n", "`"]) for _ in range(n))
    items = [(i, text(rng.randint(0, 14))) for i in range(8)]
    items += [(20, None), (None, "c C c"), (3, "b"), (7, ""), (11, " é ")]
    docs = [(i, text(rng.randint(0, 60)), None, None) for i in range(25)]
    docs += [(30 + i, " -" + text(2) + (items[i][1] or "") * 2 + " tail", None, None) for i in range(8)]
    return docs, items


@pytest.mark.parametrize("window", [1, 3, 10])
@pytest.mark.parametrize("seed", range(3))
def test_windows_against_plain_python(spark, seed, window):
    rows, items = random_tables(seed)
    rows += awkward() if window == 10 else []
    docs = table(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit("x"))
    got = contamination(docs, bench, window=window).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0
    )
    assert bag(got) == plain([r[:2] for r in rows], items, window)


def test_empty_tables(spark):
    docs, bench = table(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert decontamination_query(docs, bench).count() == 0
    rows = decontamination_query(table(spark, [(1, "a b", None, None), (2, None, None, None)]), bench).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in rows) == [(1, 2, 0, False), (2, 0, 0, False)]
    filled = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination_query(docs, filled).count() == 0


def test_terms_close_together(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30)))) for i in range(30)]
    items = [(0, "a b"), (1, "f e d a"), (2, "c c"), (3, "zz a"), (4, "")]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = build_index(spark.createDataFrame(items, "item_id long, text string"), "item_id")
    within = 4
    ids = documents_of(index).select("row", F.col("id").alias("doc"))
    names = documents_of(asked).select(F.col("row").alias("item"), F.col("id").alias("name"))
    got = near_spans(index, asked, within).join(ids, "row").join(names, "item").select("name", "doc", "start")
    want = []
    for name, body in items:
        need = set(words(body))
        for doc, text in docs:
            w = words(text)
            for start in range(1 - within, len(w)):
                if need and need <= set(w[max(start, 0) : start + within]):
                    want.append((name, doc, start))
    assert bag(got) == sorted(want) and want


def test_postings_of_a_term_lie_together_and_nothing_is_shuffled(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = build_index(docs)
    assert {"term", "row", "pos"} <= set(index.columns)
    by_file = index.filter("term IS NOT NULL").select(F.input_file_name().alias("f"), "term", F.monotonically_increasing_id().alias("i"))
    spread = by_file.groupBy("f", "term").agg((F.max("i") - F.min("i") + 1 - F.count("*")).alias("gap"))
    assert spread.filter("gap > 0").count() == 0
    assert documents_of(index).count() == docs.count()
