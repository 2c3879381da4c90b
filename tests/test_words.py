from __future__ import annotations

import os
import random
import re
from collections import Counter

import pytest

from tableforge import (
    distinct_words,
    lines_from_values,
    read_csv,
    tokens,
    top_words,
    word_count,
    word_count_job,
    write_csv,
)
from tableforge.workspace import fresh_folder

COUNTS = "word string, count bigint"
EDGE_LINES = [
    "  two leading blanks",
    "a\ttab\tand\t\ttabs",
    "",
    "   ",
    "windows\r\nline",
    "lone\rreturn",
    "vertical\x0btab",
    "no\u00a0break stays\u00a0one",
    None,
    "end ",
    "naïve 日本語 naïve",
]


def _brute(lines):
    # Java's \s: blank, tab, newline, vertical tab, form feed, return.
    return Counter(w for line in lines if line is not None for w in re.split("[ \t\n\x0b\f\r]+", line) if w)


def test_whitespace_edges(spark):
    got = Counter(r.word for r in tokens(lines_from_values(spark, EDGE_LINES)).collect())
    assert got == _brute(EDGE_LINES)
    assert "no\u00a0break" in got


def test_counts_and_distinct(spark):
    lines = lines_from_values(spark, EDGE_LINES)
    assert {r.word: r["count"] for r in word_count(lines).collect()} == _brute(EDGE_LINES)
    assert distinct_words(lines).first().n == len(_brute(EDGE_LINES))


def test_no_lines(spark):
    none = lines_from_values(spark, [])
    assert word_count(none).count() == 0
    assert distinct_words(none).first().n == 0


def test_one_hot_word_among_many_partitions(spark):
    lines = spark.range(0, 30000, 1, 16).selectExpr(
        "if(id % 3 = 0, 'hot hot', concat('w', id)) AS value"
    )
    counts = {r.word: r["count"] for r in word_count(lines).collect()}
    assert counts["hot"] == 20000
    assert len(counts) == 20001


def test_ties_are_ordered_by_word(spark):
    counts = word_count(lines_from_values(spark, ["d c b a b", "c"]))
    assert [tuple(r) for r in top_words(counts, 3).collect()] == [("b", 2), ("c", 2), ("a", 1)]


NASTY = [
    '"', '""', "\\", "a\\", '\\"', 'a"b', '"quoted"', ",", "a,b", "'", "#x", "\u00a0", "\u2028",
    "\x01", "x\x01", "\x00", "null", "\\N", "=1+1", "\ufeffbom", "日本", "é,\"", "-", "word", "count",
]


@pytest.mark.parametrize("single_file", [False, True])
def test_csv_keeps_every_word(spark, single_file):
    lines = lines_from_values(spark, NASTY + NASTY[:3])
    report = word_count_job(lines, fresh_folder(spark, "csv"), single_file=single_file)
    assert {r.word: r["count"] for r in report.counts.collect()} == Counter(NASTY + NASTY[:3])
    assert report.distinct.first().n == len(NASTY)


def test_csv_keeps_words_of_any_characters(spark):
    rng = random.Random(11)
    blanks = set(" \t\n\x0b\f\r")
    pools = ["\"\\,'#a", "".join(map(chr, range(1, 256))), None]
    words = set()
    while len(words) < 3000:
        pool = rng.choice(pools)
        word = ""
        for _ in range(rng.randrange(1, 8)):
            code = rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])
            letter = rng.choice(pool) if pool else chr(code)
            word += "" if letter in blanks else letter
        if word:
            words.add(word)
    lines = lines_from_values(spark, sorted(words))
    report = word_count_job(lines, fresh_folder(spark, "csv"))
    assert {r.word for r in report.counts.collect()} == words
    assert report.distinct.first().n == len(words)


def _csv_files(folder):
    return sorted(f for f in os.listdir(folder) if f.endswith(".csv"))


def test_csv_files_follow_the_order(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(8)
    one = word_count_job(texts, fresh_folder(spark, "csv"), "text", single_file=True)
    files = _csv_files(one.path)
    assert len(files) == 1
    with open(f"{one.path}/{files[0]}", encoding="utf-8") as f:
        assert f.readline() == "word,count\n"
    rows = [tuple(r) for r in read_csv(spark, f"{one.path}/{files[0]}", COUNTS).collect()]
    assert [n for _, n in rows] == sorted((n for _, n in rows), reverse=True)
    assert rows == sorted(rows, key=lambda r: (-r[1], r[0].encode()))
    assert rows[:20] == [tuple(r) for r in one.top.collect()]


def test_many_csv_files_follow_each_other(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = spark.range(0, 5000, 1, 8).selectExpr("concat('w', id % 700, ' v', id % 90) AS value")
        path = word_count_job(lines, fresh_folder(spark, "csv")).path
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = _csv_files(path)
    assert len(files) == 8
    rows = [tuple(r) for f in files for r in read_csv(spark, f"{path}/{f}", COUNTS).collect()]
    assert rows == sorted(rows, key=lambda r: (-r[1], r[0])) and len(rows) == 790


def test_csv_overwrites(spark):
    path = fresh_folder(spark, "csv")
    for words in (["a b c"], ["z"]):
        write_csv(word_count(lines_from_values(spark, words)), path)
    assert [tuple(r) for r in read_csv(spark, path, COUNTS).collect()] == [("z", 1)]
