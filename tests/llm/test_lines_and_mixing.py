from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from helpers import BLANKS, awkward, bag, table

from tableforge.llm.lines import dedup_lines, line_digest, with_lines_deduped
from tableforge.llm.mixing import apportion, mix, mixed_documents, targets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rank(doc_id):
    return (doc_id is not None, doc_id or 0)


def _brute_lines(rows):
    holders = {}
    split = [(i, (t or "").split("\n")) for i, t, *_ in rows]
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    for i, lines in split:
        for line in lines:
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(_rank(i))
    gone = {k: max(h) for k, h in holders.items() if len(h) >= 3}
    for i, lines in split:
        kept = [x for x in lines if gone.get(key(x), _rank(i)) == _rank(i)]
        yield i, len(lines), len(lines) - len(kept), "\n".join(kept)


def test_lines_against_brute_force(spark):
    rows = awkward()
    want = list(_brute_lines(rows))
    assert sum(w[2] for w in want) > 10
    df = table(spark, rows).repartition(5)
    assert bag(dedup_lines(df), "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(want, key=lambda r: _rank(r[0]) + r[1:])
    digests = {r.doc_id: r.kept_sha256 for r in line_digest(df).collect()}
    assert all(digests[w[0]] == hashlib.sha256(w[3].encode()).hexdigest() for w in want)


def test_a_line_of_half_the_documents_and_many_lines(spark):
    rows = [(i, "\n".join(["a line that every document has"] * 3 + [f"line {i} of its own, long enough"]), "en", "a") for i in range(300)]
    rows.append((1000, "\n".join(f"number {i % 2000} in a very long text" for i in range(20_000)), "en", "a"))
    want = sorted(_brute_lines(rows))
    assert bag(dedup_lines(table(spark, rows)), "doc_id", "n_lines", "n_dropped", "kept_text") == want


def test_lines_of_an_empty_table(spark):
    assert line_digest(table(spark, [])).collect() == []


def test_documents_keep_their_columns(spark):
    rows = awkward()
    df = table(spark, rows)
    out = with_lines_deduped(df)
    assert out.columns == df.columns and out.count() == len(rows)
    want = {w[0]: w[3] for w in _brute_lines(rows)}
    for r in out.collect():
        assert (r.text or "") == want[r.doc_id] and r.found == "x"
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert out.filter("text IS NULL").count() == 1


def _highest_quotients(votes, seats):
    won = Counter()
    for _ in range(seats if any(v > 0 for v in votes.values()) else 0):
        best = max((v / (won[k] + 0.5), -i) for i, (k, v) in enumerate(sorted(votes.items())) if v > 0)
        won[sorted(votes)[-best[1]]] += 1
    return {k: won[k] for k in votes}


def test_apportionment_is_that_of_the_highest_quotients(spark):
    rng = random.Random(4)
    cases, want = [], {}
    for g in range(60):
        votes = {k: rng.choice([0.0, 1.0, 2.0, 3.0, rng.random() * 50]) for k in range(rng.randint(1, 7))}
        seats = rng.choice([0, 1, 2, 3, 7, 40, 300])
        cases += [(g, k, v, seats) for k, v in votes.items()]
        want |= {(g, k): n for k, n in _highest_quotients(votes, seats).items()}
    df = spark.createDataFrame(cases, "g int, k int, votes double, seats long")
    got = {(r.g, r.k): r.won for r in apportion(df, ["g"], ["k"]).collect()}
    assert got == want


def _brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    free, left, out = set(order), 1.5 * sum(sizes.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * sizes[s] < weight[s] * level}
        if not full:
            return out | {s: weight[s] * level for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_targets_against_reshared_excess(spark):
    rng = random.Random(9)
    for _ in range(4):
        sizes = {s: rng.choice([0, 1, 5, 100, 1000]) for s in [None, "", "a", "B", "b", "é", "zz"][: rng.randint(1, 7)]}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in targets(df, (3, 1, 2), 1.5, 2.0).collect()}
        assert got == pytest.approx(_brute_targets(sizes))


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 400)), "en", rng.choice("aaaabcd")) for i in range(600)]
    rows += awkward()
    df = table(spark, rows)
    got = mix(df, shard_words=10_000).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 2), (s, taken[s], t)
    again = mix(df.repartition(7), shard_words=10_000)
    assert bag(again, "doc_id", "size", "taken") == sorted(((r.doc_id, r.size, r.taken) for r in got), key=lambda r: (_rank(r[0]), r))


def test_the_mix_holds_the_words_taken(spark):
    rows = awkward()
    df = table(spark, rows)
    out = mixed_documents(df)
    assert out.columns == df.columns
    want, have = Counter(), Counter()
    for r in mix(df).collect():
        want[r.doc_id] += r.taken
    texts = {i: t for i, t, *_ in rows}
    for r in out.collect():
        assert r.text and texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        have[r.doc_id] += len(r.text.encode().split())
    assert {k: v for k, v in want.items() if v} == pytest.approx(have, abs=1)


def test_an_empty_mix(spark):
    assert mix(table(spark, [])).collect() == []
    blank = table(spark, [(1, None, "en", "a"), (2, " ", "en", None)])
    assert bag(mix(blank), "doc_id", "size", "target", "taken") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mixed_documents(blank).collect() == []
