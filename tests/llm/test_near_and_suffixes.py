from __future__ import annotations

import hashlib
import random

import numpy as np
from helpers import awkward, bag, table, words
from hypothesis import given, settings
from hypothesis import strategies as st

from tableforge.llm import suffixes
from tableforge.llm.graphs import components
from tableforge.llm.near import near_duplicates, without_near_duplicates
from tableforge.llm.suffixes import common_prefixes, remove_repeats, two_stage_sort
from tableforge.llm.texts import word_hashes


def _groups(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def _brute_near(rows, n):
    sets = []
    for i, text, *_ in rows:
        w = [x.lower() for x in words(text)]
        size = min(n, len(w))
        sets.append((i, {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if w else set()))
    links = [
        (i, j)
        for x, (i, s) in enumerate(sets)
        for j, t in sets[:x]
        if None not in (i, j) and s and t and 100 * len(s & t) >= 80 * len(s | t)
    ]
    roots = _groups({i for i, _ in sets if i is not None}, links)
    return [(i, len(s), roots.get(i), i is None or roots[i] == i) for i, s in sets]


def _copies(rng, groups, size, start):
    """Near copies: a text each with up to a tenth of its words changed."""
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randint(20, 120))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(max(1, len(base) // 10))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            rows.append((start + len(rows), " ".join(copy), "en", "a"))
    return rows


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(6)
    rows = awkward() + _copies(rng, 12, 6, 100) + _copies(rng, 1, 80, 300)
    rows += [(500 + i, rows[-1][1], "en", "a") for i in range(30)]
    # One id with two texts, which ties together what each of them is like.
    rows += [(150, rows[-80][1], "en", "a"), (150, rows[-31][1] + " and two", "en", "a")]
    df = table(spark, rows).repartition(6)
    columns = ("doc_id", "n_shingles", "component_id", "kept")
    for n in (2, 5):
        want = sorted(_brute_near(rows, n), key=lambda r: [(v is not None, str(type(v)), v) for v in r])
        assert bag(near_duplicates(df, words=n), *columns) == want
    kept = without_near_duplicates(df)
    assert kept.columns == df.columns
    best = {r[0] for r in _brute_near(rows, 5) if r[3]}
    assert {r.doc_id for r in kept.collect()} == best


def test_no_documents_no_groups(spark):
    assert near_duplicates(table(spark, [])).collect() == []
    lone = table(spark, [(3, None, "en", "a"), (4, "", "en", "a"), (5, "w", "en", "a")])
    assert bag(near_duplicates(lone), "component_id", "kept") == [(3, True), (4, True), (5, True)]


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    links += [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 360)]
    roots = _groups({n for link in links for n in link}, links)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {n: r for n, r in roots.items() if n != r}


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="ab \t\né\x0b", max_size=60))
def test_word_hashes_follow_the_words(text):
    found, plain = word_hashes(text.encode()), words(text)
    assert len(found) == len(plain)
    assert len(set(zip(found.tolist(), plain))) == len(set(found.tolist())) == len(set(plain))


def test_word_hashes_of_a_long_text_in_pieces(monkeypatch):
    from tableforge.llm import texts

    rng = random.Random(3)
    data = b" ".join(b"x" * rng.randrange(1, 400) for _ in range(500))
    whole = word_hashes(data)
    monkeypatch.setattr(texts, "_CHUNK", 1000)
    assert (word_hashes(data) == whole).all() and len(whole) == 500


def _sorted_well(data: bytes, wanted: np.ndarray, length: int) -> None:
    text = np.frombuffer(data, np.uint8)
    order = two_stage_sort(text, wanted, length)
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
    heads = [data[i : i + length] for i in order]
    assert heads == sorted(heads)
    shared = common_prefixes(text, order, length)
    for i, (a, b) in enumerate(zip(heads, heads[1:])):
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert shared[i] == n


@settings(deadline=None, max_examples=150)
@given(st.binary(min_size=1, max_size=200), st.integers(1, 24), st.randoms())
def test_two_stage_sorting(data, length, rng):
    # Zero bytes can't be told from the end of the text, so a window must be whole.
    wanted = np.array([rng.random() < 0.7 and i + length <= len(data) for i in range(len(data))])
    _sorted_well(data, wanted, length)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from([b"a", b"aa", b"ab", b"ba", b"\xff", b"aaaaaaaaaaaaaaaa"]), max_size=40), st.integers(1, 24))
def test_two_stage_sorting_of_repeats(parts, length):
    data = b"".join(parts) + b"a" * length
    wanted = np.arange(len(data)) + length <= len(data)
    _sorted_well(data, wanted, length)


def _brute_repeats(rows, length):
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    seen, out = set(), []
    for i in sorted(k for k in texts if k is not None):
        data, gone = texts[i], bytearray(len(texts[i]))
        for j in range(len(data) - length + 1):
            window = data[j : j + length]
            if window in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(window)
        out.append((i, data, gone))
    if None in texts:
        out.append((None, texts[None], bytearray(len(texts[None]))))
    for i, data, gone in out:
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone))
        yield i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def _check_repeats(spark, rows, length=100):
    df = table(spark, rows).repartition(4)
    out = remove_repeats(df, length=length).selectExpr("doc_id", "n_bytes", "n_removed", "size(spans)", "kept_sha256")
    want = {r[0]: r for r in _brute_repeats(rows, length)}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows) and all(want[r[0]] == r for r in got)
    return sum(r[2] for r in want.values())


def test_repeats_against_brute_force(spark):
    assert _check_repeats(spark, awkward()) > 10_000
    assert _check_repeats(spark, awkward(5), length=30) > 10_000


def test_repeats_of_crowded_anchors_and_long_texts(spark, monkeypatch):
    rng = random.Random(11)
    line = "a line shared by all, but shorter than a window "
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join([word() for _ in range(rng.randrange(20))] + [line] + [word() for _ in range(20)]), "en", "a") for i in range(120)]
    rows += [(200 + i, rows[i][1][20:] + rows[i + 1][1][:150], "en", "a") for i in range(20)]
    rows += [(300, "".join(rng.choice("ab") for _ in range(30_000)) * 2, "en", "a"), (301, "z" * 5000, "en", "a")]
    want = _check_repeats(spark, rows)
    for name, value in (("CROWD", 3), ("FLUSH", 4000), ("SORT_BYTES", 3000)):
        monkeypatch.setattr(suffixes, name, value)
    monkeypatch.setattr(suffixes, "_hot_anchors", lambda known, length: _some_anchors(rows))
    assert _check_repeats(spark, rows) == want > 30_000


def _some_anchors(rows):
    found = suffixes._contexts([(i, 0, t.encode()) for i, t, *_ in rows[:40]], 100)[0]
    return np.unique(found)[::3]


def test_nothing_to_repeat(spark):
    assert remove_repeats(table(spark, [])).collect() == []


def test_contexts_that_collide_in_one_hash_stay_apart(monkeypatch):
    """With a polynomial hash that is the same for every context, the other hash tells them apart."""
    rng = random.Random(8)
    anchor = "".join(rng.choice("abcdefgh") for _ in range(40))
    texts = ["".join(rng.choice("ijklmnop") for _ in range(90)) + anchor + f"{i:04}" * 25 for i in range(30)]
    texts += texts[:10]
    docs = [(i, 0, t.encode()) for i, t in enumerate(texts)]
    plain = suffixes._contexts(docs, 100)
    stirred = suffixes._stirred
    monkeypatch.setattr(suffixes, "_stirred", lambda h: stirred(h) if h.size > len(plain[0]) else h * np.uint64(0))
    found = suffixes._contexts(docs, 100)
    assert (found[0] == plain[0]).all() and not found[1].any()
    batches = list(suffixes._once(suffixes._SORT, *found))
    settled = list(suffixes._settle(iter(batches[:1])))
    marks = [m for b in batches[1:] + settled for m in b.to_pylist() if m["kind"] == suffixes._MARK]
    # Only places in the copies are settled: a context of any other text stays to be sorted.
    same = {}
    lost = set()
    for key, other, doc, start, n in zip(found[0], found[2], found[3], found[4], found[5]):
        body = docs[doc][2][start : start + n + 99]
        if same.setdefault((key, other), body) != body:
            lost.add((doc, start))
    assert not lost
    assert {m["doc"] for m in marks} and all(m["doc"] >= 30 or _earlier(docs, m) for m in marks)


def _earlier(docs, mark):
    """Whether what a mark covers also starts in an earlier text, or earlier in its own."""
    body = docs[mark["doc"]][2][mark["start"] : mark["start"] + mark["n"] + 99]
    return any(body in d[2] for d in docs[: mark["doc"]]) or docs[mark["doc"]][2].find(body) < mark["start"]
