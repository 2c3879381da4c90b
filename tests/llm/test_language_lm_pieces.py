from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from helpers import awkward, bag, table, words

from tableforge.llm import language as lang
from tableforge.llm import lm
from tableforge.llm import pieces as pc
from tableforge.llm.queries import QUERIES
from tableforge.llm.texts import stored

SMALL, TENTH = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = QUERIES["op1_language_id"](spark, TENTH).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{TENTH}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 100 and np.mean(held) > 0.97
    assert np.mean([r.accepted for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def _model():
    rng = random.Random(1)
    samples = []
    for i in range(120):
        name, alphabet = (("xx", "abcde "), ("yy", "vwxyz "))[i % 2]
        b, n = lang._counted("".join(rng.choice(alphabet) for _ in range(60)) + "a" * (i % 2 == 0), 1 << 12)
        samples.append((name, b, n.astype(float)))
    return lang.fit(samples, buckets=1 << 12)


def test_predictions_depend_on_the_text_alone(spark):
    model = _model()
    rows = [(1, None, "xx", "a"), (2, " 12 \n!", "xx", "a"), (3, "", "xx", "a"), (4, "abcab decab", None, None), (4, "ABCAB decab", "yy", "b")]
    rows += [(None, "xyz vwx zzy", "xx", "a")]
    got = lang.detect(table(spark, rows), model, label="verdict").collect()
    seen = {(r.doc_id, r.text): r.verdict for r in got}
    assert len(got) == len(rows) and all(r.found == "x" for r in got)
    assert [tuple(seen[i, t]) for i, t in ((1, None), (2, " 12 \n!"), (3, ""))] == [("und", 0.0, False)] * 3
    assert seen[4, "abcab decab"] == seen[4, "ABCAB decab"] and seen[4, "abcab decab"].lang_pred == "xx"
    assert seen[None, "xyz vwx zzy"].lang_pred == "yy"


def test_a_long_text_in_pieces(monkeypatch):
    model = _model()
    text = "abc de " * 5000 + "vwx"
    whole = model.predict(text)
    monkeypatch.setattr(lang, "_CHUNK", 1000)
    assert model.predict(text)[0] == whole[0] and model.predict(text)[1] == pytest.approx(whole[1])


def test_unclear_texts_score_lower_and_can_be_rejected():
    model = _model()
    clear, unclear = model.predict("abcde abcde"), model.predict("abcde vwxyz")
    assert clear[1] > unclear[1] and clear[2]
    model.floor = (clear[1] + unclear[1]) / 2
    assert not model.predict("abcde vwxyz")[2] and model.predict("abcde abcde")[2]


def test_training_ignores_held_out_and_unlabelled_rows(spark):
    rows = [(i, f"some text number {i}", ("en", None)[i % 2], "a") for i in range(60)]
    rows += [(100 + i, "a copy of one text", "en", "a") for i in range(200)] + [(None, None, "en", "a")]
    df = table(spark, rows)
    picked = lang.sample(df.filter(~lang.held_out(df.doc_id)), per_lang=1000)
    train = {t for i, t, label, _ in rows if t and label and zlib.crc32(str(i).encode()) % 5}
    assert len(picked) == len(train) and {p[0] for p in picked} == {"en"}
    assert len(lang.sample(df, per_lang=7)) == 7


def test_language_of_nothing(spark):
    empty = table(spark, [])
    assert lang.language_query(empty).collect() == [] and lang.accepted_documents(empty).collect() == []
    unlabelled = table(spark, [(1, "text", None, "a")])
    assert lang.language_query(unlabelled).collect()[0].lang_pred == "und"
    assert lang.accepted_documents(unlabelled).count() == 1


def _plain_subwords(text, buckets):
    """The same n-grams one by one, of the whole text."""
    codes = [0]
    for c in text.lower():
        if c.isalpha():
            codes.append(ord(c))
        elif codes[-1]:
            codes.append(0)
    found = Counter()
    for n in lang.SIZES:
        for at in range(len(codes) - n + 1):
            h = n
            for i in range(n):
                h = (h + codes[at + i]) * int(lang._FACTORS[i]) % 2**32
                h ^= h >> 15
            found[h % buckets] += 1
    return found if len(codes) > 1 else Counter()


@pytest.mark.parametrize("text", ["", "7!", "a", " Ab\tcd, e", "x1yé ", "ΑΒΓ δεζ" * 7])
@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_subwords_one_by_one(monkeypatch, text, chunk):
    monkeypatch.setattr(lang, "_CHUNK", chunk)
    b, n = lang._counted(text, 1 << 10)
    assert dict(zip(b.tolist(), n.tolist())) == _plain_subwords(text, 1 << 10)


def _plain_training(samples, buckets, dimensions, epochs, rate, seed):
    """The training and the logits again, number by number."""
    langs = sorted({s[0] for s in samples})
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions)).tolist()
    out = [[0.0] * len(langs) for _ in range(dimensions)]
    train = []
    for name in langs:
        train += [s for i, s in enumerate([s for s in samples if s[0] == name], 1) if i % 5]
    train = [s for s in samples if any(s is t for t in train)]
    done, steps = 0, epochs * len(train)
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            name, b, n = train[i]
            share = [c / sum(n) for c in n]
            x = [sum(w * emb[k][d] for w, k in zip(share, b)) for d in range(dimensions)]
            z = [math.exp(sum(x[d] * out[d][j] for d in range(dimensions))) for j in range(len(langs))]
            grad = [e / sum(z) - (langs[j] == name) for j, e in enumerate(z)]
            step = rate * (1 - done / steps)
            back = [sum(out[d][j] * grad[j] for j in range(len(langs))) for d in range(dimensions)]
            for d in range(dimensions):
                for j in range(len(langs)):
                    out[d][j] -= step * x[d] * grad[j]
                for w, k in zip(share, b):
                    emb[k][d] -= step * w / sum(v * v for v in share) * back[d]
            done += 1
    return lambda b, n: [
        sum(c * sum(emb[k][d] * out[d][j] for d in range(dimensions)) for k, c in zip(b, n)) / sum(n)
        for j in range(len(langs))
    ]


def test_training_number_by_number():
    rng = random.Random(3)
    texts = [(name, "".join(rng.choice(a) for _ in range(25))) for name, a in (("p", "abc "), ("q", "bcd "), ("r", "xyz ")) * 6]
    samples = [(name, *lang._counted(t, 1 << 8)) for name, t in texts]
    model = lang.fit(samples, buckets=1 << 8, dimensions=4, epochs=3, rate=0.5, seed=5)
    plain = _plain_training(samples, 1 << 8, 4, 3, 0.5, 5)
    for t in ("abc bca", "xyzzy", texts[4][1]):
        found = _plain_subwords(t, 1 << 8)
        assert model.logits(t) == pytest.approx(plain(list(found), list(found.values())), abs=1e-5)


def test_six_hundred_languages_are_all_learnt(spark):
    # Each language writes in a letter pair of its own.
    letters = [chr(0x4E00 + i) for i in range(600)]
    rows = [(4 * i + k, f"{c}a{c} {c}{'b' * (k + 1)}{c}", f"l{i:03}", "s") for i, c in enumerate(letters) for k in range(4)]
    picked = lang.sample(table(spark, rows), buckets=1 << 14)
    assert len({p[0] for p in picked}) == 600 and len(picked) == 2400
    model = lang.fit(picked, buckets=1 << 14)
    assert len(model.langs) == 600 and (model.temperature, model.floor) == (1.0, 0.0)
    assert np.mean([model.predict(f"{c}a{c}")[0] == f"l{i:03}" for i, c in enumerate(letters)]) > 0.95
    # With next to no bytes, one text of each is still taken.
    assert len(lang.sample(table(spark, rows), buckets=1 << 14, sample_bytes=1)) == 600


def test_ten_samples_hold_back_two():
    model = lang.fit([(name, *lang._counted(a * 9, 1 << 8)) for name, a in (("p", "ab "), ("q", "xy ")) for _ in range(5)], buckets=1 << 8)
    assert model.predict("ab ab")[0] == "p" and model.predict("xyx")[0] == "q" and model.floor > 0.5
    one = lang.fit([("p", *lang._counted("ab", 1 << 8))], buckets=1 << 8)
    assert one.predict("zz")[:1] == ("p",) and one.predict("zz")[2]


def test_least_hashes_of_a_hot_language(spark):
    rng = random.Random(2)
    hashes = [("hot", rng.getrandbits(64) - 2**63) for _ in range(5000)] + [("rare", rng.getrandbits(64) - 2**63) for _ in range(3)]
    df = spark.createDataFrame(hashes + hashes[:2000], "lang string, order long")
    got = lang._least_hashes(df, 40).collect()
    for name in ("hot", "rare"):
        least = sorted((h for n, h in hashes if n == name), key=lambda h: h % 2**64)[:40]
        assert [r.order for r in sorted(got, key=lambda r: r.place) if r.lang == name] == least


def _brute_scores(rows, order, least):
    counts = Counter()
    texts = [words(t) for _, t, *_ in rows]
    for w in texts:
        for n in range(1, order + 1):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(map(len, texts))

    def score(w, i, n):
        gram = tuple(w[i - n + 1 : i + 1])
        if n == 1:
            return math.log(counts[gram] / total)
        if counts[gram] >= least:
            return math.log(counts[gram] / counts[gram[:-1]])
        return math.log(0.4) + score(w, i, n - 1)

    for (i, *_), w in zip(rows, texts):
        yield i, len(w), sum(round(score(w, j, min(order, j + 1)) * lm.UNIT) for j in range(len(w))) / lm.UNIT


@pytest.mark.parametrize(
    ("order", "block_bytes", "fan"), [(1, 9000, 256), (2, 9000, 3), (3, 1 << 20, 256), (3, 4000, 2), (4, 9000, 4)]
)
def test_scores_against_brute_force(spark, order, block_bytes, fan):
    rows = awkward()
    df = table(spark, rows).repartition(3)
    got = lm.backoff_scores(df, order=order, block_bytes=block_bytes, fan=fan).collect()
    rank = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in got), key=rank)
    want = sorted(_brute_scores(rows, order, 2), key=rank)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-3)


def test_levels_have_room_for_every_block():
    for places in (1, 2, 3, 255, 256, 257, 65536, 65537, 10**7):
        levels, fan = lm._levels(places, 256)
        assert fan <= 256 and fan**levels >= places
        assert levels == 1 or 256 ** (levels - 1) < places


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5000):
        hashes = np.unique(np.append(rng.integers(0, 2**64, size, np.uint64, endpoint=False), np.uint64(2**64 - 1)))
        assert (lm._unpack_sorted(lm._pack_sorted(hashes)) == hashes).all()
        counts = rng.integers(1, 2**40, size)
        assert (lm._unpack(lm._pack(counts), np.int64) == counts).all()


@pytest.mark.parametrize("part", [0, 3])
def test_parts_cut_hashes_once(part):
    fan, step = 5, 2**64 // 20
    hashes = np.unique(np.random.default_rng(2).integers(part * fan * step, (part + 1) * fan * step, 400, np.uint64))
    cut = lm._cut(hashes, part, fan, step)
    assert [x for _, x, _ in cut] == [0, *[y for _, _, y in cut[:-1]]] and cut[-1][2] == len(hashes)
    assert all(int(h) // step == p for p, x, y in cut for h in hashes[x:y])


def test_rows_grow_with_the_corpus_and_not_its_square(spark, monkeypatch):
    """Twice the text gives about twice the rows at every level."""
    rng = random.Random(4)
    made = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(40)), "en", "a") for i in range(160)]
    tables = []

    def kept(df, label, by=()):
        tables.append(stored(df, label, by))
        return tables[-1]

    monkeypatch.setattr(lm, "stored", kept)
    rows = []
    for n in (80, 160):
        tables.clear()
        lm.backoff_scores(table(spark, made[:n]), block_bytes=1000, fan=4).count()
        assert len(tables) > 2
        rows.append(max(t.count() for t in tables))
    assert rows[1] <= 2.5 * rows[0]


def test_scores_of_nothing(spark):
    assert lm.lm_query(table(spark, [])).collect() == []
    assert bag(lm.lm_query(table(spark, [(1, None, "en", "a")])), "n_words", "log_score", "mean_log_score") == [(0, 0.0, None)]


@pytest.fixture(scope="module")
def vocabulary():
    return pc.load_vocabulary(pc.default_vocabulary())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pc.default_vocabulary())


def _texts(seed):
    rng = random.Random(seed)
    yield "aaaa" * 90 + " " * 70 + "=" * 99
    yield from ("\u0000▁ mark▁", "  two  blanks ", "\n\n\t", " ", "😀é日本語")
    for kind in ("ab cñ😀the in\n", "abcdeth", "ethaonis   "):
        for _ in range(8):
            yield "".join(rng.choice(kind) for _ in range(rng.randint(1, 500)))


def test_pieces_are_those_of_the_library(vocabulary, library):
    seg = pc.Segmenter(vocabulary)
    for text in _texts(1):
        ids = seg.encode(text).tolist()
        assert pc.decode_ids(ids, vocabulary) == text
        if pc.SPACE not in text:
            assert ids == library.encode(text)


def test_chunks_change_nothing(spark, vocabulary, library):
    rows = [(i, t, "en", "a") for i, t in enumerate(_texts(2))]
    rows += [(99, None, "en", "a"), (100, "", "en", "a"), (100, "", "en", "a"), (101, rows[0][1], "en", "a"), (None, rows[0][1] * 2, "en", "a")]
    df = table(spark, rows).repartition(3)
    whole = pc.encode(df, vocabulary)
    assert whole.filter("round_trip").count() == len(rows)
    cut = pc.encode(df, vocabulary, chunk=40)
    assert bag(cut) == bag(whole)
    texts = {i: t or "" for i, t, *_ in rows}
    assert all(pc.SPACE in texts[r.doc_id] or r.ids == library.encode(texts[r.doc_id]) for r in cut.collect())
    back = pc.decode(whole, vocabulary).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in back) == sorted((i is not None, i or 0, t or "") for i, t, *_ in rows)


def test_max_plus_products_are_associative():
    rng = np.random.default_rng(5)
    a, b, c = (np.where(rng.random(s) < 0.4, pc.NEVER, rng.integers(-9, 9, s)) for s in ((3, 4), (4, 2), (2, 5)))
    assert (pc.max_plus(pc.max_plus(a, b), c) == pc.max_plus(a, pc.max_plus(b, c))).all()
    assert all((x == y).all() for x, y in zip(pc.prefix_products([a, b, c]), [a, pc.max_plus(a, b), pc.max_plus(pc.max_plus(a, b), c)]))


def test_pieces_of_nothing(spark, vocabulary):
    assert pc.encode(table(spark, []), vocabulary).collect() == []
    with pytest.raises(ValueError):
        pc.encode(table(spark, []), vocabulary, chunk=20)
