"""Token alignment against the libraries and plain Python, and the fragments' algebra."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tableforge.llm import align as al
from tableforge.llm.align import Fragment, Tokens, align, default_pair, encoders
from tests.llm.helpers import awkward, bag, table

PAIR = default_pair()


def plain(rows):
    """The query's rows for (doc_id, text), by the public libraries, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(PAIR.a)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PAIR.b)
    def bytes_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    docs = []
    for doc, text in rows:
        groups = []
        if text:
            data = (" " + text).encode()
            a, b = first.encode(" " + text, add_special_tokens=False), second.encode(text)
            bytes_a = [encoders(PAIR).bytes_a[i] for i in a.ids]
            pieces = [bytes_b(i) for i in b]
            if b"".join(bytes_a) == data and b"".join(pieces) == data:
                ends = [list(np.cumsum([len(t) for t in side])) for side in (bytes_a, pieces)]
                i = j = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
                    groups.append((a.ids[i:p], b[j:q]))
                    i, j = p, q
        docs.append((doc, groups))
    counts = Counter()
    for _, groups in docs:
        counts.update({(x, y) for a, b in groups for x in a for y in b})
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for doc, groups in docs:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


def texts():
    rng = random.Random(4)
    rows = [r[:2] for r in awkward()]
    rows += [
        (100, "<|endoftext|> is plain, <s> too </s> <0x41>"),
        (101, "a mark ▁ is no blank"),
        (102, "tail  "),
        (103, " "),
        (104, "don't we'll I'D\t\tx\r\n\r\n y"),
        (105, "漢字かな" * 40 + "😀é"),
        (106, "=" * 700),
        (107, "0aF9/" * 300),
        (108, "a,b;c\n" * 200 + "no blank here"),
        (109, "x " * 500),
    ]
    alphabet = "ab XY01.,'\n\té漢😀́½"
    rows += [(200 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 900)))) for i in range(30)]
    return rows


@pytest.mark.parametrize("chunk, fan_in", [(1 << 15, 8), (64, 2), (150, 3)])
def test_alignment_against_plain_python(spark, chunk, fan_in):
    rows = texts()
    docs = table(spark, [(*r, None, None) for r in rows])
    assert bag(align(docs, PAIR, chunk=chunk, fan_in=fan_in, block=5000)) == plain(rows)


def test_empty_table_and_texts_without_tokens(spark):
    assert align(table(spark, []), PAIR).count() == 0
    got = bag(align(table(spark, [(1, None, None, None), (None, "", None, None), (2, "▁", None, None)]), PAIR))
    assert got == [(d, 0, 0, 0, 0, 0, 0, "") for d in (None, 1, 2)]


def _random_tokens(rng, n, keep=0.5):
    sides = [sorted({x for x in range(1, n) if rng.random() < keep} | {n}) for _ in range(2)]
    a, b = (np.array(s, np.int64) for s in sides)
    return Tokens(a * 10, a, b * 10, b)


def test_fragments_compose_associatively():
    """However a text is cut and its fragments are composed, the same groups are closed."""
    rng = random.Random(9)
    for _ in range(300):
        whole = _random_tokens(rng, rng.randint(1, 30), rng.choice([0.2, 0.5]))
        # Each kind is cut at places of its own, as the chunks of a text are.
        cuts = [sorted(rng.randint(0, 30) for _ in range(3)) for _ in range(2)]
        parts = []
        for k in range(4):
            sides = []
            for ids, ends, c in ((whole.a, whole.ends_a, cuts[0]), (whole.b, whole.ends_b, cuts[1])):
                edges = [0, *c, 99]
                inside = (ends > edges[k]) & (ends <= edges[k + 1])
                sides += [ids[inside], ends[inside]]
            parts.append(Tokens(*sides))
        for tree in (lambda f: f(f(f(0, 1), 2), 3), lambda f: f(0, f(1, f(2, 3))), lambda f: f(f(0, 1), f(2, 3))):
            closed = []

            def join(x, y):
                left, right = (leaf(v) if isinstance(v, int) else v for v in (x, y))
                out, runs = left.then(right)
                closed.extend(runs)  # noqa: B023
                return out

            def leaf(k):
                fragment, runs = Fragment.of(parts[k])
                closed.extend(runs)  # noqa: B023
                return fragment

            total = tree(join)
            runs = sorted([*closed, total.prefix], key=lambda t: t.ends_a[-1])
            ends = np.concatenate([t.common() for t in runs])
            assert ends.tolist() == whole.common().tolist() and not len(total.suffix)
            assert np.concatenate([t.a for t in runs]).tolist() == whole.a.tolist()


def test_fast_encoder_gives_the_ids_of_the_vocabulary_file():
    enc, rng = encoders(PAIR), random.Random(8)
    alphabet = "ab XY019.,'\n\t\r\x00\x85  éß漢😀́½²sl<|endoftext|> 　"
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    samples += [" " * 3000 + "x", "\n" * 1500, "<|endoftext|>"]
    for text in samples:
        assert enc.encode_a(text).tolist() == enc.plain.encode(text, add_special_tokens=False).ids


class _Task:
    @staticmethod
    def get():
        return _Task()

    def partitionId(self):
        return 0


def test_texts_of_a_slice_are_aligned_together(monkeypatch):
    monkeypatch.setattr(al, "TaskContext", _Task)
    calls, written = [], al._written
    monkeypatch.setattr(al, "_written", lambda *args: calls.append(1) or written(*args))
    texts = ["one two", None, "", "a▁b", " ", "x" + " " * 1500 + "y", "日本語", "<|endoftext|>", "end "]
    short = al._short(al.default_pair(), 1000)

    def run(part):
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(len(part)), pa.int64()), pa.nulls(len(part), pa.int64()), pa.array(part, pa.string())],
            ["row", "id", "text"],
        )
        return [{k: v for k, v in r.items() if k not in ("block", "row")} for b in short(iter([batch])) for r in b.to_pylist()]

    together = run(texts)
    assert len(calls) == 1
    assert together == [run([text])[0] for text in texts]
    assert [r["n_a"] > 0 for r in together] == [True, False, False, False, True, True, True, True, True]
