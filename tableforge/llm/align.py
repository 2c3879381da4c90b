"""Alignment of two tokenizers' tokens, by fragments that compose associatively."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableforge.llm.texts import stored
from tableforge.workspace import fresh_folder

# Texts of two chunks or more are cut, into chunks of so many characters.
CHUNK = 1 << 15
# Tokens of a block of documents, whose counts are looked up together.
BLOCK = 4_000_000
# Fragments composed at a time.
FAN_IN = 8
_LINKS = 2_000_000
_CHARS = 1_000_000
# The fast byte-level encoder recurses over white space; longer runs of it go to the plain one.
_LONG_BLANK = re.compile(r"\s{1000}")
# Such a run holds four neighbours among every 250th character, which is looked for first.
_MAYBE_LONG, _STEP = re.compile(r"\s{4}"), 250
# A word's last character and what follows it are never in one token of the byte-level tokenizer,
# and a blank after another character always starts a new piece of the other one.
_CUT_A = re.compile(r"(?<=[A-Za-z0-9])(?=[\t\n\r -/:-@\[-`{-~])")
_CUT_B = re.compile(r"(?<=[^ ])(?= )")


# ---- the two tokenizers ---------------------------------------------------------------------


@dataclass(frozen=True)
class Pair:
    """Where the files of the tokenizers are: a byte-level BPE in JSON, and a SentencePiece model."""

    a: str
    b: str


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: visible ones as they are, others from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in seen}
    for b in sorted(set(range(256)) - set(seen)):
        out[chr(256 + len(out) - len(seen))] = b
    return out


class Encoders:
    """Both tokenizers with the bytes of their tokens. Special tokens in a text are plain text."""

    def __init__(self, pair: Pair) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(pair.a)
        self.plain.encode_special_tokens = True
        alphabet = _byte_alphabet()
        special = {t.content for t in self.plain.get_added_tokens_decoder().values()}
        ranks = {
            bytes(alphabet[c] for c in token): i
            for token, i in self.plain.get_vocab().items()
            if token not in special
        }
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = self._table({i: token for token, i in ranks.items()})
        self.model = sentencepiece.SentencePieceProcessor(model_file=pair.b)
        pieces = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                pieces[i] = bytes([int(piece[1:-1], 16)])
            elif not (self.model.is_control(i) or self.model.is_unknown(i)):
                pieces[i] = piece.replace("▁", " ").encode()
        if any(b" " in piece.lstrip(b" ") for piece in pieces.values()):
            raise ValueError("a piece with a blank after another character")
        self.bytes_b = self._table(pieces)
        self.blank = [i for i, piece in pieces.items() if piece == b" " and not self.model.is_byte(i)][:1]
        self.len_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.len_b = np.array([len(t) for t in self.bytes_b], np.int64)
        # Ids in decimal, each followed by "," (0), "|" (1), ";" (2).
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.decimal = _entries([f"{i}{sep}".encode() for i in range(most) for sep in ",|;"])
        self.entries_a, self.entries_b = _entries(self.bytes_a), _entries(self.bytes_b)

    @staticmethod
    def _table(tokens: dict[int, bytes]) -> list[bytes]:
        return [tokens.get(i, b"") for i in range(1 + max(tokens))]

    def encode_a(self, text: str) -> np.ndarray:
        if _MAYBE_LONG.search(text[::_STEP]) and _LONG_BLANK.search(text):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.int64)
        return np.array(self.fast.encode_ordinary(text), np.int64)

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Pieces of texts that begin with the blank which the model adds."""
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [ids if len(t) > 1 else self.blank[: len(t)] for t, ids in zip(texts, found, strict=True)]

    def whole(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, texts_a: list[bytes], texts_b: list[bytes]) -> np.ndarray:
        """Whether the joined bytes of both kinds' tokens are the text: for texts with so many tokens each, one after another."""
        same_a = [x == t for x, t in zip(_spelled(self.entries_a, a, n_a), texts_a, strict=True)]
        same_b = [x == t for x, t in zip(_spelled(self.entries_b, b, n_b), texts_b, strict=True)]
        return np.array(same_a, bool) & np.array(same_b, bool)


def _entries(values: list[bytes]) -> pa.LargeBinaryArray:
    return pa.array(values, pa.large_binary())


def _spelled(entries: pa.LargeBinaryArray, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The entries of ids, joined for each of the runs that have so many ids."""
    if not len(ids):
        return [b""] * len(sizes)
    _, ends, data = entries.take(pa.array(ids)).buffers()
    ends = np.frombuffer(ends, np.int64, len(ids) + 1)
    data = data.to_pybytes() if data else b""
    return [data[i:j] for i, j in pairwise(ends[_edges(sizes)].tolist())]


def _edges(sizes: np.ndarray) -> np.ndarray:
    """Where runs of so many items begin, and where the last one ends."""
    return np.append(0, np.cumsum(sizes)).astype(np.int64)


def _flat(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and how many each list or array has."""
    sizes = np.array([len(x) for x in ids], np.int64)
    if ids and isinstance(ids[0], np.ndarray):
        return np.concatenate(ids), sizes
    return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes


@lru_cache(maxsize=2)
def encoders(pair: Pair) -> Encoders:
    return Encoders(pair)


# ---- fragments ------------------------------------------------------------------------------


@dataclass
class Tokens:
    """Tokens of both kinds, each with the byte at which it ends."""

    a: np.ndarray
    ends_a: np.ndarray
    b: np.ndarray
    ends_b: np.ndarray

    @classmethod
    def none(cls) -> Tokens:
        return cls(*(np.empty(0, np.int64) for _ in range(4)))

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(p) for p in zip(self.parts(), other.parts(), strict=True)))

    def parts(self) -> tuple:
        return self.a, self.ends_a, self.b, self.ends_b

    def __len__(self) -> int:
        return len(self.a) + len(self.b)

    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """For every token of either kind, whether one of the other kind ends where it does."""
        if not len(self.a) or not len(self.b):
            return np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        first, last = min(self.ends_a[0], self.ends_b[0]), max(self.ends_a[-1], self.ends_b[-1])
        a, b, marks = self.ends_a - first, self.ends_b - first, np.zeros(last - first + 1, bool)
        marks[a] = True
        in_b = marks[b]
        marks[a] = False
        marks[b] = True
        return marks[a], in_b

    def common(self) -> np.ndarray:
        """The bytes at which tokens of both kinds end."""
        return self.ends_a[self.shared()[0]]

    def upto(self, end: int) -> tuple[Tokens, Tokens]:
        """The tokens that end at ``end`` or before, and the others."""
        i, j = (int(np.searchsorted(e, end, "right")) for e in (self.ends_a, self.ends_b))
        return (
            Tokens(self.a[:i], self.ends_a[:i], self.b[:j], self.ends_b[:j]),
            Tokens(self.a[i:], self.ends_a[i:], self.b[j:], self.ends_b[j:]),
        )


@dataclass
class Fragment:
    """What a stretch of a text says of its groups: an element of a monoid.

    ``cut`` tells whether both kinds end somewhere together. If so, ``prefix`` has the tokens up to the first such
    place, whose group begins in what is before, and ``suffix`` those after the last one; closed groups between the two
    are not kept here. If not, all tokens are in ``prefix``. No tokens at all are the neutral element.
    """

    prefix: Tokens
    suffix: Tokens
    cut: bool

    @classmethod
    def of(cls, tokens: Tokens) -> tuple[Fragment, list[Tokens]]:
        """The fragment of some tokens, and the run of groups that are closed inside it."""
        common = tokens.common()
        if not len(common):
            return cls(tokens, Tokens.none(), False), []
        prefix, rest = tokens.upto(common[0])
        closed, suffix = rest.upto(common[-1])
        return cls(prefix, suffix, True), [closed] if len(closed) else []

    def then(self, other: Fragment) -> tuple[Fragment, list[Tokens]]:
        """Both in order, and the runs of groups that this closes. Associative."""
        if not self.cut and not other.cut:
            return Fragment.of(self.prefix + other.prefix)
        if self.cut and other.cut:
            # Both ends of what lies between the two are known, so all of it is closed.
            between = self.suffix + other.prefix
            return Fragment(self.prefix, other.suffix, True), [between] if len(between) else []
        middle, closed = Fragment.of((self.suffix if self.cut else self.prefix) + other.prefix)
        if self.cut:
            # What comes before the first common end belongs to the group after our last one.
            if not middle.cut:
                return Fragment(self.prefix, middle.prefix, True), []
            return Fragment(self.prefix, middle.suffix, True), [middle.prefix, *closed]
        # The other's prefix ends at a common place, so the middle is cut and has no suffix.
        return Fragment(middle.prefix, other.suffix, True), closed


# ---- groups and links -----------------------------------------------------------------------


def _groups(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of every token of either kind, and how many groups there are."""
    # A token's group is the number of common ends before its own.
    a, b = tokens.shared()
    return np.cumsum(a) - a, np.cumsum(b) - b, int(np.count_nonzero(a))


def _written(tokens: Tokens, enc: Encoders, sizes: np.ndarray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3``: the ids of every group, in order, for each of the runs that have so many tokens of both kinds."""
    ga, gb, n = _groups(tokens)
    if not n:
        return [b""] * len(sizes)
    start_b, end_a = np.searchsorted(gb, ga), np.searchsorted(ga, gb, "right")
    out = np.empty(len(ga) + len(gb), np.int64)
    last = lambda g: np.append(g[1:] != g[:-1], True)
    out[np.arange(len(ga)) + start_b] = tokens.a * 3 + last(ga)
    out[np.arange(len(gb)) + end_a] = tokens.b * 3 + 2 * last(gb)
    return [data[:-1] for data in _spelled(enc.decimal, out, sizes)]


def _links(tokens: Tokens, base: int, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All links in pieces of bounded size: the part each lies in, its ids as ``a * base + b``, how often it occurs.

    ``part`` has the part (a text, say) of every A token. Big groups are linked by their different ids.
    """
    ga, gb, n = _groups(tokens)
    if not n:
        return
    na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    a, b, ma, mb = tokens.a, tokens.b, np.ones(len(ga), np.int64), np.ones(len(gb), np.int64)
    big = na * nb > 1 << 12
    if big.any():
        a, ga, ma, first = _merged(a, ga, big)
        part = part[first]
        b, gb, mb, _ = _merged(b, gb, big)
        nb = np.bincount(gb, minlength=n)
    start = np.concatenate([[0], np.cumsum(nb)])[ga]
    many = nb[ga]
    total = np.cumsum(many)
    i = 0
    while i < len(a):
        done = total[i - 1] if i else 0
        j = max(int(np.searchsorted(total, done + _LINKS, "right")), i + 1)
        k = many[i:j]
        place = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start[i:j], k)
        yield np.repeat(part[i:j], k), np.repeat(a[i:j], k) * base + b[place], np.repeat(ma[i:j], k) * mb[place]
        i = j


def _merged(ids: np.ndarray, groups: np.ndarray, big: np.ndarray) -> tuple:
    """Equal ids of a big group as one with their number; and the first place of each."""
    key = np.where(big[groups], ids, -1 - np.arange(len(ids)))
    order = np.lexsort((key, groups))
    k, g = key[order], groups[order]
    fresh = np.append(True, (k[1:] != k[:-1]) | (g[1:] != g[:-1]))
    at = np.flatnonzero(fresh)
    first = order[at]
    return ids[first], g[at], np.diff(np.append(at, len(ids))), first


# ---- tasks ----------------------------------------------------------------------------------

_RUN = (
    "block long, row long, id long, at long, n_a long, n_b long, n_groups long, sha string, "
    "a binary, b binary"
)
_RUN_SCHEMA = pa.schema([
    *[(c, pa.int64()) for c in ("block", "row", "id", "at", "n_a", "n_b", "n_groups")],
    ("sha", pa.string()), ("a", pa.binary()), ("b", pa.binary()),
])


def _packed(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _cut_packed(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    data = _packed(ids)
    return [data[4 * i : 4 * j] for i, j in pairwise(_edges(sizes).tolist())]


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.int64)


def _tokens(a: np.ndarray, b: np.ndarray, enc: Encoders, at: int = 0) -> Tokens:
    return Tokens(a, at + np.cumsum(enc.len_a[a]), b, at + np.cumsum(enc.len_b[b]))


class _Blocks:
    """Numbers blocks of about so many tokens; a task's numbers are its own."""

    def __init__(self, tokens: int) -> None:
        self.block, self.room, self.tokens = TaskContext.get().partitionId() << 32, tokens, tokens

    def of(self, tokens: int) -> int:
        if self.room <= 0:
            self.block, self.room = self.block + 1, self.tokens
        self.room -= tokens
        return self.block


def _sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces with about a megabyte of texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        marks = np.cumsum(sizes) // _CHARS
        edges = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), batch.num_rows]
        for i, j in pairwise(edges):
            if j > i:
                yield batch.slice(i, j - i)


def _short(pair: Pair, block: int):
    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, blocks = encoders(pair), _Blocks(block)
        for batch in _sliced(batches, 2):
            texts = [" " + t if t else "" for t in batch.column(2).to_pylist()]
            data = [t.encode() for t in texts]
            (a, n_a), (b, n_b) = _flat([enc.encode_a(t) for t in texts]), _flat(enc.encode_b(texts))
            sound = enc.whole(a, n_a, b, n_b, data, data) & (n_a > 0)
            a, b = a[np.repeat(sound, n_a)], b[np.repeat(sound, n_b)]
            n_a, n_b = n_a * sound, n_b * sound
            # Both kinds of a sound text cover its bytes, so texts one after another stay aligned.
            tokens = _tokens(a, b, enc)
            common, ends = tokens.common(), np.cumsum([len(d) if ok else 0 for d, ok in zip(data, sound, strict=True)])
            groups = np.diff(np.searchsorted(common, ends, "right"), prepend=0)
            written = _written(tokens, enc, n_a + n_b)
            shas = [hashlib.sha256(w).hexdigest() if ok else "" for w, ok in zip(written, sound, strict=True)]
            numbers = [blocks.of(n) for n in (n_a + n_b).tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers, pa.int64()), batch.column(0), batch.column(1), pa.array(np.zeros(len(texts), np.int64)),
                    pa.array(n_a), pa.array(n_b), pa.array(groups.astype(np.int64)), pa.array(shas, pa.string()),
                    pa.array(_cut_packed(a, n_a), pa.binary()), pa.array(_cut_packed(b, n_b), pa.binary()),
                ],
                schema=_RUN_SCHEMA,
            )

    return short


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


_CHUNKS = "row long, id long, k long, chunks long, text_a string, at_a long, text_b string, at_b long"


def _cuts(text: str, pattern: re.Pattern, chunk: int) -> list[int]:
    """Where chunks begin and end: at the first safe place after each multiple of ``chunk``."""
    edges = [0]
    for start in range(chunk, len(text), chunk):
        found = pattern.search(text, max(start, edges[-1]))
        edges.append(found.start() if found else len(text))
    return [*edges, len(text)]


def _cut(chunk: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            *[(c, pa.int64()) for c in ("row", "id", "k", "chunks")],
            ("text_a", pa.string()), ("at_a", pa.int64()), ("text_b", pa.string()), ("at_b", pa.int64()),
        ])
        for batch in batches:
            for row, doc, value in zip(*(c for c in batch.columns), strict=True):
                text = " " + value.as_py()
                sides = []
                for pattern in (_CUT_A, _CUT_B):
                    edges = _cuts(text, pattern, chunk)
                    parts = [text[i:j] for i, j in pairwise(edges)]
                    sides.append((parts, np.cumsum([0, *(len(p.encode()) for p in parts)]).tolist()))
                (a, at_a), (b, at_b) = sides
                yield _batch(
                    [
                        (row.as_py(), doc.as_py(), k, len(a), a[k], at_a[k], b[k], at_b[k])
                        for k in range(len(a))
                    ],
                    schema,
                )

    return cut


# Kind 0: a run of closed groups. Kind 1: a fragment, whose tokens are those of its prefix (a, b) and of its suffix.
_FRAGMENT = (
    "row long, k long, kind int, whole boolean, cut boolean, at long, a binary, ends_a binary, b binary, ends_b binary, "
    "sa binary, sends_a binary, sb binary, sends_b binary"
)
_FRAGMENT_SCHEMA = pa.schema([
    ("row", pa.int64()), ("k", pa.int64()), ("kind", pa.int32()), ("whole", pa.bool_()), ("cut", pa.bool_()),
    ("at", pa.int64()), *[(c, pa.binary()) for c in ("a", "ends_a", "b", "ends_b", "sa", "sends_a", "sb", "sends_b")],
])
_NO = (b"",) * 4


def _bytes(tokens: Tokens) -> tuple:
    return tuple(p.astype("<i8").tobytes() for p in tokens.parts())


def _fragment_rows(row: int, k: int, whole: bool, fragment: Fragment, closed: list[Tokens]) -> list[tuple]:
    out = [(row, k, 1, whole, fragment.cut, 0, *_bytes(fragment.prefix), *_bytes(fragment.suffix))]
    # A run is known by where it ends.
    return out + [(row, k, 0, True, True, int(run.ends_a[-1]), *_bytes(run), *_NO) for run in closed]


def _read_tokens(values) -> Tokens:
    return Tokens(*(np.frombuffer(v, "<i8") for v in values))


def _chunked(pair: Pair):
    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(pair)
        for batch in _sliced(batches, 4):
            out = []
            for r in batch.to_pylist():
                (a, n_a), (b, n_b) = _flat([enc.encode_a(r["text_a"])]), _flat(enc.encode_b([r["text_b"]]))
                whole = bool(enc.whole(a, n_a, b, n_b, [r["text_a"].encode()], [r["text_b"].encode()])[0])
                tokens = Tokens(
                    a, r["at_a"] + np.cumsum(enc.len_a[a]), b, r["at_b"] + np.cumsum(enc.len_b[b])
                )
                # A text that does not come back has no tokens at all, so its ends mean nothing.
                fragment, closed = Fragment.of(tokens if whole else Tokens.none())
                out += _fragment_rows(r["row"], r["k"], whole, fragment, closed)
            yield _batch(out, _FRAGMENT_SCHEMA)

    return chunked


def _composed(fan_in: int):
    def composed(rows: pa.Table) -> pa.Table:
        """Neighbouring fragments of a text as one, and the runs that this closes."""
        found = rows.sort_by("k").to_pylist()
        names = _FRAGMENT_SCHEMA.names[6:]
        total, closed = Fragment(Tokens.none(), Tokens.none(), False), []
        for r in found:
            values = [r[n] for n in names]
            total, runs = total.then(Fragment(_read_tokens(values[:4]), _read_tokens(values[4:]), r["cut"]))
            closed += runs
        whole = all(r["whole"] for r in found)
        out = _fragment_rows(found[0]["row"], found[0]["k"] // fan_in, whole, total, closed)
        return pa.Table.from_batches([_batch(out, _FRAGMENT_SCHEMA)])

    return composed


def _long_runs(pair: Pair, block: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, blocks = encoders(pair), _Blocks(block)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                tokens = _read_tokens([r[n] for n in ("a", "ends_a", "b", "ends_b")])
                n = len(tokens.common())
                out.append((
                    blocks.of(len(tokens)), r["row"], r["id"], r["at"], len(tokens.a), len(tokens.b), n, None,
                    _packed(tokens.a), _packed(tokens.b),
                ))
            yield _batch(out, _RUN_SCHEMA)

    return runs


def _long_hashes(pair: Pair):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A hash over each text's runs, which come in order."""
        enc, schema = encoders(pair), pa.schema([("row", pa.int64()), ("sha", pa.string())])
        row, digest = None, None
        for batch in batches:
            out = []
            for key, a, b in zip(*(batch.column(c) for c in ("row", "a", "b")), strict=True):
                tokens = _tokens(_unpacked(a.as_py()), _unpacked(b.as_py()), enc)
                written = _written(tokens, enc, np.array([len(tokens)]))[0]
                if key.as_py() == row:
                    digest.update(b";" + written)
                    continue
                if digest is not None:
                    out.append((row, digest.hexdigest()))
                row, digest = key.as_py(), hashlib.sha256(written)
            yield _batch(out, schema)
        if digest is not None:
            yield _batch([(row, digest.hexdigest())], schema)

    return hashes


def _joined(batch: pa.RecordBatch, enc: Encoders) -> tuple[Tokens, np.ndarray]:
    """The tokens of all runs of a batch one after another, and the run of each A token.

    Both kinds of a run cover the same bytes, so they stay aligned.
    """
    a = [_unpacked(v.as_py()) for v in batch.column("a")]
    b = [_unpacked(v.as_py()) for v in batch.column("b")]
    empty = [np.empty(0, np.int64)]
    tokens = _tokens(np.concatenate(a + empty), np.concatenate(b + empty), enc)
    return tokens, np.repeat(np.arange(len(a)), [len(x) for x in a])


def _pairs(pair: Pair):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different id pairs of each block; and how many texts hold each, or for a text in several runs its row."""
        enc, base = encoders(pair), len(encoders(pair).bytes_b)
        schema = pa.schema([(c, pa.int64()) for c in ("block", "pair", "docs", "row")])
        for batch in _sliced(batches, 3):
            block = batch.column("block").to_numpy()
            row, lone = batch.column("row").to_numpy(), batch.column("lone").to_numpy(zero_copy_only=False)
            tokens, run = _joined(batch, enc)
            # Each pair of a run once; a slice of links may end within a run, so they meet here.
            seen = [_different(part, key) for part, key, _ in _links(tokens, base, run)]
            if not seen:
                continue
            part, key = _different(*(np.concatenate(c) for c in zip(*seen, strict=True))) if len(seen) > 1 else seen[0]
            single = lone[part]
            for b in np.unique(block):
                here = single & (block[part] == b)
                keys, docs = np.unique(key[here], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), b)), pa.array(keys), pa.array(docs.astype(np.int64)), pa.nulls(len(keys), pa.int64())],
                    schema=schema,
                )
            if not single.all():
                many = ~single
                n = int(many.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[part[many]]), pa.array(key[many]), pa.nulls(n, pa.int64()), pa.array(row[part[many]])],
                    schema=schema,
                )

    return pairs


def _different(part: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return part, key
    # As one number each: a batch has few runs, and a key has two ids.
    span = int(key.max()) + 1
    both = np.sort(part * span + key)
    return np.divmod(both[np.append(True, both[1:] != both[:-1])], span)


_SCORE = (
    "row long, id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, sha string"
)


def _scored(pair: Pair):
    def scored(runs: pa.Table, counts: pa.Table) -> pa.Table:
        """The sums over the links of each run, by the counts of its block's pairs."""
        enc, base = encoders(pair), len(encoders(pair).bytes_b)
        counts = counts.sort_by("pair")
        keys, docs, best = (counts[c].to_numpy() for c in ("pair", "docs", "best"))
        out = []
        for batch in _sliced(iter(runs.to_batches()), 8):
            tokens, run = _joined(batch, enc)
            sums = np.zeros((3, batch.num_rows), np.int64)
            for part, key, often in _links(tokens, base, run):
                at = np.searchsorted(keys, key)
                for i, value in enumerate((often, often * best[at], often * docs[at])):
                    np.add.at(sums[i], part, value)
            kept = [batch.column(c) for c in ("row", "id", "n_a", "n_b", "n_groups")]
            out.append(
                pa.RecordBatch.from_arrays(
                    [*kept, *map(pa.array, sums), batch.column("sha")],
                    ["row", "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha"],
                )
            )
        return pa.Table.from_batches(out)

    return scored


# ---- the operator ---------------------------------------------------------------------------


def _long_texts(texts: DataFrame, pair: Pair, chunk: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """Runs of closed groups of long texts, ``row, id, at, a, ends_a, b, ends_b``; and ``row, id`` of all of them."""
    chunks = stored(texts.mapInArrow(_cut(chunk), _CHUNKS), "align-chunks")
    heads = chunks.filter("k = 0").select("row", "id", "chunks")
    fragments = stored(chunks.repartition("row", "k").mapInArrow(_chunked(pair), _FRAGMENT), "align-fragments")
    closed = [fragments.filter("kind = 0")]
    # Each level composes neighbours; how many there are follows from the longest text alone.
    left = heads.agg(F.max("chunks").alias("n")).first()["n"] or 0
    while left > 1:
        level = fragments.filter("kind = 1").groupBy("row", F.floor(F.col("k") / fan_in).alias("_group"))
        fragments = stored(level.applyInArrow(_composed(fan_in), _FRAGMENT), "align-level")
        closed.append(fragments.filter("kind = 0"))
        left = -(-left // fan_in)
    last = fragments.filter("kind = 1")
    # A text begins where both kinds do, so what is left of its prefix is a closed group.
    ends = ("a", "ends_a", "b", "ends_b")
    first = last.filter("cut").select("row", F.lit(0).cast("long").alias("at"), *ends)
    runs = first
    for part in closed:
        runs = runs.union(part.select("row", "at", *ends))
    sound = heads.join(last.filter("whole").select("row"), "row").select("row", "id")
    return runs.join(sound, "row"), heads.select("row", "id")


def align(
    docs: DataFrame, pair: Pair, doc_id: str = "doc_id", text: str = "text",
    chunk: int = CHUNK, block: int = BLOCK, fan_in: int = FAN_IN,
) -> DataFrame:
    """Which tokens of two tokenizers cover the same bytes of every text, and how usual that is.

    Every text gets a blank in front. Bytes at which tokens of both kinds end cut it into groups; all A and B tokens of a
    group are linked. A link counts in how many documents its pair of ids is linked, corpus-wide.

    Returns per document ``doc_id``; ``n_a``, ``n_b``, ``n_groups``, ``n_links``; ``n_best``, the links whose count is the highest
    of their A id; ``count_sum`` over the links (long); ``groups_sha256`` of the groups as text. A text that is null, empty, or
    not given back by either kind's tokens has no tokens: zeros and an empty text. Repeated rows are documents
    of their own. Other columns are ignored.

    Texts of two chunks or more are cut into byte ranges, for each kind where its own tokens can be cut, so that a range's two kinds
    do not end alike. Each yields a fragment: an open prefix, closed groups, an open suffix. Fragments compose associatively, ``fan_in``
    at a time, level by level; only open ends are moved, closed groups stay. A stretch without a place to cut goes to one task.

    Tokens are written once, in a table bucketed by blocks of documents, and read where they are: a block gets the counts
    of its own different pairs by a join, of which there are few against its links. All memory is bounded by
    ``block`` and ``chunk``.
    """
    spark = docs.sparkSession
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")
    )
    long = F.coalesce(F.length("text") >= 2 * chunk, F.lit(False))
    # Long texts have negative numbers, for the two parts are numbered apart.
    cut = numbered.filter(long).withColumn("row", -1 - F.col("row"))
    runs, heads = _long_texts(cut, pair, chunk, fan_in)
    short = numbered.filter(~long).mapInArrow(_short(pair, block), _RUN)
    long_runs = runs.mapInArrow(_long_runs(pair, block), _RUN)

    name = f"align_{uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    (
        short.union(long_runs)
        .write.bucketBy(buckets, "block")
        .option("path", fresh_folder(spark, "align-tokens"))
        .option("compression", "zstd")
        .saveAsTable(name)
    )
    tokens = spark.table(name)

    lone = tokens.select("block", "row", (F.col("row") >= 0).alias("lone"), "a", "b")
    pairs = stored(lone.mapInArrow(_pairs(pair), "block long, pair long, docs long, row long"), "align-pairs")
    single = pairs.filter("row IS NULL").groupBy("pair").agg(F.sum("docs").alias("docs"))
    several = pairs.filter("row IS NOT NULL").select("row", "pair").distinct().groupBy("pair").agg(F.count("*").alias("docs"))
    counts = stored(single.union(several).groupBy("pair").agg(F.sum("docs").alias("docs")), "align-counts")
    a_id = F.floor(F.col("pair") / len(encoders(pair).bytes_b)).alias("a_id")
    top = counts.groupBy(a_id).agg(F.max("docs").alias("top"))
    known = counts.withColumn("a_id", a_id).join(top, "a_id").select(
        "pair", "docs", (F.col("docs") == F.col("top")).cast("long").alias("best")
    )
    asked = pairs.select("block", "pair").distinct().join(known, "pair").select("block", "pair", "docs", "best")

    scores = tokens.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_scored(pair), _SCORE)
    scores = stored(scores, "align-scores")
    spark.sql(f"DROP TABLE {name}")
    sums = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    hashes = (
        runs.select("row", "at", "a", "b").mapInArrow(_repacked, "row long, at long, a binary, b binary")
        .repartition("row").sortWithinPartitions("row", "at")
        .mapInArrow(_long_hashes(pair), "row long, sha string")
    )
    totals = scores.filter("row < 0").groupBy("row").agg(*[F.sum(c).alias(c) for c in sums])
    result = lambda sha: [F.col("id").alias(doc_id), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums], sha.alias("groups_sha256")]
    return (
        scores.filter("row >= 0").select(*result(F.col("sha")))
        .union(
            heads.join(totals, "row", "left").join(hashes, "row", "left")
            .select(*result(F.coalesce("sha", F.lit(""))))
        )
    )


def _repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of runs in four bytes each, as the token table has them."""
    for batch in batches:
        a, b = ([_packed(np.frombuffer(v.as_py(), "<i8")) for v in batch.column(c)] for c in ("a", "b"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("at"), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
            ["row", "at", "a", "b"],
        )


def default_pair() -> Pair:
    import public_tokenizers

    return Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def alignment_query(docs: DataFrame, pair: Pair | None = None) -> DataFrame:
    return align(docs, pair or default_pair())
