"""SentencePiece encoding and decoding by a max-plus parallel scan."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value of the format: the mark for a space.
SPACE = "▁"

CHUNK = 1 << 14
NEVER = -(2**61)
_REMEMBERED = 300_000
# Texts whose new units are cut together; none has two chunks.
_TOGETHER = 256
# Longer units are found by the scan's own forward pass.
_SHORT = 48
# Blanks and what follows them. No piece holds a blank after another character, so every way to cut
# a text into pieces cuts here too.
_UNIT = re.compile(" +[^ ]*")
_ENCODED = "id long, ids array<int>, score long, round_trip boolean"


@dataclass
class Vocabulary:
    """Pieces, with blanks as blanks, and their whole-number scores; a piece per byte value."""

    ids: dict[str, int]
    scores: dict[str, int]
    byte_ids: list[int]
    # The model itself, which cuts short units; without it they are merged here.
    model: bytes | None = None

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.ids))
        self.bytes_of = {i: piece.encode() for piece, i in self.ids.items()}
        self.bytes_of |= {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        if any(" " in piece.lstrip(" ") for piece in self.ids):
            raise ValueError("a piece with a blank after another character")
        # What two neighbours merge into, by their ids: the better the score, the smaller the number.
        self.base = 1 + max([*self.ids.values(), *self.byte_ids])
        order = {score: i for i, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.joint = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    self.joint[left * self.base + right] = order[self.scores[piece]] * self.base + i
        count = Counter(self.scores.values())
        self.tied = {i for piece, i in self.ids.items() if count[self.scores[piece]] > 1}
        self.score_of = np.zeros(self.base, np.int64)
        for piece, i in self.ids.items():
            self.score_of[i] = self.scores[piece]


def load_vocabulary(path: str) -> Vocabulary:
    """The pieces of a SentencePiece BPE model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, byte_ids = {}, {}, [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            piece = piece.replace(SPACE, " ")
            ids[piece], scores[piece] = i, round(model.get_score(i))
    return Vocabulary(ids, scores, byte_ids, model.serialized_model_proto())


def decode_ids(ids, vocabulary: Vocabulary) -> str:
    """The text of some pieces; the blank put before every text is taken off again."""
    return b"".join([vocabulary.bytes_of[i] for i in ids]).decode("utf-8", "replace")[1:]


class Segmenter:
    """The pieces of a BPE model for a text, as merging the best neighbours first would give them.

    Merging is replaced by a search for the best path: a way to cut a text scores minus infinity
    unless merging leaves each piece whole and every two neighbours apart. Exactly one way is left, and
    it is the merged one: no merge ever crosses the cuts that remain, so neighbours evolve
    as they would alone. So the piece that ends at a place follows from the one before it.
    A character that is no piece is written as its UTF-8 bytes and scores 0.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.ids: dict[str, list[int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.model = None
        if vocabulary.model is not None:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)

    def merged(self, text: str) -> list[str]:
        """A short text merged: the neighbours with the best joint score first, the leftmost on a tie."""
        parts, scores = list(text), self.v.scores
        # The joint score of every two neighbours; a merge changes two of them.
        joint = [scores.get(a + b, NEVER) for a, b in pairwise(parts)]
        while joint and (top := max(joint)) != NEVER:
            i = joint.index(top)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joint[i]
            if i < len(joint):
                joint[i] = scores.get(parts[i] + parts[i + 1], NEVER)
            if i:
                joint[i - 1] = scores.get(parts[i - 1] + parts[i], NEVER)
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Whether merging leaves two pieces whole and apart; an empty one is the start of a text."""
        found = self.pairs.get((left, right))
        if found is None:
            found = self.merged(left + right) == [p for p in (left, right) if p]
            if len(self.pairs) >= _REMEMBERED:
                self.pairs.clear()
            self.pairs[left, right] = found
        return found

    def pieces_ending(self, text: str, end: int) -> Iterator[tuple[int, int]]:
        """Lengths and scores of the pieces of ``text`` that end at ``end``, longest first."""
        scores = self.v.scores
        for size in range(min(self.v.longest, end), 0, -1):
            score = scores.get(text[end - size : end])
            if score is not None:
                yield size, score
            elif size == 1:
                yield 1, 0

    def forward(self, text: str, sizes: list[int | None], best: list[int]) -> None:
        """Follow the path from the places known so far to the end of ``text``.

        ``sizes`` has the length of the piece that ends at each place, 0 at the start of a text and
        None where no piece ends; ``best`` has the scores.
        """
        for end in range(len(sizes), len(text) + 1):
            chosen, total = None, NEVER
            for size, score in self.pieces_ending(text, end):
                place = end - size
                before = sizes[place]
                if before is not None and self.apart(text[place - before : place], text[place:end]):
                    chosen, total = size, best[place] + score
                    break
            sizes.append(chosen)
            best.append(total)

    def ids_of(self, piece: str) -> list[int]:
        found = self.v.ids.get(piece)
        return [found] if found is not None else [self.v.byte_ids[b] for b in piece.encode()]

    def back(self, text: str, sizes: list[int | None], end: int, start: int) -> tuple[list[int], int]:
        """The pieces up to ``end``, back to the first cut at or before ``start``; and that cut."""
        parts = []
        while end > start:
            size = sizes[end]
            parts.append(self.ids_of(text[end - size : end]))
            end -= size
        return [i for part in reversed(parts) for i in part], end

    def merged_ids(self, text: str) -> list[int]:
        """The ids of a short text merged, as ``merged`` does it."""
        ids, joint, base = self.v.ids, self.v.joint, self.v.base
        parts = list(map(ids.get, text))
        if None not in parts:
            never = base * base
            pairs = [joint.get(a * base + b, never) for a, b in pairwise(parts)]
            while pairs and (top := min(pairs)) != never:
                new = top % base
                if new in self.v.tied:
                    break
                i = pairs.index(top)
                parts[i : i + 2] = [new]
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = joint.get(new * base + parts[i + 1], never)
                if i:
                    pairs[i - 1] = joint.get(parts[i - 1] * base + new, never)
            else:
                return parts
        # A character without a piece, or pieces with equal scores, of which the leftmost goes first.
        return [i for p in self.merged(text) for i in self.ids_of(p)]

    def units(self, texts: list[str]) -> list[int]:
        """The pieces of some units, which stand for themselves; each different one is cut once."""
        self.learn(texts)
        return list(chain.from_iterable(map(self.ids.__getitem__, texts)))

    def learn(self, texts: list[str]) -> None:
        """Cut the units that are not known yet; all of these are known then."""
        new = set(texts).difference(self.ids)
        if len(self.ids) + len(new) > _REMEMBERED:
            self.ids.clear()
            new = set(texts)
        if self.model is not None:
            # The model puts the first blank there itself; a lone one and a literal mark it would take otherwise.
            plain = [t for t in new if 1 < len(t) <= _SHORT and t[0] == " " and SPACE not in t]
            self.ids.update(zip(plain, self.model.encode([t[1:] for t in plain], num_threads=1), strict=True))
            new.difference_update(plain)
        for text in new:
            if len(text) <= _SHORT:
                self.ids[text] = self.merged_ids(text)
            else:
                sizes, best = [0], [0]
                self.forward(text, sizes, best)
                self.ids[text] = self.back(text, sizes, len(text), 0)[0]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The pieces of whole texts; new units of all of them are cut together."""
        split = [_UNIT.findall(" " + text) if text else [] for text in texts]
        self.learn(list(chain.from_iterable(split)))
        known = self.ids.__getitem__
        return [np.array(list(chain.from_iterable(map(known, units))), np.int32) for units in split]


# ---- the scan over the chunks of a giant document -----------------------------------------


def chunk_bounds(length: int, chunk: int) -> list[int]:
    """Where chunks of at least ``chunk`` characters begin and end."""
    return [*range(0, max(length // chunk, 1) * chunk, chunk), length]


def _unit_cuts(text: str, start: int, margin: int) -> tuple[int | None, int | None]:
    """The first and last place after ``start`` where every way to cut cuts, ``margin`` before the end."""
    places = [
        m.start()
        for m in _UNIT.finditer(text, start)
        if start < m.start() <= len(text) - margin and text[m.start() - 1] != " "
    ]
    return (places[0], places[-1]) if places else (None, None)


def states(seg: Segmenter, text: str, end: int) -> list[tuple[int, int]]:
    """How a text may be cut near ``end``: the last cut, as its distance from ``end``, and the
    length of the piece that ends there, 0 for the start of the text."""
    found = [(end, 0)] if end < seg.v.longest else []
    for distance in range(min(seg.v.longest, end)):
        place = end - distance
        for size, _ in seg.pieces_ending(text, place):
            if seg.apart("", text[place - size : place]):
                found.append((distance, size))
    return found


def _run(seg: Segmenter, text: str, cut: int, size: int) -> tuple[list, list]:
    """The path from a cut that a piece of ``size`` precedes."""
    sizes: list[int | None] = [None] * cut + [size]
    best = [NEVER] * cut + [0]
    seg.forward(text, sizes, best)
    return sizes, best


def _pack(matrix: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(matrix.tobytes())


def _unpack(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64).reshape(rows, -1)


def trace(seg: Segmenter, text: str, lead: int, before: list[int]) -> tuple[list, list, list, int]:
    """The pieces of one chunk for every cut near its end by which the next may leave it.

    ``before`` has the score of each state at the chunk's start. Returns the ids up to the last place where
    all ways cut, the ids from there to q characters before the end, for each q how many
    characters before the chunk its first piece starts, or -1, and the score at the end.
    """
    sizes: list[int | None] = [None] * (lead + 1)
    best = [NEVER] * (lead + 1)
    for (distance, size), score in zip(states(seg, text, lead), before, strict=True):
        if score > NEVER // 2:
            sizes[lead - distance], best[lead - distance] = size, score
    first, last = _unit_cuts(text, lead, seg.v.longest)
    common: list[int] = []
    entry, score = -1, 0
    if first is None:
        seg.forward(text, sizes, best)
    else:
        # All ways meet at the first cut; from there to the last one the units stand for themselves.
        seg.forward(text[:first], sizes, best)
        common, cut = seg.back(text, sizes, first, lead)
        entry, score = lead - cut, best[first]
        ids = seg.units(_UNIT.findall(text[first:last]))
        common += ids
        score += int(seg.v.score_of[ids].sum())
        text = text[last:]
        sizes, best = _run(seg, text, 0, 0)
    tails, entries = [], []
    for q in range(min(seg.v.longest, len(text) - (lead if first is None else 0))):
        if sizes[len(text) - q] is None:
            tails.append([])
            entries.append(-1)
            continue
        ids, cut = seg.back(text, sizes, len(text) - q, lead if first is None else 0)
        tails.append(ids)
        entries.append(lead - cut if first is None else entry)
    return common, tails, entries, score + best[len(text)]


def transfer(seg: Segmenter, text: str, lead: int) -> np.ndarray:
    """The max-plus matrix of a chunk, ``text[lead:]``; the first ``lead`` characters are before it.

    A row for each of the states at the chunk's start, a column for each at its end: the score of the
    pieces between the two, minus infinity where no path joins them.
    """
    starts, ends = states(seg, text, lead), states(seg, text, len(text))
    out = np.full((len(starts), len(ends)), NEVER, np.int64)
    first, last = _unit_cuts(text, lead, seg.v.longest)
    stop, base = (len(text), 0) if first is None else (first, last)
    if first is not None:
        middle = int(seg.v.score_of[seg.units(_UNIT.findall(text[first:last]))].sum())
        tail = _run(seg, text[last:], 0, 0)
    for i, (distance, size) in enumerate(starts):
        sizes, best = _run(seg, text[:stop], lead - distance, size)
        score = 0
        if first is not None:
            if sizes[stop] is None:
                continue
            score = best[stop] + middle
            sizes, best = tail
        for j, (to_end, piece) in enumerate(ends):
            place = len(text) - to_end - base
            if sizes[place] == piece:
                out[i, j] = score + best[place]
    return out


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices."""
    out = np.full((len(a), b.shape[1]), NEVER, np.int64)
    for i in range(a.shape[1]):
        reached = a[:, i] > NEVER // 2
        if reached.any():
            out[reached] = np.maximum(out[reached], a[reached, i, None] + b[i])
    out[out < NEVER // 2] = NEVER
    return out


def prefix_products(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """The product of each matrix with all before it, by doubling: the product is associative."""
    out, step = list(matrices), 1
    while step < len(out):
        out = out[:step] + [max_plus(a, b) for a, b in zip(out, out[step:], strict=False)]
        step *= 2
    return out


def _direct(vocabulary: Vocabulary):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(start, _TOGETHER)
                texts = [text or "" for text in part.column(1).to_pylist()]
                rows = [
                    (ids, int(vocabulary.score_of[ids].sum()), decode_ids(ids.tolist(), vocabulary) == text)
                    for text, ids in zip(texts, seg.encode_all(texts), strict=True)
                ]
                yield _encoded(part.column(0), rows)

    return encode


def _encoded(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *[len(r[0]) for r in rows]]).astype(np.int32)
    pieces = np.concatenate([np.empty(0, np.int32), *[r[0] for r in rows]])
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(pieces)),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.bool_()),
        ],
        ["id", "ids", "score", "round_trip"],
    )


def _cut(vocabulary: Vocabulary, chunk: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = " " + value
                bounds = chunk_bounds(len(text), chunk)
                leads = [min(b, 2 * vocabulary.longest) for b in bounds[:-1]]
                bodies = [text[b - lead : e] for b, lead, e in zip(bounds, leads, bounds[1:], strict=False)]
                n = len(bodies)
                # One chunk to a batch would be many; all of one text are no more than the text.
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int64()),
                     pa.array(leads, pa.int32()), pa.array(bodies, pa.string())],
                    ["row", "id", "k", "lead", "body"],
                )

    return cut


def _transfers(vocabulary: Vocabulary):
    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(vocabulary)
        for batch in batches:
            found = [
                transfer(seg, body.as_py(), lead.as_py())
                for lead, body in zip(batch.column("lead"), batch.column("body"), strict=True)
            ]
            yield batch.append_column("rows", pa.array([len(m) for m in found], pa.int32())).append_column(
                "matrix", pa.array([_pack(m) for m in found], pa.binary())
            )

    return transfers


def _scan(chunks: pa.Table) -> pa.Table:
    """Adds to every chunk the scores of the states at its start."""
    chunks = chunks.sort_by("k")
    matrices = [_unpack(m, n) for m, n in zip(chunks["matrix"].to_pylist(), chunks["rows"].to_pylist(), strict=True)]
    before = [[0], *[p[0].tolist() for p in prefix_products(matrices)[:-1]]]
    return chunks.drop_columns(["matrix", "rows"]).append_column("before", pa.array(before, pa.list_(pa.int64())))


def _traces(vocabulary: Vocabulary):
    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(vocabulary)
        for batch in batches:
            found = [
                trace(seg, body.as_py(), lead.as_py(), before.as_py())
                for lead, body, before in zip(*(batch.column(c) for c in ("lead", "body", "before")), strict=True)
            ]
            ints = pa.list_(pa.int32())
            for name, column, kind in zip(
                ("common", "tails", "entries", "score"), zip(*found, strict=True), (ints, pa.list_(ints), ints, pa.int64()),
                strict=True,
            ):
                batch = batch.append_column(name, pa.array(list(column), kind))
            yield batch.select(["row", "id", "k", "lead", "body", "common", "tails", "entries", "score"])

    return traces


def _joiner(vocabulary: Vocabulary):
    def join(chunks: pa.Table) -> pa.Table:
        """The chunks' pieces from the last to the first: each says where the one before it ends."""
        rows = chunks.sort_by([("k", "descending")]).to_pylist()
        parts: list[list[int]] = []
        q = 0
        for row in rows:
            parts += [row["tails"][q], row["common"]]
            q = row["entries"][q]
        ids = [i for part in reversed(parts) for i in part]
        text = "".join(row["body"][row["lead"] :] for row in reversed(rows))[1:]
        batch = _encoded(
            pa.array([rows[0]["id"]], pa.int64()),
            [(np.array(ids, np.int32), rows[0]["score"], decode_ids(ids, vocabulary) == text)],
        )
        return pa.Table.from_batches([batch])

    return join


def encode(
    docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """The pieces of every whole text, as the model's merges give them.

    A blank is put before every text. A text of fewer than two chunks is encoded at once. A longer one is
    cut into chunks of ``chunk`` characters that are dealt out to tasks. Each yields a max-plus
    matrix between the states at its two ends, a state being a cut near the end and the piece before it; the
    matrices' prefix products give every chunk the scores of its first states, and the chunks are
    traced back independently. Each says, for each way in which the next one may begin, where it
    begins itself; following that from the last chunk joins their pieces. The result does
    not depend on ``chunk``.

    Returns ``doc_id``, ``ids`` (array of int), ``score`` (long) and ``round_trip`` (whether the ids decode to
    the text). Other columns are ignored. A null or empty text has no pieces and a score of 0.
    Repeated rows give repeated results. Characters without a piece are written as UTF-8 bytes, so every text comes back.
    """
    if chunk < 2 * vocabulary.longest:
        raise ValueError("a chunk must hold the longest piece twice")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    giant = F.coalesce(F.length("text") + 1 >= 2 * chunk, F.lit(False))
    short = rows.filter(~giant).mapInArrow(_direct(vocabulary), _ENCODED)
    piece = "row long, id long, k long, lead int, body string"
    chunks = (
        rows.filter(giant)
        .select(F.monotonically_increasing_id().alias("row"), "id", "text")
        .mapInArrow(_cut(vocabulary, chunk), piece)
        .repartition("row", "k")
    )
    scanned = (
        chunks.mapInArrow(_transfers(vocabulary), f"{piece}, rows int, matrix binary")
        .groupBy("row")
        .applyInArrow(_scan, f"{piece}, before array<long>")
        .repartition("row", "k")
    )
    long = (
        scanned.mapInArrow(
            _traces(vocabulary),
            f"{piece}, common array<int>, tails array<array<int>>, entries array<int>, score long",
        )
        .groupBy("row")
        .applyInArrow(_joiner(vocabulary), _ENCODED)
    )
    return short.union(long).withColumnRenamed("id", doc_id)


def decode(
    encoded: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", ids: str = "ids"
) -> DataFrame:
    """The texts of arrays of piece ids: ``doc_id``, ``text``. Null ids give a null text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if v is None else decode_ids(v, vocabulary) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return (
        encoded.select(F.col(doc_id).cast("long").alias("id"), F.col(ids).alias("ids"))
        .mapInArrow(rows, "id long, text string")
        .withColumnRenamed("id", doc_id)
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_query(docs: DataFrame, path: str | None = None) -> DataFrame:
    encoded = encode(docs, load_vocabulary(path or default_vocabulary()))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "score", "round_trip", "ids"
    )
