"""Repair of damaged conversations by a Viterbi search that lets go of what is settled."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tableforge.llm.texts import BLANKS

# What edits and a cut-off text that stays cost.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
_FAULTS = ("blank", "duplicate", "truncated")

# States of a conversation by what came last: nothing, a system row, a user row, an assistant's row.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT,
}
_BATCH_ROWS, _BATCH_CHARS = 4096, 4 << 20


class Step(NamedTuple):
    """What one row does to the survivors.

    ``costs`` are those of the states' survivors above ``base``, None where there is none; ``order`` compares each two
    survivors' edits; ``moves`` has for every state the state it came from and the edits (letter, new role).
    """

    base: int
    costs: tuple
    order: tuple
    moves: tuple


class _Way(NamedTuple):
    cost: int
    origin: int
    edits: tuple

    @property
    def letters(self) -> str:
        return "".join(letter for letter, _ in self.edits)


def _compare(order: tuple, a: _Way, b: _Way):
    """How all edits of ``a`` compare with those of ``b``: "<", ">", or by how many letters ``b`` is longer.

    ``order`` says the same of the survivors they come from. Where one survivor's edits begin the other's, the rest are
    inserts, for both have dealt with the same rows.
    """
    known = order[a.origin][b.origin]
    if known in ("<", ">"):
        return known
    left = "I" * max(-known, 0) + a.letters
    right = "I" * max(known, 0) + b.letters
    if right.startswith(left) or left.startswith(right):
        return len(right) - len(left)
    return "<" if left < right else ">"


def _better(order: tuple, a: _Way | None, b: _Way | None) -> _Way | None:
    if a is None or b is None:
        return b if a is None else a
    if a.cost != b.cost:
        return a if a.cost < b.cost else b
    found = _compare(order, a, b)
    # Equal costs with one way a beginning of the other mean equal ways: an insert costs.
    return b if found == ">" else a


def _settled(order: tuple, ways: list[_Way | None]) -> Step:
    """Adds inserts, drops survivors that cannot win, and compares those that are left."""

    def inserted(way: _Way | None, role: str) -> _Way | None:
        return way and _Way(way.cost + INSERT, way.origin, (*way.edits, ("I", ROLES[role])))

    ways = list(ways)
    for state in (START, SYSTEM, ASSISTANT):
        ways[USER] = _better(order, ways[USER], inserted(ways[state], "u"))
    ways[ASSISTANT] = _better(order, ways[ASSISTANT], inserted(ways[USER], "a"))
    # What can follow a system row can follow an assistant's, and what can follow nothing can too but
    # for a system row, which can be deleted. So neither is followed beyond that.
    least = ways[ASSISTANT].cost
    for state, more in ((START, DELETE), (SYSTEM, 0)):
        if ways[state] is not None and ways[state].cost > least + more:
            ways[state] = None
    base = min(w.cost for w in ways if w is not None)
    compared = tuple(
        tuple(None if a is None or b is None else _compare(order, a, b) for b in ways) for a in ways
    )
    return Step(
        base,
        tuple(None if w is None else w.cost - base for w in ways),
        compared,
        tuple(None if w is None else (w.origin, w.edits) for w in ways),
    )


@lru_cache(maxsize=1 << 16)
def begin() -> Step:
    """Before the first row: nothing yet, or inserts."""
    nothing = tuple((0,) * 4 for _ in range(4))
    return _settled(nothing, [_Way(0, START, ()), None, None, None])


@lru_cache(maxsize=1 << 16)
def advance(costs: tuple, order: tuple, initial: str, fault: str | None) -> Step:
    """The survivors after one more row. Costs differ by little, so that few different steps exist."""
    ways: list[_Way | None] = [None] * 4
    for state, cost in enumerate(costs):
        if cost is None:
            continue
        ways[state] = _better(order, ways[state], _Way(cost + DELETE, state, (("D", None),)))
        if fault in ("blank", "duplicate"):
            continue
        stays = cost + (CUT_OFF if fault == "truncated" else 0)
        after = _NEXT.get((state, initial))
        if after is not None:
            ways[after] = _better(order, ways[after], _Way(stays, state, (("K", None),)))
        for role in ROLES:
            after = _NEXT.get((state, role))
            if after is not None:
                ways[after] = _better(
                    order, ways[after], _Way(stays + REROLE, state, (("R", ROLES[role]),))
                )
    return _settled(order, ways)


class _Node:
    """Edits for one row on the way to a survivor; ``kids`` go on from it, ``live`` if it is a survivor."""

    __slots__ = ("parent", "edits", "kids", "live")

    def __init__(self, parent: _Node | None, edits: tuple) -> None:
        self.parent, self.edits, self.kids, self.live = parent, edits, [], True
        if parent is not None:
            parent.kids.append(self)


def _release(node: _Node) -> None:
    """A survivor that lost: it goes, and so do those before it that nothing else goes on from."""
    node.live = False
    while not node.live and not node.kids and node.parent is not None:
        node.parent.kids.remove(node)
        node = node.parent


class Search:
    """The cheapest edits of one conversation, row by row; ties go to the least edits as a text.

    Edits are given out as soon as all survivors share them. Held are the rows since then and the
    tree of the survivors' edits: a node goes when no survivor needs it.
    """

    def __init__(self) -> None:
        self.step = begin()
        self.cost = self.step.base
        self.root = _Node(None, ())
        self.tips: list[_Node | None] = self._grown([self.root] * 4)
        self.rows: deque = deque([None])

    def _grown(self, tips: list) -> list:
        grown = [m and _Node(tips[m[0]], m[1]) for m in self.step.moves]
        for tip in {id(t): t for t in tips if t is not None}.values():
            _release(tip)
        return grown

    def add(self, row, initial: str, fault: str | None) -> Iterator[tuple]:
        """Takes one more row; yields (row or None, edits) that are settled."""
        self.rows.append(row)
        self.step = advance(self.step.costs, self.step.order, initial if initial in "sua" else "", fault)
        self.cost += self.step.base
        self.tips = self._grown(self.tips)
        yield from self._shared()

    def _shared(self) -> Iterator[tuple]:
        while len(self.root.kids) == 1 and not self.root.live:
            self.root = self.root.kids[0]
            self.root.parent = None
            yield self.rows.popleft(), self.root.edits

    def end(self) -> Iterator[tuple]:
        """The rest of the edits; ``cost`` is then that of all."""
        empty, whole = (
            None if self.step.costs[s] is None else _Way(self.step.costs[s], s, ()) for s in (START, ASSISTANT)
        )
        best = _better(self.step.order, empty, whole)
        self.cost += best.cost
        for state, tip in enumerate(self.tips):
            if tip is not None and state != best.origin:
                _release(tip)
        yield from self._shared()


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` with the rows damaged by a checksum of their id and turn.

    Of twenty rows one is gone (kept here without role and text, so that its conversation stays known), one has no text, one
    no ends of sentences, one is there twice, and one is by the user. Null roles and texts, and nulls in the checksum's
    text, are one space. Other columns are left out.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))) % 20
    text = (
        F.when(kind == 0, None).when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", ""))
        .otherwise(part("text"))
    )
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 0, None).when(kind == 4, "user").otherwise(part("role")).alias("role"),
        text.alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


_LOG = (
    "conv_id long, turn long, edit string, role string, text string, fault string, illegal boolean, "
    "cost long, gone boolean"
)


class _Batches:
    """Collects rows into record batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.chars += sum(len(v) for v in row if isinstance(v, str))

    def full(self) -> bool:
        return len(self.rows) >= _BATCH_ROWS or self.chars >= _BATCH_CHARS

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.chars = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema
        )


def _fields(**kinds) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def _log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of conversations whose rows come one after another in order."""
    text, whole, flag = pa.string(), pa.int64(), pa.bool_()
    out = _Batches(
        _fields(conv_id=whole, turn=whole, edit=text, role=text, text=text, fault=text, illegal=flag, cost=whole, gone=flag)
    )
    conv, search, before = None, None, None

    def put(settled) -> None:
        for row, edits in settled:
            for letter, role in edits:
                if letter == "I":
                    out.add(conv, None, "I", role, "", None, False, INSERT, False)
                    continue
                turn, old, body, fault, illegal = row
                cost = {"K": 0, "R": REROLE, "D": DELETE}[letter]
                if letter != "D" and fault == "truncated":
                    cost += CUT_OFF
                out.add(conv, turn, letter, role or old, body, fault, illegal, cost, False)

    for batch in batches:
        for key, turn, role, body, gone, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if search is None or key != conv:
                if search is not None:
                    put(search.end())
                conv, search, before = key, Search(), None
            if gone:
                out.add(conv, None, None, None, None, None, False, 0, True)
            else:
                last = body.rstrip(BLANKS)[-1:]
                fault = "blank" if not last else "duplicate" if again else None if last in ".!?" else "truncated"
                initial = role[:1]
                illegal = before is not None and before + initial not in LEGAL
                before = initial
                put(search.add((turn, role, body, fault, illegal), initial, fault))
            if out.full():
                yield out.take()
    if search is not None:
        put(search.end())
    yield out.take()


def edit_log(rows: DataFrame) -> DataFrame:
    """The cheapest edits that give every conversation roles ``(s?(ua)+)?``, in order.

    ``rows`` has ``conv_id``, ``turn``, ``role``, ``text`` and ``gone``; a conversation's rows go by turn (nulls first), and at one turn by
    role and text. A row is blank (no character but blanks), else a duplicate (role and text seen earlier in the conversation), else
    truncated (its last character that is no blank is none of ``.!?``). Each row is kept (0), gets the role
    user or assistant (3) or is deleted (4), and rows without text are inserted (3); blank rows and duplicates
    must be deleted, and truncated rows that stay cost 3 more. Of equally cheap edits those whose letters K, R, D, I
    come first as a text are taken. A null ``conv_id`` is a conversation like others; a role whose first letter is
    none of s, u, a can't be kept.

    Returns ``conv_id``, ``turn``, ``edit``, ``role`` (the new one, if changed), ``text``, ``fault``, ``illegal`` (whether the pair with the row
    before is none of su, ua, au), ``cost`` and ``gone``. Rows that are gone give one without an edit. A conversation's rows lie
    together and in order in one partition; the repaired ones are those with K, R and I.

    One shuffle by conversation, then two sorts, which spill. A conversation is a stream: of its rows a task holds
    those since the survivors' last shared edit, however long it is. It is not cut, as a later
    text of its result (a hash of all of it, say) needs all of it in order anyway.
    """
    seen = W.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")
    ordered = (
        rows.select("conv_id", "turn", "role", "text", "gone")
        .repartition("conv_id")
        .withColumn("n", F.row_number().over(seen))
        .sortWithinPartitions(
            "conv_id", F.col("gone").desc(), F.col("turn").asc_nulls_first(), "role", "text", "n"
        )
    )
    return ordered.select("conv_id", "turn", "role", "text", "gone", (F.col("n") > 1).alias("again")).mapInArrow(
        _log, _LOG
    )


_DIGEST = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its edits in order."""
    whole, text = pa.int64(), pa.string()
    out = _Batches(
        _fields(
            conv_id=whole, gaps=whole, blank=whole, duplicate=whole, truncated=whole, illegal=whole, cost=whole,
            audit=text, repaired_sha256=text,
        )
    )
    conv, at_work = None, False

    def finish() -> None:
        gaps = 0 if first is None else last - first + 1 - turns
        out.add(conv, gaps, *(faults[f] for f in _FAULTS), illegal, cost, "".join(audit), digest.hexdigest())

    for batch in batches:
        for key, turn, edit, role, body, fault, off, paid, gone in zip(
            *(c.to_pylist() for c in batch.columns), strict=True
        ):
            if not at_work or key != conv:
                if at_work:
                    finish()
                conv, at_work = key, True
                first, last, turns, illegal, cost = None, None, 0, 0, 0
                faults, audit, digest, written = dict.fromkeys(_FAULTS, 0), [], hashlib.sha256(), False
            if gone:
                continue
            if turn is not None and turn != last:
                first, last, turns = turn if first is None else first, turn, turns + 1
            if fault is not None:
                faults[fault] += 1
            illegal += off
            cost += paid
            audit.append(edit)
            if edit != "D":
                digest.update((("\n" if written else "") + f"{role}:{body}").encode())
                written = True
        if out.full():
            yield out.take()
    if at_work:
        finish()
    yield out.take()


def repair_query(conversations: DataFrame) -> DataFrame:
    """Damages all conversations, repairs them, and gives a row for each ``conv_id``."""
    return edit_log(damaged(conversations)).mapInArrow(_digests, _DIGEST)


# The same search with whole strings: a recursive query keeps the best edits of every state.
REPAIR_SQL = r"""
WITH RECURSIVE
crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
hurt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN
      string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
      lambda c, b: xor(c >> 8, crc.t[1 + xor(c, b) % 256])), 4294967295) % 20 AS k
  FROM conversations, crc),
stay AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hurt, range(CASE WHEN k = 0 THEN 0 WHEN k = 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM stay),
marked AS (
  SELECT *, left(role, 1) AS f, rtrim(text, E' \t\n\x0b\f\r') AS body,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair
  FROM placed),
faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM marked),
v AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, {'c': 0, 'a': '', 'r': []::VARCHAR[]} AS z, NULL::STRUCT(c INT, a VARCHAR, r VARCHAR[]) AS s,
    {'c': 3, 'a': 'I', 'r': ['user:']} AS u, {'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']} AS x
  FROM conversations
  UNION ALL
  SELECT conv_id, n, z, s, u, list_sort([y FOR y IN [x, {'c': u.c + 3, 'a': u.a || 'I', 'r': list_append(u.r, 'assistant:')}] IF y IS NOT NULL])[1]
  FROM (
    SELECT conv_id, n, z, s, x, list_sort([y FOR y IN [u,
      {'c': z.c + 3, 'a': z.a || 'I', 'r': list_append(z.r, 'user:')},
      CASE WHEN s IS NOT NULL THEN {'c': s.c + 3, 'a': s.a || 'I', 'r': list_append(s.r, 'user:')} END,
      CASE WHEN x IS NOT NULL THEN {'c': x.c + 3, 'a': x.a || 'I', 'r': list_append(x.r, 'user:')} END] IF y IS NOT NULL])[1] AS u
    FROM (
      SELECT v.conv_id, w.n, {'c': z.c + 4, 'a': z.a || 'D', 'r': z.r} AS z,
        list_sort([y FOR y IN [
          CASE WHEN s IS NOT NULL THEN {'c': s.c + 4, 'a': s.a || 'D', 'r': s.r} END,
          CASE WHEN ok AND f = 's' THEN {'c': z.c + t, 'a': z.a || 'K', 'r': list_append(z.r, line)} END] IF y IS NOT NULL])[1] AS s,
        list_sort([y FOR y IN [{'c': u.c + 4, 'a': u.a || 'D', 'r': u.r},
          CASE WHEN ok AND f = 'u' THEN {'c': z.c + t, 'a': z.a || 'K', 'r': list_append(z.r, line)} END,
          CASE WHEN ok AND f = 'u' AND s IS NOT NULL THEN {'c': s.c + t, 'a': s.a || 'K', 'r': list_append(s.r, line)} END,
          CASE WHEN ok AND f = 'u' THEN {'c': x.c + t, 'a': x.a || 'K', 'r': list_append(x.r, line)} END,
          CASE WHEN ok THEN {'c': z.c + t + 3, 'a': z.a || 'R', 'r': list_append(z.r, 'user:' || text)} END,
          CASE WHEN ok AND s IS NOT NULL THEN {'c': s.c + t + 3, 'a': s.a || 'R', 'r': list_append(s.r, 'user:' || text)} END,
          CASE WHEN ok THEN {'c': x.c + t + 3, 'a': x.a || 'R', 'r': list_append(x.r, 'user:' || text)} END] IF y IS NOT NULL])[1] AS u,
        list_sort([y FOR y IN [{'c': x.c + 4, 'a': x.a || 'D', 'r': x.r},
          CASE WHEN ok AND f = 'a' THEN {'c': u.c + t, 'a': u.a || 'K', 'r': list_append(u.r, line)} END,
          CASE WHEN ok THEN {'c': u.c + t + 3, 'a': u.a || 'R', 'r': list_append(u.r, 'assistant:' || text)} END] IF y IS NOT NULL])[1] AS x
      FROM v JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS ok, role || ':' || text AS line,
                          CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS t FROM faulty) w
        ON v.conv_id IS NOT DISTINCT FROM w.conv_id AND w.n = v.n + 1))),
done AS (
  SELECT conv_id, list_sort([z, x])[1] AS b FROM v
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT d.conv_id, coalesce(t.gaps, 0)::BIGINT AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate,
  coalesce(t.truncated, 0) AS truncated, coalesce(t.illegal, 0) AS illegal, d.b.c::BIGINT AS cost, d.b.a AS audit,
  sha256(array_to_string(d.b.r, chr(10))) AS repaired_sha256
FROM done d LEFT JOIN told t ON d.conv_id IS NOT DISTINCT FROM t.conv_id
"""
