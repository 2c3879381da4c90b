"""Conversation repair against trying all edits, and the bounds of what the search holds."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from tableforge.llm.repair import Search, damaged, edit_log, repair_query
from tests.llm.helpers import bag

SCHEMA = "conv_id long, turn long, role string, text string"


def exhaustive(rows):
    """(cost, letters, lines) of the cheapest edits, by trying all; rows are (role, text, fault)."""
    best = (10**9, "", ())

    def walk(i, out, letters, cost, inserted):
        nonlocal best
        if cost > best[0]:
            return
        initials = "".join(o[:1] for o in out)
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", initials):
                best = min(best, (cost, letters, tuple(out)))
        else:
            role, text, fault = rows[i]
            walk(i + 1, out, letters + "D", cost + 4, 0)
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if role:
                    walk(i + 1, [*out, f"{role}:{text}"], letters + "K", cost + extra, 0)
                for new in ("user", "assistant"):
                    walk(i + 1, [*out, f"{new}:{text}"], letters + "R", cost + extra + 3, 0)
        if inserted < 3:
            for new in ("user", "assistant"):
                walk(i, [*out, f"{new}:"], letters + "I", cost + 3, inserted + 1)

    walk(0, [], "", 0, 0)
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = text.rstrip(" \t\n\x0b\f\r")[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain(conversations):
    """The query's rows for (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in conversations:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marked = faults([r[1:] for r in rows])
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = exhaustive(marked)
        count = lambda f: sum(m[2] == f for m in marked)  # noqa: B023, E731
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def test_search_against_trying_all_edits():
    rng = random.Random(3)
    for _ in range(400):
        rows = [
            (rng.choice(["user", "assistant", "user", "assistant", "system", "tool", " ", ""]), rng.choice("abcd"),
             rng.choice([None, None, "truncated", "blank", "duplicate"]))
            for _ in range(rng.randint(0, 4))
        ]
        search, got = Search(), []
        for i, (role, _, fault) in enumerate(rows):
            got += search.add(i, role[:1], fault)
        got += search.end()
        cost, letters, _ = exhaustive(rows)
        assert (search.cost, "".join(e for _, edits in got for e, _ in edits)) == (cost, letters), rows


def test_query_against_trying_all_edits(spark):
    rng = random.Random(11)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (7, None, "system", "x!"), (7, None, "user", " \t")]
    for conv in range(60):
        for turn in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant"][turn % 2 :] + ["system", None, "bot"][: rng.randint(0, 3)])
            rows.append((conv, rng.choice([turn, turn * 2]), role, rng.choice(["Yes.", "No", "Why?", "", None, "Yes."])))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS n", "'x' AS gone", "'x' AS edit")
    assert bag(repair_query(df)) == plain(rows)
    assert repair_query(df.limit(0)).count() == 0


def test_conversation_without_rows_after_damage(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair_query(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation_holds_few_rows():
    rng, search, most, given = random.Random(2), Search(), 0, 0
    for i in range(20_000):
        role = rng.choice("uuaas") if rng.random() < 0.2 else "ua"[i % 2]
        given += len(list(search.add(i, role, rng.choice([None] * 8 + ["truncated", "blank"]))))
        most = max(most, len(search.rows))
    given += len(list(search.end()))
    assert given == 20_001 and most < 200


def test_repaired_rows_are_legal(spark, sf_dir):
    log = edit_log(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    kept = log.filter("edit <> 'D'").select("conv_id", F.substring("role", 1, 1).alias("r"))
    rows = {}
    for r in kept.collect():
        rows[r.conv_id] = rows.get(r.conv_id, "") + r.r
    assert rows and all(re.fullmatch("(s?(ua)+)?", v) for v in rows.values())
