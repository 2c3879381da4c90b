"""Small tables with awkward rows, and plain versions of what the operators compute."""

from __future__ import annotations

import random

BLANKS = " \t\n\x0b\f\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators might use inside; they must not get in the way.
CLASHES = ("id", "key", "pos", "size", "found", "h1", "block", "row", "kept", "lines", "_id", "doc", "carried")


def table(spark, rows, clashes=True):
    """Documents from (doc_id, text, lang, source), with columns of clashing names besides."""
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
    if clashes:
        df = df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES])
    return df


def awkward(seed=1):
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, copies, odd characters."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    shared = ["This line is shared by many documents.", "  \tthis LINE is shared by many documents.\r"]
    long_line = " ".join(word() for _ in range(60))
    rows = [
        (0, None, None, None),
        (1, "", "en", "a"),
        (2, " \t\n\x0b\f\r", None, ""),
        (3, "one", "en", "a"),
        (4, "One", "en", "b"),
        (5, "\n\n", "fr", None),
        (6, "no newline " * 3000, "en", "é"),
        (None, "a row without an id " * 12, None, "a"),
        (8, "\u0000 zero   odd \U0001f600 ▁ mark", "en", "a"),
    ]
    base = [word() for _ in range(150)]
    for i in range(10, 34):
        lines = [rng.choice(shared), " ".join(word() for _ in range(rng.randint(0, 40)))]
        if i % 3 == 0:
            lines.append(long_line)
        if i % 4 == 0:
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = word()
            lines = [" ".join(copy)]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None])))
    rows += [(40, rows[-1][1], "en", "a"), (41, rows[-1][1], "en", "b"), (41, rows[-1][1], "en", "b")]
    return rows


def words(text):
    return (text or "").encode().split()


def bag(df, *columns):
    """Rows as a sorted list, nulls first."""
    rows = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(rows, key=lambda r: [(v is not None, str(type(v)), v) for v in r])
