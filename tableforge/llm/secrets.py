"""Secret scans: fixed patterns, and strings that look random to character Markov models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableforge.llm.texts import constant

# The kinds of secrets and their patterns, in the order in which they are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

SYMBOLS = 128
# A log ratio of 1.0 as a whole number, and the mean log ratio per character of a secret.
UNIT = 1 << 16
THRESHOLD = 0.5
TRAIN_DOCS = 2000
RANDOM_STRINGS = 4000
_BLOCK = 256


def _pairs_of(strings: DataFrame) -> DataFrame:
    """The character pairs of a column ``s``: ``a`` and ``b``, ASCII codes, 0 before the first."""
    place = F.explode(F.sequence(F.lit(1), F.length("s"))).alias("i")
    return strings.filter(F.length("s") > 0).select("s", place).select(
        F.when(F.col("i") > 1, F.ascii(F.substring("s", F.col("i") - 1, F.lit(1))))
        .otherwise(F.lit(0))
        .alias("a"),
        F.ascii(F.substring("s", F.col("i"), F.lit(1))).alias("b"),
    ).filter("a < 128 AND b < 128")


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """Samples of random strings: hex, Base64 and capitals with digits, from hashes of numbers."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    kind = F.col("id") % 4
    return spark.range(n).select(
        F.when(kind == 0, digest)
        .when(kind == 1, F.upper(F.regexp_replace(base64, "[+/]", "7")))
        .when(kind == 2, F.translate(base64, "+/", "-_"))
        .otherwise(base64)
        .alias("s")
    )


def ordinary_strings(docs: DataFrame, text: str = "text", n: int = TRAIN_DOCS) -> DataFrame:
    """Samples of ordinary identifiers: runs of letters, digits, - and _ in ``n`` documents.

    The different texts with the smallest hashes are taken. Runs that a pattern for secrets
    would take, and those of 32 or more characters, are left out.
    """
    hashed = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("order")).filter("text IS NOT NULL")
    # The hashes alone are ranked, once each, so that no task gets many texts.
    cut = hashed.select("order").distinct().orderBy("order").limit(n).agg(F.max("order").alias("cut")).first()["cut"]
    sample = hashed.filter(F.col("order") <= F.lit(cut)).dropDuplicates(["order"])
    found = sample.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_-]{3,}"), F.lit(0))).alias("s"))
    plain = (F.length("s") < 32) & ~F.col("s").rlike("AKIA[A-Z0-9]{12}") & ~F.col("s").rlike("[0-9a-f]{24}")
    return found.filter(plain)


def train(random: DataFrame, ordinary: DataFrame, prior: float = 0.5, weight: float = 4.0) -> np.ndarray:
    """The log ratio of each character pair (a, b) at 128 * a + b, in units of 1/65536.

    Each model has P(b) = (count(b) + prior) / (count + 128 * prior) and
    P(b | a) = (count(a, b) + weight * P(b)) / (count(a) + weight).
    """
    counts = (
        _pairs_of(random).withColumn("kind", F.lit(0))
        .union(_pairs_of(ordinary).withColumn("kind", F.lit(1)))
        .groupBy("kind", "a", "b")
        .agg(F.count("*").alias("n"))
    )
    table = np.zeros((2, SYMBOLS, SYMBOLS))
    # At most 2 * 128 * 128 rows, whatever the corpus.
    for row in counts.collect():
        table[row["kind"], row["a"], row["b"]] = row["n"]
    alone = table.sum(axis=1, keepdims=True) + prior
    alone /= alone.sum(axis=2, keepdims=True)
    log = np.log((table + weight * alone) / (table.sum(axis=2, keepdims=True) + weight))
    return np.rint((log[0] - log[1]) * UNIT).astype(np.int64).ravel()


def _running_sums(steps: str) -> Column:
    """The running sums of a column of int arrays.

    Summed by blocks, so that a text with very many matches costs about n * sqrt(n) steps.
    """
    return F.expr(f"""
        if(size({steps}) > 0, flatten(aggregate(
          transform(sequence(0, (size({steps}) - 1) div {_BLOCK}),
                    b -> slice({steps}, cast(b * {_BLOCK} + 1 as int), {_BLOCK})),
          cast(struct(0, array()) as struct<total:int,ends:array<array<int>>>),
          (a, p) -> struct(
            a.total + aggregate(p, 0, (s, x) -> s + x) as total,
            concat(a.ends, array(transform(p, (y, i) ->
              a.total + aggregate(slice(p, 1, i + 1), 0, (s, x) -> s + x)))) as ends),
          a -> a.ends)), cast(array() as array<int>))""")


_SPANS = "array<struct<start:int,end:int,value:string>>"


def _with_spans(df: DataFrame, name: str, pattern: str, hint: Column, group: int | None = None) -> DataFrame:
    """Adds ``name``, the leftmost non-overlapping matches: start, end, and the match or a group of it.

    What lies between the matches and the matches themselves give the places by their lengths.
    ``hint`` is a cheaper test that every text with a match passes.
    """
    empty = F.array().cast("array<string>")
    found = F.regexp_extract_all("body", F.lit(pattern), F.lit(0))
    df = df.withColumn("_found", F.when(hint, found).otherwise(empty))
    has = F.size("_found") > 0
    gaps = F.slice(F.split("body", pattern, -1), 1, F.size("_found"))
    values = F.regexp_extract_all("body", F.lit(pattern), F.lit(group or 0))
    df = df.withColumn("_gaps", F.when(has, gaps).otherwise(empty))
    df = df.withColumn("_values", F.when(has, values).otherwise(empty))
    df = df.withColumn(
        "_steps", F.zip_with("_found", "_gaps", lambda m, g: F.length(m) + F.length(g))
    ).withColumn("_ends", _running_sums("_steps"))
    spans = F.transform(
        F.arrays_zip("_found", "_values", "_ends"),
        lambda z: F.struct(
            (z["_ends"] - F.length(z["_found"])).alias("start"),
            z["_ends"].alias("end"),
            z["_values"].alias("value"),
        ),
    ).cast(_SPANS)
    return df.withColumn(name, spans).drop("_found", "_gaps", "_values", "_steps", "_ends")


def scan(
    docs: DataFrame,
    model: np.ndarray,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """All secrets of every document, in one pass without a shuffle.

    Returns ``doc_id``, ``base`` and ``found``: arrays of (start, kind, end), in code points, end
    exclusive, by start and then in the order of kinds. ``base`` holds the matches of the
    fixed patterns (``assign`` with a value of at least 8 characters). ``found`` also has kind
    ``random``: runs of at least 20 characters of ``[A-Za-z0-9+/_=-]`` that overlap no base
    span and whose log-likelihood ratio, random strings against ordinary identifiers, is at
    least ``threshold`` per character.

    A null text counts as empty, and an empty one has no spans. Rows are judged each by itself.
    Other columns are ignored.
    """
    df = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    df = _with_spans(df, "assign", ASSIGN, F.col("body").rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), 2)
    df = _with_spans(df, "access", ACCESS, F.contains("body", F.lit("AKIA")))
    df = _with_spans(df, "hex", HEX, F.lit(True))
    df = _with_spans(df, "runs", RUN, F.lit(True)).drop("body")
    df = df.withColumn("assign", F.filter("assign", lambda s: F.length(s["value"]) >= 8))

    ratios = constant(model)

    def ratio(s: Column) -> Column:
        # Runs are ASCII; they are cut into characters once, so a run costs as much as it is long.
        codes = F.transform(F.split(s, ""), lambda c: F.ascii(c))
        state = lambda total, last: F.struct(total.alias("total"), last.alias("last"))
        return F.aggregate(
            codes,
            state(F.lit(0).cast("long"), F.lit(0)),
            lambda a, c: state(a["total"] + F.get(ratios, a["last"] * SYMBOLS + c), c),
            lambda a: a["total"],
        )

    unit = int(threshold * UNIT)
    df = df.withColumn(
        "runs", F.filter("runs", lambda s: ratio(s["value"]) >= F.length(s["value"]).cast("long") * unit)
    )
    shaped = lambda name, k: F.transform(
        name, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), s["end"].alias("end"))
    )
    df = df.withColumn("base", F.array_sort(F.concat(shaped("assign", 0), shaped("access", 1), shaped("hex", 2))))
    added = F.filter(
        shaped("runs", 3),
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    named = lambda spans: F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.get(F.array(*[F.lit(k) for k in KINDS]), s["rank"]).alias("kind"),
            s["end"].alias("end"),
        ),
    )
    return df.withColumn("found", F.array_sort(F.concat("base", added))).select(
        F.col("id").alias(doc_id), named("base").alias("base"), named("found").alias("found")
    )


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets_digest(docs: DataFrame) -> DataFrame:
    model = train(random_strings(docs.sparkSession), ordinary_strings(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs, model).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("found").alias("spans"),
    )
