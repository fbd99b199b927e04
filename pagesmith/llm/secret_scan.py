"""Operator 3: secret scans by character Markov models.

Base rules are patterns. The method adds runs of 16 or more letters, digits, ``_`` and ``-``
that look random: two first-order Markov models over characters, one of random strings and one
of ordinary identifiers, give a log-likelihood ratio per run; runs above ``MIN_RATIO`` in all
and ``MIN_MEAN`` per character are spans of kind ``markov``, unless they overlap a base span.

The models are trained from labelled samples: the values that the base rules find are random
strings, the other words of letters, digits, ``_`` and ``-`` are ordinary. The sample is
bounded: all texts of the ``SAMPLE`` documents whose hashed id and text are smallest. Without
any labelled random string the model of random strings is uniform over ``ALPHABET``. A model
is at most 65 x 65 counts; it becomes one array of constants.

Offsets are code points. Matches of a pattern and the text between them, cut with the same
pattern, are listed side by side, and a window over the matches of a document sums lengths;
only texts with a match take part. Null texts are empty; repeated rows get the same result;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesmith.llm.common import let, stored, whole

#: Kinds in their order, patterns, the group that must be long, its least length.
KINDS = ["assign", "access", "hex"]
PATTERNS = {
    "assign": r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA[A-Z0-9]{12,})",
    "hex": r"([0-9a-f]{32,})",
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
RUN = r"([A-Za-z0-9_-]{16,})"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"
SAMPLE = 5_000
MIN_RATIO = 12.0
MIN_MEAN = 0.7
SIDE = len(ALPHABET) + 1


def matches(rows: DataFrame, pattern: str, kind: str, least: int) -> DataFrame:
    """``_row, kind, start, end, value`` of rows of ``_uid, _row, text``: leftmost matches whose first group is long enough."""
    text = F.col("text")
    hit = rows.filter(text.rlike(pattern)).select(
        "_uid", "_row", F.posexplode(F.arrays_zip(
            F.transform(F.split(text, pattern), lambda x: F.length(x)).alias("gap"),
            F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"),
            F.regexp_extract_all(text, F.lit(pattern), 1).alias("value"),
        )).alias("_k", "_m")
    ).select("_uid", "_row", "_k", "_m.gap", F.length("_m.found").alias("n"), F.col("_m.value").alias("value"))
    before = Window.partitionBy("_uid").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.coalesce("n", F.lit(0))).over(before)
    return hit.withColumn("end", end).filter(F.length("value") >= least).select(
        "_row", F.lit(kind).alias("kind"), (F.col("end") - F.col("n")).alias("start"), "end", "value"
    )


def _code(char: Column) -> Column:
    return F.position(char, F.lit(ALPHABET))


def pairs(value: Column) -> Column:
    """The codes of neighbouring characters as one number; other characters share code 0."""

    def of(codes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(codes) - 2), lambda i: F.get(codes, i) * SIDE + F.get(codes, i + 1))

    codes = F.transform(F.split(value, ""), lambda x: _code(x))
    return let(codes, lambda c: F.when(F.size(c) < 2, F.array().cast("array<int>")).otherwise(of(c)))


def train(rows: DataFrame, base: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios of character pairs, SIDE x SIDE.

    ``rows``: ``_row, text``; ``base``: the base spans with their values.
    """
    chosen = rows.select("_row", "text").orderBy("_row").limit(sample)
    found = base.join(chosen.select("_row"), "_row", "left_semi").select(
        F.lit(1).alias("random"), F.explode(pairs(F.col("value"))).alias("pair")
    )
    plain = F.array_distinct(F.regexp_extract_all(
        F.regexp_replace(F.regexp_replace(F.regexp_replace("text", PATTERNS["assign"], " "), PATTERNS["access"], " "), PATTERNS["hex"], " "),
        F.lit(r"([A-Za-z0-9_-]{4,})"), 1,
    ))
    ordinary = chosen.select(F.explode(plain).alias("w")).filter(F.length("w") < 16).select(F.lit(0).alias("random"), F.explode(pairs(F.col("w"))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["count"] for r in found.union(ordinary).groupBy("random", "pair").count().collect()}

    def model(random: int) -> list[float]:
        # pairs lean on single characters, those on an even spread; random strings may hold any
        own = [counts.get((random, p), 0) for p in range(SIDE * SIDE)]
        firsts = [sum(own[a * SIDE : (a + 1) * SIDE]) for a in range(SIDE)]
        even = 2.0 if random else 0.5
        alone = [(sum(own[b::SIDE]) + even) / (sum(firsts) + even * SIDE) for b in range(SIDE)]
        lean = 50.0 if random else 5.0
        return [log((own[p] + lean * alone[p % SIDE]) / (firsts[p // SIDE] + lean)) for p in range(SIDE * SIDE)]

    return [a - b for a, b in zip(model(1), model(0), strict=True)]


def ratio(value: Column, model: list[float]) -> Column:
    table = F.array(*[F.lit(x) for x in model])
    return F.aggregate(pairs(value), F.lit(0.0), lambda s, p: s + F.get(table, p))


def scan(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_assign, n_access, n_hex, base_sha256, spans, n_markov`` of every document."""
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\0")), whole(F.col(text_col)))
    named = docs.select(F.col(id_col).alias("_id"), key.alias("_row"), whole(F.col(text_col)).alias("text"))
    # one scan for all patterns: texts without a match go no further
    any_hit = F.col("text").rlike("|".join([*PATTERNS.values(), RUN]))
    rows = stored(named.filter(any_hit).select(F.monotonically_increasing_id().alias("_uid"), "_row", "text"))
    base = None
    for kind in KINDS:
        got = matches(rows, PATTERNS[kind], kind, LEAST[kind])
        base = got if base is None else base.union(got)
    base = stored(base)
    model = train(rows, base, sample)
    runs = stored(matches(rows, RUN, "markov", 16))
    score = ratio(F.col("value"), model)
    odd = runs.withColumn("_score", score).filter(
        (F.col("_score") >= MIN_RATIO) & (F.col("_score") >= MIN_MEAN * F.length("value"))
    ).drop("_score")
    order = F.array_position(F.array(*[F.lit(k) for k in [*KINDS, "markov"]]), F.col("kind"))
    spans = base.union(odd).select("_row", F.struct("start", order.alias("order"), "end", "kind").alias("s"))

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def apart(items: Column) -> Column:
        # model spans that overlap no base span
        own = F.filter(items, lambda s: s["kind"] != "markov")
        return let(own, lambda b: F.filter(items, lambda s: (s["kind"] != "markov") | ~F.exists(
            b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])
        )))

    per_row = spans.groupBy("_row").agg(F.sort_array(F.collect_set("s")).alias("_all")).withColumn("_all", apart(F.col("_all")))

    def count(kind: str) -> Column:
        return F.size(F.filter("_all", lambda s: s["kind"] == kind)).cast("long")

    out = named.select("_id", "_row").join(per_row, "_row", "left").withColumn(
        "_all", F.coalesce("_all", F.array().cast("array<struct<start:bigint,order:bigint,end:bigint,kind:string>>"))
    )
    return out.select(
        F.col("_id").alias(id_col), *[count(k).alias(f"n_{k}") for k in [*KINDS, "markov"]],
        F.sha2(joined(F.filter("_all", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        joined(F.col("_all")).alias("spans"),
    )
