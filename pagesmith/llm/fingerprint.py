"""Operator 5: consistent weighted sampling over five-word shingles.

A term is a shingle, its weight the times it stands in the text; texts with fewer words are one
term. For a term of weight S, numbers r and c of the gamma distribution with shape 2 and b, even
between 0 and 1, come from the term's hash alone. With t = floor(ln S / r + b), the term's
sample is ln a = ln c - r (t - b) - r; the slot keeps the smallest sample, which two texts share
exactly if term and t are the same. The chance of that is the generalised Jaccard similarity
sum(min weights) / sum(max weights).

Every one of the ``GROUPS * EACH`` slots takes its least sample over all terms of the text. The
two hashes of a term and a slot bound its sample from below, and logarithms are taken only where
the bound is as low as the least sample of a text of that many words is, but for a chance of
e ** -SURE. If a slot's least sample turns out not to be that low, the text is done again with
all logarithms, so no fingerprint differs. A slot is written as 4 hexadecimal digits, dots if the text has no terms. The
likeness of two fingerprints is the share of equal slots among those that are not empty in both;
it is 1 if both are empty throughout.

Edited texts need the next document's beginning. Documents are dealt out by blocks of CELL ids,
so every document but the last of a block has the next one in its task; the first document of
every block is sent to the block before it as a guest. Blocks in use are put in order by a
global numbering of block numbers. Texts are shuffled once, by block.

Null texts are empty; the order is descending id with null ids last, then text; repeated rows
are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesmith.llm.common import let, lower_ascii, numbered, stored, whole, words

WIDTH = 5
GROUPS = 8
EACH = 8
CELL = 256
SURE = 12
MOST = 0.135
MANY = 500_000


def term_hashes(text: Column, width: int = WIDTH) -> Column:
    """The hashes of all shingles, in order."""

    def of(h: Column) -> Column:
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(
            F.size(h) < width, F.array(F.xxhash64(h))
        ).otherwise(F.transform(
            F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])
        ))

    return let(F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w)), of)


def _unit(bits: Column, shift: int) -> Column:
    """21 bits of a hash as a number above 0 and below 1."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) * F.lit(1 / (1 << 21))


def _drawn(term: Column, slot: Column) -> tuple[Column, Column, Column]:
    """``x, y, b``: r and c of a term in a slot are -ln x and -ln y."""
    one, two = F.xxhash64(term, 2 * slot), F.xxhash64(term, 2 * slot + 1)
    return _unit(one, 0) * _unit(one, 21), _unit(two, 0) * _unit(two, 21), _unit(one, 42)


def sample(term: Column, log_weight: Column, slot: Column) -> Column:
    """The term's sample in a slot."""
    x, y, b = _drawn(term, slot)
    r, c = -F.log(x), -F.log(y)
    t = F.floor(log_weight / r + b)
    return F.log(c) - r * (t - b) - r


def may_be_below(tau: Column, term: Column, weight: Column, slot: Column) -> Column:
    """False only if the term's sample in the slot is at least ln tau; told without a logarithm.

    c is at least d = 2 (1 - y) / (1 + y). A sample of weight S is at least ln c + ln x - ln S, one of weight 1 is
    ln c + (1 - b) ln x, where x ** (1 - b) is at least v = tau / d if v <= e ** -2 and x >= v (1 - b) ** 2.
    """
    x, y, b = _drawn(term, slot)
    above, below, q = F.lit(2.0) - F.lit(2.0) * y, (F.lit(1.0) + y) * tau, F.lit(1.0) - b
    return (above * F.lit(MOST) < below) | (x * above < below * F.when(weight == 1, q * q).otherwise(weight))


def fingerprints(texts: DataFrame, keys: list[str], term_arrays: str, bounded: bool = True) -> DataFrame:
    """``keys, fingerprint, whole`` of the rows' term arrays; rows are told apart by the keys.

    The least sample of n terms, repeats counted, is below ln(SURE / n) but for a chance of e ** -SURE, so ``bounded``
    leaves out others before their logarithms are taken. A fingerprint is ``whole`` if every slot's least sample is
    below that: then it is the least of all.
    """

    def counted(sorted_terms: Column) -> Column:
        ends = F.filter(
            F.sequence(F.lit(0), F.size(sorted_terms) - 1),
            lambda i: ~F.get(sorted_terms, i).eqNullSafe(F.get(sorted_terms, i + 1)),
        )
        return let(ends, lambda e: F.transform(e, lambda x, k: F.struct(
            F.coalesce(F.get(sorted_terms, x), F.lit(0)).alias("_term"), (x - F.coalesce(F.get(e, k - 1), F.lit(-1))).cast("double").alias("_weight"), k.alias("_nth"),
        )))

    n = F.size(term_arrays)
    # weight 0 has no logarithm, so a text without terms has null samples
    none = F.array(F.struct(F.lit(0).cast("long").alias("_term"), F.lit(0.0).alias("_weight"), F.lit(-1).alias("_nth")))
    some = F.coalesce(F.when(n > 0, let(F.sort_array(term_arrays), counted)), none)
    tau = F.when(n == 0, 0.0).when(F.lit(bounded), F.lit(float(SURE)) / n).otherwise(float("inf"))
    terms = texts.withColumn("_tau", tau).select(*keys, "_tau", F.inline(some)).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(GROUPS * EACH - 1))).alias("_slot")
    )
    term, weight, slot = F.col("_term"), F.col("_weight"), F.col("_slot")
    # a text's first term stays in every slot, so every text has all its groups
    samples = terms.filter((F.col("_nth") <= 0) | may_be_below(F.col("_tau"), term, weight, slot)).select(
        *keys, "_tau", (slot - slot % EACH).alias("_group"), (slot % EACH).alias("_k"),
        sample(term, F.log(weight), slot).alias("_a"),
    )
    least = samples.groupBy(*keys, "_tau", "_group").agg(*[F.min(F.when(F.col("_k") == k, F.col("_a"))).alias(f"_m{k}") for k in range(EACH)])
    digits = [F.when(F.col(f"_m{k}").isNull(), "....").otherwise(
        F.substring(F.lpad(F.hex(F.xxhash64(f"_m{k}")), 16, "0"), 13, 4)
    ) for k in range(EACH)]
    # a little below, for the rounding of the samples
    told = (F.col("_tau") == 0) | (F.greatest(*[f"_m{k}" for k in range(EACH)]) < F.log("_tau") - F.lit(1e-6))
    groups = least.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_group", F.concat(*digits).alias("_part")))).alias("_parts"), F.min(told).alias("whole"),
    )
    return groups.select(*keys, F.array_join(F.col("_parts._part"), "").alias("fingerprint"), "whole")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal slots."""
    slots = F.sequence(F.lit(0), F.lit(GROUPS * EACH - 1))
    pair = F.transform(slots, lambda i: F.struct(F.substr(a, i * 4 + 1, F.lit(4)).alias("x"), F.substr(b, i * 4 + 1, F.lit(4)).alias("y")))
    return let(F.filter(pair, lambda p: (p["x"] != "....") | (p["y"] != "....")), lambda p: F.when(F.size(p) == 0, 1.0).otherwise(
        F.size(F.filter(p, lambda q: q["x"] == q["y"])) / F.size(p)
    ))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    rows = docs.select(
        F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"), F.floor(F.col(id_col) / F.lit(CELL)).alias("cell"),
    )
    narrow = docs.select(F.col(id_col).alias("id")).groupBy(F.floor(F.col("id") / F.lit(CELL)).alias("cell")).agg(F.max("id").alias("top"))
    order = numbered(narrow, [F.col("cell").desc_nulls_last()])
    last = order.agg(F.max("rn")).first()[0]
    # a block's first document is a guest of the block before it, that of the first block of the last one
    guests = stored(order.select(
        F.col("top"), F.col("cell").alias("own_cell"),
        F.when(F.col("rn") == 0, last).otherwise(F.col("rn") - 1).alias("rn"),
    ).join(order.select("rn", F.col("cell").alias("host_cell")), "rn").drop("rn"))
    heads = rows.join(guests, F.col("cell").eqNullSafe(F.col("own_cell")) & F.col("id").eqNullSafe(F.col("top")))
    # of repeated ids the first by text is the guest
    heads = heads.groupBy("host_cell", "id").agg(F.min("text").alias("text")).select(
        "id", "text", F.col("host_cell").alias("cell"), F.lit(1).alias("guest")
    )
    dealt = rows.withColumn("guest", F.lit(0)).unionByName(heads).repartition("cell")
    sequence = Window.partitionBy("cell").orderBy("guest", F.col("id").desc_nulls_last(), "text")
    n = F.length("text")
    ordered = dealt.select(
        "cell", "id", "guest", "text", F.lead("text").over(sequence).alias("_next"), F.row_number().over(sequence).alias("nth")
    )
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.coalesce("_next", "text"), F.lit(1), half))
    ordered = ordered.withColumn("_edited", F.when(F.col("guest") == 0, edited))
    keys = ["cell", "nth", "id", "guest", "n_chars", "edited_sha256", "which"]

    def terms(texts: DataFrame) -> DataFrame:
        return texts.select(
            "cell", "nth", "id", "guest", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
            F.explode(F.array(
                F.struct(F.lit(0).alias("which"), term_hashes(F.col("text")).alias("terms")),
                F.struct(F.lit(1).alias("which"), term_hashes(F.when(F.col("guest") == 0, F.col("_edited")).otherwise("")).alias("terms")),
            )).alias("_x"),
        ).select(*keys[:-1], F.col("_x.which").alias("which"), F.col("_x.terms").alias("terms"))

    prints = stored(fingerprints(terms(ordered), keys, "terms"))
    # about one text in 2,500 has a least sample that is not below the limit; those are done again without one
    again = prints.filter(~F.col("whole")).select(F.col("cell").alias("_cell"), F.col("nth").alias("_nth")).distinct()
    if not again.isEmpty():
        again = F.broadcast(again) if again.limit(MANY + 1).count() <= MANY else again
        # rows without an id have no cell
        same = F.col("cell").eqNullSafe(F.col("_cell")) & (F.col("nth") == F.col("_nth"))
        once = fingerprints(terms(ordered.join(again, same, "left_semi")), keys, "terms", bounded=False)
        prints = prints.join(again, same, "left_anti").union(once)
    both = prints.groupBy(*keys[:-1]).agg(
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    following = Window.partitionBy("cell").orderBy("nth")
    out = both.withColumn("_next", F.coalesce(F.lead("fingerprint").over(following), F.col("fingerprint"))).filter("guest = 0")
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )
