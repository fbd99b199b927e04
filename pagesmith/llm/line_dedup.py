"""Operator 1: repeated line runs by distributed prefix doubling.

The corpus is the sequence of the non-blank lines of all documents, in the order of id and
text; suffixes are the positions of lines and end with their document. A suffix's rank at depth
h is the first position whose next h lines are the same: rank 1 comes from the line's hash,
rank 2h from the ranks h of the position and of the position h lines on. Suffixes that share
their prefix with no other are settled and leave the next round. The repeated runs that count
have ``min_words`` words or more, so the doubling ends at that depth, never at the length of
the longest copy: two overlapping ranks of depth 2^k name any run of 2^k to 2^(k+1) lines.

Suffixes with one name down to ``min_words`` words form an interval of the suffix order whose
common prefix is at least that long. In each interval the first position stays and the lines
of the others are deleted. Runs are taken from every line forwards and backwards, so a line is
deleted if and only if it lies in a run of ``min_words`` words or more that also stands at an
earlier position. Maximal runs are the unions of these intervals.

Line numbers count from 0 over all lines split at line feeds; blank lines take no part and stay.
Null and empty texts have no lines and stay as they are. Rows that agree in id and text are one
document and get one result; a null id comes first. An empty table gives no rows. The first
document keeps its passage, so a complete later copy is left without those lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesmith.llm.common import let, numbered, stored, whole, words

MIN_WORDS = 50
SPAN = 1 << 28  # positions per document


def _reach(counts: Column, i: Column, min_words: int) -> Column:
    """Lines from ``i`` on until they have ``min_words`` words, null if they never do."""
    first = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"))
    return F.aggregate(
        F.slice(counts, i + 1, F.lit(min_words)), first,
        lambda a, x: F.when(a["w"] >= min_words, a).otherwise(F.struct((a["w"] + x).alias("w"), (a["n"] + 1).alias("n"))),
        lambda a: F.when(a["w"] >= min_words, a["n"]),
    )


def line_table(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """``pos, at, line, ahead, back``: position, line number, hash, and lines to the word limit both ways."""
    text = whole(F.col(text_col))

    def of(lines: Column) -> Column:
        filled = F.filter(
            F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("line"), F.size(words(x)).alias("n"))),
            lambda x: x["n"] > 0,
        )

        def windows(rows: Column) -> Column:
            return let(F.transform(rows, lambda x: x["n"]), lambda n: let(F.reverse(n), lambda back: F.transform(
                rows, lambda x, i: F.struct(
                    i.alias("i"), x["at"].alias("at"), x["line"].alias("line"), _reach(n, i, min_words).alias("ahead"),
                    _reach(back, F.size(n) - 1 - i, min_words).alias("back"),
                )
            )))

        return let(filled, windows)

    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_key"), of(F.split(text, "\n")).alias("_rows"))
    lines = keyed.select("_id", "_key", F.explode("_rows").alias("_r")).select("_id", "_key", "_r.*")
    lines = stored(lines.withColumn("_id_text", F.coalesce(F.col("_id").cast("string"), F.lit("\0"))))
    ids = numbered(lines.filter("i = 0").select("_id", "_id_text", "_key").distinct(), [F.col("_id").asc_nulls_first(), "_key"])
    return lines.drop("_id").join(ids.select("_id_text", "_key", "rn"), ["_id_text", "_key"]).dropDuplicates(
        ["_id_text", "_key", "i"]
    ).select((F.col("rn") * SPAN + F.col("i")).alias("pos"), "_id_text", "_key", "at", "line", "ahead", "back")


def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``pos, rank`` of the rows that share all keys with another; the rank is the first position."""
    groups = rows.groupBy(*keys).agg(F.min("pos").alias("rank"), F.max("pos").alias("_last")).filter("rank < _last")
    return rows.join(groups.drop("_last"), keys).select("pos", "rank")


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``pos, n``: runs of ``n`` lines whose words reach the limit and that stand earlier, too."""
    runs = lines.filter("ahead is not null").select("pos", F.col("ahead").alias("n")).union(
        lines.filter("back is not null").select(F.col("pos") - F.col("back") + 1, F.col("back"))
    )
    levels = runs.agg(F.max("n")).first()[0]
    found = None
    ranks = stored(grouped(lines.select("pos", "line"), ["line"]))
    for k in range(int(levels).bit_length() if levels else 0):
        h = 1 << k
        head, tail = ranks.select("pos", F.col("rank").alias("r1")), ranks.select(F.col("pos").alias("tail"), F.col("rank").alias("r2"))
        named = (
            runs.filter((F.col("n") >= h) & (F.col("n") < 2 * h)).distinct()
            .join(head, "pos").withColumn("tail", F.col("pos") + F.col("n") - h).join(tail, "tail")
            .select("pos", "n", "r1", "r2")
        )
        first = named.groupBy("n", "r1", "r2").agg(F.min("pos").alias("first"))
        later = named.join(first, ["n", "r1", "r2"]).filter("pos > first").select("pos", "n")
        found = later if found is None else found.union(later)
        if 2 * h <= levels:
            pairs = head.withColumn("tail", F.col("pos") + h).join(tail, "tail").select("pos", "r1", "r2")
            ranks = stored(grouped(pairs, ["r1", "r2"]))
    return found if found is not None else runs.limit(0)


def deletions(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """``_id_text, _key, gone``: the numbers of the deleted lines of each document that has any."""
    lines = stored(line_table(docs, min_words, id_col, text_col))
    runs = repeated_runs(lines.select("pos", "line", "ahead", "back"), min_words)
    hit = runs.groupBy("pos").agg(F.max("n").alias("n")).select(
        F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("pos")
    ).distinct()
    return lines.join(hit, "pos").groupBy("_id_text", "_key").agg(F.sort_array(F.collect_list("at")).alias("gone"))


def dedup_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", gone_col: str | None = None
) -> DataFrame:
    """All documents with the deleted lines taken out of the text; ``gone_col`` gets their numbers."""
    text = whole(F.col(text_col))
    gone = deletions(docs, min_words, id_col, text_col).select(
        F.col("_id_text").alias("_gone_id"), F.col("_key").alias("_gone_key"), F.col("gone").alias("_gone")
    )
    rows = docs.join(
        gone, (F.coalesce(F.col(id_col).cast("string"), F.lit("\0")) == F.col("_gone_id"))
        & (F.xxhash64(text) == F.col("_gone_key")), "left",
    )
    kept = let(F.split(text, "\n"), lambda lines: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda i: F.get(lines, i)), "\n"
    ))
    out = rows.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept))
    if gone_col:
        out = out.withColumn(gone_col, F.coalesce("_gone", F.array().cast("array<int>")))
    return out.select(*docs.columns, *([gone_col] if gone_col else []))
