"""Operator 10: quality rules with the line frequency across documents of a host.

Base rules are counts inside the text. The method's verdict: lines are normalised (lower case,
blanks as spaces, ends trimmed) and hashed; per host, the documents that hold a line are
counted; a line in more than ``min_docs`` documents and more than ``share`` of the host's
documents is removed; a document of which less than ``min_left`` of the words remains is
rejected. Copies are not many documents: the documents of such a line are told apart by the
least hash among their lines that are *not* so frequent themselves, for three hash functions, or
by the whole text if it has no such line, and the line is removed only if more than ``min_docs``
and half of its different texts differ there. So the lines of a passage that was copied a
thousand times with its surroundings are no boilerplate, those that stand in a thousand
different documents are, however many lines their template has. Near copies that differ in
lines of their own count as different documents.

The lines to remove are one row per host: by the share rule there are at most (lines per
document / share) of them, whatever the size of the table. Texts are not shuffled where that
table is small enough to be broadcast by Catalyst's size check; otherwise they meet it in a
join by host, whose hot hosts AQE splits. Null texts have no words and are rejected; a null
host is a host of its own; repeated rows are judged alike and, as copies, count once; an empty
table gives no rows; only id, host and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesmith.llm.common import let, stored, whole, words

MIN_DOCS = 50
SHARE = 0.001
MIN_LEFT = 0.3
SEEDS = (1, 2, 3)
DIFFERENT = 0.5
SYMBOLS = "[#*$%&|<>]"


def repeated_words(w: Column) -> Column:
    """Words inside windows of three words that the text holds twice or more.

    Windows are hashed. Few repeated hashes are looked for in a short list; where there are
    more, the windows are sorted with their positions, so long repetitive texts stay cheap.
    """

    def by_list(windows: Column) -> Column:
        twice = let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.get(s, k - 1) == x)))
        return let(twice, lambda d: F.filter(
            F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.array_contains(d, F.get(windows, i))
        ))

    def by_order(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])),
            lambda x: x["i"],
        )))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n")),
            lambda a: a["n"],
        )

    def of(v: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2))
        )
        return F.when(F.size(v) < 4, 0).otherwise(let(windows, lambda g: let(
            F.size(g) - F.size(F.array_distinct(g)),
            lambda extra: F.when(extra == 0, 0).when(extra <= 50, covered(by_list(g))).otherwise(covered(by_order(g))),
        )))

    return let(w, of)


def lines_of(text: Column) -> Column:
    """Normalised lines, with the empty ones."""
    flat = F.lower(whole(text))
    for blank in "\t\x0b\f\r":
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    return F.transform(F.split(flat, "\n"), lambda x: F.trim(x))


def line_hash(line: Column) -> Column:
    return F.unhex(F.md5(line))


def frequent_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, host_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """``_host, _frequent``: the hashes of the lines to remove, a row per host that has any."""
    own = docs.select(F.col(host_col).alias("_host"), whole(F.col(text_col)).alias("_text"))
    lines = own.select("_host", F.explode(
        F.array_distinct(F.transform(F.array_remove(lines_of(F.col("_text")), ""), line_hash))
    ).alias("_line"))
    sizes = docs.groupBy(F.col(host_col).alias("_of")).agg(F.count("*").alias("_docs"))
    often = stored(
        lines.groupBy("_host", "_line").count().filter(F.col("count") > min_docs)
        .join(sizes, F.col("_host").eqNullSafe(F.col("_of")))
        .filter(F.col("count") > share * F.col("_docs"))
        .groupBy("_host").agg(F.sort_array(F.collect_list("_line")).alias("_frequent"))
    )
    # of these, those whose documents differ outside the line
    held = with_frequent(own, often, "_host").filter("_frequent is not null").select(
        "_host", F.xxhash64("_text").alias("_key"),
        F.array_distinct(F.transform(F.array_remove(lines_of(F.col("_text")), ""), line_hash)).alias("_lines"), "_frequent",
    )
    # what tells the texts apart: the least hash outside all of these lines, the text itself where there are none
    own_lines = F.array_except("_lines", "_frequent")
    held = held.select(
        "_host", "_key", F.explode(F.array_intersect("_lines", "_frequent")).alias("_line"),
        *[F.coalesce(F.array_min(F.transform(own_lines, lambda x, k=k: F.xxhash64(x, F.lit(k)))), "_key").alias(f"_other{k}") for k in SEEDS],
    )
    counts = held.groupBy("_host", "_line").agg(
        F.countDistinct("_key").alias("_texts"), *[F.countDistinct(f"_other{k}").alias(f"_n{k}") for k in SEEDS]
    )
    most = F.greatest(*[F.col(f"_n{k}") for k in SEEDS])
    return stored(
        counts.filter((most > min_docs) & (most >= DIFFERENT * F.col("_texts")))
        .groupBy("_host").agg(F.sort_array(F.collect_list("_line")).alias("_frequent"))
    )


def with_frequent(docs: DataFrame, frequent: DataFrame, host_col: str) -> DataFrame:
    """Documents with the array of their host's frequent lines, null where it has none."""
    own = frequent.withColumnRenamed("_host", "_frequent_host")
    return docs.join(own, F.col(host_col).eqNullSafe(F.col("_frequent_host")), "left").drop("_frequent_host")


def words_left(text: Column, n_words: Column) -> Column:
    """Words outside the lines of ``_frequent``."""

    def left(lines: Column) -> Column:
        hit = F.array_intersect(F.transform(lines, line_hash), F.col("_frequent"))
        kept = F.filter(lines, lambda x: ~F.array_contains(hit, line_hash(x)))
        return F.when(F.size(hit) == 0, n_words).otherwise(F.size(words(F.array_join(kept, "\n"))))

    return F.when(F.col("_frequent").isNull(), n_words).otherwise(let(lines_of(text), left))


def measures(text: Column) -> dict[str, Column]:
    """The counts of the base rules."""
    t = whole(text)
    filled = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words(t)).cast("long"),
        "word_chars": F.length(F.array_join(words(t), "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words(t)).cast("long"),
    }


def judge(
    docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, min_left: float = MIN_LEFT,
    id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``id``, the base measures, ``base_failed, words_left, kept`` of every document."""
    text = F.col(text_col)
    rows = with_frequent(docs.select(id_col, host_col, text_col), frequent_lines(docs, min_docs, share, host_col, text_col), host_col)
    m = rows.select(id_col, *[c.alias(n) for n, c in measures(text).items()], words_left(text, F.size(words(text))).cast("long").alias("words_left"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("words_left") >= min_left * F.col("n_words"))
    )


def clean(
    docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, min_left: float = MIN_LEFT,
    host_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The kept documents with all their columns, frequent lines taken out of the text."""
    text = F.col(text_col)
    rows = with_frequent(docs, frequent_lines(docs, min_docs, share, host_col, text_col), host_col)
    n, repeats = F.size(words(text)), repeated_words(words(text))
    kept = rows.filter(
        (n >= 50) & (100 * repeats <= 50 * n) & (words_left(text, n) >= min_left * n)
    )
    raw, normal = F.split(text, "\n"), lines_of(text)
    hits = F.array_intersect(F.transform(normal, line_hash), F.col("_frequent"))
    cut = let(hits, lambda h: F.when(F.size(h) == 0, text).otherwise(
        let(normal, lambda ls: F.array_join(F.filter(raw, lambda _, i: ~F.array_contains(h, line_hash(F.get(ls, i)))), "\n"))
    ))
    return kept.withColumn(text_col, F.when(F.col("_frequent").isNull(), text).otherwise(cut)).drop("_frequent")
