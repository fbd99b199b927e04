"""Operator 4: optimal length buckets and token-budget batches.

Lengths are words. One pass builds the global histogram of lengths; a dynamic program over it
picks the bucket bounds with the least padding; inside a bucket documents are numbered in the
order of length and id and cut into batches of ``budget // bucket_len`` documents, at least
one, so a batch holds no more than ``budget`` padded words unless one document alone does.

The histogram is exact below 512 words; above, lengths are rounded up to 8 significant bits,
so it has at most 256 entries per octave and is the only thing that reaches the driver. A
bucket's length is the longest document in it. Null and empty texts have length 0; repeated
rows are packed one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesmith.llm.common import numbered, stored, words

BUCKETS = 16
BUDGET = 8192


def length_bin(n: Column) -> Column:
    """The length rounded up to 8 bits after the first."""
    step = F.pow(F.lit(2), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1)))) - 8)).cast("long")
    return (F.ceil(n / step) * step).cast("long")


def best_bounds(tops: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """Indexes of the last histogram entry of each bucket, with the least padding in all.

    ``tops``: the longest length of each entry, ascending; ``counts``: its documents;
    ``totals``: its words. best[j] is the least padding of the first j entries.
    """
    n = len(tops)
    docs, toks = np.concatenate([[0], np.cumsum(counts)]).astype(float), np.concatenate([[0], np.cumsum(totals)]).astype(float)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        nxt, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(1, n + 1):
            cost = best[:j] + tops[j - 1] * (docs[j] - docs[:j]) - (toks[j] - toks[:j])
            cut[j] = int(np.argmin(cost))
            nxt[j] = cost[cut[j]]
        best = nxt
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        ends.append(j - 1)
        j = cut[j]
    return ends[::-1]


def pack(
    docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_tokens, bucket, bucket_len, batch, slot, padding`` of every document."""
    sizes = stored(docs.select(F.col(id_col), F.size(words(F.col(text_col))).cast("long").alias("n_tokens")))
    sizes = sizes.withColumn("_bin", length_bin(F.col("n_tokens")))
    hist = sizes.groupBy("_bin").agg(
        F.max("n_tokens").alias("top"), F.count("*").alias("n"), F.sum("n_tokens").alias("words")
    ).orderBy("_bin").toPandas()
    if not len(hist):
        ends = []
    else:
        ends = best_bounds(*(hist[c].to_numpy() for c in ("top", "n", "words")), buckets)
    bins = [int(hist["_bin"][e]) for e in ends]
    tops = [int(hist["top"][e]) for e in ends]
    filled = np.cumsum(hist["n"].to_numpy())[ends].tolist() if ends else []
    firsts = [0, *filled[:-1]]
    bucket = F.lit(0)
    for b in bins[:-1]:
        bucket = bucket + (F.col("_bin") > b).cast("int")
    rows = numbered(
        sizes.select(id_col, "n_tokens", bucket.alias("bucket")),
        ["bucket", "n_tokens", F.col(id_col).asc_nulls_first()],
    )
    at = F.col("bucket")
    length = F.get(F.array(*[F.lit(t).cast("long") for t in tops or [0]]), at)
    per_batch = F.get(F.array(*[F.lit(max(1, budget // max(1, t))).cast("long") for t in tops or [0]]), at)
    place = F.col("rn") - F.get(F.array(*[F.lit(int(f)).cast("long") for f in firsts or [0]]), at)
    return rows.select(
        id_col, "n_tokens", "bucket", length.alias("bucket_len"), F.floor(place / per_batch).cast("long").alias("batch"),
        F.pmod(place, per_batch).alias("slot"), (length - F.col("n_tokens")).alias("padding"),
    )
