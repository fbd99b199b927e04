"""A join whose hot keys are spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that share a copy of what they are joined with.
ROWS_PER_COPY = 1_000_000


def skew_join(rows: DataFrame, table: DataFrame, on: list[str], spread: list[str], rows_per_copy: int | None = None) -> DataFrame:
    """Inner join of many rows with a table that has few rows per key.

    A key with more than ``rows_per_copy`` rows gets several copies of its table rows, over which its rows are
    dealt by a hash of the columns ``spread``. The list of such keys has at most one row per ``rows_per_copy``
    rows, hence it is broadcast. Null keys join nothing.
    """
    limit = rows_per_copy or ROWS_PER_COPY
    counted = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    hot = counted.select(*on, F.ceil(F.col("_n") / limit).cast("int").alias("_copies"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn(
        "_copy", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_copies")), F.lit(0))).drop("_copies")
    copied = table.join(F.broadcast(hot), on, "left").withColumn(
        "_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_copies"), F.lit(1)).cast("long") - 1))).drop("_copies")
    return dealt.join(copied, [*on, "_copy"]).drop("_copy")
