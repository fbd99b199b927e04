"""Column helpers and global order shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesmith.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = r"[\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and return."""
    return F.array_remove(F.split(whole(text), BLANKS), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# Spark deletes the shuffle files of a query at its end, not when the driver's memory is next collected.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: cuts lineage, has a known size, keeps no shuffle."""
    session = df.sparkSession
    path = f"{shared_folder(session)}/llm-{uuid4().hex}"
    before = session.conf.get(CLEAN)
    session.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        session.conf.set(CLEAN, before)
    return session.read.schema(df.schema).parquet(path)


def release(session: SparkSession) -> None:
    """Let go of finished shuffles.

    Spark deletes the shuffle files of a query when nothing in the driver refers to it any more, which only a
    collection of its memory finds out; in a job of many queries that comes too late by itself.
    """
    gc.collect()
    session.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables nothing will read any more, and release finished shuffles."""
    for table in tables:
        session = table.sparkSession
        files = table.inputFiles()
        if files:
            path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release(tables[0].sparkSession)


def numbered(df: DataFrame, order: list[Column | str], sums: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their number ``rn`` in a global order, from 0, without a global sort in one task.

    Rows are range-partitioned by the order and stored with their block; row numbers and, for
    every column in ``sums``, the total of the rows before (``before_<name>``) and of all rows
    (``total_<name>``) are the sums inside the block plus those of the blocks before it. The
    table of blocks has one row per range partition. Equal rows keep an arbitrary, fixed order.
    """
    ranged = (
        df.withColumn("_seq", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_seq")
        .withColumn("_block", F.spark_partition_id())
    )
    kept = stored(ranged)
    inside = Window.partitionBy("_block").orderBy(*order, "_seq")
    rows = kept.select(
        "*",
        (F.row_number().over(inside) - F.lit(1)).cast("long").alias("_rn"),
        *[(F.sum(c).over(inside) - F.col(c)).alias(f"_in_{c}") for c in sums],
    )
    totals = kept.groupBy("_block").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    starts = totals.select(
        "_block",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_first_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(every).alias(f"total_{c}") for c in sums],
    )
    return rows.join(F.broadcast(starts), "_block").select(
        *df.columns,
        (F.col("_first") + F.col("_rn")).alias("rn"),
        *[(F.col(f"_first_{c}") + F.col(f"_in_{c}")).alias(f"before_{c}") for c in sums],
        *[F.col(f"total_{c}") for c in sums],
    )
