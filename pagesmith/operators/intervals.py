"""Interval work on element rows of a page.

Nested elements lie inside one another or are disjoint, so containment needs no pair
of every two spans: a sweep over start and end positions gives each element its depth,
and the last element opened one level up is its parent. All windows share the page key
as leading partition column, so a page-partitioned input is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["title", "namespace_id"]


def with_depth(spans: DataFrame) -> DataFrame:
    """Number of spans around each span, itself included."""
    row = F.struct(*[c for c in spans.columns if c not in KEY])
    opening = F.struct(F.col("start").alias("pos"), F.lit(1).alias("delta"), row.alias("row"))
    closing = F.struct(F.col("end").alias("pos"), F.lit(-1).alias("delta"), F.lit(None).alias("row"))
    events = spans.select(*KEY, F.explode(F.array(opening, closing)).alias("e")).select(*KEY, "e.*")
    sweep = Window.partitionBy(*KEY).orderBy("pos", "delta").rowsBetween(Window.unboundedPreceding, 0)
    return (
        events.withColumn("depth", F.sum("delta").over(sweep).cast("int"))
        .where(F.col("row").isNotNull())
        .select(*KEY, "row.*", "depth")
    )


def ancestors(spans: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """One row per element and element around it, with the distance in levels.

    ``kinds`` limits the ancestors. The result is as large as the answer itself.
    """
    at = F.struct("kind", "start", "end")
    deep = with_depth(spans.select(*KEY, "kind", "start", "end"))
    # A provider opens its own level; a seeker asks for the last one open at each level above.
    provider = F.array(F.struct(F.col("depth").alias("level"), F.lit(0).alias("seeks")))
    seekers = F.when(
        F.col("depth") > 1,
        F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda l: F.struct(l.alias("level"), F.lit(1).alias("seeks"))),
    )
    roles = deep.select(
        *KEY, at.alias("element"), "depth",
        F.explode(F.concat(provider, F.coalesce(seekers, F.filter(provider, lambda _: F.lit(False))))).alias("role"),
    ).select(*KEY, "element", "depth", "role.level", "role.seeks")
    order = Window.partitionBy(*KEY, "level").orderBy(F.col("element.start"), "seeks").rowsBetween(Window.unboundedPreceding, 0)
    open_above = F.last(F.when(F.col("seeks") == 0, F.col("element")), ignorenulls=True).over(order)
    found = (
        roles.withColumn("outer", open_above)
        .where(F.col("seeks") == 1)
        .select(
            *KEY, "element.*",
            F.col("outer.kind").alias("outer_kind"), F.col("outer.start").alias("outer_start"),
            F.col("outer.end").alias("outer_end"), (F.col("depth") - F.col("level")).alias("distance"),
        )
    )
    return found if kinds is None else found.where(F.col("outer_kind").isin(kinds))


def parent(spans: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The nearest ancestor (of the given kinds)."""
    found = ancestors(spans, kinds)
    if kinds is None:
        return found.where(F.col("distance") == 1)
    nearest = F.min_by(F.struct("outer_kind", "outer_start", "outer_end", "distance"), "distance")
    return found.groupBy(*KEY, "kind", "start", "end").agg(nearest.alias("p")).select(*KEY, "kind", "start", "end", "p.*")


def nesting_level(spans: DataFrame, kinds: tuple[str, ...] = ("Template", "ParserFunction")) -> DataFrame:
    """Spans of those kinds around each of them, itself included; tables start at 0."""
    level = F.col("depth") - (1 if tuple(kinds) == ("Table",) else 0)
    chosen = spans.where(F.col("kind").isin(list(kinds))).select(*KEY, "kind", "start", "end")
    return with_depth(chosen).withColumn("nesting_level", level).drop("depth")


def contains_element(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Does span b lie inside span a (bounds may be equal)."""
    return (a_start <= b_start) & (b_end <= a_end)


def outermost(spans: DataFrame) -> DataFrame:
    """Spans that do not end inside an earlier one."""
    order = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return (
        spans.withColumn("frontier", F.max("end").over(order))
        .where(F.col("frontier").isNull() | (F.col("end") >= F.col("frontier")))
        .drop("frontier")
    )


def frontier(elements: DataFrame) -> DataFrame:
    """W1, first half: elements with the furthest end of all earlier ones and whether they are kept.

    Rows need start, end and rank, the order of kinds that start at the same place.
    """
    order = Window.partitionBy(*KEY).orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    return elements.withColumn("frontier", F.coalesce(F.max("end").over(order), F.lit(0))).withColumn(
        "kept", F.col("start") >= F.col("frontier")
    )


def last_duplicates(rows: DataFrame, by: list[str], name: Column, order: str = "ord") -> DataFrame:
    """Rows with ``is_last`` set on the last one of each trimmed name."""
    w = Window.partitionBy(*by, name).orderBy(F.col(order).desc())
    return rows.withColumn("is_last", F.row_number().over(w) == 1)


def first_mode(rows: DataFrame, by: list[str], value: Column, order: Column) -> DataFrame:
    """Most common value per group; the one seen first among ties."""
    counted = rows.groupBy(*by, value.alias("mode")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.max_by("mode", F.struct("n", -F.col("first")))
    return counted.groupBy(*by).agg(best.alias("mode"), F.max("n").alias("n"))


def max_width(rows: DataFrame, by: list[str], text: Column) -> DataFrame:
    """Widest text per group."""
    return rows.groupBy(*by).agg(F.max(F.length(text)).alias("width"))
