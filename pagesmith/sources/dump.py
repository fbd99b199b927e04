"""Compressed XML dumps as tables (A1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXT = "struct<_VALUE:string>"
_PAGE = f"title string, ns int, redirect struct<_title:string>, revision array<struct<model:string,text:{_TEXT}>>"
END = "</page>"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A1: ``.xml.bz2`` dump to raw pages ``ord, title, ns, redirect, model, text``.

    Records end at ``</page>``, so one bz2 file is read by many tasks. ``text`` and
    ``model`` are those of the first revision; absent fields take their defaults. A record
    that is no well-formed XML is an error.
    """
    if not path.endswith(".bz2"):
        raise ValueError("a dump must be a .bz2 file")
    return parse_records(add_ord(read_records(spark.read, path)))


def read_records(reader, path: str) -> DataFrame:
    """Raw page records with where they lie; ``reader`` may be a stream reader."""
    return reader.option("lineSep", END).schema("value string").format("text").load(path).select(
        "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def add_ord(records: DataFrame) -> DataFrame:
    """Dump order. Files are ordered by name, splits by offset, rows as read."""
    return records.select(
        F.struct("file", "block", F.monotonically_increasing_id().alias("row")).alias("ord"), "value"
    )


def parse_records(records: DataFrame) -> DataFrame:
    at = F.instr("value", "<page>")
    xml = F.concat(F.col("value").substr(at, F.length("value")), F.lit(END))
    page = F.from_xml(xml, _PAGE, {"ignoreSurroundingSpaces": "false", "mode": "FAILFAST"})
    revision = F.try_element_at("p.revision", F.lit(1))
    return (
        records.where(F.col("value").contains("<page>"))
        .select("ord", page.alias("p"))
        .select(
            "ord",
            F.coalesce("p.title", F.lit("")).alias("title"),
            F.coalesce("p.ns", F.lit(0)).alias("ns"),
            F.when(F.col("p.redirect").isNotNull(), F.coalesce("p.redirect._title", F.lit(""))).alias("redirect"),
            F.coalesce(revision["model"], F.lit("")).alias("model"),
            F.coalesce(revision["text"]["_VALUE"], F.lit("")).alias("text"),
        )
    )
