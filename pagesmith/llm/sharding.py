"""Operator 8: contiguous shards of near-equal bytes from global prefix sums.

The law is ``bytes``. Documents are taken in the order of id, checksum and size; nulls come
first. A document goes to the shard that holds the middle of its bytes, so no shard is further
from its target than one document, and no document is split. Null texts have no bytes and the
checksum of the empty text; an empty table gives no rows; repeated rows are shards' rows like
any other; other columns are ignored. Only ids, sizes and checksums are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesmith.llm.common import numbered, stored, whole

ROW_BYTES = 16


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` of every document."""
    text = whole(F.col(text_col))
    narrow = docs.select(
        F.col(id_col),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = numbered(narrow, [F.col(id_col).asc_nulls_first(), "text_crc32", "size"], ("size",)).withColumn(
        "shard",
        F.expr(f"int(least({shards - 1}, ((2 * before_size + size) * {shards}) div (2 * total_size)))"),
    )
    first = placed.groupBy("shard").agg(F.min("rn").alias("_start"))
    return placed.join(F.broadcast(first), "shard").select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rn") - F.col("_start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Every document with its shard and slot, one folder per shard.

    Identical rows are told apart by a number among their equals, so each takes one slot.
    """
    same = ["_id", "_crc", "_size"]
    text = whole(F.col(text_col))
    rows = docs.select(
        "*", F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.crc32(text.cast("binary")).alias("_crc"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("_size"),
    )
    places = assign_shards(docs, shards, id_col, text_col).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col("text_crc32").alias("_crc"),
        F.col("size").alias("_size"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"),
    )
    left = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))))
    right = stored(places).withColumn("_nth", F.row_number().over(Window.partitionBy(*same).orderBy("_shard", "_slot")))
    out = left.join(right, [*same, "_nth"]).drop(*same, "_nth")
    out.repartition("_shard").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
