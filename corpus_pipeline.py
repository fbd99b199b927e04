"""A training corpus from documents: quality, repeated lines, near duplicates, mix, batches.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
documents. The mix gives a document as often as it is taken, whole: a document of which a part
is taken is kept once. ``ORACLE_SQL`` is None, as flows, components and bucket bounds are not
SQL; the tests hold the stages against brute force.
"""

from __future__ import annotations

from functools import wraps
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesmith.llm import line_dedup, mixing, ngram_join, packing, quality
from pagesmith.session import shared_folder

ORACLE_SQL = None


def sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents with ``n_chars`` of the new text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


KNOWN = ("doc_id", "text", "source", "n_chars")


def apart(stage):
    """The stage on the columns it knows, all others in one struct, so that no name of theirs meets one of its own.

    Null, empty and repeated rows, and empty tables, are as the stage's operator has them; see its module.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = [c for c in docs.columns if c in KNOWN]
        others = [F.col(f"`{c}`") for c in docs.columns if c not in KNOWN]
        packed = docs.select(*held, F.struct(*others).alias("_others")) if others else docs
        out = stage(spark, packed, sf_dir)
        return out.select(*[F.col(c) if c in KNOWN else F.col("_others").getField(c).alias(c) for c in docs.columns])

    return run


@apart
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that many documents of a source share; documents that fail the rules go."""
    return sized(quality.clean(docs), docs.columns)


@apart
def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later copies of repeated runs of lines."""
    return sized(line_dedup.dedup_lines(docs), docs.columns)


@apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs)


@apart
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document as often as the mix takes its words, rounded up."""
    taken = mixing.mix_rows(docs)
    copies = F.ceil(F.col("_taken") / F.col("_size")).cast("int")
    times = F.when(F.col("_size") > 0, copies).otherwise(0)
    rows = taken.withColumn("_copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    return rows.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches; the columns of the packing operator."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules), ("line dedup", repeated_lines), ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mix), ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
