"""Page tables, dimensions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagesmith.constants import INFLECTED_FORMS, WORD_CLASSES
from pagesmith.schemas import NAMESPACE_ENTRY, PAGES
from pagesmith.sources import versions


def read_namespaces(spark: SparkSession, folder: str, lang: str = "*") -> DataFrame:
    """A2: ``<folder>/<lang>/namespaces.json`` to one row per namespace."""
    files = spark.read.text(f"{folder}/{lang}/namespaces.json", wholetext=True)
    entries = F.from_json("value", f"map<string,{NAMESPACE_ENTRY}>")
    code = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/namespaces\.json(?:/[^/]+)?$", 1)
    rows = files.select(code.alias("lang"), F.explode(entries).alias("canonical_name", "n"))
    return with_pairs(rows.select("lang", "canonical_name", "n.*"))


def with_pairs(namespaces: DataFrame) -> DataFrame:
    """Talk namespace of content namespaces, subject namespace of talk namespaces."""
    talk = F.when(F.col("content") & (F.col("id") >= 0), F.col("id") + 1)
    is_subject_of = F.when(talk.isNull() & F.col("istalk"), F.col("id") - 1)
    return namespaces.withColumn("talk_id", talk).withColumn("subject_id", is_subject_of)


def subject_talk_pairs(namespaces: DataFrame) -> DataFrame:
    """Names of both sides; a self-join on the id of the partner."""
    n = with_pairs(namespaces)
    by = ["lang"] if "lang" in n.columns else []
    partner = namespaces.select(*by, F.col("id").alias("partner_id"), F.col("name").alias("partner_name"))
    return n.withColumn("partner_id", F.coalesce("talk_id", "subject_id")).join(partner, [*by, "partner_id"], "left")


def local_names(namespaces: DataFrame, lang: str | None = None) -> DataFrame:
    """Namespaces of one language, each id once; an error where a page would meet two of them.

    A table of several languages needs ``lang``.
    """
    if lang is not None:
        namespaces = namespaces.where(F.col("lang") == lang)
    n = F.count(F.lit(1))
    twice = F.raise_error(F.concat(F.lit("namespace "), F.col("id").cast("string"), F.lit(" occurs more than once; name the language")))
    rest = [c for c in ("canonical_name", "name") if c in namespaces.columns]
    once = namespaces.groupBy("id").agg(*[F.first(c).alias(c) for c in rest], n.alias("n"))
    return once.select(*[F.when(F.col("n") > 1, twice.cast(t)).otherwise(F.col(c)).alias(c) for c, t in once.select("id", *rest).dtypes])


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    """A3: language table ``code, name, ord`` from a JSON object of codes and names, in its order."""
    text = spark.read.text(path, wholetext=True)
    entries = F.map_entries(F.from_json("value", "map<string,string>"))
    return text.select(F.posexplode(entries).alias("ord", "e")).select("e.key", "e.value", "ord").toDF("code", "name", "ord")


def lang_name(df: DataFrame, code: str, languages: DataFrame, out: str = "lang_name") -> DataFrame:
    """A3: language name of a code. ``languages`` is ``code, name, ord``."""
    return df.join(languages.select(F.col("code").alias(code), F.col("name").alias(out)), code, "left")


def lang_code(df: DataFrame, name: str, languages: DataFrame, out: str = "lang_code") -> DataFrame:
    """A3: language code of a name; of codes that share a name the last one wins."""
    inverse = languages.groupBy(F.col("name").alias(name)).agg(F.max_by("code", "ord").alias(out))
    return df.join(inverse, name, "left")


def terms(spark: SparkSession) -> DataFrame:
    """A4: word classes and inflected forms as ``kind, term``."""
    rows = [("class", t) for t in WORD_CLASSES] + [("inflected", t) for t in INFLECTED_FORMS]
    return spark.createDataFrame(rows, "kind string, term string")


def filter_terms(df: DataFrame, col: str, kind: str) -> DataFrame:
    """A4: rows whose column holds a word class or an inflected form."""
    return df.where(F.col(col).isin(WORD_CLASSES if kind == "class" else INFLECTED_FORMS))


PAGE_COLUMNS = ["title", "namespace_id", "redirect_to", "body", "model"]


def write_pages(pages: DataFrame, path: str) -> int:
    """A5: page table as Parquet by namespace; returns the number of rows.

    Rows are rebalanced by namespace: a large namespace gets several files of about the advisory partition
    size, small ones one each.
    """
    seen = Observation("pages")
    counted = pages.select(*PAGE_COLUMNS).observe(seen, F.count(F.lit(1)).alias("n"))
    counted.hint("rebalance", "namespace_id").write.mode("overwrite").partitionBy("namespace_id").parquet(path)
    return seen.get["n"]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A5: scan of a page table, plain or versioned; filters on namespace_id prune folders, others reach the Parquet reader."""
    pointer = versions.current(spark, path)
    if pointer is not None:
        return versions.read_parts(spark, path, pointer, PAGES)
    return spark.read.schema(PAGES).parquet(path).select(*PAGE_COLUMNS)


def write_title_report(pages: DataFrame, path: str) -> int:
    """One title per line; returns the total."""
    seen = Observation("titles")
    pages.select("title").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    return seen.get["n"]
