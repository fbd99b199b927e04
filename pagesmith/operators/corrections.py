"""Correction rules of a Spanish dictionary wiki (K1-K5).

K2 to K5 work on the segments of a page, an array in its row: classes, numbers within a class and
edits are array expressions, so one read of the page table gives the corrections, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesmith.constants import (
    CORRECTION_LABELS,
    LABEL_RULES,
    SYLLABLE_PATTERN,
    TEMPLATE_PREFIX_PATTERN,
)
from pagesmith.functions.scan import bound, exploded
from pagesmith.functions.text import codepoint_char
from pagesmith.operators.intervals import KEY
from pagesmith.operators.rewrite import edited
from pagesmith.operators.segments import segment_arrays

MERGE_TEMPLATES, INSERT_TEMPLATE, TEXT_TO_TEMPLATE, ITEM_TO_TEMPLATE = 0, 3, 5, 6
DROP_TEMPLATE, DROP_COMMENT, DROP_TAG, FIX_HIERARCHY, NORMALISE_TEMPLATE = 7, 8, 13, 15, 18
_RULE_CODES = {"item": ITEM_TO_TEMPLATE, "text": TEXT_TO_TEMPLATE, "pron": INSERT_TEMPLATE}


def _literal(pattern: str) -> str:
    """The longest plain text that every match of a rule's pattern contains."""
    return max(re.split(r"\[[^\]]*\]|\.", pattern), key=len)


def label_hits() -> Column:
    """K1 as an array<struct<rule,kind,template,n>> of the rules that match the body."""
    body = F.col("body")
    rules = [
        F.struct(
            F.lit(number).alias("rule"), F.lit(kind).alias("kind"), F.lit(template).alias("template"),
            F.when(body.contains(_literal(pattern)) & body.rlike(pattern), F.regexp_count(body, F.lit(pattern))).alias("n"),
        )
        for number, (kind, pattern, template) in enumerate(LABEL_RULES)
    ]
    return F.filter(F.array(*rules), lambda r: r["n"] > 0)


def label_suggestions(pages: DataFrame) -> DataFrame:
    """K1: one row per page and rule that matches, with the suggested template."""
    return exploded(pages, KEY, label_hits(), "r").select(*KEY, "r.*")


_CLASSES = ["desambiguación", "unicode", "pronunciación", "lengua", "estructura", "Carácter Oriental", "TRANSLIT", "TAXO"]


def _legacy_class(name: Column, clean: Column) -> Column:
    return (
        F.when(clean.isin("desambiguación", "unicode", "pronunciación"), clean)
        .when(name.contains("ES"), "lengua")
        .when(name == "estructura", "estructura")
        .when(name.contains("Carácter Oriental"), "Carácter Oriental")
        .when(name.contains("TRANSLIT"), "TRANSLIT")
        .when(name.contains("TAXO"), "TAXO")
    )


def with_legacy(rows: DataFrame) -> DataFrame:
    """K2 on rows with ``segments``: adds ``legacy``, the legacy templates of the page with what to do.

    Repeated disambiguations go into the first one.
    """
    named = F.transform(
        F.filter("segments", lambda s: s["kind"] == "Template"),
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["string"].alias("string"),
            F.regexp_extract(s["string"], r"(?s)^\{\{\s*([^|}<\n]*?)\s*(?:[|<\n].*)?\}\}$", 1).alias("name"),
            F.regexp_extract(s["string"], r"(?s)^\{\{[^|]*?(\|.*)?\}\}$", 1).alias("rest"),
        ),
    )
    cleaned = F.transform("named", lambda t: t.withField("clean_name", F.regexp_replace(t["name"], TEMPLATE_PREFIX_PATTERN, "")))
    classed = F.transform("cleaned", lambda t: t.withField("class", _legacy_class(t["name"], t["clean_name"])))
    # One part per class, in which the place in the array is the number within the class.
    def of_class(c: str) -> Column:
        return F.transform(F.filter("classed", lambda t: t["class"] == c), lambda t, i: t.withField("nth", i + 1))

    parts = [of_class(c) for c in _CLASSES]
    renamed = F.filter("classed", lambda t: t["class"].isNull() & (t["name"] != t["clean_name"]))
    parts.append(F.transform(renamed, lambda t: t.withField("nth", F.lit(None).cast("int"))))
    merged_args = F.array_join(F.transform(F.filter("classed", lambda t: t["class"] == _CLASSES[0]), lambda t: t["rest"]), "")
    keep = rows.columns
    rows = bound(bound(bound(rows, keep, named=named), keep, cleaned=cleaned), keep, classed=classed)
    numbered = bound(rows, keep, numbered=F.concat(*parts), merged_args=merged_args)
    return bound(numbered, keep, legacy=F.transform("numbered", lambda t: _decided(t, F.col("merged_args"))))


def _decided(t: Column, merged_args: Column) -> Column:
    """One legacy template with action, replacement and correction code."""
    kind, nth = t["class"], t["nth"]
    repeated = (kind == "desambiguación") & (nth > 1)
    is_error = (kind == "unicode") & (nth > 1)
    code = F.lower(F.regexp_replace(F.split_part(t["name"], F.lit("-"), F.lit(1)), "[^a-zA-Z]+", ""))
    number = F.regexp_extract(t["string"], r"uniact=([0-9]+)[|}]", 1)
    char = F.when(number != "", codepoint_char(number))
    action = (
        F.when(repeated, "delete")
        .when(kind.isin("desambiguación", "lengua"), "replace")
        .when((kind == "unicode") & ~is_error & char.isNotNull(), "replace")
        .when(kind.isin("estructura", "Carácter Oriental", "TRANSLIT", "TAXO"), "delete")
        .otherwise("keep")
    )
    replacement = (
        F.when(kind == "lengua", F.concat(F.lit("{{lengua|"), code, F.lit("}}")))
        .when((kind == "desambiguación") & ~repeated, F.concat(F.lit("{{desambiguación"), merged_args, F.lit("}}")))
        .when((kind == "unicode") & ~is_error, F.concat(F.lit("{{mostrar-unicode|"), char, F.lit("}}")))
    )
    correction = (
        F.when(repeated, MERGE_TEMPLATES)
        .when((kind == "lengua") | (t["name"] != t["clean_name"]), NORMALISE_TEMPLATE)
        .when(action == "delete", DROP_TEMPLATE)
    )
    return F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["name"].alias("name"), t["clean_name"].alias("clean_name"),
        kind.alias("class"), nth.alias("nth"), action.alias("action"), F.when(action == "replace", replacement).alias("replacement"),
        correction.alias("code"), F.coalesce(is_error, F.lit(False)).alias("is_error"),
    )


def classify_legacy_templates(pages: DataFrame) -> DataFrame:
    """K2: top-level legacy templates with what to do and the correction code."""
    found = with_legacy(segment_arrays(pages.where(F.col("body").contains("{{"))))
    return found.select(*KEY, F.explode("legacy").alias("t")).select(*KEY, "t.*")


def ref_flags() -> Column:
    """K3 on ``segments``: array<struct<start,end,inside,after>> of the ``ref`` tags by a syllable division."""
    flagged = F.transform(
        "segments",
        lambda s, i: F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            ((s["kind"] == "ExtensionTag") & s["string"].rlike(r"^<ref[\s>/]")).alias("is_ref"),
            s["string"].rlike(SYLLABLE_PATTERN).alias("inside"),
            F.coalesce(F.get("segments", i + 1)["string"].rlike(SYLLABLE_PATTERN), F.lit(False)).alias("after"),
        ),
    )
    refs = F.filter(flagged, lambda s: s["is_ref"] & (s["inside"] | s["after"]))
    return F.transform(refs, lambda s: F.struct(s["start"], s["end"], s["inside"], s["after"]))


def syllable_refs(pages: DataFrame) -> DataFrame:
    """K3: ``ref`` tags that hold a syllable division or stand before one."""
    found = segment_arrays(pages.where(F.col("body").contains("<ref")))
    return exploded(found, KEY, ref_flags(), "r").select(*KEY, "r.*")


def corrections_table(spark) -> DataFrame:
    """K4: the correction codes and their labels."""
    return spark.createDataFrame(list(enumerate(CORRECTION_LABELS)), "code int, label string")


def page_corrections(pages: DataFrame) -> DataFrame:
    """K4: one row per page and correction it needs, with the label."""
    rows = with_legacy(segment_arrays(pages.where(F.col("body").isNotNull())))
    none = F.lit(None).cast("int")
    by_kind = lambda s: F.when(s["kind"] == "Comment", DROP_COMMENT).when(s["kind"] == "SectionTitle", FIX_HIERARCHY).otherwise(none)
    rule_code = F.create_map(*[F.lit(x) for pair in _RULE_CODES.items() for x in pair])
    codes = F.concat(
        F.transform("segments", by_kind), F.transform("legacy", lambda t: t["code"]),
        F.transform(ref_flags(), lambda r: F.lit(DROP_TAG)), F.transform(label_hits(), lambda h: rule_code[h["kind"]]),
    )
    labels = F.array(*[F.lit(label) for label in CORRECTION_LABELS])
    found = exploded(rows, KEY, F.array_distinct(F.array_compact(codes)), "code")
    return found.withColumn("label", F.get(labels, F.col("code")))


def correction_counts(pages: DataFrame) -> DataFrame:
    """K4: pages per correction code."""
    return page_corrections(pages).groupBy("code", "label").agg(F.count(F.lit(1)).alias("pages"))


def correct_pages(pages: DataFrame) -> DataFrame:
    """K5: pages without legacy templates and comments; all else stays in order."""
    rest = tuple(c for c in pages.columns if c not in (*KEY, "body"))
    rows = with_legacy(segment_arrays(pages, rest))
    gone = F.transform(
        F.filter("segments", lambda s: s["kind"] == "Comment"),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("new")),
    )
    changed = F.transform(
        F.filter("legacy", lambda t: t["action"] != "keep"),
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.coalesce(t["replacement"], F.lit("")).alias("new")),
    )
    return edited(rows, F.concat(gone, changed), pages.columns)
