"""Wikitext to plain text over a whole corpus.

The elements of a page yield the spans to delete or replace; they are merged and applied
inside the row of the page, without a shuffle. Tables become text in the same step, from what
the edits leave of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesmith.constants import FILE_EXTENSIONS
from pagesmith.functions.scan import MARKS, bound, exploded, match_in, plain_pages, quotes_in, scan_elements, splice, splice_parts
from pagesmith.functions.text import normal_name, unescape_entities
from pagesmith.operators.extract import _LINK_URL, link_fields, link_items, name_of, quote_items
from pagesmith.operators.intervals import KEY
from pagesmith.operators.joins import skew_join
from pagesmith.operators.rewrite import rule_map

_EDIT = "array<struct<start:int,end:int,new:string,merge:boolean>>"


def _edit(start: Column, end: Column, new=None) -> Column:
    return F.struct(
        start.alias("start"), end.alias("end"), (F.lit("") if new is None else new).alias("new"), F.lit(True).alias("merge")
    )


def _keep(start: Column, end: Column, inner_start: Column, inner_end: Column) -> Column:
    """Delete [start, end) but for its inside."""
    return F.array(_edit(start, inner_start), _edit(inner_end, end))


def _nothing() -> Column:
    return F.array().cast(_EDIT)


def _element_edits(f: Column, flags: dict) -> Column:
    """Edits of one scanned element."""
    kind, s, e, string = f["kind"], f["start"], f["end"], f["string"]
    whole = F.array(_edit(s, e))
    result = F.when(kind == "Comment", whole)

    for name, flag in (("Template", flags["replace_templates"]), ("ParserFunction", flags["replace_parser_functions"])):
        if callable(flag):
            result = result.when(kind == name, F.array(_edit(s, e, F.coalesce(flag(f), F.lit("")))))
        elif flag:
            result = result.when(kind == name, whole)
    if flags["replace_parameters"]:
        default = F.array(_edit(s, s + f["split"] + 1), _edit(e - 3, e))
        result = result.when((kind == "Parameter") & (f["split"] >= 0), default).when(kind == "Parameter", whole)
    if flags["replace_tags"]:
        opening = F.length(F.regexp_extract(string, r"(?s)^<(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", 0))
        closing = F.length(F.regexp_extract(string, r"(?s)</[^<>]*>\z", 0))
        paired = kind.isin("Tag", "ExtensionTag") & (closing > 0) & ~string.rlike(r"^<[^>]*/\s*>\z")
        result = result.when(paired, _keep(s, e, s + opening, e - closing)).when(kind.isin("Tag", "ExtensionTag"), whole)
    if flags["replace_wikilinks"]:
        is_link = kind == "WikiLink"
        parts = link_fields(lambda n: f[n])
        is_file = parts["link_title"].rlike(rf"(?s)^(?!:)[^:]*:[^.]*\.(?:{'|'.join(FILE_EXTENSIONS)})\z")
        inner = s + F.when(f["split"] >= 0, f["split"] + 1).otherwise(f["opening"])
        result = result.when(is_link & is_file, whole).when(is_link, _keep(s, e, inner, s + f["closing"]))
    return F.coalesce(result, _nothing())


def plain_text(
    pages: DataFrame,
    replace_templates: bool | Callable = True,
    replace_parser_functions: bool | Callable = True,
    replace_parameters: bool = True,
    replace_tags: bool = True,
    replace_external_links: bool = True,
    replace_wikilinks: bool = True,
    unescape_html_entities: bool = True,
    replace_bolds_and_italics: bool = True,
    replace_tables: bool | Callable = True,
    replacements: dict[str, str] | DataFrame | None = None,
) -> DataFrame:
    """Page key and plain text.

    T2: templates and functions may be replaced by a function from the element (a struct
    Column of kind, start, end, string, mask and the marks of the scan) to a Column; tables by a function
    from their text, when all other markup in it is gone, to a Column. Templates may also be replaced by
    ``replacements`` from normal names to texts, a dict or a table ``name, text``; one that is not listed
    is dropped. A table of few names is a constant; of a larger one every page gets the names it uses
    in a join that spreads hot names.
    """
    flags = dict(locals())
    if replacements is not None:
        if isinstance(replacements, dict):
            table = F.create_map(*[F.lit(x) for pair in replacements.items() for x in pair])
        else:
            table = rule_map(replacements, "name", F.col("text"))
            if table is None:
                pages, table = _with_replacements(pages, replacements), F.col("replacements")
            else:
                pages, table = pages.withColumn("replacements", table), F.col("replacements")
        flags["replace_templates"] = lambda f: F.try_element_at(table, normal_name(name_of(lambda n: f[n])))

    keep = [c for c in ("replacements",) if c in pages.columns]
    found = F.col("found")
    fields = ("string", "mask", *MARKS)
    scanned = bound(pages, [*KEY, *keep, "body"], found=scan_elements("body", _KINDS, fields, masked=_MASKED))
    links = match_in(_LINK_URL, link_items(found)) if replace_external_links else F.lit(None)
    quotes = quotes_in(quote_items(found)) if replace_bolds_and_italics else F.lit(None)
    scanned = bound(scanned, [*KEY, *keep, "body", "found"], links=links, quotes=quotes)
    parts = [F.flatten(F.transform(found, lambda f: _element_edits(f, flags)))]
    if replace_external_links:

        def link_edits(m):
            text = F.length(m["texts"][2]) - m["texts"][2].startswith(" ").cast("int")
            kept = _keep(m["start"], m["end"], m["end"] - 1 - text, m["end"] - 1)
            return F.when(m["texts"][2] == "", F.array(_edit(m["start"], m["end"]))).otherwise(kept)

        bracketed = F.filter("links", lambda m: m["texts"][1].isNotNull())
        parts.append(F.flatten(F.transform(bracketed, link_edits)))
    if replace_bolds_and_italics:

        def quote_edits(q):
            width = F.length(q["string"]) - F.length(q["text"])
            mark = F.when(q["kind"] == "Bold", 3).otherwise(2)
            inner = q["start"] + F.when(width > mark, width / 2).otherwise(width).cast("int")
            return _keep(q["start"], q["end"], inner, inner + F.length(q["text"]))

        parts.append(F.flatten(F.transform("quotes", quote_edits)))

    tables = F.filter(found, lambda f: f["kind"] == "Table")
    by_page = bound(
        scanned, [*KEY, "body"], edits=F.array_sort(F.concat(*parts)),
        tables=F.transform(tables, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))),
    )
    if callable(replace_tables):
        text = _with_tables(by_page, replace_tables)
    else:
        plain = plain_pages("body", "tables", "edits") if replace_tables else splice("body", "edits")
        text = by_page.select(*KEY, plain.alias("text"))
    if not unescape_html_entities:
        return text
    return text.select(*KEY, unescape_entities("text").alias("text"))


_KINDS = ("Page", "Comment", "ExtensionTag", "Parameter", "ParserFunction", "Template", "WikiLink", "Tag", "Table")
_MASKED = ("Page", "ExtensionTag", "Parameter", "ParserFunction", "Template", "WikiLink")


def _with_replacements(pages: DataFrame, table: DataFrame) -> DataFrame:
    """Pages with ``replacements``, a map of the normal names they use to texts."""
    body = F.when(F.col("body").contains("{{"), F.col("body"))
    found = bound(pages, KEY, found=scan_elements(body, ("Template",), ("string", "split", "closing")))
    used = F.array_distinct(F.transform("found", lambda f: normal_name(name_of(lambda n: f[n]))))
    names = exploded(found, KEY, used, "name")
    once = table.groupBy("name").agg(F.min("text").alias("text"))
    listed = skew_join(names, once, ["name"], KEY).groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("replacements"))
    return pages.join(listed, KEY, "left")


def _with_tables(by_page: DataFrame, replace) -> DataFrame:
    """Pages with every outer table replaced by what the caller makes of its text."""
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform("tables", lambda t: F.array(t["start"], t["end"]))), F.array(F.length("body")))
    bounds = F.transform(
        F.sequence(F.lit(0), F.size("edges") - 2),
        lambda i: F.struct(F.get("edges", i).alias("start"), F.get("edges", i + 1).alias("end")),
    )
    pieces = bound(by_page, by_page.columns, edges=edges)
    pieces = bound(pieces, KEY, pieces=splice_parts("body", bounds, "edits"))
    # Odd pieces are tables.
    text = F.transform("pieces", lambda p, i: F.when(i % 2 == 1, F.coalesce(replace(p), F.lit(""))).otherwise(p))
    return pieces.select(*KEY, F.array_join(text, "").alias("text"))
