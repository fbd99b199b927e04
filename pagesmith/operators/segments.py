"""All elements of a page in document order, and its segmentation.

The elements of a page are one array in its row, from one scan of the body; order, frontier and
cuts are worked out inside the row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesmith.functions.scan import bound, cut_spans, match_in, match_positions, quotes_in, scan_elements, segments_of
from pagesmith.operators.extract import (
    _HEADING,
    _LINK_URL,
    _QUOTABLE,
    LIST_PATTERNS,
    link_items,
    list_patterns,
    quote_items,
)
from pagesmith.operators.intervals import KEY

# Which kind comes first among elements that start at the same place.
RANKS = {
    "Comment": 1, "ExternalLink": 2, "Parameter": 3, "ParserFunction": 4, "Template": 5, "WikiLink": 6,
    "SectionTitle": 7, "Bold": 8, "Italic": 8, "WikiList": 9, "Table": 10, "Tag": 11, "ExtensionTag": 11,
}
_SCANNED = ("Page", "Comment", "ExtensionTag", "Parameter", "ParserFunction", "Template", "WikiLink", "Tag", "Table")


def element_arrays(pages: DataFrame, kinds: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Page key, ``keep``, body and ``elements``: array<struct<start,rank,end,kind>> in document order."""
    found = F.col("found")
    scanned = bound(pages, [*KEY, *keep, "body"], found=scan_elements("body", _SCANNED, ("mask",), masked=_QUOTABLE))
    scanned = scanned.withColumn("shadow", F.try_element_at("found", F.lit(1))["mask"])
    # Only places are needed, so masks stand in for the texts.
    matched = bound(
        scanned, [*KEY, *keep, "body"], found=F.transform(found, lambda f: F.struct(f["kind"], f["start"], f["end"])),
        links=match_in(_LINK_URL, link_items(found, "mask"), groups=False),
        lines=match_positions([_HEADING, *list_patterns(LIST_PATTERNS)], F.col("shadow"), groups=False),
        quotes=quotes_in(quote_items(found, text="mask")),
    )
    rank = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])

    def named(array: Column, kind) -> Column:
        return F.transform(array, lambda m: F.struct(
            m["start"].alias("start"), rank[kind(m)].alias("rank"), m["end"].alias("end"), kind(m).alias("kind")))

    everything = F.concat(
        named(F.filter("found", lambda f: f["kind"] != "Page"), lambda f: f["kind"]),
        named(F.col("links"), lambda m: F.lit("ExternalLink")),
        named(F.col("lines"), lambda m: F.when(m["which"] == 0, "SectionTitle").otherwise("WikiList")),
        named(F.col("quotes"), lambda q: q["kind"]),
    )
    if kinds is not None:
        everything = F.filter(everything, lambda e: e["kind"].isin(kinds))
    return bound(matched, [*KEY, *keep, "body"], elements=F.array_sort(everything))


def elements(pages: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Every element of every kind as one table, from one scan of each body.

    Tables nested in tables are left out, as in the listing of outer tables.
    """
    cut = bound(element_arrays(pages, kinds), [*KEY, "elements"], strings=cut_spans("body", "elements"))
    rows = cut.select(*KEY, F.explode(F.arrays_zip("elements", "strings")).alias("z"))
    return rows.select(*KEY, "z.elements.kind", "z.elements.start", "z.elements.end", F.col("z.strings").alias("string"), "z.elements.rank")


def document_order(elements: DataFrame) -> DataFrame:
    """O1: listing by page, start and end."""
    return elements.orderBy(*KEY, "start", "end", "rank")


def segment_arrays(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """W1 as ``segments``: array<struct<kind,start,end,string>> beside page key, ``keep`` and body.

    An element is kept when it starts at or after the furthest end of all earlier
    elements; a dropped one still moves that frontier.
    """
    found = element_arrays(pages, keep=keep)
    return bound(found, [*KEY, *keep, "body"], segments=segments_of("body", "elements"))


def segment(pages: DataFrame) -> DataFrame:
    """Top-level elements and the text between them, in order."""
    cut = segment_arrays(pages.where(F.col("body").isNotNull()))
    return cut.select(*KEY, F.posexplode("segments").alias("ord", "s")).select(*KEY, "ord", "s.*")
