"""Elements of wikitext as tables.

``texts`` runs one scan over each body and explodes it: a ``Page`` row plus one row
per comment, tag, parameter, function, template, link and table, with the kinds and
fields the job asks for. Everything else is column logic over those rows, so a page is
scanned once per job and nothing is shuffled unless a group asks for it. Pages without
the opening characters of the wanted kinds are filtered by the table scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesmith.constants import URL_SCHEMES
from pagesmith.functions.brackets import LINK_CLOSE, LINK_COLON, LINK_OPEN
from pagesmith.functions.grids import CAPTION, CELL
from pagesmith.functions.scan import (
    KINDS, MARKS, arguments_in, bound, cut_spans, exploded, match_in, match_positions, quotes_in, scan_elements,
    sections_of, table_layout, table_texts,
)
from pagesmith.operators.intervals import KEY
from pagesmith.functions.text import attr_map, attr_pairs, cut, trim_ws

NESTED = ["Comment", "ExtensionTag", "Parameter", "ParserFunction", "Template", "WikiLink"]

_SCHEMES = "|".join(re.escape(s) for s in URL_SCHEMES)
# What a URL may hold: no blank, quote, angle bracket or square bracket, shown or masked; a host may be [IPv6].
_URL_CHAR = rf'[^ \t\n"<>\[\]{LINK_OPEN}{LINK_CLOSE}]'
_URL_TAIL = rf"(?:\[[0-9a-fA-F:.]+\]{_URL_CHAR}*|{_URL_CHAR}+)"
_LINK_URL = rf"\[((?:{_SCHEMES}|//){_URL_TAIL})([^\]\n]*)\]|\b((?:{_SCHEMES}){_URL_TAIL})"
_HEADING = r"(?m)^(={1,6})([^\n]+?)\1[ \t]*$"
LIST_PATTERNS = (r"\#", r"\*", "[:;]")


# --- X0, X20 ---------------------------------------------------------------------


_OPENINGS = {
    "Comment": "<!--", "ExtensionTag": "<", "Tag": "<", "Parameter": "{{{", "ParserFunction": "{{", "Template": "{{",
    "WikiLink": "[", "Table": "{|", "InnerTable": "{|",
}


def with_any(pages: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Pages that may have an element of these kinds; the test reaches the scan of the table."""
    if "Page" in kinds:
        return pages
    tests = [F.col("body").contains(mark) for mark in sorted({_OPENINGS[k] for k in kinds})]
    return pages.where(reduce(lambda a, b: a | b, tests))


def texts(
    pages: DataFrame, kinds: Sequence[str] | None = None, keep: tuple[str, ...] = (), fields: Sequence[str] = ("string", "mask")
) -> DataFrame:
    """Page key, kind, start, end and ``fields`` (string, mask): the page itself and its elements."""
    chosen = KINDS if kinds is None else kinds
    found = exploded(with_any(pages, chosen), [*KEY, *keep], scan_elements("body", chosen, fields), "f")
    return found.select(*KEY, *keep, "f.*")


def spans(pages: DataFrame, kinds: Sequence[str] | None = None, fields: Sequence[str] = ("string", "mask")) -> DataFrame:
    """The nested elements of every page."""
    return texts(pages, kinds or NESTED, fields=fields)


def with_shadow(pages: DataFrame, *keep: str) -> DataFrame:
    """Page key, ``keep``, body and ``shadow``, the masked body."""
    scanned = bound(pages, [*KEY, *keep, "body"], found=scan_elements("body", ("Page",), ("mask",)))
    return scanned.select(*KEY, *keep, "body", F.try_element_at("found", F.lit(1))["mask"].alias("shadow"))


def masked(pages: DataFrame) -> DataFrame:
    """Every page with its masked body."""
    return with_shadow(pages, *[c for c in pages.columns if c not in (*KEY, "body")]).select(*pages.columns, "shadow")


def element_string(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Cut elements given by page key, start and end from the bodies."""
    rest = [c for c in spans.columns if c not in KEY and c != "string"]
    grouped = spans.groupBy(*KEY).agg(F.collect_list(F.struct(*rest)).alias("spans"))
    joined = bound(grouped.join(pages.select(*KEY, "body"), KEY), [*KEY, "spans"], strings=cut_spans("body", "spans"))
    zipped = F.explode(F.arrays_zip("spans", "strings")).alias("z")
    return joined.select(*KEY, zipped).select(*KEY, "z.spans.*", F.col("z.strings").alias("string"))


# --- X1-X4: comments, tags, attributes -------------------------------------------


def comments(pages: DataFrame) -> DataFrame:
    """Contents of comments; an unclosed comment runs to the end."""
    found = spans(pages, ["Comment"], ("string",))
    return found.select(*KEY, "start", "end", comment_contents(F.col("string")).alias("contents"))


def comment_contents(string: Column) -> Column:
    return F.regexp_replace(string.substr(F.lit(5), F.length(string)), r"-->\z", "")


def tag_fields(string: Column) -> dict[str, Column]:
    """Start tag, end tag, name and contents (null when there are none) of a tag."""
    start_tag = F.regexp_extract(string, r"(?s)^<(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", 0)
    start_tag = F.when(start_tag == "", F.regexp_extract(string, r"(?s)^<[^>]*>", 0)).otherwise(start_tag)
    end_tag = F.regexp_extract(string, r"(?s)</[^<>]*>\z", 0)
    open_ended = (end_tag == "") | start_tag.rlike(r"/\s*>\z")
    inner = string.substr(F.length(start_tag) + 1, F.length(string) - F.length(start_tag) - F.length(end_tag))
    return {
        "start_tag": start_tag, "end_tag": end_tag, "name": F.regexp_extract(string, r"^<([^\s>/]+)", 1),
        "contents": F.when(~open_ended, inner),
    }


def _tag_columns(tags: DataFrame) -> DataFrame:
    return tags.withColumns(tag_fields(F.col("string"))).withColumn("attrs", attr_map(F.col("start_tag")))


def extension_tags(pages: DataFrame) -> DataFrame:
    """Extension tags with name, contents (null when self-closing) and attributes."""
    return _tag_columns(spans(pages, ["ExtensionTag"], ("string",)))


def html_tags(pages: DataFrame, name: str | None = None) -> DataFrame:
    """HTML and extension tags; contents are null for self-closing and start-only tags."""
    tags = _tag_columns(texts(pages, ["ExtensionTag", "Tag"], fields=("string",)))
    return tags if name is None else tags.where(F.col("name") == name)


def attributes(tags: DataFrame) -> DataFrame:
    """One row per attribute of the tags of X2 or X3; the last duplicate wins."""
    return tags.select(*KEY, "start", "end", F.explode("attrs").alias("attr", "value"))


def get_attr(tags: DataFrame, attr: str) -> DataFrame:
    """has/get by name."""
    value = F.try_element_at("attrs", F.lit(attr))
    return tags.withColumn("value", value).withColumn("has_attr", value.isNotNull())


# --- X5-X10: parameters, functions, templates -------------------------------------


def parameters(pages: DataFrame) -> DataFrame:
    """Name, whether a default exists, and the default (null without a pipe)."""
    found = spans(pages, ["Parameter"], ("string", "split", "closing"))
    return found.select(*KEY, "kind", "start", "end", "string", *[v.alias(n) for n, v in parameter_fields(F.col).items()])


def parameter_fields(e) -> dict[str, Column]:
    """Name and default of a parameter; ``e`` gives a field of the scanned element by name."""
    has_default = e("split") >= 0
    return {
        "name": cut(e("string"), F.lit(3), F.when(has_default, e("split")).otherwise(e("closing"))),
        "has_default": has_default,
        "default": F.when(has_default, cut(e("string"), e("split") + 1, e("closing"))),
    }


def name_of(e) -> Column:
    """Name of a template or function, up to its first separator."""
    return cut(e("string"), F.lit(2), F.when(e("split") >= 0, e("split")).otherwise(e("closing")))


def _named(pages: DataFrame, kind: str) -> DataFrame:
    found = spans(pages, [kind], ("string", "mask", "split", "closing"))
    return found.withColumn("name", name_of(F.col)).drop("split", "closing")


def parser_functions(pages: DataFrame) -> DataFrame:
    """Functions; the name ends at the first colon."""
    return _named(pages, "ParserFunction")


def templates(pages: DataFrame) -> DataFrame:
    """Templates; the name, white space kept, ends at the first pipe."""
    return _named(pages, "Template")


def template_args(owners: DataFrame) -> DataFrame:
    """One row per argument of the templates of X7 or the functions of X6.

    Argument positions are page offsets: ``arg_start`` is the separator, ``name_start``
    and ``value_start`` the text after it. Unnamed arguments are numbered among
    themselves (W4).
    """
    one = F.array(F.struct("kind", "start", "string", "mask"))
    rows = owners.select(*KEY, "kind", "start", "end", "string", "mask", F.trim("name").alias("owner"))
    keep = [*KEY, "kind", "start", "end", "owner"]
    return exploded(rows, keep, F.flatten(arguments_in(one)), "a").select(
        *keep, "a.ord", "a.value", "a.positional", "a.arg_start", "a.arg_end", "a.value_start", "a.arg_string", "a.name",
        "a.is_last", "a.fate",
    )


def get_arg(args: DataFrame, name: str) -> DataFrame:
    """The last argument with that trimmed name, per owner."""
    same = args.where(trim_ws("name") == name.strip())
    return same.groupBy(*KEY, "start", "owner").agg(F.max_by(F.struct("value", "positional"), "ord").alias("last")).select(
        *KEY, "start", "owner", "last.value", "last.positional"
    )


def has_arg(args: DataFrame, name: str, value: str | None = None) -> DataFrame:
    """Per owner with arguments, is there one (whose last value equals ``value``)."""
    is_name = trim_ws("name") == name.strip()
    last = F.max_by(F.when(is_name, F.struct("value", "positional")), F.when(is_name, F.col("ord")))
    owners = args.groupBy(*KEY, "start", "owner").agg(last.alias("last"))
    found = F.col("last").isNotNull()
    if value:
        equal = F.when(F.col("last.positional"), F.col("last.value") == value).otherwise(
            trim_ws("last.value") == value.strip()
        )
        found = found & equal
    return owners.select(*KEY, "start", "owner", F.coalesce(found, F.lit(False)).alias("has_arg"))


# --- X11, X12: links --------------------------------------------------------------


def wikilinks(pages: DataFrame) -> DataFrame:
    """X11: target, title, fragment and text of every wikilink, nested ones included."""
    found = spans(pages, ["WikiLink"], ("string", *MARKS))
    return found.select(*KEY, "kind", "start", "end", "string", *[v.alias(n) for n, v in link_fields(F.col).items()])


def link_fields(e) -> dict[str, Column]:
    """Parts of a wikilink and where they end; ``e`` gives a field of the scanned element by name."""
    inner_end = e("closing")
    target_end = F.when(e("split") >= 0, e("split")).otherwise(inner_end)
    title_end = F.when(e("anchor") >= 0, e("anchor")).otherwise(target_end)
    return {
        "open_len": e("opening"), "title_end": title_end, "target_end": target_end, "inner_end": inner_end,
        "target": cut(e("string"), e("opening"), target_end),
        "link_title": cut(e("string"), e("opening"), title_end),
        "fragment": F.when(e("anchor") >= 0, cut(e("string"), title_end + 1, target_end)),
        "text": F.when(e("split") >= 0, cut(e("string"), target_end + 1, inner_end)),
    }


LINKABLE = ("Page", "ExtensionTag", "Template", "ParserFunction", "Parameter")


def link_items(found: Column, text: str = "string") -> Column:
    """Texts in which external links are searched: pages, tags, and what stands in braces."""
    return _items(
        found,
        lambda f: f["kind"].isin(*LINKABLE),
        lambda f: F.struct(
            f["start"].alias("base"), f[text].alias("text"),
            F.lower(F.when(f["kind"].isin("Page", "ExtensionTag"), f["mask"]).otherwise(F.translate(f["mask"], "{}", "  "))).alias("mask"),
        ),
    )


def _items(found: Column, chosen, item) -> Column:
    return F.transform(F.filter(found, chosen), item)


def external_links(pages: DataFrame) -> DataFrame:
    """Bare and bracketed links of pages, tags, templates, functions and parameters."""
    scanned = bound(pages, KEY, found=scan_elements("body", LINKABLE))
    return exploded(scanned, KEY, match_in(_LINK_URL, link_items(F.col("found"))), "m").select(
        *KEY, F.lit("ExternalLink").alias("kind"), *[v.alias(n) for n, v in external_fields(F.col("m")).items()])


def external_fields(m: Column) -> dict[str, Column]:
    """Columns of X12 from a match."""
    rest = m["texts"][2]
    return {
        "start": m["start"], "end": m["end"], "string": m["texts"][0], "url": F.coalesce(m["texts"][1], m["texts"][3]),
        "text": F.when(rest == "", None).when(rest.startswith(" "), rest.substr(F.lit(2), F.length(rest))).otherwise(rest),
        "in_brackets": m["texts"][1].isNotNull(),
    }


# --- X13, X14: sections -------------------------------------------------------------


def section_titles(pages: DataFrame) -> DataFrame:
    """Heading lines; the level is the usable equal count on both sides."""
    found = with_shadow(pages.where(F.col("body").contains("=")))
    lines = exploded(found, KEY, match_positions(_HEADING, F.col("body"), F.col("shadow")), "m")
    return lines.select(*KEY, F.lit("SectionTitle").alias("kind"), *[v.alias(n) for n, v in heading_fields(F.col("m")).items()])


def heading_fields(m: Column) -> dict[str, Column]:
    """Columns of X13 from a match."""
    return {
        "start": m["start"], "end": m["end"], "string": m["texts"][0], "level": F.length(m["texts"][1]),
        "section_title": m["texts"][2],
    }


def section_array(pages: DataFrame, nested: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """Page key, ``keep``, body and ``sections``, the lead (level 0, maybe empty) first."""
    headings = match_positions(_HEADING, F.col("body"), F.col("shadow"))
    found = bound(with_shadow(pages, *keep), [*KEY, *keep, "body"], headings=headings)
    return bound(found, [*KEY, *keep, "body"], sections=sections_of(F.col("body"), F.col("headings"), nested))


def sections(
    pages: DataFrame, include_subsections: bool = True, level: int | None = None, top_levels_only: bool = False
) -> DataFrame:
    """Lead first, then sections, with or without their subsections."""
    if top_levels_only and (level is not None or not include_subsections):
        raise ValueError("top_levels_only excludes level and needs include_subsections")
    chosen = F.col("sections")
    if top_levels_only:
        chosen = F.filter(chosen, lambda s: s["depth"] == 1)
    if level is not None:
        chosen = F.filter(chosen, lambda s: s["level"] == level)
    rows = section_array(pages, include_subsections).select(*KEY, F.explode(chosen).alias("s"))
    return rows.select(*KEY, "s.ord", "s.start", "s.end", "s.level", "s.section_title", "s.contents")


# --- X15: bold and italic -----------------------------------------------------------


_QUOTABLE = ["Page", "Template", "ParserFunction", "Parameter", "WikiLink", "ExtensionTag"]


def quote_items(found: Column, kinds: list[str] = _QUOTABLE, text: str = "string") -> Column:
    """Contents of the elements in which bold and italic text is searched."""

    def contents(f):
        kind, mask = f["kind"], f["mask"]
        pipe = F.instr(mask, "|")
        head = (
            F.when(kind.isin("Template", "ParserFunction"), F.lit(2))
            .when(kind == "Parameter", F.lit(3))
            .when(kind == "WikiLink", F.when(pipe > 0, pipe).otherwise(F.length(mask)))
            .when(kind == "ExtensionTag", F.length(F.regexp_extract(mask, r"(?s)^<[^>]*>", 0)))
            .otherwise(F.lit(0))
        )
        tail = (
            F.when(kind.isin("Template", "ParserFunction", "WikiLink"), F.lit(2))
            .when(kind == "Parameter", F.lit(3))
            .when(kind == "ExtensionTag", F.length(F.regexp_extract(mask, r"(?s)</[^<>]*>\z", 0)))
            .otherwise(F.lit(0))
        )
        return F.struct(
            (f["start"] + head).alias("base"), cut(f[text], head, F.length(mask) - tail).alias("text"),
            cut(mask, head, F.length(mask) - tail).alias("mask"),
        )

    return _items(found, lambda f: f["kind"].isin(kinds) & f["mask"].contains("'"), contents)


def bold_italic(pages: DataFrame, kind: str | None = None, recursive: bool = True) -> DataFrame:
    """Bold and italic text, also inside other elements when ``recursive``."""
    kinds = _QUOTABLE if recursive else ["Page"]
    scanned = bound(pages.where(F.col("body").contains("''")), KEY, found=scan_elements("body", kinds))
    runs = quotes_in(quote_items(F.col("found"), kinds))
    result = exploded(scanned, KEY, runs, "q").select(*KEY, "q.*")
    return result if kind is None else result.where(F.col("kind") == kind)


# --- X16, X17: lists ----------------------------------------------------------------


def list_patterns(patterns, prefixes=("",)) -> list[str]:
    """Runs of lines that start with prefix + pattern."""
    # (?=...) captures the start of the first line: its length is the level.
    return [rf"(?m)(?=^({p + q}))(?:^(?:{p + q})[^\n]*(?:\n|\Z))+" for p in prefixes for q in patterns]


def _list_runs(patterns, text, mask, prefixes=("",), prefix_column=None):
    """Those runs as one array."""
    full = [prefix + pattern for prefix in prefixes for pattern in patterns]
    runs = list_patterns(patterns, prefixes)
    found = match_positions(runs, text, mask)
    if prefix_column is not None:
        first = [i * len(patterns) for i in range(len(prefixes))]
        mine = F.create_map(*[F.lit(x) for pair in zip(prefixes, first) for x in pair])[prefix_column]
        found = F.filter(found, lambda m: (m["which"] >= mine) & (m["which"] < mine + len(patterns)))
    names = F.array(*[F.lit(f) for f in full])
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["texts"][0].alias("string"),
            m["mask"].alias("mask"), names[m["which"]].alias("pattern"), F.length(m["texts"][1]).alias("level"),
        ),
    )


def lists(pages: DataFrame, pattern=LIST_PATTERNS) -> DataFrame:
    """Runs of list lines with their pattern and level."""
    return lists_of(texts(pages, ["Page"]), pattern)


def lists_of(rows: DataFrame, pattern=LIST_PATTERNS) -> DataFrame:
    patterns = (pattern,) if isinstance(pattern, str) else tuple(pattern)
    runs = _list_runs(patterns, F.col("string"), F.col("mask"))
    found = exploded(rows.withColumn("base", F.col("start")), [*KEY, "base"], runs, "l")
    return found.select(*KEY, F.lit("WikiList").alias("kind"), (F.col("base") + F.col("l.start")).alias("start"),
                        (F.col("base") + F.col("l.end")).alias("end"), "l.string", "l.mask", "l.pattern", "l.level")


def item_patterns(patterns=LIST_PATTERNS) -> list[str]:
    """Items of the lists of each pattern."""
    url = rf"\[(?:{_SCHEMES}|//)[^\]\n]*\]|\b(?:{_SCHEMES})[^\s\"<>\[\]]+"
    expressions = []
    for p in patterns:
        deeper = rf"(?:^(?:{p})[:;#*][^\n]*(?:\n|\Z))*"
        expressions.append(
            rf"(?m)^({p})(?:"
            rf"(?<=;)((?:{url}|[^:{LINK_COLON}\n])*+)(?:([:{LINK_COLON}][^\n]*))?(?:\n|\Z){deeper}"
            rf"|(?=[:;#*])()[^\n]*(?:\n|\Z){deeper}"
            rf"|([^\n]*)(?:\n|\Z){deeper})"
        )
    return expressions


def list_items(lists: DataFrame, patterns=LIST_PATTERNS) -> DataFrame:
    """Items without their sub-items, and full items with prefix and sub-items.

    ``; a : b`` gives two items. ``patterns`` are those the lists may have.
    """
    mine = F.array_position(F.array(*[F.lit(p) for p in patterns]), F.col("pattern")) - 1
    found = F.filter(match_positions(item_patterns(patterns), F.col("string"), F.col("mask")), lambda m: m["which"] == mine)
    base = F.col("start")
    rows = exploded(lists, [*KEY, "start", "end", "pattern", "level"], found, "m")
    whole = F.struct(
        (base + F.col("m.start")).alias("item_start"), (base + F.col("m.end")).alias("item_end"),
        F.coalesce(F.col("m.texts")[2], F.col("m.texts")[4], F.col("m.texts")[5]).alias("item"),
        F.col("m.texts")[0].alias("fullitem"), F.col("m.texts")[1].alias("prefix"),
    )
    second = F.col("m.texts")[3]
    definition = F.struct(
        (base + F.col("m.starts")[3]).alias("item_start"),
        (base + F.col("m.starts")[3] + F.length(second)).alias("item_end"),
        second.substr(F.lit(2), F.length(second)).alias("item"), second.alias("fullitem"), F.lit("").alias("prefix"),
    )
    both = F.when(second.isNull(), F.array(whole)).otherwise(F.array(whole, definition))
    return rows.select(*KEY, "start", "end", "pattern", "level", F.explode(both).alias("i")).select(
        *KEY, "start", "end", "pattern", "level", "i.*"
    )


def sublists(lists: DataFrame, item_span: bool = False, patterns=LIST_PATTERNS) -> DataFrame:
    """Lists one level deeper inside the given lists.

    With ``item_span`` the rows must carry ``item_start`` and ``item_end``; only lists
    inside that item are returned.
    """
    extra = ["item_start", "item_end"] if item_span else []
    runs = _list_runs(patterns, F.col("string"), F.col("mask"), patterns, F.col("pattern"))
    rows = exploded(lists.withColumn("list_start", F.col("start")), [*KEY, "list_start", *extra], runs, "l")
    found = rows.select(*KEY, "list_start", *extra, (F.col("list_start") + F.col("l.start")).alias("start"),
                        (F.col("list_start") + F.col("l.end")).alias("end"), "l.string", "l.mask", "l.pattern", "l.level")
    if item_span:
        found = found.where((F.col("item_start") <= F.col("start")) & (F.col("end") <= F.col("item_end")))
    return found


# --- X18, X19: tables ---------------------------------------------------------------

_ROW_BREAK = r"\|-([^\n]*)"


def tables(pages: DataFrame, recursive: bool = False) -> DataFrame:
    """Table blocks with caption, caption attributes and table attributes.

    Without ``recursive`` only tables outside other tables are returned.
    """
    found = texts(pages, ["Table", "InnerTable"] if recursive else ["Table"])
    return table_columns(found.withColumn("kind", F.lit("Table")))


def table_fields(t, caption_match: Column) -> dict[str, Column]:
    """Caption, its attributes and the table's attribute text; ``t`` gives a field of the scanned table by name."""
    line_end = F.instr(t("mask"), "\n")
    return {
        "caption": caption_match["texts"][2], "caption_attrs": caption_match["texts"][1],
        "caption_starts": caption_match["starts"],
        "attrs_string": cut(t("string"), F.lit(2), F.when(line_end > 0, line_end - 1).otherwise(F.length(t("string")))),
    }


def table_columns(found: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    matches = match_positions(CAPTION, F.col("string"), F.col("mask"))
    found = bound(found, found.columns, caption_match=F.try_element_at(matches, F.lit(1)))
    fields = table_fields(F.col, F.col("caption_match"))
    return found.select(
        *KEY, *keep, "kind", "start", "end", "string", "mask", *[v.alias(n) for n, v in fields.items()],
        attr_map(fields["attrs_string"]).alias("attrs"),
    )


def table_row_attrs(tables: DataFrame) -> DataFrame:
    """One row per row separator of each table, with its attributes."""
    found = match_positions(_ROW_BREAK, F.col("string"), F.col("mask"))
    rows = exploded(tables.withColumn("table_start", F.col("start")), [*KEY, "table_start"], found, "m", "row")
    return rows.select(
        *KEY, "table_start", "row", (F.col("table_start") + F.col("m.starts")[1]).alias("attrs_start"),
        (F.col("table_start") + F.col("m.end")).alias("attrs_end"), attr_map(F.col("m.texts")[1]).alias("attrs"),
    )


def cell_mask(mask: Column) -> Column:
    """In header cells !! separates like ||; mark it so that it is told from text."""
    return F.regexp_replace(mask, r"(\G(?!\A)|\n\s*!)((?:(?!\n\s*[|!])[\s\S])*?)!!", "$1$2\x05\x05")


def cell_pieces(matches: Column) -> Column:
    """Row breaks and cells among the matches of ``CELL``."""
    return F.filter(matches, lambda m: m["texts"][2].isNull())


def cell_spans(pieces: Column) -> Column:
    """array<struct<is_break,colspan,rowspan>> of row breaks and cells."""
    return F.transform(
        pieces,
        lambda m: F.struct(
            m["texts"][1].isNotNull().alias("is_break"),
            head_int(m["texts"][5], "colspan").alias("colspan"),
            head_int(m["texts"][5], "rowspan").alias("rowspan"),
        ),
    )


def _cell_pieces(tables: DataFrame, span: bool) -> DataFrame:
    """Row breaks and cells of each table as ``pieces`` and their layout as ``slots``."""
    found = match_positions(CELL, F.col("string"), cell_mask(F.col("mask")))
    rows = bound(tables, tables.columns, pieces=cell_pieces(found))
    return bound(rows, rows.columns, slots=table_layout(cell_spans(F.col("pieces")), span))


def cell_fields(m: Column, strip: bool = True) -> dict[str, Column]:
    """Value, attributes and places (inside the table) of a cell from its match."""
    header = (m["texts"][3] == "!") | m["texts"][4].eqNullSafe("!!")
    return {
        "value": cell_value(m["texts"], strip),
        "is_header": F.when(m.isNotNull(), F.coalesce(header, F.lit(False))),
        "attrs_string": m["texts"][5], "cell_start": m["start"], "attrs_start": m["starts"][5], "value_start": m["starts"][6],
        "value_end": m["end"], "mark_length": F.length(F.regexp_extract(m["mask"], r"^(?:\n\s*[|!]|\|?\x05\x05|\|\|)", 0)),
    }


def cell_value(texts: Column, strip: bool = True) -> Column:
    value = texts[6]
    return F.rtrim(F.ltrim(value), F.lit("\r\n\t ")) if strip else value


def table_cells(
    tables: DataFrame, span: bool = True, strip: bool = True, row: int | None = None, column: int | None = None
) -> DataFrame:
    """Row, col, value, is_header and attributes of every slot of every table."""
    tiles = F.col("slots")
    for name, size, wanted in (("row", "rows", row), ("col", "cols", column)):
        if wanted is not None:
            inside = F.filter(tiles, lambda t: (t[name] <= wanted) & (wanted < t[name] + t[size]))
            tiles = F.transform(inside, lambda t: t.withField(name, F.lit(wanted).cast("long")).withField(size, F.lit(1).cast("long")))
    # A tile takes its cell along, so that the list of cells is not copied per slot.
    filled = F.transform(tiles, lambda t: F.struct(t.alias("t"), F.get(F.col("pieces"), t["cell"].cast("int")).alias("m")))
    rows = _cell_pieces(tables, span).select(*KEY, F.col("start").alias("table_start"), F.explode(filled).alias("s"))
    rows = rows.select(*KEY, "table_start", "s.t.*", "s.m")
    rows = _slots(_slots(rows, "row", "rows"), "col", "cols").select(
        *KEY, "table_start", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "m")
    fields = cell_fields(F.col("m"), strip)
    places = ["cell_start", "attrs_start", "value_start", "value_end"]
    return rows.select(
        *KEY, "table_start", "row", "col", fields["value"].alias("value"), fields["is_header"].alias("is_header"),
        fields["attrs_string"].alias("attrs_string"), attr_map(fields["attrs_string"]).alias("attrs"),
        *[(F.col("table_start") + fields[n]).alias(n) for n in places], fields["mark_length"].alias("mark_length"),
    )


_AT_ONCE = 4096


def _slots(rows: DataFrame, name: str, size: str) -> DataFrame:
    """A row per row (column) of a tile, listed in parts, so that no array is as long as the tile."""
    first, n = F.col(name), F.col(size)
    parts = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(_AT_ONCE).cast("long"))))
    last = F.least(F.col("_part") + _AT_ONCE, n) - 1
    return parts.withColumn("_slot", F.explode(F.sequence(first + F.col("_part"), first + last))).withColumn(
        name, F.col("_slot")).drop("_part", "_slot")


def table_text(tables: DataFrame) -> DataFrame:
    """The rows of X18 with ``text``: caption line, then rows of tab-joined padded cells.

    The width of a text is its number of characters; the last column is not padded.
    """
    return tables.withColumn("text", table_texts("string", "mask"))


def head_int(attrs: Column, name: str) -> Column:
    """Leading integer of the last attribute of that name; 1 when there is none."""
    values = F.transform(F.filter(attr_pairs(attrs), lambda a: a["name"] == name), lambda a: a["value"])
    number = F.regexp_extract(F.try_element_at(values, F.lit(-1)), r"^\s*(\d+)", 1).try_cast("int")
    return F.when(attrs.contains(name), F.coalesce(number, F.lit(1))).otherwise(1)
