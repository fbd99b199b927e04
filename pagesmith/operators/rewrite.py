"""Bulk rewrite jobs.

A job turns the elements of a page, an array in its row, into edits ``start, end, new`` and applies
them there: one read of the page table, no shuffle. ``where`` and new values are functions of an
element (a struct Column) or constants. They may also be Columns over element rows; the elements are
then exploded, and their edits meet the pages again in ``apply_edits``, as edits of a table do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesmith.functions.grids import CAPTION, CELL
from pagesmith.functions.scan import (
    MARKS, arguments_in, bound, exploded, match_each, match_in, match_positions, plain_layouts, scan_elements, splice,
)
from pagesmith.functions.text import attr_map, bind, trim_ws
from pagesmith.operators import extract
from pagesmith.operators.intervals import KEY, with_depth
from pagesmith.operators.joins import skew_join
from pagesmith.operators.lookup import redirect_targets

_EDITS = "array<struct<start:int,end:int,new:string>>"
# Rules that ride along as one constant; more of them are joined.
MAX_CONSTANT_RULES = 500


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _edit(start, end, new) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), _lit(new).alias("new"))


def _edits(rows: DataFrame, start: Column, end: Column, new) -> DataFrame:
    return rows.select(*KEY, start.alias("start"), end.alias("end"), _lit(new).alias("new"))


# --- R0, R16 ------------------------------------------------------------------------


def edited(rows: DataFrame, edits: Column, columns: list[str]) -> DataFrame:
    """R0 inside the row: ``columns`` with the edits applied to ``body``, and whether it changed.

    Edits are sorted by position; one that starts inside an earlier one is dropped. At one
    position insertions come before a replacement. Without a body there is nothing to edit.
    """
    ordered = F.array_sort(F.transform(
        F.coalesce(edits, F.array().cast(_EDITS)),
        lambda e: F.struct(e["start"], e["end"], e["new"], F.lit(False).alias("merge"))))
    made = bound(rows, columns, _edits=ordered).withColumn("new_body", splice("body", "_edits"))
    return made.select(
        *[F.col("new_body").alias("body") if c == "body" else F.col(c) for c in columns],
        (~F.col("new_body").eqNullSafe(F.col("body"))).alias("changed"),
    )


def apply_edits(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Pages with the edits of a table ``title, namespace_id, start, end, new``; see ``edited``."""
    by_page = edits.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end", "new")).alias("edits"))
    return edited(pages.join(by_page, KEY, "left"), F.col("edits"), pages.columns)


def _each(pages: DataFrame, found: DataFrame, where, edits: Callable, *values) -> DataFrame:
    """Pages with ``edits(element, values)`` of the chosen elements of ``found``, pages with ``elements``.

    ``element`` gives a field by name. Rows are exploded only where a Column over them is given.
    """
    given = [v for v in (where, *values) if isinstance(v, Column)]
    value = lambda v, e: None if v is None else v(e) if callable(v) and not isinstance(v, Column) else _lit(v)
    if not given:
        chosen = F.col("elements") if where is None else F.filter("elements", where)
        made = F.transform(chosen, lambda x: edits(lambda n: x[n], *[value(v, x) for v in values]).cast(_EDITS))
        return edited(found, F.flatten(made), pages.columns)
    rows = exploded(found, KEY, F.col("elements"), "x").select(*KEY, "x.*", "x")
    if where is not None:
        rows = rows.where(value(where, F.col("x")))
    made = edits(F.col, *[value(v, F.col("x")) for v in values]).cast(_EDITS)
    return apply_edits(pages, rows.select(*KEY, F.explode(made).alias("e")).select(*KEY, "e.*"))


def _scanned(pages: DataFrame, kinds: tuple[str, ...], fields: tuple[str, ...], mark: str, more: Callable) -> DataFrame:
    """Pages with ``elements`` of some kinds: kind, start, end, string and ``more(element)``.

    Bodies without the opening mark are not scanned.
    """
    body = F.when(F.col("body").contains(mark), F.col("body"))
    found = bound(pages, pages.columns, found=scan_elements(body, kinds, fields))
    elements = F.transform("found", lambda f: F.struct(
        f["kind"], f["start"], f["end"], f["string"], *[v.alias(n) for n, v in more(lambda n: f[n]).items()]))
    return found.select(*pages.columns, elements.alias("elements"))


def _clamped(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """One join: pages with the edits of the table, positions counted from the end when negative, else moved into the body."""
    by_page = rows.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end", "new")).alias("given"))

    def inside(c: Column) -> Column:
        n = F.length("body")
        return F.greatest(F.lit(0), F.least(F.when(c < 0, c + n).otherwise(c), n))

    moved = F.transform("given", lambda e: F.struct(
        inside(e["start"]).alias("start"), inside(e["end"]).alias("end"), e["new"].alias("new")))
    return pages.join(by_page, KEY, "left").withColumn("edits", moved)


def replace_span(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Replace ``start..end`` by ``new`` for rows of an edit table."""
    return edited(_clamped(pages, rows.select(*KEY, "start", "end", "new")), F.col("edits"), pages.columns)


def insert_at(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert ``new`` at ``index``."""
    return replace_span(pages, rows.select(*KEY, F.col("index").alias("start"), F.col("index").alias("end"), "new"))


def delete_span(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """Delete ``start..end``."""
    return replace_span(pages, rows.select(*KEY, "start", "end", F.lit("").alias("new")))


# --- R1-R6: templates ---------------------------------------------------------------


def rule_map(rules: DataFrame, key: str, value: Column) -> Column | None:
    """Rules as one constant map, or None where they are too many; of a repeated key the least value."""
    small = rules.groupBy(key).agg(F.min(value).alias("value")).limit(MAX_CONSTANT_RULES + 1).collect()
    if len(small) > MAX_CONSTANT_RULES:
        return None
    schema = rules.select(key, value.alias("value")).schema
    entries = rules.sparkSession.createDataFrame([tuple(r) for r in small], schema)
    return entries.agg(F.map_from_entries(F.collect_list(F.struct(*entries.columns)))).scalar()


def _owners(pages: DataFrame, kind: str) -> DataFrame:
    """Pages with their templates or functions."""
    return _scanned(pages, (kind,), ("string", "split", "closing"), "{{", lambda f: {"name": extract.name_of(f)})


def rename_template(pages: DataFrame, renames: DataFrame, kind: str = "Template") -> DataFrame:
    """New names for templates or functions from a table ``name, new``.

    Up to ``MAX_CONSTANT_RULES`` names are looked up in the row. Beyond, names meet the table in a
    join in which names of very many templates are spread over several copies of their rule.
    """

    def renamed(e, new):
        at = e("start") + 2
        return F.array(_edit(at, at + F.length(e("name")), new))

    owners = _owners(pages, kind)
    known = rule_map(renames, "name", F.col("new"))
    if known is not None:
        owners = owners.withColumn("rules", known)
        new = lambda e: F.try_element_at(F.col("rules"), trim_ws(e["name"]))
        return _each(pages, owners, lambda e: new(e).isNotNull(), renamed, new)
    rows = exploded(owners, KEY, F.col("elements"), "x").select(*KEY, "x.start", "x.name", trim_ws("x.name").alias("old"))
    table = renames.groupBy(F.col("name").alias("old")).agg(F.min("new").alias("new"))
    hits = skew_join(rows, table, ["old"], [*KEY, "start"])
    return apply_edits(pages, hits.select(*KEY, F.explode(renamed(F.col, F.col("new"))).alias("e")).select(*KEY, "e.*"))


def _arguments(pages: DataFrame) -> DataFrame:
    """Pages with the arguments of their templates as ``elements``, the fields of X8."""
    body = F.when(F.col("body").contains("{{"), F.col("body"))
    found = bound(pages, pages.columns, found=scan_elements(body, ("Template",), ("string", "mask", "split", "closing")))
    found = bound(found, found.columns, args=arguments_in(F.col("found")))

    def fields(owner, args):
        name = F.trim(extract.name_of(lambda n: owner[n]))
        return F.transform(args, lambda a: F.struct(
            owner["kind"].alias("kind"), owner["start"].alias("start"), owner["end"].alias("end"), name.alias("owner"),
            *[a[n].alias(n) for n in _ARGUMENT_FIELDS],
        ))

    elements = F.flatten(F.transform("args", lambda args, i: fields(F.get("found", i), args)))
    return found.select(*pages.columns, elements.alias("elements"))


_ARGUMENT_FIELDS = ("ord", "name", "value", "positional", "arg_start", "arg_end", "value_start", "arg_string", "is_last", "fate")


def _gone(e) -> Column:
    return F.array(_edit(e("arg_start"), e("arg_end"), ""))


def del_arg(pages: DataFrame, name: str, where=None) -> DataFrame:
    """Delete all arguments with that name."""

    def gone(e, *_):
        return F.when(trim_ws(e("name")) == name.strip(), _gone(e)).otherwise(F.array().cast(_EDITS))

    return _each(pages, _arguments(pages), where, gone)


def rm_first_of_dup_args(pages: DataFrame) -> DataFrame:
    """Of arguments that share a name keep the last."""
    return _each(pages, _arguments(pages), lambda e: ~e["is_last"], _gone)


def rm_dup_args_safe(pages: DataFrame, tag: str | None = None) -> DataFrame:
    """Drop duplicates that are empty or equal to a later one; tag those that stay.

    An empty last one makes way for the nearest filled one, which is then not compared
    with those before it.
    """

    def change(e):
        mark = F.array(_edit(e("arg_end"), e("arg_end"), tag or ""))
        return F.when(e("fate") == "drop", _gone(e)).otherwise(mark)

    wanted = ["drop", "tag"] if tag else ["drop"]
    return _each(pages, _arguments(pages), lambda e: e["fate"].isin(wanted), change)


def edit_args(pages: DataFrame, new_name=None, new_value=None, positional: bool | None = None, where=None) -> DataFrame:
    """Set name, value or the positional flag of arguments.

    A named positional argument becomes a keyword; making a positional argument a
    keyword without a name is an error.
    """

    def change(e, name, value):
        given, after_mark = [], e("arg_start") + 1
        if name is not None:
            given.append(_edit(after_mark, F.when(e("positional"), after_mark).otherwise(e("value_start") - 1),
                               F.when(e("positional"), F.concat(name, F.lit("="))).otherwise(name)))
        if positional is False and name is None:
            error = F.raise_error(F.lit("a positional argument needs a name to become a keyword")).cast("string")
            given.append(_edit(e("value_start"), e("value_start"), F.when(e("positional"), error).otherwise("")))
        if positional:
            given.append(_edit(after_mark, e("value_start"), ""))
        if value is not None:
            given.append(_edit(e("value_start"), e("arg_end"), value))
        return F.array(*given)

    return _each(pages, _arguments(pages), where, change, new_name, new_value)


def _mode(values: Column) -> Column:
    """Most common value of an array, the first one among ties: the longest run of the sorted values."""

    def of(ranked: Column) -> Column:
        first = F.filter(F.transform(ranked, lambda x, i: F.struct(
            i.alias("i"), (F.get(ranked, i - 1)["v"].eqNullSafe(x["v"]) & (i > 0)).alias("same"))), lambda x: ~x["same"])

        def longest(starts: Column) -> Column:
            runs = F.transform(starts, lambda s, j: F.struct(
                (F.coalesce(F.get(starts, j + 1)["i"], F.size(ranked)) - s["i"]).alias("n"),
                (-F.get(ranked, s["i"])["at"]).alias("at"), F.get(ranked, s["i"])["v"].alias("v")))
            return F.array_max(runs)["v"]

        return bind(first, longest)

    return bind(F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("at")))), of)


def set_arg(
    pages: DataFrame,
    rules: DataFrame,
    positional: bool | None = None,
    before: str | None = None,
    after: str | None = None,
    preserve_spacing: bool = False,
) -> DataFrame:
    """R2: set an argument of the templates named in a table ``owner, name, value``.

    The last match is updated. Where there is none, the argument is put before or after
    a named one, else at the end. ``preserve_spacing`` follows the most common spacing
    of the template's other arguments. Rules reach their templates as in ``rename_template``; several
    rules of one template apply in the order of name and value.
    """
    body = F.when(F.col("body").contains("{{"), F.col("body"))
    found = bound(pages, pages.columns, found=scan_elements(body, ("Template",), ("string", "mask", "split", "closing")))
    found = bound(found, found.columns, args=arguments_in(F.col("found")))
    owners = F.transform("found", lambda f, i: F.struct(
        f["start"].alias("start"), f["end"].alias("end"), f["string"].alias("string"),
        trim_ws(extract.name_of(lambda n: f[n])).alias("owner"), F.get("args", i).alias("args")))
    found = found.select(*pages.columns, owners.alias("elements"))
    edits = lambda owner, rule: _set_edits(owner, rule, positional, before, after, preserve_spacing)
    table = rules.groupBy("owner").agg(F.array_sort(F.collect_set(F.struct(F.trim("name").alias("arg"), "value"))).alias("rules"))
    known = rule_map(table, "owner", F.col("rules"))
    if known is not None:
        found = found.withColumn("by_owner", known)
        mine = lambda e: F.try_element_at(F.col("by_owner"), e["owner"])
        made = F.transform(F.filter("elements", lambda e: mine(e).isNotNull()),
                           lambda e: F.flatten(F.transform(mine(e), lambda rule: edits(e, rule))))
        return edited(found, F.flatten(made), pages.columns)
    rows = exploded(found, KEY, F.col("elements"), "e").select(*KEY, "e", F.col("e.start").alias("start"), F.col("e.owner").alias("owner"))
    hits = skew_join(rows, table, ["owner"], [*KEY, "start"]).select(*KEY, "e", F.explode("rules").alias("rule"))
    made = hits.select(*KEY, F.explode(edits(F.col("e"), F.col("rule"))).alias("x")).select(*KEY, "x.*")
    return apply_edits(pages, made)


def _set_edits(owner: Column, rule: Column, positional, before, after, preserve_spacing) -> Column:
    """R2: the edits of one rule on one template with its arguments."""
    arg, new = rule["arg"], rule["value"]

    def of(args: Column) -> Column:
        """``args``: the last one first."""

        def last_named(name):
            return F.try_element_at(F.filter(args, lambda a: trim_ws(a["name"]) == name), F.lit(1))

        # A new argument.
        as_positional = F.lit(bool(positional)) if positional is not None else arg == ""
        plain = F.when(as_positional, F.concat(F.lit("|"), new)).otherwise(F.concat(F.lit("|"), arg, F.lit("="), new))
        last = F.try_element_at(args, F.lit(1))
        end = owner["end"] - 2
        addition, add_start, add_end = plain, end, end
        if preserve_spacing:
            lead_ws = lambda c: F.regexp_extract(c, r"(?U)^\s*", 0)
            tail_ws = lambda c: F.regexp_extract(c, r"(?:\n[ \t]*+)*+\z", 0)
            names = F.transform(args, lambda a: a["name"])
            values = F.transform(args, lambda a: a["value"])
            tails = F.transform(values, tail_ws)
            before_pipe = F.array(F.regexp_extract(owner["string"], r"(?U)(\s*)\|", 1))
            post = _mode(F.concat(before_pipe, F.slice(tails, 2, F.greatest(F.size(args) - 1, F.lit(0)))))
            padded = F.concat(_mode(F.transform(names, lead_ws)), arg)
            width = F.greatest(_mode(F.transform(names, lambda n: F.length(n))), F.length(padded))
            spaced = F.concat(F.lit("|"), F.rpad(padded, width, F.lit(" ")), F.lit("="), _mode(F.transform(values, lead_ws)), new, post)
            use = (F.size(args) > 0) & ~as_positional
            if before is None and after is None:
                joined = F.concat(F.rtrim(last["arg_string"], F.lit("\r\n\t ")), post, F.rtrim(spaced, F.lit("\r\n\t ")), F.get(tails, F.lit(0)))
                addition = F.when(use, joined).otherwise(plain)
                add_start = F.when(use, last["arg_start"]).otherwise(end)
            else:
                addition = F.when(use, spaced).otherwise(plain)
        if before is not None:
            add_start = add_end = last_named(F.lit(before.strip()))["arg_start"]
        elif after is not None:
            add_start = add_end = last_named(F.lit(after.strip()))["arg_end"]
        added = F.filter(F.array(_edit(add_start, add_end, addition)), lambda e: e["start"].isNotNull())

        def on(hit: Column) -> Column:
            # Update of an existing argument.
            lead = F.length(F.regexp_extract(hit["value"], r"^[\r\n\t ]*", 0))
            core = F.length(trim_ws(hit["value"]))
            core_start = F.when(core == 0, hit["value_start"]).otherwise(hit["value_start"] + lead)
            if preserve_spacing:
                updates = [_edit(core_start, F.when(core == 0, core_start).otherwise(core_start + core), new)]
            else:
                updates = [_edit(hit["value_start"], hit["arg_end"], new)]
            if positional:
                updates.append(_edit(hit["arg_start"] + 1, hit["value_start"], ""))
            return F.when(hit.isNotNull(), F.array(*updates)).otherwise(added)

        return bind(last_named(arg), on)

    return bind(F.reverse(owner["args"]), of)


# --- R7, R8: links ------------------------------------------------------------------


def _links(pages: DataFrame) -> DataFrame:
    """Pages with their wikilinks, the fields of X11."""
    return _scanned(pages, ("WikiLink",), ("string", *MARKS), "[", extract.link_fields)


def edit_links(pages: DataFrame, part: str, new=None, where=None) -> DataFrame:
    """Set or (``new`` is None) delete target, title, fragment or text of wikilinks."""
    return _each(pages, _links(pages), where, lambda e, value: _link_edits(e, part, value), new)


def _link_edits(e, part: str, new) -> Column:
    base = e("start")
    head, title_end = base + e("open_len"), base + e("title_end")
    target_end, inner_end = base + e("target_end"), base + e("inner_end")
    no_text, no_fragment = e("text").isNull(), e("fragment").isNull()
    if part == "target":
        end = target_end if new is not None else F.when(no_text, target_end).otherwise(target_end + 1)
        return F.array(_edit(head, end, "" if new is None else new))
    if part == "title":
        end = title_end if new is not None else F.when(no_fragment, title_end).otherwise(title_end + 1)
        return F.array(_edit(head, end, "" if new is None else new))
    mark, missing, start, end = {
        "fragment": ("#", no_fragment, title_end, target_end),
        "text": ("|", no_text, target_end, inner_end),
    }[part]
    if new is None:
        return F.filter(F.array(_edit(start, end, "")), lambda x: ~missing)
    return F.array(_edit(start, F.when(missing, start).otherwise(end), F.concat(F.lit(mark), new)))


def _retargeted(pages: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """Titles of exploded links replaced by those of a table ``link_title, new``.

    Only place and title of a link meet the table, in a join that spreads hot titles; the body meets
    its page's edits once.
    """
    hits = skew_join(links, targets, ["link_title"], [*KEY, "start"])
    return apply_edits(pages, hits.select(*KEY, F.explode(_link_edits(F.col, "title", F.col("new"))).alias("e")).select(*KEY, "e.*"))


def _narrow_links(pages: DataFrame) -> DataFrame:
    return extract.wikilinks(pages).select(
        *KEY, "start", "open_len", "title_end", "target_end", "inner_end", "link_title", "fragment", "text")


def retarget_links(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """New titles for wikilinks from a table ``link_title, new``; of a repeated title the least new one."""
    once = targets.groupBy("link_title").agg(F.min("new").alias("new"))
    return _retargeted(pages, _narrow_links(pages), once)


def fix_redirect_links(pages: DataFrame, unresolved: bool = False) -> DataFrame:
    """R7 with J5: links to a redirect point to the page it resolves to.

    Titles are looked up as J1 does (underscores are blanks, ``Main:`` goes), in any namespace. A link to
    a missing page stays as it is, as does one whose target is no redirect. One to a redirect without target
    page or to a double redirect does too; with ``unresolved`` it moves one hop, to the title the redirect names.
    Each distinct title is looked up once.
    """
    links = _narrow_links(pages)
    titles = links.select("link_title").distinct()
    return _retargeted(pages, links, redirect_targets(titles, pages, unresolved))


def edit_external_links(pages: DataFrame, url=None, text=None, delete_text: bool = False, where=None) -> DataFrame:
    """Set the url, set the text (adds brackets) or delete the text of external links."""
    body = F.when(F.col("body").rlike("(?i):|//"), F.col("body"))
    found = bound(pages, pages.columns, found=scan_elements(body, extract.LINKABLE))
    found = bound(found, pages.columns, links=match_in(extract._LINK_URL, extract.link_items(F.col("found"))))
    found = found.select(*pages.columns, F.transform("links", lambda m: F.struct(
        *[v.alias(n) for n, v in extract.external_fields(m).items()])).alias("elements"))

    def change(e, new_url, new_text):
        start, end, bracketed = e("start"), e("end"), e("in_brackets")
        size = F.length(e("text"))
        has_text = bracketed & F.coalesce(size > 0, F.lit(False))
        parts = []
        if new_url is not None:
            at = start + bracketed.cast("int")
            parts.append(F.array(_edit(at, at + F.length(e("url")), new_url)))
        if new_text is not None:
            parts.append(
                F.when(has_text, F.array(_edit(end - 1 - size, end - 1, new_text)))
                .when(bracketed, F.array(_edit(end - 1, end - 1, F.concat(F.lit(" "), new_text))))
                .otherwise(F.array(_edit(start, start, "["), _edit(end, end, F.concat(F.lit(" "), new_text, F.lit("]")))))
            )
        if delete_text:
            parts.append(F.filter(F.array(_edit(end - 2 - size, end - 1, "")), lambda x: has_text))
        return F.concat(*parts)

    return _each(pages, found, where, change, url, text)


# --- R9, R10: sections and lists ----------------------------------------------------


def _section_titles(pages: DataFrame) -> DataFrame:
    """Pages with their heading lines, the fields of X13."""
    rest = [c for c in pages.columns if c not in (*KEY, "body")]
    found = bound(extract.with_shadow(pages, *rest), pages.columns, lines=match_positions(extract._HEADING, F.col("body"), F.col("shadow")))
    return found.withColumn("elements", F.transform("lines", lambda m: F.struct(
        *[v.alias(n) for n, v in extract.heading_fields(m).items()])))


def edit_section_titles(pages: DataFrame, level=None, title=None, drop: bool = False, where=None) -> DataFrame:
    """New level, new title, or no title line. Both runs of equal signs change."""

    def change(e, new_level, new_title):
        start, width = e("start"), e("level")
        title_end = start + width + F.length(e("section_title"))
        if drop:
            return F.array(_edit(start, e("end") + 1, ""))
        parts = []
        if new_level is not None:
            run = F.repeat(F.lit("="), new_level.cast("int"))
            parts += [_edit(start, start + width, run), _edit(title_end, title_end + width, run)]
        if new_title is not None:
            parts.append(_edit(start + width, title_end, new_title))
        return F.array(*parts)

    return _each(pages, _section_titles(pages), where, change, level, title)


def _sections(pages: DataFrame, nested: bool) -> DataFrame:
    rest = tuple(c for c in pages.columns if c not in (*KEY, "body"))
    return extract.section_array(pages, nested, rest).withColumnRenamed("sections", "elements")


def set_section_contents(pages: DataFrame, contents, where, include_subsections: bool = False) -> DataFrame:
    """New contents of the chosen sections, lead included."""

    def change(e, new):
        return F.array(_edit(e("end") - F.length(e("contents")), e("end"), new))

    return _each(pages, _sections(pages, include_subsections), where, change, contents)


def set_section_title(pages: DataFrame, title, where) -> DataFrame:
    """New title of the chosen sections; choosing a lead is an error."""

    def change(e, new):
        error = F.raise_error(F.lit("a lead section has no title")).cast("string")
        at = e("start") + e("level")
        return F.array(_edit(at, at + F.length(e("section_title")), F.when(e("level") == 0, error).otherwise(new)))

    return _each(pages, _sections(pages, False), where, change, title)


def convert_lists(pages: DataFrame, pattern: str, new_start: str) -> DataFrame:
    """Another prefix for the lists of one pattern."""
    rest = [c for c in pages.columns if c not in (*KEY, "body")]
    found = bound(extract.with_shadow(pages, *rest), pages.columns, lists=extract._list_runs((pattern,), F.col("body"), F.col("shadow")))
    items = F.transform("lists", lambda r: F.struct(r["start"].alias("base"), r["string"].alias("text"), r["mask"].alias("mask")))
    found = bound(found, pages.columns, elements=match_in(extract.item_patterns((pattern,)), items))

    def change(m):
        return F.array(_edit(m("start"), m("start") + F.length(m("texts")[1]), new_start))

    return _each(pages, found, lambda m: m["texts"][1] != "", change)


# --- R11-R13: tags, attributes, tables ----------------------------------------------


def _tags(pages: DataFrame, name: str) -> DataFrame:
    """Pages with their tags of one name, the fields of X3 but for attributes."""
    found = _scanned(pages, ("ExtensionTag", "Tag"), ("string",), "<", lambda e: extract.tag_fields(e("string")))
    return found.withColumn("elements", F.filter("elements", lambda e: e["name"] == name))


def rewrite_tags(pages: DataFrame, name: str, new_name: str | None = None, contents=None) -> DataFrame:
    """Rename both ends, or set the contents; a tag without contents is expanded."""

    def change(e, new):
        start, end = e("start"), e("end")
        bare = e("contents").isNull()
        parts = []
        if new_name is not None:
            parts.append(F.array(_edit(start + 1, start + 1 + F.length(e("name")), new_name)))
            closing = end - F.length(e("end_tag")) + 2
            parts.append(F.filter(F.array(_edit(closing, closing + F.length(e("name")), new_name)), lambda x: ~bare))
        if new is not None:
            mark = F.length(F.regexp_extract(e("start_tag"), r"\s*/?\s*>\z", 0))
            closed = F.concat(F.lit(">"), new, F.lit("</"), F.lit(new_name or name), F.lit(">"))
            parts.append(
                F.when(bare, F.array(_edit(end - mark, end, closed))).otherwise(
                    F.array(_edit(start + F.length(e("start_tag")), end - F.length(e("end_tag")), new))
                )
            )
        return F.concat(*parts)

    return _each(pages, _tags(pages, name), None, change, contents)


_ATTR = r"\s*([^\s\x00-\x1f\x7f-\x9f\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?"


def _with_attrs(found: DataFrame, text: Callable, base: Callable, attr: str) -> DataFrame:
    """Elements with ``attr_text``, ``attr_base`` and the matches ``of_name`` of one attribute in that text."""
    items = F.transform("elements", lambda e: F.struct(base(e).alias("base"), text(e).alias("text"), text(e).alias("mask")))
    found = bound(found, found.columns, items=items)
    matched = bound(found, found.columns, matches=match_each(_ATTR, "items"))
    return matched.withColumn("elements", F.transform("elements", lambda e, i: e.withField(
        "of_name", F.filter(F.get("matches", i), lambda m: m["texts"][1] == attr))))


def _attr_change(e, insert_at: Column, attr: str, value: str | None, fresh: Column | None = None) -> Column:
    """Edits that set one attribute in an attribute text, or delete it when value is None."""
    if value is None:
        return F.transform(e("of_name"), lambda m: _edit(m["start"], m["end"], ""))
    last = F.try_element_at(e("of_name"), F.lit(-1))
    fresh = F.lit(f' {attr}="{value}"' if value else f" {attr}") if fresh is None else fresh
    return F.array(F.when(last.isNotNull(), _edit(last["starts"][1], last["end"], f'{attr}="{value}"')).otherwise(
        _edit(insert_at, insert_at, fresh)))


def set_tag_attr(pages: DataFrame, tag: str, attr: str, value: str | None) -> DataFrame:
    """Set (an empty value gives a bare name) or delete an attribute of tags."""
    opening = lambda e: F.length(e["name"]) + 1
    found = _with_attrs(
        _tags(pages, tag), lambda e: e["start_tag"].substr(opening(e) + 1, F.length(e["start_tag"])),
        lambda e: e["start"] + opening(e), attr)

    def change(e):
        closing = F.length(F.regexp_extract(e("start_tag"), r"\s*/?\s*>\z", 0))
        return _attr_change(e, e("start") + F.length(e("start_tag")) - closing, attr, value)

    return _each(pages, found, None, change)


def _tables(pages: DataFrame) -> DataFrame:
    """Pages with all their tables, the fields of X18 but for attribute maps."""
    body = F.when(F.col("body").contains("{|"), F.col("body"))
    found = bound(pages, pages.columns, found=scan_elements(body, ("Table", "InnerTable")))
    items = F.transform("found", lambda t: F.struct(F.lit(0).alias("base"), t["string"].alias("text"), t["mask"].alias("mask")))
    found = bound(found, found.columns, captions=match_each(CAPTION, items))

    def fields(t, caption):
        more = extract.table_fields(lambda n: t[n], caption)
        return F.struct(t["kind"], t["start"], t["end"], t["string"], t["mask"], *[v.alias(n) for n, v in more.items()])

    elements = F.transform("found", lambda t, i: fields(t, F.try_element_at(F.get("captions", i), F.lit(1))))
    return found.select(*pages.columns, elements.alias("elements"))


def set_table_attr(pages: DataFrame, attr: str, value: str | None) -> DataFrame:
    """Set or delete an attribute of tables."""
    found = _with_attrs(_tables(pages), lambda e: e["attrs_string"], lambda e: e["start"] + 2, attr)
    end = lambda e: e("start") + 2 + F.length(e("attrs_string"))
    return _each(pages, found, None, lambda e: _attr_change(e, end(e), attr, value))


def _cells(pages: DataFrame) -> DataFrame:
    """Pages with the cells of all their tables, the fields of X19 without spans; places are page offsets."""
    found = _tables(pages)
    found = bound(found, pages.columns, tables=F.col("elements"))
    items = F.transform("tables", lambda t: F.struct(
        t["start"].alias("base"), t["string"].alias("text"), extract.cell_mask(t["mask"]).alias("mask")))
    found = bound(found, found.columns, matches=match_each(CELL, items))
    found = bound(found, [*pages.columns, "tables"], pieces=F.transform("matches", extract.cell_pieces))
    found = bound(found, found.columns, spans=F.transform("pieces", extract.cell_spans))
    found = bound(found, found.columns, layouts=plain_layouts("spans"))

    def cell(start, tile, m):
        return F.struct(
            start.alias("table_start"), tile["row"].cast("int").alias("row"), tile["col"].cast("int").alias("col"),
            *[v.alias(n) for n, v in extract.cell_fields(m).items()], attr_map(m["texts"][5]).alias("attrs"))

    elements = F.flatten(F.transform("layouts", lambda tiles, i: F.transform(
        tiles, lambda t: cell(F.get("tables", i)["start"], t, F.get(F.get("pieces", i), t["cell"].cast("int"))))))
    return found.select(*pages.columns, elements.alias("elements"))


def set_cell_attr(pages: DataFrame, attr: str, value: str | None, where=None) -> DataFrame:
    """Set or delete an attribute of cells; a first attribute brings its pipe."""
    found = _with_attrs(_cells(pages), lambda e: F.coalesce(e["attrs_string"], F.lit("")), lambda e: F.coalesce(e["attrs_start"], F.lit(0)), attr)

    def change(e):
        if value is None:
            return _attr_change(e, e("cell_start"), attr, None)
        given = e("attrs_string").isNotNull()
        after_mark = e("cell_start") + e("mark_length")
        at = F.when(given, e("attrs_start") + F.length(e("attrs_string"))).otherwise(after_mark)
        spaced = F.when(e("attrs_string").endswith(" "), f'{attr}="{value}" ').otherwise(f' {attr}="{value}"')
        fresh = F.when(given, spaced).otherwise(f' {attr}="{value}" |' if value else f" {attr} |")
        return _attr_change(e, at, attr, value, fresh)

    return _each(pages, found, where, change)


def set_cell(pages: DataFrame, value, where) -> DataFrame:
    """New value of the chosen cells (row and col do not count spans)."""
    return _each(pages, _cells(pages), where, lambda e, new: F.array(_edit(e("value_start"), e("value_end"), new)), value)


def _after_first_line(e) -> Column:
    return e("start") + F.instr(e("mask"), "\n")


def set_caption(pages: DataFrame, caption) -> DataFrame:
    """New caption; a table without one gets it after its first line."""

    def change(e, new):
        none, at = e("caption").isNull(), e("start") + e("caption_starts")[2]
        return F.array(_edit(
            F.when(none, _after_first_line(e)).otherwise(at),
            F.when(none, _after_first_line(e)).otherwise(at + F.length(e("caption"))),
            F.when(none, F.concat(F.lit("|+"), new, F.lit("\n"))).otherwise(new)))

    return _each(pages, _tables(pages), None, change, caption)


def set_caption_attrs(pages: DataFrame, attrs) -> DataFrame:
    """New caption attributes. A caption without attributes stays as it is."""

    def change(e, new):
        none, at = e("caption").isNull(), e("start") + e("caption_starts")[1]
        return F.array(_edit(
            F.when(none, _after_first_line(e)).otherwise(at),
            F.when(none, _after_first_line(e)).otherwise(at + F.length(e("caption_attrs"))),
            F.when(none, F.concat(F.lit("|+"), new, F.lit("|\n"))).otherwise(new)))

    return _each(pages, _tables(pages), lambda e: e["caption"].isNull() | e["caption_attrs"].isNotNull(), change, attrs)


def set_row_attrs(pages: DataFrame, attrs: dict[str, str], where=None) -> DataFrame:
    """Attributes of row separators; existing ones are replaced."""
    new = "".join(f' {k}="{v}"' if v else f" {k}" for k, v in attrs.items())
    found = _tables(pages)
    found = bound(found, pages.columns, tables=F.col("elements"))
    items = F.transform("tables", lambda t: F.struct(t["start"].alias("base"), t["string"].alias("text"), t["mask"].alias("mask")))
    found = bound(found, found.columns, matches=match_each(extract._ROW_BREAK, items))
    elements = F.flatten(F.transform("matches", lambda rows, i: F.transform(rows, lambda m, j: F.struct(
        F.get("tables", i)["start"].alias("table_start"), j.alias("row"), m["starts"][1].alias("attrs_start"),
        m["end"].alias("attrs_end"), attr_map(m["texts"][1]).alias("attrs")))))
    found = found.select(*pages.columns, elements.alias("elements"))
    return _each(pages, found, where, lambda e: F.array(_edit(e("attrs_start"), e("attrs_end"), new)))


# --- R14, R15: parameters and comments ----------------------------------------------


def edit_parameters(pages: DataFrame, name=None, default=None, delete_default: bool = False, where=None) -> DataFrame:
    """Rename parameters, set or delete their default."""

    def change(e, new_name, new_default):
        start, inner_end = e("start"), e("end") - 3
        name_end = start + 3 + F.length(e("name"))
        parts = []
        if new_name is not None:
            parts.append(_edit(start + 3, name_end, new_name))
        if new_default is not None:
            parts.append(_edit(name_end, inner_end, F.concat(F.lit("|"), new_default)))
        if delete_default:
            parts.append(_edit(name_end, inner_end, ""))
        return F.array(*parts)

    found = _scanned(pages, ("Parameter",), ("string", "split", "closing"), "{{{", extract.parameter_fields)
    return _each(pages, found, where, change, name, default)


def append_default(pages: DataFrame, new_name: str, where: Column | None = None) -> DataFrame:
    """A further default for the innermost of parameters that default to one another.

    Nothing changes where the chain already has that name. ``where`` looks at the
    outermost parameter of a chain (columns name, default, start, end).
    """
    params = with_depth(extract.parameters(pages).drop("kind"))
    default_start = F.col("end") - 3 - F.length("default")
    parents = params.select(*KEY, default_start.alias("start"), (F.col("end") - 3).alias("end"), F.lit(True).alias("is_default"))
    # Along a chain the end falls by three per level, so this sum is the same.
    params = params.join(parents.where(F.col("start").isNotNull()), [*KEY, "start", "end"], "left").withColumn(
        "line", F.col("end") + 3 * F.col("depth")
    )
    order = Window.partitionBy(*KEY, "line").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    params = params.withColumn("chain", F.count(F.when(F.col("is_default").isNull(), 1)).over(order))
    fields = F.struct("start", "end", "name", "default")
    chains = params.groupBy(*KEY, "line", "chain").agg(
        F.min_by(fields, "start").alias("outer"), F.max_by(fields, "start").alias("inner"),
        F.max(trim_ws("name") == new_name.strip()).alias("known"),
    ).where(~F.col("known"))
    if where is not None:
        chains = chains.select("*", "outer.name", "outer.default", "outer.start", "outer.end").where(where).select(*KEY, "inner")
    end = F.col("inner.end") - 3
    default = F.col("inner.default")
    start = F.when(default.isNull(), end).otherwise(end - F.length(default))
    new = F.when(default.isNull(), F.lit("|{{{" + new_name + "}}}")).otherwise(
        F.concat(F.lit("{{{" + new_name + "|"), default, F.lit("}}}"))
    )
    return apply_edits(pages, _edits(chains, start, end, new))


def strip_comments(pages: DataFrame, blank_only: bool = False) -> DataFrame:
    """Without comments, or without blank ones."""
    found = _scanned(pages, ("Comment",), ("string",), "<!--", lambda e: {"contents": extract.comment_contents(e("string"))})
    blank = (lambda e: trim_ws(e["contents"]) == "") if blank_only else None
    return _each(pages, found, blank, lambda e: F.array(_edit(e("start"), e("end"), "")))
