"""Column functions on text."""

from __future__ import annotations

import json
import re
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesmith.constants import NOWIKI_ESCAPES

WS = "\r\n\t "
_ATTRIBUTE = (
    r"([^\s\x00-\x1f\x7f-\x9f\"'>/=]+)"
    r"(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut(text, start: Column, end: Column) -> Column:
    """text[start:end] by zero-based code points."""
    return _col(text).substr(start + 1, end - start)


def trim_ws(c) -> Column:
    """Strip carriage returns, line feeds, tabs and blanks."""
    return F.btrim(_col(c), F.lit(WS))


def partition(c: Column, separator: str) -> tuple[Column, Column, Column]:
    """Head, whether the separator occurs, and tail, as Python's str.partition."""
    at = F.instr(c, separator)
    head = F.when(at > 0, c.substr(F.lit(1), at - 1)).otherwise(c)
    tail = F.when(at > 0, c.substr(at + len(separator), F.length(c))).when(at == 0, "")
    return head, at > 0, tail


def attr_pairs(text: Column) -> Column:
    """array<struct<name,value>> of attributes in order, duplicates kept.

    A leading ``<name`` is skipped; an attribute without value has the value "".
    """
    body = F.regexp_replace(text, r"^</?[^\s>/]+", "")
    groups = [F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(g)) for g in range(1, 5)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "nabc")])
    return F.transform(
        zipped, lambda z: F.struct(z["n"].alias("name"), F.concat(z["a"], z["b"], z["c"]).alias("value"))
    )


def bind(value: Column, fn) -> Column:
    """fn(value) with value evaluated once, however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def attr_map(text: Column) -> Column:
    """Map of attributes, empty without a text; the last duplicate wins."""

    def last_of_name(pairs: Column) -> Column:
        # Sorted by name and place, a pair is the last of its name when the next one has another name.
        ranked = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["name"].alias("name"), i.alias("i"), p["value"].alias("value"))))

        def chosen(rows: Column) -> Column:
            last = F.filter(rows, lambda r, i: ~F.coalesce(F.get(rows, i + 1)["name"] == r["name"], F.lit(False)))
            in_order = F.array_sort(F.transform(last, lambda r: F.struct(r["i"], r["name"], r["value"])))
            return F.transform(in_order, lambda r: F.struct(r["name"], r["value"]))

        return bind(ranked, chosen)

    nothing = F.array().cast("array<struct<name:string,value:string>>")
    return F.map_from_entries(F.when(F.length(text) > 0, bind(attr_pairs(text), last_of_name)).otherwise(nothing))


def normal_name(name, rm_namespaces=("Template",), code: str | None = None, capitalize: bool = False) -> Column:
    """Normal form of a template name.

    Comments, a language code, a namespace of the given list and an anchor are
    dropped; underscores become blanks; runs of white space become one blank.
    """

    def without_head(c: Column, heads) -> Column:
        words = "|".join(re.escape(h) for h in heads)
        return F.regexp_replace(c, rf"(?iu)^ *(?:{words}) *(?:: *|\z)", "")

    c = trim_ws(F.regexp_replace(_col(name), r"(?s)<!--.*?(?:-->|\z)", ""))
    if code:
        c = without_head(F.regexp_replace(c, "^: *", ""), [code])
    c = without_head(F.regexp_replace(c, "^: *", ""), rm_namespaces)
    c = F.replace(c, F.lit("_"), F.lit(" "))
    if capitalize:
        c = first_upper(c)
    return F.trim(F.regexp_replace(F.regexp_replace(c, "(?s)#.*", ""), r"(?U)\s+", " "))


def first_upper(c: Column) -> Column:
    """First letter in upper case, the rest unchanged."""
    return F.concat(F.upper(c.substr(1, 1)), c.substr(F.lit(2), F.length(c)))


def escape_nowiki(c) -> Column:
    """T5: the fifteen markup characters as entities, each character once."""
    # Entities hold no marked character but #, so # is replaced before any entity is there.
    order = sorted(NOWIKI_ESCAPES, key=lambda x: x != "#")
    return reduce(lambda acc, x: F.replace(acc, F.lit(x), F.lit(NOWIKI_ESCAPES[x])), order, _col(c))


def safe_filename(c) -> Column:
    """No double slash, and no dots when two of them meet."""
    c = F.replace(_col(c), F.lit("//"), F.lit("__slashslash__"))
    return F.when(F.contains(c, F.lit("..")), F.replace(c, F.lit("."), F.lit("__dot__"))).otherwise(c)


def codepoint_char(c) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(_col(c).cast("long")), 8, "0")), "UTF-32")


def unescape_basic(c) -> Column:
    """T4, the four basic entities: < > " and &, in one pass each, & last."""
    pairs = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")]
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, _col(c))


# What follows an ampersand in an entity: a number, or up to 32 characters of a name.
_ENTITY = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _names_by_length() -> Column:
    """Constant: for every length the names of that length (without &) and their texts."""
    longest = max(map(len, html5))
    return F.array(*[
        F.from_json(F.lit(json.dumps({n: t for n, t in html5.items() if len(n) == length})), "map<string,string>")
        for length in range(1, longest + 1)
    ])


def _number_text(entity: Column) -> Column:
    """Text of #123; or #x1F;, as browsers read it."""
    is_hex = entity.rlike("^#[xX]")
    digits = F.regexp_replace(F.regexp_replace(entity, "^#[xX]?0*", ""), ";", "")
    long_ = F.length(digits) > F.when(is_hex, 6).otherwise(7)
    given = F.when(digits == "", "0").otherwise(digits)
    value = F.when(is_hex, F.conv(given, 16, 10)).otherwise(F.conv(given, 10, 10))
    number = F.when(long_, F.lit(0x110000)).otherwise(value.cast("long"))
    windows = F.array(*[F.lit(bytes([b]).decode("cp1252", "ignore") or chr(b)) for b in range(0x80, 0xA0)])

    def text(n: Column) -> Column:
        control = n.between(1, 8) | (n == 0xB) | n.between(0xE, 0x1F) | (n == 0x7F)
        no_character = n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
            .when(n.between(0x80, 0x9F), F.get(windows, (n - 0x80).cast("int")))
            .when(control | no_character, "")
            .otherwise(codepoint_char(n))
        )

    return bind(number, text)


def unescape_entities(c) -> Column:
    """T4: entities to characters.

    A name is looked up at its whole length, then at ever shorter ones, so that an entity without its semicolon
    is found in front of other letters. Names of one length are one constant map.
    """
    c = _col(c)
    names = _names_by_length()

    def resolved(piece: Column) -> Column:
        """What stands behind an ampersand, with the ampersand."""

        def of(entity: Column) -> Column:
            lengths = F.when(F.length(entity) > 1, F.sequence(F.length(entity), F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))

            def of_length(n: Column) -> Column:
                name = F.left(entity, n)
                return F.struct(n.alias("n"), F.try_element_at(F.get(names, n - 1), name).alias("text"))

            # Stops at the first length that has the name.
            found = F.aggregate(
                lengths, F.lit(None).cast("struct<n:int,text:string>"),
                lambda best, n: F.when(best["text"].isNotNull(), best).otherwise(of_length(n)),
            )
            named = bind(found, lambda f: F.when(
                f["text"].isNotNull(), F.concat(f["text"], piece.substr(f["n"] + 1, F.length(piece)))).otherwise(F.concat(F.lit("&"), piece)))
            number = F.concat(_number_text(entity), piece.substr(F.length(entity) + 1, F.length(piece)))
            return F.when(entity.rlike("^#"), number).otherwise(named)

        return bind(F.regexp_extract(piece, _ENTITY, 1), of)

    pieces = F.split(c, "&")
    whole = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(resolved(p))), "")
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)
