"""Arrow helpers for what Spark SQL functions cannot express on one string.

* ``scan_elements``  - the elements of one page body (``brackets.scan_page``) as an array.
* ``match_positions``, ``match_in`` - regex matches *with offsets*, cut from a second string.
* ``arguments_in``   - arguments of templates and functions, numbered and told from duplicates.
* ``sections_of``, ``segments_of`` - sections and top-level pieces of one page.
* ``splice``, ``splice_parts``, ``cut_spans`` - cut or replace many spans of one string.
* ``table_layout``   - slots of the cells of one table.
* ``quotes_in``      - apostrophe balancing of bold and italic, line by line.

All offsets are code points, as in Spark's ``length`` and ``substring``. Spark
partitions and shuffles the pages; a helper only ever sees one page's text. Spark hands over
up to 10,000 pages at once, of which ``SLICE`` bytes at a time become Python objects; what is as
long as the text is handed back slice by slice. All are deterministic, so filters on other columns pass below them to the scan of the table;
``bound`` keeps what several expressions use a column of its own.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesmith.functions import brackets, grids
from pagesmith.functions.brackets import KINDS, scan_marked, scan_page  # noqa: F401
from pagesmith.functions.grids import table_layout_of, table_rectangles, table_text_of  # noqa: F401

# Ship the helper code inside the UDFs, so executors need no extra files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(brackets)
cloudpickle.register_pickle_by_value(grids)


def bound(rows, keep, **made):
    """``keep`` and the made columns, each computed once, wherever it is used.

    The optimizer merges projections, and an expression that is put into the call of a Python function is
    computed for it alone. A generator of one row stands between: filters on the kept columns pass it, and
    columns nobody reads are dropped.
    """
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))


def exploded(rows, keep, array, name, position=None):
    """A row per element of an array that is made once: explode alone would test its size by making it again."""
    made = bound(rows, keep, _array=array)
    each = F.explode("_array").alias(name) if position is None else F.posexplode("_array").alias(position, name)
    return made.select(*keep, each)


def _structs(**fields):
    return T.ArrayType(T.StructType([T.StructField(k, t()) for k, t in fields.items()]))


# Arrow bytes that become Python objects at a time; these take many times as much.
SLICE = 1 << 20


def slices(arrays: Sequence[pa.Array]) -> Iterator[list[pa.Array]]:
    """Rows of arrays of equal length, about SLICE bytes at a time; of no rows one empty slice."""
    rows = len(arrays[0])
    step = max(1, rows * SLICE // max(1, sum(a.nbytes for a in arrays)))
    for at in range(0, max(1, rows), step):
        yield [a.slice(at, step) for a in arrays]


def sliced(made: Callable) -> Callable:
    """A function of arrays that sees a slice at a time."""

    @wraps(made)
    def run(*arrays):
        return pa.concat_arrays([made(*part) for part in slices(arrays)])

    return run


def streamed(type_: T.DataType, made: Callable) -> Callable:
    """Arrow UDF of a function of arrays that sees a slice at a time and gives its result back at once."""

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices([batch]):
                yield made(*part)

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                yield made(*part)

    return lambda *columns: F.arrow_udf(one if len(columns) == 1 else several, type_)(*columns)


MARKS = ("opening", "split", "anchor", "closing")
_SPAN_TYPES = {"string": T.StringType, "mask": T.StringType} | dict.fromkeys(MARKS, T.IntegerType)
QUOTES_TYPE = _structs(kind=T.StringType, start=T.IntegerType, end=T.IntegerType, string=T.StringType, text=T.StringType)
MATCHES_TYPE = _structs(
    start=T.IntegerType,
    end=T.IntegerType,
    texts=lambda: T.ArrayType(T.StringType()),
    starts=lambda: T.ArrayType(T.IntegerType()),
    mask=T.StringType,
    which=T.IntegerType,
    item=T.IntegerType,
)
LAYOUT_TYPE = _structs(**dict.fromkeys(("row", "rows", "col", "cols", "cell"), T.LongType))


def _nested(counts, names, columns):
    """ListArray of structs from flat columns and the number of structs per row."""
    return _lists(counts, pa.StructArray.from_arrays(columns, names))


def scan_elements(
    body, kinds: Sequence[str] = KINDS, fields: Sequence[str] = ("string", "mask"), masked: Sequence[str] | None = None
):
    """array<struct<kind,start,end,...>>: the elements of these kinds, the page first, then by start.

    ``fields``: ``string``; ``mask``, see ``brackets``; and the offsets of ``MARKS`` inside parameters, functions,
    templates and links (-1 where there is none). Only what is asked for is made; with ``masked`` only these kinds
    have their mask.
    """
    kinds, fields = tuple(kinds), tuple(fields)
    types = {"kind": T.StringType, "start": T.IntegerType, "end": T.IntegerType} | {f: _SPAN_TYPES[f] for f in fields}
    masked = () if "mask" not in fields else kinds if masked is None else tuple(masked)

    def run(body: pa.Array) -> pa.Array:
        counts, columns = [], {name: [] for name in types}
        for text in body.to_pylist():
            spans = scan_marked(text, kinds, masked) if text is not None else []
            counts.append(len(spans))
            for kind, s, e, mask, marks in spans:
                columns["kind"].append(kind)
                columns["start"].append(s)
                columns["end"].append(e)
                for name in fields:
                    if name == "string":
                        value = text[s:e]
                    elif name == "mask":
                        value = None if mask is None else mask.decode("ascii")
                    else:
                        value = marks[MARKS.index(name)] if marks else -1
                    columns[name].append(value)
        arrays = [pa.array(v, pa.string() if types[n] is T.StringType else pa.int32()) for n, v in columns.items()]
        return _nested(counts, list(columns), arrays)

    return streamed(_structs(**types), run)(body)


def _find(compiled, rows, groups, each=False) -> pa.Array:
    """Matches per row; a row is a list of (offset of the text, text, mask). With ``each`` a list per text."""
    counts, starts, ends, texts, positions, masks, which, items, per_item = [], [], [], [], [], [], [], [], []
    for row in rows:
        before = len(starts)
        for item, (base, full, masked) in enumerate(row):
            inside = len(starts)
            for number, pattern in enumerate(compiled) if full is not None and masked is not None else ():
                for m in pattern.finditer(masked):
                    spans = m.regs if groups else m.regs[:1]
                    starts.append(base + spans[0][0])
                    ends.append(base + spans[0][1])
                    texts.append([full[s:e] if s >= 0 else None for s, e in spans] if groups else None)
                    positions.append([base + s if s >= 0 else None for s, _ in spans] if groups else None)
                    masks.append(m[0] if groups else None)
                    which.append(number)
                    items.append(item)
            per_item.append(len(starts) - inside)
        counts.append(len(row) if each else len(starts) - before)
    found = _nested(
        per_item if each else counts,
        ["start", "end", "texts", "starts", "mask", "which", "item"],
        [
            pa.array(starts, pa.int32()), pa.array(ends, pa.int32()),
            pa.array(texts, pa.list_(pa.string())), pa.array(positions, pa.list_(pa.int32())),
            pa.array(masks, pa.string()), pa.array(which, pa.int32()), pa.array(items, pa.int32()),
        ],
    )
    return _lists(counts, found) if each else found


def _lists(counts, values) -> pa.Array:
    """ListArray of so many values per row."""
    offsets = [0]
    for n in counts:
        offsets.append(offsets[-1] + n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _rows_of(items: pa.Array):
    """Lists of (offset, text, mask) from array<struct<base,text,mask>>."""
    flat = items.flatten()
    triples = zip(*[flat.field(i).to_pylist() for i in range(3)])
    return [[next(triples) for _ in range(n or 0)] for n in items.value_lengths().to_pylist()]


def _compile(patterns):
    return [re.compile(p) for p in ([patterns] if isinstance(patterns, str) else patterns)]


def match_positions(patterns, text, mask=None, groups: bool = True):
    """array<struct<start,end,texts,starts,mask,which,item>>: matches in mask, cut from text.

    Index 0 of ``texts`` is the whole match; a group that took no part is null. Start
    positions are code points. Patterns are Python ``re`` syntax; of a list each one is
    searched by itself and ``which`` is its index. Without ``groups`` texts, starts and mask are null.
    """
    compiled = _compile(patterns)

    @F.arrow_udf(MATCHES_TYPE)
    @sliced
    def run(text: pa.Array, mask: pa.Array) -> pa.Array:
        return _find(compiled, [[(0, t, m)] for t, m in zip(text.to_pylist(), mask.to_pylist())], groups)

    return run(text, text if mask is None else mask)


def match_in(patterns, items, groups: bool = True):
    """As ``match_positions``, over all texts of an array<struct<base,text,mask>>.

    Positions are moved by ``base``, the place of the text in its page; ``item`` is its index.
    """
    compiled = _compile(patterns)

    @F.arrow_udf(MATCHES_TYPE)
    @sliced
    def run(items: pa.Array) -> pa.Array:
        return _find(compiled, _rows_of(items), groups)

    return run(items)


def match_each(patterns, items):
    """As ``match_in``, with an array of matches for every text of the array."""
    compiled = _compile(patterns)

    @F.arrow_udf(T.ArrayType(MATCHES_TYPE))
    @sliced
    def run(items: pa.Array) -> pa.Array:
        return _find(compiled, _rows_of(items), True, True)

    return run(items)


_ARGUMENT = re.compile(r"\|(?:((?:(?:(?m:^={1,6}[^\n|]+?={1,6}[ \t]*\n)|[^|=])*+))=)?([^|]*)")
_NAME_END = re.compile(r"[^:|]*:")
_WHITE = "\r\n\t "
ARGUMENTS_TYPE = _structs(
    ord=T.IntegerType, name=T.StringType, value=T.StringType, positional=T.BooleanType,
    arg_start=T.IntegerType, arg_end=T.IntegerType, value_start=T.IntegerType, arg_string=T.StringType,
    is_last=T.BooleanType, fate=T.StringType,
)


def arguments_of(base, text, mask, is_function):
    """Arguments of one template or function given by its place, text and mask, braces included.

    Unnamed ones are 1, 2, ... counting only earlier unnamed ones. ``is_last``: no later argument has the
    trimmed name. ``fate``: what a careful removal of duplicates does: ``drop`` one that is empty or equal to a
    later one, ``tag`` one that stays beside a later one, else null. An empty last one makes way for the nearest
    filled one, which is then not compared with those before it.
    """
    inner = mask[2:-2]
    if is_function and (m := _NAME_END.match(inner)):
        inner = inner[:m.end() - 1] + "|" + inner[m.end():]
    out, unnamed, by_name = [], 0, {}
    for ord_, m in enumerate(_ARGUMENT.finditer(inner)):
        (s, e), name, (vs, ve) = m.span(), m.span(1), m.span(2)
        positional = name[0] < 0
        unnamed += positional
        given = str(unnamed) if positional else text[2 + name[0]:2 + name[1]]
        value = text[2 + vs:2 + ve]
        out.append([ord_, given, value, positional, base + 2 + s, base + 2 + e, base + 2 + vs, text[2 + s:2 + e], True, None])
        by_name.setdefault(given.strip(_WHITE), []).append((ord_, value if positional else value.strip(_WHITE)))
    for same in by_name.values():
        for ord_, _ in same[:-1]:
            out[ord_][8] = False
        last, last_value = same[-1]
        seen, moved = set(), False
        if last_value:
            seen.add(last_value)
        elif any(v for _, v in same):
            out[last][9] = "drop"
        for ord_, value in reversed(same[:-1]):
            if not value or value in seen:
                out[ord_][9] = "drop"
            elif not last_value and not moved:
                moved = True
            else:
                seen.add(value)
                out[ord_][9] = "tag"
    return out


@F.arrow_udf(T.ArrayType(ARGUMENTS_TYPE))
@sliced
def _arguments_in(owners: pa.Array) -> pa.Array:
    per_owner, rows = [], []
    flat = owners.flatten()
    for owner in zip(*[flat.field(i).to_pylist() for i in range(4)]):
        found = arguments_of(*owner)
        rows += found
        per_owner.append(len(found))
    types = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
    names = [f.name for f in ARGUMENTS_TYPE.elementType]
    inner = _nested(per_owner, names, [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)])
    return _lists([n or 0 for n in owners.value_lengths().to_pylist()], inner)


def arguments_in(owners):
    """Arguments of all templates and functions of an array, an array for each."""
    return _arguments_in(F.transform(owners, lambda o: F.struct(
        o["start"].alias("base"), o["string"].alias("text"), o["mask"].alias("mask"), (o["kind"] == "ParserFunction").alias("is_function"))))


SECTIONS_TYPE = _structs(
    ord=T.IntegerType, start=T.IntegerType, end=T.IntegerType, level=T.IntegerType,
    section_title=T.StringType, contents=T.StringType, depth=T.IntegerType,
)


def section_extents(levels, starts, length):
    """(end, depth) of every section with its subsections: up to the next heading of its level or higher."""
    ends, depths, stack = [length] * len(levels), [1] * len(levels), []
    for i, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            ends[stack.pop()] = starts[i]
        depths[i] = len(stack) + 1
        stack.append(i)
    return list(zip(ends, depths))


def sections_of(body, headings, nested: bool):
    """array of sections, the lead first (level 0, maybe empty), from the matches of heading lines.

    With ``nested`` a section reaches over its subsections, else it ends at the next heading.
    """

    def run(body: pa.Array, headings: pa.Array) -> pa.Array:
        counts, rows = [], []
        for text, found in zip(body.to_pylist(), headings.to_pylist()):
            if text is None:
                counts.append(0)
                continue
            starts = [h["start"] for h in found] + [len(text)]
            rows.append((0, 0, starts[0], 0, None, text[:starts[0]], 1))
            levels = [len(h["texts"][1]) for h in found]
            extents = section_extents(levels, starts, len(text)) if nested else [(s, 1) for s in starts[1:]]
            for i, (h, level, (end, depth)) in enumerate(zip(found, levels, extents)):
                inner = min(h["end"] + 1, len(text))  # the line feed belongs to the heading
                rows.append((i + 1, h["start"], end, level, h["texts"][2], text[inner:end], depth))
            counts.append(len(found) + 1)
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
        return _nested(counts, [f.name for f in SECTIONS_TYPE.elementType], [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)])

    return streamed(SECTIONS_TYPE, run)(body, headings)


SEGMENTS_TYPE = _structs(kind=T.StringType, start=T.IntegerType, end=T.IntegerType, string=T.StringType)


def top_segments(elements, length):
    """(kind, start, end) of the kept elements and the text between them, for elements in order.

    An element is kept when it starts at or behind the furthest end of all before it; a dropped one still
    moves that frontier.
    """
    out, frontier = [], 0
    for kind, start, end in elements:
        if start >= frontier:
            if start > frontier:
                out.append(("Text", frontier, start))
            out.append((kind, start, end))
        frontier = max(frontier, end)
    if length > frontier:
        out.append(("Text", frontier, length))
    return out


def _segments_of(body: pa.Array, elements: pa.Array) -> pa.Array:
    """Top-level segments of an array<struct<kind,start,end,..>> in document order."""
    counts, rows = [], []
    for text, found in zip(body.to_pylist(), elements.to_pylist()):
        if text is None:
            counts.append(0)
            continue
        segments = top_segments([(f["kind"], f["start"], f["end"]) for f in found or ()], len(text))
        rows += [(kind, s, e, text[s:e]) for kind, s, e in segments]
        counts.append(len(segments))
    types = [pa.string(), pa.int32(), pa.int32(), pa.string()]
    return _nested(counts, ["kind", "start", "end", "string"], [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)])


segments_of = streamed(SEGMENTS_TYPE, _segments_of)


def splice_text(text, edits, lo, hi):
    """text[lo:hi] with the sorted edits applied, clipped to that range."""
    parts, pos = [], lo
    for edit in edits:
        start, end = max(edit["start"], lo), min(edit["end"], hi)
        if edit["start"] > hi or end < lo or (edit["start"] == hi and hi < len(text)):
            continue
        if start < pos or edit["start"] < lo:
            if edit["merge"]:
                pos = max(pos, end)
            continue
        parts += text[pos:start], edit["new"]
        pos = end
    return "".join(parts) + text[pos:hi]


def _splice(body: pa.Array, edits: pa.Array) -> pa.Array:
    """Replace [start, end) by new for each struct<start,end,..,new,merge> of a sorted array.

    An edit that starts inside an earlier one is skipped; with ``merge`` it still
    extends the earlier deletion.
    """
    pairs = zip(body.to_pylist(), edits.to_pylist())
    return pa.array([t if t is None or not e else splice_text(t, e, 0, len(t)) for t, e in pairs], pa.string())


splice = streamed(T.StringType(), _splice)


@F.arrow_udf(T.ArrayType(T.StringType()))
@sliced
def splice_parts(body: pa.Array, bounds: pa.Array, edits: pa.Array) -> pa.Array:
    """The spliced text of every struct<start,end> of ``bounds``."""
    return pa.array(
        [
            None if t is None else [splice_text(t, e or [], b["start"], b["end"]) for b in bs]
            for t, bs, e in zip(body.to_pylist(), bounds.to_pylist(), edits.to_pylist())
        ],
        pa.list_(pa.string()),
    )


@F.arrow_udf(T.ArrayType(T.StringType()))
@sliced
def cut_spans(body: pa.Array, spans: pa.Array) -> pa.Array:
    """body[start:end] of every struct<start,end,..> of an array."""
    return pa.array(
        [
            None if t is None or ss is None else [t[s["start"]:s["end"]] for s in ss]
            for t, ss in zip(body.to_pylist(), spans.to_pylist())
        ],
        pa.list_(pa.string()),
    )


_QUOTES = re.compile(r"'(?:\0*'){1,}")


def quote_runs_of(mask):
    """[(kind, start, end, inner start, inner end)] of bold and italic text of one mask."""
    found, offset = [], 0
    if "'" not in mask:
        return []
    for line in mask.split("\n"):
        tokens = []  # [kind, position of the first counted quote, end]
        for m in _QUOTES.finditer(line):
            at = [i for i in range(*m.span()) if line[i] == "'"]
            width = {2: 2, 3: 3, 4: 3}.get(len(at), 5)
            tokens.append([width, at[-width], m.end(), at])
        italics = sum(t[0] in (2, 5) for t in tokens)
        bolds = sum(t[0] in (3, 5) for t in tokens)
        if italics % 2 and bolds % 2:
            _demote_bold(line, [t for t in tokens if t[0] == 3])
        opened = {}
        for width, start, end, at in tokens:
            if width == 5:
                # An open bold closes first; otherwise the italic mark is the outer one.
                order = [3, 2] if 3 in opened else [2, 3]
            else:
                order = [width]
            pos = at.index(start)
            for k in order:
                first, last = at[pos], at[pos + k - 1] + 1
                if k in opened:
                    s, inner = opened.pop(k)
                    if inner < first:
                        found.append((k, offset + s, offset + last, offset + inner, offset + first))
                else:
                    opened[k] = (first, last)
                pos += k
        for k, (s, inner) in opened.items():
            if inner < len(line):
                found.append((k, offset + s, offset + len(line), offset + inner, offset + len(line)))
        offset += len(line) + 1
    found.sort(key=lambda f: (f[1], -f[2]))
    return [("Bold" if k == 3 else "Italic", *rest) for k, *rest in found]


def _demote_bold(line, bolds):
    """Turn one bold mark into an apostrophe plus an italic mark, as the wiki does.

    First choice is a mark after a single-letter word, then after a longer word,
    then after a space.
    """
    def before(token, n):
        return line[token[1] - n:token[1] - n + 1] if token[1] >= n else ""

    single = [t for t in bolds if before(t, 1) != " " and before(t, 2) == " "]
    word = [t for t in bolds if before(t, 1) != " "]
    for token in (single or word or bolds)[:1]:
        token[0], token[1] = 2, token[3][-2]


@F.arrow_udf(QUOTES_TYPE)
@sliced
def quotes_in(items: pa.Array) -> pa.Array:
    """Bold and italic text of all texts of an array<struct<base,text,mask>>, as page positions."""
    counts, flat = [], []
    for row in _rows_of(items):
        before = len(flat)
        for base, full, masked in row:
            flat += [(kind, base + s, base + e, full[s:e], full[i:j]) for kind, s, e, i, j in quote_runs_of(masked)]
        counts.append(len(flat) - before)
    names = ["kind", "start", "end", "string", "text"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    columns = [pa.array([f[i] for f in flat], t) for i, t in enumerate(types)]
    return _nested(counts, names, columns)


def table_layout(cells, expand):
    """array<struct<row,rows,col,cols,cell>> from array<struct<is_break,colspan,rowspan>>."""

    @F.arrow_udf(LAYOUT_TYPE)
    @sliced
    def run(cells: pa.Array) -> pa.Array:
        layouts = [table_rectangles(c, expand) if c else [] for c in cells.to_pylist()]
        flat = [r for layout in layouts for r in layout]
        columns = [pa.array([f[i] for f in flat], pa.int64()) for i in range(5)]
        return _nested([len(layout) for layout in layouts], ["row", "rows", "col", "cols", "cell"], columns)

    return run(cells)


@F.arrow_udf(T.ArrayType(LAYOUT_TYPE))
@sliced
def plain_layouts(tables: pa.Array) -> pa.Array:
    """Layouts without spans of an array<array<struct<is_break,..>>>, one per table."""
    per_row, per_table, flat = [], [], []
    for cells_of in tables.to_pylist():
        per_row.append(len(cells_of or ()))
        for cells in cells_of or ():
            tiles = table_rectangles(cells, False) if cells else []
            per_table.append(len(tiles))
            flat += tiles
    columns = [pa.array([f[i] for f in flat], pa.int64()) for i in range(5)]
    return _lists(per_row, _nested(per_table, ["row", "rows", "col", "cols", "cell"], columns))


@F.arrow_udf(T.StringType())
@sliced
def table_texts(text: pa.Array, mask: pa.Array) -> pa.Array:
    """Plain text of a table from its text and mask."""
    return pa.array([None if t is None else table_text_of(t, m) for t, m in zip(text.to_pylist(), mask.to_pylist())], pa.string())


def _plain_pages(body: pa.Array, tables: pa.Array, edits: pa.Array) -> pa.Array:
    """Bodies with their edits applied and their outer tables, array<struct<start,end>>, as plain text.

    What the edits leave of a table is scanned again, as markup inside it is gone.
    """
    out = []
    for text, spans, changes in zip(body.to_pylist(), tables.to_pylist(), edits.to_pylist()):
        if text is None:
            out.append(None)
            continue
        parts, at = [], 0
        for span in spans or ():
            parts.append(splice_text(text, changes or [], at, span["start"]))
            at = span["end"]
            left = splice_text(text, changes or [], span["start"], at)
            found = [f for f in scan_marked(left, ("Table",), ("Table",)) if f[1] == 0]
            if found:
                end, mask = found[0][2], found[0][3].decode("ascii")
                parts.append(table_text_of(left[:end], mask))
        parts.append(splice_text(text, changes or [], at, len(text)))
        out.append("".join(parts))
    return pa.array(out, pa.string())


plain_pages = streamed(T.StringType(), _plain_pages)
