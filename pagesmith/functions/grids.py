"""Cells, layout and plain text of one wikitext table."""

from __future__ import annotations

import re

CAPTION = (
    r"\A\{\|(?:[^\n]|\n(?!\s*\|))*\n\s*\|\+"
    r"(?:([^\n|]*)\|(?!\|))?((?s:.*?))(?=\n[|!]|\|\|)"
)
# Row break, caption or table end, or a cell with optional attributes before one pipe.
CELL = (
    r"(\n\s*\|-[^\n]*)|(\n\s*\|[+}](?:(?!\n\s*[|!])[\s\S])*)"
    r"|(?:\n\s*(\||!)|(\|?\x05\x05|\|\|))"
    r"(?:([^|\n\x05]*)\|(?![|\x05]))?((?:(?!\|\||\x05\x05|\|\x05\x05|\n\s*[|!])[\s\S])*)"
)
_caption, _cell = re.compile(CAPTION), re.compile(CELL)
_header = re.compile(r"(\n\s*!)((?:(?!\n\s*[|!])[\s\S])*)")
_attribute = re.compile(
    r"([^\s\x00-\x1f\x7f-\x9f\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?", re.A)
_number = re.compile(r"\s*([0-9]+)", re.A)


def _cell_rows(cells):
    """Rows of (cell number, colspan, rowspan); rows without cells do not count."""
    rows, fresh = [], True
    for number, cell in enumerate(cells):
        if cell["is_break"]:
            fresh = True
            continue
        if fresh:
            rows.append([])
            fresh = False
        rows[-1].append((number, cell["colspan"], cell["rowspan"]))
    return rows


def _painted(intervals):
    """Disjoint (from, to, cell) by place, of intervals of which later ones lie on top."""
    by_place = sorted(intervals)
    if all(a[1] <= b[0] for a, b in zip(by_place, by_place[1:])):
        return by_place
    edges = sorted({edge for a, b, _ in intervals for edge in (a, b)})
    top = [None] * len(edges)
    at = {edge: i for i, edge in enumerate(edges)}
    for a, b, cell in intervals:
        for i in range(at[a], at[b]):
            top[i] = cell
    out = []
    for i, cell in enumerate(top[:-1]):
        if cell is None:
            continue
        if out and out[-1][1] == edges[i] and out[-1][2] == cell:
            out[-1] = (out[-1][0], edges[i + 1], cell)
        else:
            out.append((edges[i], edges[i + 1], cell))
    return out


def table_rectangles(cells, expand):
    """[(row, rows, col, cols, cell number)] that tile one table; a null cell number is a hole.

    ``cells`` lists row breaks and cells in text order. With ``expand`` a cell fills its colspan x rowspan
    slots, a rowspan of zero grows to the last row, and a later cell lies over an earlier one. A sweep over
    the rows keeps the cells that are open as column intervals; slots are never listed.
    """
    rows = _cell_rows(cells)
    if not expand:
        return [(y, 1, x, 1, cell[0]) for y, row in enumerate(rows) for x, cell in enumerate(row)]
    open_, growing, bands, width, height = [], [], [], 0, 0
    for y, row in enumerate(rows):
        open_ = [c for c in open_ if c[3] > y]
        taken = sorted((a, b) for a, b, *_ in open_ + growing)
        x, i, placed, grown = 0, 0, [], []
        height = max(height, y + 1)
        for number, colspan, rowspan in row:
            while i < len(taken) and taken[i][0] <= x:
                x, i = max(x, taken[i][1]), i + 1
            colspan, deep = max(colspan, 1), max(rowspan, 1)
            placed.append((x, x + colspan, number, y + deep))
            width, height = max(width, x + colspan), max(height, y + deep)
            if rowspan == 0:
                grown.append((x, x + colspan, number))
            x += colspan
        bands.append((y, y + 1, _painted([c[:3] for c in open_] + growing + [c[:3] for c in placed])))
        open_ += placed
        growing += grown
    y = len(rows)
    while y < height:
        open_ = [c for c in open_ if c[3] > y]
        end = min([c[3] for c in open_], default=height)
        bands.append((y, end, _painted([c[:3] for c in open_] + growing)))
        y = end
    out, standing = [], {}
    for top, _, intervals in [*bands, (height, height, None)]:
        now, x = set(), 0
        if intervals is not None:
            for a, b, cell in [*intervals, (width, width, None)]:
                if a > x:
                    now.add((x, a, None))
                if b > a:
                    now.add((a, b, cell))
                x = b
        for key in [k for k in standing if k not in now]:
            a, b, cell = key
            begin = standing.pop(key)
            out.append((begin, top - begin, a, b - a, cell))
        for key in now:
            standing.setdefault(key, top)
    return sorted(out, key=lambda r: (r[0], r[2]))


def table_layout_of(cells, expand):
    """[(row, col, cell number)] of every slot of one table, row by row."""
    slots = [
        (y, x, cell)
        for top, rows, left, cols, cell in table_rectangles(cells, expand)
        for y in range(top, top + rows) for x in range(left, left + cols)
    ]
    return sorted(slots, key=lambda s: s[:2])


def span_of(attrs, name):
    """Leading integer of the last attribute of that name; 1 when there is none."""
    values = [a or b or c or "" for n, a, b, c in _attribute.findall(attrs or "") if n == name]
    m = _number.match(values[-1]) if values else None
    return int(m[1]) if m and int(m[1]) < 1 << 31 else 1


def table_text_of(text, mask):
    """Caption line, then rows of tab-joined cells; all columns but the last are padded to their width."""
    # In header cells !! separates like ||.
    marked = _header.sub(lambda m: m[1] + m[2].replace("!!", "\x05\x05"), mask)
    cells, values = [], []
    for m in _cell.finditer(marked):
        if m[2] is not None:
            continue
        attrs = None if m[5] is None else text[m.start(5):m.end(5)]
        cells.append({"is_break": m[1] is not None, "colspan": span_of(attrs, "colspan"), "rowspan": span_of(attrs, "rowspan")})
        values.append("" if m[6] is None else text[m.start(6):m.end(6)].lstrip(" ").rstrip("\r\n\t "))
    tiles = table_rectangles(cells, True)
    if not tiles:
        return ""
    rows = [[] for _ in range(max(top + n for top, n, *_ in tiles))]
    for top, n, _, cols, cell in sorted(tiles, key=lambda t: t[2]):
        for y in range(top, top + n):
            rows[y] += ["" if cell is None else values[cell]] * cols
    widths = [max(map(len, column)) for column in zip(*rows)][:-1] + [0]
    grid = "\n".join("\t".join(v.ljust(w) for v, w in zip(row, widths)) for row in rows)
    m = _caption.search(mask)
    caption = "" if m is None or m[2] is None else f"\n{text[m.start(2):m.end(2)]}\n"
    return f"{caption}\n{grid}\n"
