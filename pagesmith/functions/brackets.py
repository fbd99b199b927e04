"""Bracket matching of one page body in one left-to-right pass.

Links, parameters, functions and templates are closed from the inside out. Nothing is copied per
level: a found element becomes a *block*, and what stands around it only ever looks at the text
between its blocks. Live pipes, live square brackets, brace pairs that stay text and blocks are kept
as sorted positions, of which a new block drops those it covers; so each is entered and dropped once,
and text behind a closing bracket is looked at by the pair that takes it, not by all pairs around it.
The time follows the length of the body, and the result is offsets; texts and masks of elements are
made for the kinds that ask for them.

A *mask* is a string of the same length as its text in which inner elements are blanked, as
``APPEARANCE`` says. Non-ASCII characters are ``?``. All offsets are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort

from pagesmith.constants import HTML_TAGS, MAGIC_WORDS, OPAQUE_TAGS, PARSABLE_TAGS, URL_SCHEMES

# What an element looks like in the mask of what stands around it: one character for all of it,
# or, for a link, its text with these characters replaced.
APPEARANCE = {"Comment": "\0", "Template": "X", "ParserFunction": "X", "Parameter": "_", "ExtensionTag": "_", "": "_", "Table": "#"}
LINK_OPEN, LINK_CLOSE, LINK_COLON = "\x0e", "\x0f", "\x10"
_IN_LINKS = {"[": LINK_OPEN, "]": LINK_CLOSE, ":": LINK_COLON} | dict.fromkeys("|'{}", "_")
_IN_TAGS_FIRST = dict.fromkeys("[]", "_")
_IN_TAGS_LAST = dict.fromkeys("|{}\n", "_")


def _table(chars: dict[str, str]) -> bytes:
    return bytes(ord(chars.get(chr(b), chr(b))) for b in range(256))


_LINK, _TAG_FIRST, _TAG_LAST = _table(_IN_LINKS), _table(_IN_TAGS_FIRST), _table(_IN_TAGS_LAST)
_FILL = {kind: char.encode() for kind, char in APPEARANCE.items()}


def _any_of(words, escape: bool = False) -> bytes:
    return "|".join(re.escape(w) if escape else w for w in sorted(words, reverse=True)).encode()


_EXTENSION_OPEN = re.compile(rb"<(?:(!--)|(%s)(?=[\s>/])([^>]*)>)" % _any_of(PARSABLE_TAGS + OPAQUE_TAGS), re.I)
_PARSABLE = {name.encode() for name in PARSABLE_TAGS}
_HTML_TAG = re.compile(
    rb"<(/?)(%s)\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|\"(?![^\"]*\")|'(?![^']*'))*+(?=>)|[^>]*+)>" % _any_of(HTML_TAGS)
)
_TOKEN = re.compile(rb"\[(?:\0*\[)*|\](?:\0*\])*|\{\{+|\}\}+|\|")
_BLANK = re.compile(rb"[\s\0_]*\Z")
_FUNCTION = re.compile(rb"[\s\0]*(?:#[^{}\s:|]+|%s)(:|\Z)" % _any_of(MAGIC_WORDS))
_URL = re.compile(rb"[ \0]*(?:%s)[^ \t\n\"<>\[\]]" % _any_of(URL_SCHEMES, escape=True))
_NOT_IN_NAMES = re.compile(rb"[\[\]{}<>\n%s%s]" % (LINK_OPEN.encode(), LINK_CLOSE.encode()))
_TABLE_EDGE = re.compile(rb"^[ :\0]*(\{\|)|\n\s*(\|\})", re.M)
_OPEN_SQUARE, _OPEN_BRACE, _CLOSE_SQUARE, _PIPE = b"[{]|"
# A block in the condensed text of a name: as its mask, cut to five characters.
_SHORT = 5

TABLES = ("Table", "InnerTable")


class Block:
    __slots__ = ("start", "end", "kind", "inner")

    def __init__(self, start, end, kind, inner):
        self.start, self.end, self.kind, self.inner = start, end, kind, inner


def _appearance(mask, start, end, blocks):
    """mask[start:end] with its blocks blanked."""
    out = bytearray(mask[start:end])
    todo = list(blocks)
    while todo:
        b = todo.pop()
        if b.kind == "WikiLink":
            out[b.start - start:b.end - start] = out[b.start - start:b.end - start].translate(_LINK)
    todo = list(blocks)
    while todo:
        b = todo.pop()
        if b.kind == "WikiLink":
            todo += b.inner
        else:
            out[b.start - start:b.end - start] = _FILL[b.kind] * (b.end - b.start)
    return bytes(out)


class _Matcher:
    """State of one pass over ``mask[lo:hi]``."""

    def __init__(self, mask, found, wanted):
        self.mask, self.found, self.wanted = mask, found, wanted
        self.links, self.closable = [], []  # (run, start, inner) of open links; runs of those that close later
        self.braces = []  # [run, count] of open braces
        self.pipes, self.squares, self.dead = [], [], []
        self.opened = []  # opening square brackets up to and including each live one
        self.blocks, self.block_starts = [], []

    # -- what stands between two positions -------------------------------------------

    def condensed(self, lo, hi):
        """The text between lo and hi with every block cut short."""
        at = bisect_left(self.block_starts, lo)
        if at == len(self.blocks) or self.block_starts[at] >= hi:
            return bytes(self.mask[lo:hi])
        parts = []
        for b in self.blocks[at:]:
            if b.start >= hi:
                break
            parts.append(self.mask[lo:b.start])
            short = (LINK_OPEN + LINK_CLOSE).encode() if b.kind == "WikiLink" else _FILL[b.kind] * min(_SHORT, b.end - b.start)
            parts.append(short)
            lo = b.end
        parts.append(self.mask[lo:hi])
        return b"".join(parts)

    def first(self, char, lo, hi):
        """Place of the first such character between the blocks, or -1."""
        at = bisect_left(self.block_starts, lo)
        while lo < hi:
            stop = min(hi, self.block_starts[at]) if at < len(self.blocks) else hi
            place = self.mask.find(char, lo, stop)
            if place >= 0 or stop == hi:
                return place
            lo, at = self.blocks[at].end, at + 1
        return -1

    def pipe(self, lo, hi):
        at = bisect_left(self.pipes, lo)
        return self.pipes[at] if at < len(self.pipes) and self.pipes[at] < hi else -1

    # -- changes ---------------------------------------------------------------------

    def square(self, position):
        before = self.opened[-1] if self.opened else 0
        self.squares.append(position)
        self.opened.append(before + (self.mask[position] == _OPEN_SQUARE))

    def block(self, start, end, kind):
        at = bisect_left(self.block_starts, start)
        inner = self.blocks[at:]
        del self.blocks[at:], self.block_starts[at:]
        self.blocks.append(Block(start, end, kind, inner))
        self.block_starts.append(start)
        for places in (self.pipes, self.dead):
            del places[bisect_left(places, start):]
        at = bisect_left(self.squares, start)
        del self.squares[at:], self.opened[at:]
        return inner

    def add(self, kind, start, end, inner, marks):
        text = _appearance(self.mask, start, end, inner) if kind in self.wanted else None
        self.found.append((kind, start, end, text, marks))

    def drop_links(self, after):
        while self.links and self.links[-1][0] > after:
            self.drop_link()

    def drop_link(self):
        run, _, inner = self.links.pop()
        if self.closable and self.closable[-1][0] == run:
            self.closable.pop()

    # -- the tokens --------------------------------------------------------------------

    def close_links(self, at):
        while len(at) >= 2 and self.links:
            run, start, inner = self.links[-1]
            lone = 0
            if len(at) > 2:
                # A run of three closes a single bracket opened in the link text first.
                i = bisect_left(self.squares, inner)
                n = len(self.squares) - i
                opening = (self.opened[-1] if self.opened else 0) - (self.opened[i - 1] if i else 0)
                lone = int(2 * opening > n)
            if lone:
                self.square(at[0])
            first, last = at[lone], at[lone + 1]
            title_end = self.link_title(inner, first)
            self.drop_link()
            if title_end >= 0:
                while self.braces and self.braces[-1][0] > run:
                    self.braces.pop()
                split = title_end if title_end < first else -1
                anchor = self.first(b"#", inner, title_end)
                self.add("WikiLink", start, last + 1, self.block(start, last + 1, "WikiLink"),
                         (inner - start, split - start if split >= 0 else -1, anchor - start if anchor >= 0 else -1, first - start))
                at = at[lone + 2:]
            else:
                if lone:
                    self.squares.pop()
                    self.opened.pop()
                for position in at[:2]:
                    self.square(position)
                at = at[2:]
        for position in at:
            self.square(position)

    def link_title(self, lo, hi):
        """End of the title when lo..hi is the inside of a link, else -1.

        The title is strict; each part of the text may hold one [pair], or start with a stray bracket.
        """
        split = self.pipe(lo, hi)
        end = split if split >= 0 else hi
        title = self.condensed(lo, end)
        if _NOT_IN_NAMES.search(title) or _URL.match(title):
            return -1
        if split < 0:
            return end
        i = len(self.squares)
        while i and self.squares[i - 1] > split:
            # The last part that holds a bracket.
            pipe = self.pipes[bisect_left(self.pipes, self.squares[i - 1]) - 1]
            j = bisect_left(self.squares, pipe)
            if i - j > 4:
                return -1
            part = self.squares[j:i]
            chars = bytes(self.mask[p] for p in part)
            if chars not in (b"", b"[]"):
                k = 0
                if part[0] == pipe + 1 and chars[0] == _OPEN_SQUARE:
                    k = 1
                if k < len(part) and part[k] == pipe + 1 + k and chars[k] == _CLOSE_SQUARE:
                    k += 1
                if chars[k:] not in (b"", b"[]"):
                    return -1
            i = j
        return end

    def close_braces(self, s, e):
        while e - s >= 2 and self.braces:
            run, count = self.braces[-1]
            above = bisect_right(self.closable, (run, 1 << 62))
            if above < len(self.closable) and self.pipes and self.pipes[-1] >= self.closable[above][1]:
                break  # these braces are text of a link that closes later
            width = 3 if count >= 3 and e - s >= 3 else 2
            start = run + count - width
            kind, split = self.brace_kind(start + width, s, width)
            self.drop_links(run)
            if kind is None:
                self.braces.pop()
                insort(self.dead, run)
                self.dead.append(s)
            else:
                inner = self.block(start, s + width, kind)
                if kind:
                    self.add(kind, start, s + width, inner, (width, split - start if split >= 0 else -1, -1, s - start))
                self.braces[-1][1] = count - width
                if count - width < 2:
                    self.braces.pop()
            s += width
        if e - s >= 2:
            self.dead.append(s)

    def brace_kind(self, lo, hi, width):
        """Kind of a closed pair and its first separator; "" for a nameless one, None for plain text."""
        if bisect_left(self.dead, lo) < len(self.dead):
            return None, -1
        pipe = self.pipe(lo, hi)
        if width == 3:
            return ("Parameter" if hi > lo else None), pipe
        name = self.condensed(lo, pipe if pipe >= 0 else hi)
        m = _FUNCTION.match(name)
        if m and (m[1] or pipe < 0):
            return "ParserFunction", self.first(b":", lo, hi)
        if _BLANK.match(name):
            return "", -1
        if _NOT_IN_NAMES.search(name.strip(b" \t\r\n\f\v\0")):
            return None, -1
        return "Template", pipe

    def run(self, lo, hi):
        mask = self.mask
        # A tag ends at a ">", so nothing behind the last one is searched.
        tags = [m.span() for m in _HTML_TAG.finditer(mask, lo, mask.rfind(b">", lo, hi) + 1)]
        for s, e in tags:
            mask[s:e] = mask[s:e].translate(_TAG_FIRST)
        tokens = [(m.start(), m.end(), mask[m.start()]) for m in _TOKEN.finditer(mask, lo, hi)]
        places = {s: [i for i in range(s, e) if mask[i] == char] for s, e, char in tokens if char in b"[]"}
        # Which link openers have a closer at all, looking at square brackets only.
        closing, waiting = set(), []
        for s, _, char in tokens:
            if char == _OPEN_SQUARE and len(places[s]) > 1:
                waiting.append(s)
            elif char == _CLOSE_SQUARE and len(places[s]) > 1 and waiting:
                closing.add(waiting.pop())
        for s, e, char in tokens:
            if char == _PIPE:
                self.pipes.append(s)
            elif char == _OPEN_SQUARE:
                at = places[s]
                for position in at:
                    self.square(position)
                if len(at) % 2 == 0:
                    self.links.append((s, at[-2], at[-1] + 1))
                    if s in closing:
                        self.closable.append((s, at[-1] + 1))
            elif char == _OPEN_BRACE:
                self.braces.append([s, e - s])
            elif char == _CLOSE_SQUARE:
                self.close_links(places[s])
            else:
                self.close_braces(s, e)
        if self.blocks:
            mask[lo:hi] = _appearance(mask, lo, hi, self.blocks)
        for s, e in tags:
            mask[s:e] = mask[s:e].translate(_TAG_LAST)


def _extension_tags(mask, lo, hi, found, wanted):
    """Comments and extension tags between lo and hi; contents of opaque tags are blanked."""
    pos, unclosed = lo, set()

    def add(kind, start, end):
        found.append((kind, start, end, bytes(mask[start:end]) if kind in wanted else None, None))

    while m := _EXTENSION_OPEN.search(mask, pos, hi):
        start = m.start()
        if m[1]:
            close = mask.find(b"-->", m.end(), hi)
            pos = hi if close < 0 else close + 3
            add("Comment", start, pos)
            mask[start:pos] = _FILL["Comment"] * (pos - start)
            continue
        name = m[2].lower()
        inner = None
        if m[3].endswith(b"/"):
            pos = m.end()
        else:
            close = None
            if name not in unclosed:
                close = re.compile(rb"</%s\s*>" % name, re.I).search(mask, m.end(), hi)
            if close is None:
                unclosed.add(name)
                pos = start + 1
                continue
            inner, pos = (m.end(), close.start()), close.end()
        if name in _PARSABLE:
            if inner:
                _extension_tags(mask, *inner, found, wanted)
            _Matcher(mask, found, wanted).run(start, pos)
            add("ExtensionTag", start, pos)
            if "tables" in wanted:
                _tables(bytes(mask[start:pos]), start, found, wanted)
            if inner:
                mask[inner[0]:inner[1]] = _FILL["ExtensionTag"] * (inner[1] - inner[0])
        else:
            add("ExtensionTag", start, pos)
            mask[start:pos] = _FILL["ExtensionTag"] * (pos - start)


def _html_pairs(shadow, found, wanted):
    """HTML tags of the page: a start tag takes the nearest unused end tag after it."""
    open_tags = {}

    def add(start, end):
        found.append(("Tag", start, end, shadow[start:end] if "Tag" in wanted else None, None))

    for m in _HTML_TAG.finditer(shadow, 0, shadow.rfind(b">") + 1):
        if m[1]:
            if starts := open_tags.get(m[2]):
                add(starts.pop()[0], m.end())
        elif m[3].rstrip().endswith(b"/"):
            add(*m.span())
        else:
            open_tags.setdefault(m[2], []).append(m.span())
    for starts in open_tags.values():
        for span in starts:
            add(*span)


def _tables(shadow, offset, found, wanted):
    """Table blocks, innermost first; an unclosed one runs to a final line end."""
    if b"{|" not in shadow:
        return
    starts, blocks = [], []

    def close(start, end):
        inner = []
        while blocks and blocks[-1].start >= start:
            inner.append(blocks.pop())
        blocks.append(Block(start, end, "Table", ()))
        text = _appearance(shadow, start, end, inner) if wanted & set(TABLES) else None
        found.append(("Table", offset + start, offset + end, text, None))

    for m in _TABLE_EDGE.finditer(shadow):
        if m[1]:
            starts.append(m.start(1))
        elif starts:
            close(starts.pop(), m.end())
    if starts and re.search(rb"\n\s*\Z", shadow[starts[-1]:]):
        close(starts.pop(), len(shadow))


KINDS = ("Page", "Comment", "ExtensionTag", "Parameter", "ParserFunction", "Template", "WikiLink", "Tag", *TABLES)


def scan_page(body):
    """[(kind, start, end, mask)] of all elements."""
    return [f[:4] for f in scan_marked(body)]


def scan_marked(body, kinds=KINDS, masked=KINDS):
    """[(kind, start, end, mask, marks)] of the given kinds, the page itself first, then by start.

    Masks are given for the kinds in ``masked``, else None. ``marks`` of parameters, functions, templates and
    links are offsets inside the element: end of the opening, first separator, first ``#`` of a link's target
    (-1 where there is none), start of the closing.
    """
    mask, found = bytearray(body, "ascii", "replace"), []
    wanted = set(masked) & set(kinds)
    if set(kinds) & set(TABLES):
        wanted.add("tables")  # they are told apart only at the end
    _extension_tags(mask, 0, len(mask), found, wanted)
    _Matcher(mask, found, wanted).run(0, len(mask))
    shadow = bytes(mask)
    if "Tag" in kinds:
        _html_pairs(shadow, found, wanted)
    if "tables" in wanted:
        _tables(shadow, 0, found, wanted)
    found.sort(key=lambda f: (f[1], -f[2]))
    # Tables that end inside an earlier one are told apart.
    frontier, out = 0, [("Page", 0, len(body), shadow, None)]
    for kind, start, end, text, marks in found:
        if kind == "Table":
            kind = "InnerTable" if end < frontier else kind
            frontier = max(frontier, end)
        out.append((kind, start, end, text, marks))
    chosen = set(kinds)
    return [f if f[0] in masked else (*f[:3], None, f[4]) for f in out if f[0] in chosen]
