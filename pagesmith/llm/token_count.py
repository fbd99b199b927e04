"""Token counts by a compiled finite-state tokenizer.

A byte-pair vocabulary whose tokenizer lower-cases, drops white space and cuts words by one
pattern is compiled into two deterministic transducers; no text is ever tokenized by merging.

* The *cutter* reads character classes and marks where a piece (a contraction, a run of letters,
  one number, a run of other characters) starts. It has seven states. The characters of a block of
  texts are dealt into equal chunks whatever text they belong to; every chunk gives its state map
  (end state for each of the seven start states, all chunks side by side), the maps are composed by
  a parallel prefix scan, and with its true start state each chunk is read once more for its marks.
  Blanks lead to the start state from everywhere, so texts are told apart by a blank.
* The *counter* reads the bytes of a piece; its last byte is a symbol of its own. Each transition is
  annotated with the tokens it emits: how many more tokens the piece read so far has than the piece
  before this byte (it may be negative, as a byte can join tokens). It rests on a property of merge
  lists: a row of tokens is the encoding of its bytes exactly if each two neighbours are the encoding
  of theirs. So the last token of a prefix is the one token that ends there, starts where another
  prefix ends, and stays apart from that prefix's last token. A state is the set of prefixes from
  which a token may still reach on: (place in the trie of tokens, last token before it, tokens since).
  States are made when a text first asks for them and kept in a hash table that starts anew beyond
  ``MAX_STATES``; what is counted does not depend on it. All pieces of a block step side by side.

Special strings are one token each, as the tokenizer's default has it. A null text is empty and has
no tokens; ids may be null or repeated, every row is answered. Columns of other names do no harm: only
the two named ones are read. A single piece of millions of characters is read byte by byte.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 128
BLOCK_CHARS = 1 << 21
MAX_STATES = 1 << 18
END = 256  # symbols 256 to 511 are bytes that end a piece

# Character classes of the cutter. In a contraction the letters are told apart.
LETTER, SHORT, R, V, L, E, NUMBER, BLANK, QUOTE, OTHER = range(10)
BETWEEN, WORD, SIGNS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
STATES, CLASSES = 7, 10


def cutter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and start marks (1: here, 2: one character back) by class and state."""
    letters = (LETTER, SHORT, R, V, L, E)
    goto = np.zeros((CLASSES, STATES), np.int8)
    mark = np.zeros((CLASSES, STATES), np.int8)

    def plain(state, c):
        """A character outside contractions."""
        if c == BLANK:
            return BETWEEN, 0
        if c in letters:
            return WORD, int(state != WORD)
        if c == NUMBER:
            return BETWEEN, 1
        if state == SIGNS:
            return SIGNS, 0
        return (QUOTED if c == QUOTE else SIGNS), 1

    pending = {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}
    for c in range(CLASSES):
        for state in (BETWEEN, WORD, SIGNS):
            goto[c, state], mark[c, state] = plain(state, c)
        for state, last in pending.items():
            # Not the contraction: the letter after the quote began a word.
            to, here = plain(WORD, c)
            goto[c, state], mark[c, state] = (BETWEEN, 0) if c == last else (to, here | 2)
        goto[c, QUOTED], mark[c, QUOTED] = {
            SHORT: (BETWEEN, 0), R: (QUOTED_R, 0), V: (QUOTED_V, 0), L: (QUOTED_L, 0),
        }.get(c) or plain(SIGNS, c)
    return goto, mark


def class_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        table[[ord(char) for char in regex.findall(pattern, every)]] = c
    for chars, c in (("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE)):
        for char in chars:
            table[ord(char)] = c
    return table


class Cutter:
    """Where the pieces of a row of characters start."""

    def __init__(self):
        goto, mark = cutter()
        self.goto, self.mark = goto.ravel(), mark.ravel()
        self.classes = class_table()

    def starts(self, classes: np.ndarray) -> np.ndarray:
        n = len(classes)
        chunks = -(-n // CHUNK)
        padded = np.full(chunks * CHUNK, BLANK, np.int16)
        padded[:n] = classes
        offset = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T) * np.int16(STATES)
        maps = np.repeat(np.arange(STATES, dtype=np.int8)[None, :], chunks, 0)
        for column in offset:
            maps = self.goto[column[:, None] + maps]
        # Inclusive prefix scan: maps[i] becomes the map of chunks 0 to i.
        reach = 1
        while reach < chunks:
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.int64), 1)
            reach *= 2
        state = np.empty(chunks, np.int8)
        state[0], state[1:] = BETWEEN, maps[:-1, BETWEEN]
        marks = np.empty((CHUNK, chunks), np.int8)
        for k, column in enumerate(offset):
            at = column + state
            marks[k] = self.mark[at]
            state = self.goto[at]
        flat = np.ascontiguousarray(marks.T).ravel()
        found = (flat & 1).astype(bool)
        found[np.flatnonzero(flat & 2) - 1] = True
        return np.flatnonzero(found[:n])


class Merges:
    """The merge list over symbols 0 to 511: bytes, and bytes that end a piece."""

    def __init__(self, spec: dict):
        model = spec["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        suffix = model["end_of_word_suffix"]
        ids = {letter[b]: b for b in range(256)} | {letter[b] + suffix: b + END for b in range(256)}
        self.rank, self.left, self.right, self.joined = [-1] * 512, [-1] * 512, [-1] * 512, {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.joined[ids[a], ids[b]] = rank
            ids[a + b] = len(self.rank)
            self.rank.append(rank)
            self.left.append(ids[a])
            self.right.append(ids[b])

    def apart(self, a: int, b: int, limit: int) -> bool:
        """No merge before ``limit`` joins a and b, each made of its own bytes."""
        rank, left, right, joined = self.rank, self.left, self.right, self.joined
        while True:
            if joined.get((a, b), limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], right[a]
            elif rank[b] >= 0:
                # Of equal merges the left one comes first.
                limit, b = rank[b] + 1, left[b]
            else:
                return True


class Counter:
    """The byte transducer over pieces, made state by state."""

    def __init__(self, spec: dict):
        self.merges = m = Merges(spec)
        symbols, whole = [], []
        self.child, self.token, self.inner = {}, [-1], [False]
        for t in range(len(m.rank)):
            own = t < 512 or (whole[m.left[t]] and whole[m.right[t]] and m.apart(m.left[t], m.right[t], m.rank[t]))
            whole.append(own)
            symbols.append((t,) if t < 512 else symbols[m.left[t]] + symbols[m.right[t]])
            if not own:
                continue  # no text is ever encoded with this token
            node = 0
            for s in symbols[t]:
                key = node << 9 | s
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                self.inner[node] = True
                node = self.child[key]
            self.token[node] = t
        self.known = {}
        self.clear()

    def clear(self):
        self.states = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.bits = 16
        self._table()

    def _table(self):
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int32)
        self.weight = np.zeros(1 << self.bits, np.int8)
        self.used = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _apart(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if key not in self.known:
            if len(self.known) > 4 * MAX_STATES:
                self.known.clear()
            self.known[key] = self.merges.apart(a, b, 1 << 30)
        return self.known[key]

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        reached = []
        for node, last, since in self.states[state]:
            child = self.child.get(node << 9 | symbol)
            if child is None:
                continue
            t = self.token[child]
            if t >= 0 and (last < 0 or self._apart(last, t)):
                token, weight = t, 1 - since
            if self.inner[child]:
                reached.append((child, last, since))
        if symbol >= END:
            return 0, weight
        made = (*((node, last, since + weight) for node, last, since in reached), (0, token, 0))
        if made not in self.number:
            self.number[made] = len(self.states)
            self.states.append(made)
        return self.number[made], weight

    def _insert(self, keys: np.ndarray, nexts, weights):
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys = np.concatenate([self.keys[old], keys])
            nexts = np.concatenate([self.next[old], np.asarray(nexts, np.int32)])
            weights = np.concatenate([self.weight[old], np.asarray(weights, np.int8)])
            while 3 * len(keys) > 1 << self.bits:
                self.bits += 1
            self._table()
        mask = len(self.keys) - 1
        for key, slot, to, w in zip(keys.tolist(), self._slot(keys).tolist(), nexts, weights, strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & mask
            self.keys[slot], self.next[slot], self.weight[slot] = key, to, w
        self.used += len(keys)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the transitions, -1 where there is none yet."""
        slot = self._slot(keys)
        held = self.keys[slot]
        open_ = np.flatnonzero(held != keys)
        mask = len(self.keys) - 1
        while len(open_):
            gone = held[open_] < 0
            slot[open_[gone]] = -1
            open_ = open_[~gone]
            slot[open_] = (slot[open_] + 1) & mask
            held[open_] = self.keys[slot[open_]]
            open_ = open_[held[open_] != keys[open_]]
        return slot

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of every piece ``data[start:start + length]``."""
        if len(self.states) > MAX_STATES:
            self.clear()
        order = np.argsort(-lengths, kind="stable")
        begin, size = starts[order], lengths[order]
        live_at = len(size) - np.searchsorted(size[::-1], np.arange(1, int(size.max(initial=0)) + 1))
        state = np.zeros(len(order), np.int64)
        total = np.zeros(len(order), np.int32)
        for t, live in enumerate(live_at.tolist()):
            # Pieces are sorted by length: those that end here are the last live ones.
            more = int(live_at[t + 1]) if t + 1 < len(live_at) else 0
            keys = state[:live] << 9 | data[begin[:live] + t]
            keys[more:] += END
            slot = self._find(keys)
            missing = np.flatnonzero(slot < 0)
            if len(missing):
                fresh = np.unique(keys[missing])
                made = [self._step(key >> 9, key & 511) for key in fresh.tolist()]
                self._insert(fresh, [to for to, _ in made], [w for _, w in made])
                slot = self._find(keys)
            total[:live] += self.weight[slot]
            state[:live] = self.next[slot]
        out = np.empty(len(order), np.int32)
        out[order] = total
        return out


class Machine:
    """Both transducers of one vocabulary file, with its special strings."""

    def __init__(self, spec: dict):
        self.cutter, self.counter = Cutter(), Counter(spec)
        names = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True))) or "(?!)")

    def _parts(self, text: str):
        """Parts of a text without special strings, cut at blanks when they are long."""
        for part in self.special.split(text):
            at = 0
            while len(part) - at > BLOCK_CHARS and (blank := part.find(" ", at + BLOCK_CHARS)) >= 0:
                yield part[at:blank]
                at = blank
            yield part[at:]

    def count(self, texts: list[str | None]) -> np.ndarray:
        totals = np.zeros(len(texts), np.int64)
        parts, owners, held = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if "<" in text or self.special.pattern[0] != "<":
                totals[i] += len(self.special.findall(text))
            for part in self._parts(text):
                parts.append(normal(part))
                owners.append(i)
                held += len(part)
                if held >= BLOCK_CHARS:
                    self._add(totals, parts, owners)
                    parts, owners, held = [], [], 0
        if parts:
            self._add(totals, parts, owners)
        return totals

    def _add(self, totals: np.ndarray, parts: list[str], owners: list[int]):
        joined = " ".join(parts) + " "
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode(), np.uint8)
        classes = self.cutter.classes[points]
        starts = self.cutter.starts(classes)
        if not len(starts):
            return
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        ends = np.cumsum(width, dtype=np.int64)
        lengths = np.add.reduceat(np.where(classes == BLANK, 0, width), starts, dtype=np.int64)
        counts = self.counter.count(data, ends[starts] - width[starts], lengths)
        edges = np.cumsum([len(p) + 1 for p in parts])
        owner = np.asarray(owners)[np.searchsorted(edges, starts, "right")]
        np.add.at(totals, owner, counts)


def normal(text: str) -> str:
    """Composed and in lower case, each character by itself."""
    if text.isascii():
        return text.lower()
    # A final capital sigma gets its own small form in lower(), but not character by character.
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def machine(key: str, source: bytes) -> Machine:
    """The compiled machine of a worker process, made once and kept for its later tasks."""
    held = sys.modules.setdefault("_compiled_tokenizers", types.ModuleType("_compiled_tokenizers"))
    if not hasattr(held, key):
        setattr(held, key, Machine(json.loads(source)))
    return getattr(held, key)


def count_tokens(
    docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row. ``path`` is the tokenizer file on the driver.

    The file (a few MB, whatever the corpus) is broadcast; nothing is shuffled.
    """
    with open(path, "rb") as file:
        source = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(source)
    key = "of_" + hashlib.sha256(source).hexdigest()

    @F.arrow_udf("long")
    def tokens(text: pa.Array) -> pa.Array:
        return pa.array(machine(key, shared.value).count(text.to_pylist()), pa.int64())

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return counted.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
