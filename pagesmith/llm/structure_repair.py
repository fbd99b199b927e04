"""Repair of the turn structure of conversations with an audit of the edits.

A conversation is read as a row of role initials that should be ``(s?(ua)+)?``. The cheapest edits that
get there (keep, rerole, delete, insert) are found by dynamic programming over (row, automaton state),
from the last row to the first. Of equally cheap edits the least audit string wins, and strings are
compared as they are extended, so they are kept persistent:

* An audit is a linked list of edit letters. What follows a row is shared: each (row, state) adds one
  node in front of the list it goes on with. (Suffixes are shared, not prefixes: of two equally cheap
  beginnings one may be a beginning of the other, and which is less then depends on what follows.)
* A node holds its binary-lifting ancestors, 2^k letters on, and the rolling hash of those letters.
  Blocks of equal hash get the same name only after their halves' names are compared, so a collision
  is noticed and equal names mean equal letters.
* Two audits of equal cost are compared by descending through the powers of two: blocks of equal names
  are skipped, and the first letter that differs, or the end of one list, decides.

Spark brings a conversation's narrow rows (initial, faults, key) into one sorted stream for this; its
texts come in a second sorted stream, behind its audit, and are edited as they pass, one at a time.
A conversation's facts must fit a worker (some hundred bytes a row), as its audit fits one cell;
its texts need not.

Nulls count as one blank, in roles, texts and keys of the damage. Rows are ordered by turn, null first,
then by role and text key; repeated rows have one order. Rows of a null conversation id form one
conversation. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOLID = r"[^\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs; CUT for a truncated row that stays
GOOD = ("su", "ua", "au")

# Automaton: EMPTY and DONE may end. A kept initial or an inserted turn moves it on.
EMPTY, SYSTEM, USER, DONE = range(4)
MOVES = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
TURN = {EMPTY: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", DONE), DONE: ("user", USER)}
PRIME, RADIX = (1 << 61) - 1, 0x1F3D5B79


class Audits:
    """Persistent strings: nodes with ancestors at powers of two and named blocks."""

    def __init__(self):
        self.letter, self.length, self.up, self.block, self.hash = [""], [0], [[]], [[]], [[]]
        self.names: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.fresh = 256
        self.powers = [RADIX]

    def add(self, letter: str, rest: int) -> int:
        up, block, hashes = [rest], [ord(letter)], [ord(letter)]
        length, k = self.length[rest] + 1, 1
        while length >= 1 << k:
            if k == len(self.powers):
                self.powers.append(self.powers[-1] ** 2 % PRIME)
            middle = up[k - 1]
            value = (hashes[k - 1] * self.powers[k - 1] + self.hash[middle][k - 1]) % PRIME
            block.append(self._name(k, value, block[k - 1], self.block[middle][k - 1]))
            hashes.append(value)
            up.append(self.up[middle][k - 1])
            k += 1
        self.letter.append(letter)
        self.length.append(length)
        self.up.append(up)
        self.block.append(block)
        self.hash.append(hashes)
        return len(self.letter) - 1

    def _name(self, k: int, value: int, left: int, right: int) -> int:
        """Name of a block; blocks of one hash are told apart by their halves."""
        known = self.names.setdefault((k, value), [])
        for a, b, name in known:
            if (a, b) == (left, right):
                return name
        self.fresh += 1
        known.append((left, right, self.fresh))
        return self.fresh

    def less(self, a: int, b: int) -> bool:
        """Is string a before string b?"""
        if a == b:
            return False
        for k in range(min(len(self.up[a]), len(self.up[b])) - 1, -1, -1):
            if k < len(self.up[a]) and k < len(self.up[b]) and self.block[a][k] == self.block[b][k]:
                a, b = self.up[a][k], self.up[b][k]
        return self.letter[a] < self.letter[b]  # the end of a string is the empty letter

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(out)


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and least audit for rows of (initial, must go, is truncated)."""
    audits = Audits()

    def before(a, b):
        """Is candidate a = (cost, letter, rest) better than b?"""
        return a[:2] < b[:2] if a[:2] != b[:2] else audits.less(a[2], b[2])

    def closed(candidates: dict) -> list[tuple[int, int]]:
        """Best (cost, audit) of each state: its candidates, or an inserted turn and on from there.

        States are settled by cost: a turn inserted costs more than what it leads to.
        """
        settled: dict[int, tuple[int, int]] = {}
        while candidates:
            state = min(candidates, key=lambda s: candidates[s][0])
            cost, letter, rest = candidates.pop(state)
            node = settled[state] = (cost, audits.add(letter, rest) if letter else rest)
            for s, (_, to) in TURN.items():
                if to == state and s not in settled:
                    inserted = (cost + INSERT, "I", node[1])
                    if s not in candidates or before(inserted, candidates[s]):
                        candidates[s] = inserted
        return [settled[s] for s in range(4)]

    best = closed({EMPTY: (0, "", 0), DONE: (0, "", 0)})
    for initial, must_go, truncated in reversed(rows):
        candidates = {}
        for state in range(4):
            choice = (best[state][0] + DELETE, "D", best[state][1])
            if not must_go:
                extra = CUT if truncated else 0
                kept = MOVES.get((state, initial))
                if kept is not None:
                    other = (best[kept][0] + KEEP + extra, "K", best[kept][1])
                    choice = other if before(other, choice) else choice
                turned = best[TURN[state][1]]
                other = (turned[0] + REROLE + extra, "R", turned[1])
                choice = other if before(other, choice) else choice
            candidates[state] = choice
        best = closed(candidates)
    return best[EMPTY][0], audits.text(best[EMPTY][1])


def replay(audit: str):
    """Generator of edits: send a (role, text) per row, get the rows ``(edit, role, text)`` it gives.

    The first ``next`` and every ``send`` return what stands up to and including that row's edit;
    the insertions behind the last row come with it.
    """
    state, at = EMPTY, 0

    def inserted():
        nonlocal state, at
        out = []
        while at < len(audit) and audit[at] == "I":
            role, state = TURN[state]
            out.append(("I", role, ""))
            at += 1
        return out

    given = yield inserted()
    while True:
        role, text = given
        out, edit = [], audit[at]
        at += 1
        if edit == "R":
            role, state = TURN[state]
        elif edit == "K":
            state = MOVES[state, role[:1]]
        if edit != "D":
            out.append((edit, role, text))
        given = yield out + inserted()


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, key, copies`` of every row; the key orders rows of one turn."""
    role, text = _text(F.col(role_col)), _text(F.col(text_col))
    return conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        _key(role, text).alias("key"), F.lit(1).alias("copies"),
    )


def _key(role: Column, text: Column) -> Column:
    return F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32))


def damage(rows: DataFrame) -> DataFrame:
    """Rows of ``turns`` with the faults their crc32 gives; a dropped row has no copies."""
    kind = F.crc32(F.concat(_text(F.col("conv_id")), F.lit(":"), _text(F.col("turn")))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.withColumn("kind", kind).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "key",
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


ORDER = ["turn", "key", "role"]
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Conversation id and rows, for sorted rows with the id first."""
    held, conv, any_ = [], None, False
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if any_ and row[0] != conv:
                yield conv, held
                held = []
            conv, any_ = row[0], True
            held.append(row[1:])
    if any_:
        yield conv, held


def _audited(rows: list[tuple]) -> tuple:
    """Counts, cost and audit of one conversation's (turn, initial, blank, truncated, key, copies)."""
    seen, facts, numbers = set(), [], set()
    count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for turn, initial, blank, truncated, key, copies in rows:
        for _ in range(copies):
            fault = "blank" if blank else "duplicate" if key in seen else "truncated" if truncated else None
            seen.add(key)
            if fault:
                count[fault] += 1
            facts.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
            if turn is not None:
                numbers.add(turn)
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[0] + b[0] not in GOOD for a, b in zip(facts, facts[1:]))
    return gaps, *count.values(), illegal, *cheapest(facts)


def audits(rows: DataFrame) -> DataFrame:
    """``conv_id``, the counts, ``cost`` and ``audit`` of every conversation of ``turns`` or ``damage``."""
    text = F.col("text")
    last = F.regexp_extract("text", rf"(?s)({SOLID})[\x20\x09-\x0D]*\z", 1)
    facts = rows.select(
        "conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), (~text.rlike(SOLID)).alias("blank"),
        (~last.isin(".", "!", "?")).alias("truncated"), _key(F.col("role"), text).alias("now"), "copies", "key", "role",
    )
    sorted_ = facts.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).drop("key", "role")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *_COUNTS, "audit"]

    def run(batches):
        out = []
        for conv, held in _grouped(batches):
            out.append((conv, *_audited(held)))
            if len(out) == 2000:
                yield _columns(out, names)
                out = []
        if out:
            yield _columns(out, names)

    return sorted_.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string")


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    arrays = [pa.array([r[i] for r in rows], pa.string() if n in _STRINGS else pa.int64()) for i, n in enumerate(names)]
    return pa.RecordBatch.from_arrays(arrays, names)


_STRINGS = {"audit", "edit", "role", "text", "repaired_sha256"}


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit, then its rows in order, in one task."""
    nothing = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    counts = F.struct(*_COUNTS).alias("counts")
    heads = found.select("conv_id", F.lit(0).alias("step"), *nothing(("turn", "long"), ("key", "string"), ("role", "string"),
                         ("text", "string"), ("copies", "int")), "audit", counts)
    tails = rows.where("copies > 0").select("conv_id", F.lit(1).alias("step"), "turn", "key", "role", "text", "copies",
                                           F.lit(None).cast("string").alias("audit"))
    both = heads.unionByName(tails, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "step", *ORDER).select(
        "conv_id", "role", "text", "copies", "audit", *[F.col(f"counts.{c}").alias(c) for c in _COUNTS])


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(head row or None, edited rows) in the order of the stream."""
    player = None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[4] is not None:
                player = replay(row[4])
                yield row, next(player)
            else:
                for _ in range(row[3]):
                    yield None, player.send((row[1], row[2]))


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, position, edit, role, text`` of the repaired conversations."""
    names = ["conv_id", "position", "edit", "role", "text"]

    def run(batches):
        out, conv, at, size = [], None, 0, 0
        for head, edits in _edited(batches):
            if head is not None:
                conv, at = head[0], 0
            for edit, role, text in edits:
                out.append((conv, at, edit, role, text))
                at, size = at + 1, size + len(text)
            if len(out) >= 2000 or size > 1 << 24:
                yield _columns(out, names)
                out, size = [], 0
        if out:
            yield _columns(out, names)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _stream(rows, found).mapInArrow(run, f"conv_id {kind}, position bigint, edit string, role string, text string")


def repair_report(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The columns of ``audits`` and the SHA-256 of the repaired ``role:text`` lines, joined by line feeds."""
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]

    def run(batches):
        out, head, digest, begun = [], None, None, False

        def done():
            return (head[0], *head[5:], head[4], digest.hexdigest())

        for new, edits in _edited(batches):
            if new is not None:
                if head is not None:
                    out.append(done())
                    if len(out) == 2000:
                        yield _columns(out, names)
                        out = []
                head, digest, begun = new, hashlib.sha256(), False
            for _, role, text in edits:
                digest.update((("\n" if begun else "") + role + ":" + text).encode())
                begun = True
        if head is not None:
            out.append(done())
        if out:
            yield _columns(out, names)

    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return _stream(rows, found).mapInArrow(run, schema)
