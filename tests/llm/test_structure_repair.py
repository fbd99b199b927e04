"""Conversation repair against recursion over whole strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from pagesmith.llm import structure_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, key string, step int, audit string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def best(rows):
    """Least (cost, audit), all strings compared as a whole."""

    @lru_cache(None)
    def go(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in (0, 3) else []

        def take(cost, letter, rest):
            if rest:
                found.append((cost + rest[0], letter + rest[1]))

        if i < len(rows):
            initial, must_go, cut = rows[i]
            take(4, "D", go(i + 1, state, 3))
            if not must_go:
                if (state, initial) in NEXT:
                    take(3 * cut, "K", go(i + 1, NEXT[state, initial], 3))
                for to in "ua":
                    if (state, to) in NEXT:
                        take(3 + 3 * cut, "R", go(i + 1, NEXT[state, to], 3))
        for to in "ua":
            if inserts and (state, to) in NEXT:
                take(3, "I", go(i, NEXT[state, to], inserts - 1))
        return min(found, default=None)

    return go(0, 0, 3)


def facts(rnd, n):
    return tuple((rnd.choice("suat" if rnd.random() < 0.3 else "ua"), rnd.random() < 0.2, rnd.random() < 0.2) for _ in range(n))


def test_cheapest_audit():
    rnd = random.Random(9)
    for _ in range(4000):
        rows = facts(rnd, rnd.randint(0, 16))
        assert repair.cheapest(list(rows)) == best(rows)


def test_long_ties():
    """Rows that all may be kept or paired in many ways."""
    for rows in [(("u", False, False),) * 150, (("a", False, False),) * 150, (("u", False, True), ("u", False, False)) * 70]:
        assert repair.cheapest(list(rows)) == best(rows)


def test_collisions_are_verified(monkeypatch):
    """With one hash for all blocks, names still tell them apart."""
    monkeypatch.setattr(repair, "PRIME", 1)
    rnd = random.Random(2)
    for _ in range(300):
        rows = facts(rnd, 12)
        assert repair.cheapest(list(rows)) == best(rows)


def test_comparison_of_persistent_strings():
    rnd = random.Random(4)
    audits, made = repair.Audits(), [(0, "")]
    for _ in range(300):
        node, text = rnd.choice(made[-6:])
        letter = rnd.choice("DK")
        made.append((audits.add(letter, node), letter + text))
    for _ in range(5000):
        (a, x), (b, y) = rnd.choice(made), rnd.choice(made)
        assert audits.less(a, b) == (x < y)
        assert audits.text(a) == x


def shown(value):
    return " " if value is None else str(value)


def brute(rows, damaged=True):
    held = defaultdict(list)
    for c, t, role, text in rows:
        role, text = shown(role), shown(text)
        kind = zlib.crc32(f"{shown(c)}:{shown(t)}".encode()) % 20 if damaged else 9
        key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        held[c] += [(t is not None, t or 0, key, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for c, v in held.items():
        v.sort()
        seen, found, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for *_, role, text in v:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            count[fault] += 1
            found.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {r[1] for r in v if r[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, audit = best(tuple(found))
        lines, at, last = [], 0, ""
        for edit in audit:
            role, text = "assistant" if last == "u" else "user", ""
            if edit in "DKR":
                given, text = v[at][3:]
                at += 1
                role = given if edit == "K" else role
            if edit != "D":
                lines.append((edit, role, text))
                last = role[:1]
        whole = "\n".join(f"{role}:{text}" for _, role, text in lines)
        out[c] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
                  hashlib.sha256(whole.encode()).hexdigest()), lines
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    said = ["Yes.", "no", "", None, " \t", "What?\n", "é 𝄞!", "word " * 4000]
    out = [(c, rnd.choice([t, t, t, None, t + 2]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rnd.choice(said))
           for c in range(60) for t in range(rnd.randint(1, 8))]
    out += [(None, t, "user", "no id.") for t in range(3)] + [out[0]] * 2
    return out + [(500, t, ("user", "assistant")[t % 2], f"{t % 30}.") for t in range(400)]


@pytest.mark.parametrize("damaged", [True, False])
def test_report_and_rows(spark, rows, damaged):
    table = spark.createDataFrame([(*r, "k", 1, "K") for r in rows], SCHEMA).repartition(3)
    given = repair.turns(table)
    given = repair.damage(given) if damaged else given
    found = repair.audits(given)
    want = brute(rows, damaged)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_report(given, found).collect()}
    assert got == {c: w[0] for c, w in want.items()}
    lines = defaultdict(list)
    for r in sorted(repair.repaired_rows(given, found).collect(), key=lambda r: r["position"]):
        assert r["position"] == len(lines[r["conv_id"]])
        lines[r["conv_id"]].append((r["edit"], r["role"], r["text"]))
    assert {c: w[1] for c, w in want.items() if w[1]} == dict(lines)


def test_conversation_without_rows_and_empty_table(spark):
    lost = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    for rows in ([(lost, 0, "user", "x", "k", 1, "")], []):
        given = repair.damage(repair.turns(spark.createDataFrame(rows, SCHEMA)))
        got = [tuple(r) for r in repair.repair_report(given, repair.audits(given)).collect()]
        assert got == [(r[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows]
