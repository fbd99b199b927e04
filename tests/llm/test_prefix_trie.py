"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from math import fmod

import pytest

from pagesmith.llm import prefix_trie
from pagesmith.llm.prefix_trie import DoubleArray

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    given = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            given[c].append((t is not None, t or 0, key(role, text), role, text))
    turns = {c: [r[3:] for r in sorted(v)] for c, v in given.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = turns.get(c - int(fmod(c, 20)), [])[:h] + own[h:]
    members, below = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    leaves, saved = {}, {}
    for node in members:
        if node:
            below[node[:-1]].append(node)
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in below[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in below[node])
    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(paths[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(ids), len(node), parent, len(ids), len(below[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    said = ["a b.", "", None, "c", " \n", "é 𝄞 é", "long " * 3000]
    out = []
    for c in [*range(-3, 130), 10_000]:
        same = c % 3 == 0  # a third of all conversations are one
        for t in range(rnd.randint(1, 6) if not same else 4):
            role, text = (("user", "a b."), ("assistant", "c"))[t % 2] if same else (rnd.choice(["user", None, "system"]), rnd.choice(said))
            out.append((c, rnd.choice([t, t, None]) if not same else t, role, text))
    out += [out[5]] * 3 + [(None, 1, "user", "x"), (7, None, None, None)]
    out += [(200, t, "user", f"turn {t % 5}") for t in range(300)] + [(201, t, "user", f"turn {t % 5}") for t in range(300)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "x", -1) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("shard", [1, 7, 50_000])
def test_nodes(table, rows, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard)
    got = prefix_trie.conversation_trie(table).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_turnless_conversation(spark):
    """All own turns replaced by a base that does not exist: only the root is left."""
    lost = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    table = spark.createDataFrame([(lost, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in prefix_trie.conversation_trie(table).select(*COLUMNS).collect()]
    assert got == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_double_array_finds_its_paths_only():
    rnd = random.Random(1)
    paths = sorted({tuple(bytes([rnd.randint(0, 40)]) for _ in range(rnd.randint(0, 6))) for _ in range(800)})
    trie = DoubleArray([list(p) for p in paths])
    prefixes = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert len(trie.order) == len(prefixes)
    slots = {tuple(trie.walk(list(p))) for p in prefixes}
    assert len(slots) == len(prefixes)
    for _ in range(2000):
        p = tuple(bytes([rnd.randint(0, 42)]) for _ in range(rnd.randint(0, 6)))
        held = max(d for d in range(len(p) + 1) if p[:d] in prefixes)
        assert len(trie.walk(list(p))) == held + 1
