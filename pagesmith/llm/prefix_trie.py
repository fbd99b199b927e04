"""Prefix tries of conversations as double arrays.

Every conversation is a path of turns; the trie of all paths has one node per distinct prefix.

1. A turn becomes a 16-byte key of its role and text, a conversation one row with its keys in turn
   order. Texts are read once and never shuffled.
2. Paths are range-partitioned by (path, conversation) and sorted, so equal prefixes stand together
   and a path shared by very many conversations is spread over tasks. A *prefix shard* is a run of
   such rows in one task, at most ``SHARD_ROWS`` rows or ``SHARD_BYTES``.
3. In a shard turns get dense ids and the trie is packed into BASE and CHECK arrays: the child of the
   node in slot s by turn t lies in slot BASE[s] + t, where CHECK holds s. Ids are dealt in
   breadth-first order, so siblings mostly have neighbouring ids and slots are found at once. The
   paths are walked through the arrays for the aggregates of each node.
4. Only prefixes of a shard's first or last path can occur in other shards. All other nodes are final
   with their subtree. The shared upper nodes leave partial aggregates, keyed by a chained hash of
   their turns and merged globally: counts add up, a node is a leaf if no shard gave it a child, and
   what a merged node adds goes to the merged nodes above it. They are few: shards times depth.

Null roles and texts are empty strings; turns are ordered by (turn, null first; key), so ties and
repeated rows have one order. Rows without conversation id belong to no conversation and are left
out. An empty table has no node, not even the root. Only the named columns are read. A conversation
is one row of 20 bytes a turn, whatever the length of its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesmith.llm.common import stored, whole, words

SHARD_ROWS = 50_000
SHARD_BYTES = 16 << 20
KEY_BYTES = 16
ROOT = b"\0" * KEY_BYTES
NODE = (
    "node binary, parent binary, open boolean, parent_open boolean, depth bigint, words bigint, conv_id bigint, "
    "parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
    "ends string, first_end bigint, above array<binary>"
)


def turn_paths(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
               role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turns``: array of ``key, words`` in turn order."""
    role, text = whole(F.col(role_col)), whole(F.col(text_col))
    exact = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).isNotNull().alias("given"), F.col(turn_col).alias("turn"),
            F.left(F.sha2(exact, 256), F.lit(2 * KEY_BYTES)).alias("key"), F.size(words(text)).alias("words"),
        ).alias("t"),
    ).where("conv_id IS NOT NULL")
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"], t["words"])).alias("turns"))


def rebuilt(paths: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % every, h = crc32(c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    own = paths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"), "turns")
    # At most ``every`` conversations ask for one base, so the join has no hot key.
    bases = paths.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    nothing = F.slice("turns", 1, F.lit(0))
    joined = own.join(bases, "base", "left")
    head = F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


class DoubleArray:
    """BASE and CHECK over dense turn ids, packed from distinct sorted paths."""

    def __init__(self, paths: list[list[bytes]]):
        self.dense: dict[bytes, int] = {}
        self.base, self.check = [0], [0]
        self.order, self.depth, self.key = [0], {0: 0}, {0: b""}  # slots, parents first
        self._free = 1
        self._pack(paths)

    def _pack(self, paths: list[list[bytes]]):
        todo = [(0, 0, len(paths))]
        for slot, lo, hi in todo:  # grows while it is read: breadth first
            depth = self.depth[slot]
            if lo < hi and len(paths[lo]) == depth:
                lo += 1  # the path that ends here comes first
            groups, at = [], lo
            while at < hi:
                key, begin = paths[at][depth], at
                while at < hi and paths[at][depth] == key:
                    at += 1
                groups.append((self.dense.setdefault(key, len(self.dense) + 1), key, begin, at))
            if not groups:
                continue
            self.base[slot] = base = self._room([g[0] for g in groups])
            for turn, key, begin, end in groups:
                child = base + turn
                self.check[child], self.depth[child], self.key[child] = slot, depth + 1, key
                self.order.append(child)
                todo.append((child, begin, end))

    def _room(self, turns: list[int], tries: int = 64) -> int:
        """A base at which the slots of all these turns are free."""
        check, least, most = self.check, min(turns), max(turns)
        while self._free < len(check) and check[self._free] >= 0:
            self._free += 1
        at = self._free
        for _ in range(tries):
            base = at - least
            if all(base + t >= len(check) or check[base + t] < 0 for t in turns):
                break
            at += 1
        else:
            base = len(check) - least
        grow = base + most + 1 - len(check)
        if grow > 0:
            check.extend([-1] * grow)
            self.base.extend([0] * grow)
        return base

    def walk(self, path: list[bytes]) -> list[int]:
        """Slots from the root along a path; it ends where the trie does."""
        slots, slot = [0], 0
        for key in path:
            turn = self.dense.get(key)
            child = -1 if turn is None else self.base[slot] + turn
            if not 0 < child < len(self.check) or self.check[child] != slot:
                break
            slots.append(child)
            slot = child
        return slots


def shard_nodes(rows: list[tuple[int, bytes, list[int]]]) -> Iterator[tuple]:
    """Node rows of one prefix shard of (conversation, path, words per turn), sorted."""
    members: dict[bytes, list[int]] = {}
    counts: dict[bytes, list[int]] = {}
    for conv, path, sizes in rows:
        members.setdefault(path, []).append(conv)
        counts[path] = sizes
    paths = [[p[i:i + KEY_BYTES] for i in range(0, len(p), KEY_BYTES)] for p in members]
    trie = DoubleArray(paths)
    n = len(trie.check)
    convs, least, size, ends = [0] * n, [0] * n, [0] * n, {}
    shared = set()
    for nth, (path, (flat, ids)) in enumerate(zip(paths, members.items(), strict=True)):
        slots, first = trie.walk(path), min(ids)
        if nth in (0, len(paths) - 1):
            shared.update(slots)
        for slot in slots:
            least[slot] = min(least[slot], first) if convs[slot] else first
            convs[slot] += len(ids)
        for slot, w in zip(slots[1:], counts[flat], strict=True):
            size[slot] = w
        ends[slots[-1]] = ids
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for slot in reversed(trie.order):
        if slot not in shared:
            leaves[slot] += not children[slot]
            saved[slot] += (convs[slot] - 1) * size[slot]
            up = trie.check[slot]
            children[up] += 1
            leaves[up] += leaves[slot]
            saved[up] += saved[slot]
    name, above = {0: ROOT}, {0: [ROOT]}
    for slot in trie.order:
        up = trie.check[slot]
        if slot:
            name[slot] = hashlib.sha256(name[up] + trie.key[slot]).digest()[:KEY_BYTES]
        open_ = slot in shared
        if open_ and slot:
            above[slot] = [*above[up], name[slot]]
        own = ends.get(slot)
        yield (
            name[slot], name[up] if slot else None, open_, up in shared, trie.depth[slot], size[slot], least[slot],
            least[up] if slot else None, convs[slot], children[slot], leaves[slot], saved[slot],
            ",".join(map(str, own)) if own else None, own[0] if own else None, above.get(slot) if open_ else None,
        )


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            held.append(row)
            size += len(row[1]) + 64
            if len(held) >= SHARD_ROWS or size >= SHARD_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


_ARROW = {"binary": pa.binary(), "boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string(), "array<binary>": pa.list_(pa.binary())}
_FIELDS = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split(" ") for f in NODE.split(", "))])


def _nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _shards(batches):
        part = []
        for node in shard_nodes(rows):
            part.append(node)
            if len(part) == 5000:
                yield _batch(part)
                part = []
        if part:
            yield _batch(part)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the segments of each node, in the order given, joined by commas."""
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    node, digest = None, None
    for batch in batches:
        done = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], schema=schema)


def trie_nodes(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie of ``conv_id, turns``, and who ends at them.

    The first table has ``node`` (a key), ``depth, conv_id`` (the smallest member), ``parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens``; the second ``node, first_end, ends``: comma-joined conversations
    in ascending order, by segments that ``first_end`` orders.
    """
    flat = paths.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("path"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    )
    ranged = flat.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    made = stored(ranged.mapInArrow(_nodes, NODE))
    partial = made.where("open")
    merged = stored(partial.groupBy("node").agg(
        F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.max("words").alias("words"),
        F.min("conv_id").alias("conv_id"), F.any_value("above").alias("above"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    ))
    below = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_open"))
    full = merged.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("n_open", F.lit(0)))
    own_leaf = (F.col("n_children") == 0).cast("long")
    adds = full.select(
        F.explode("above").alias("node"), (F.col("n_leaves") + own_leaf).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    ).groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("merged_parent"))
    out = ["node", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    upper = (
        full.drop("n_leaves", "saved_tokens").join(adds, "node").join(parents, "parent", "left")
        .withColumnRenamed("merged_parent", "parent_conv_id").select(*out)
    )
    inner = made.where("NOT open")
    under = inner.where("parent_open").drop("parent_conv_id").join(parents, "parent").withColumnRenamed("merged_parent", "parent_conv_id")
    nodes = inner.where("NOT parent_open").select(*out).unionByName(under.select(*out)).unionByName(upper)
    return nodes, made.where("ends IS NOT NULL").select("node", "first_end", "ends", "open")


def ends_digest(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes with ``ends_sha256``; segments of shared nodes are streamed in order, never joined in memory."""
    own = ends.where("NOT open").select("node", F.sha2("ends", 256).alias("ends_sha256"))
    segments = ends.where("open").select("node", "first_end", "ends").repartition("node").sortWithinPartitions("node", "first_end")
    every = own.unionByName(segments.mapInArrow(_digests, "node binary, ends_sha256 string"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(every, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))


def conversation_trie(conversations: DataFrame, every: int = 20, most: int = 4, **columns: str) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node."""
    nodes, ends = trie_nodes(rebuilt(turn_paths(conversations, **columns), every, most))
    return ends_digest(nodes, ends).drop("node")
