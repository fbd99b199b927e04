"""Operator 9: exact Jaccard join of word shingle sets, and its components.

Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.8 or
more. Documents with equal sets are one *class*, so copies are never paired. A set that links
to another of 0.8 times its size or more shares a shingle with it among its first ``size -
ceil(0.8 size) + 1`` shingles in any global order; the order here puts shingles that stand in
many documents last, so passages that unrelated documents share seldom count.

1. *Stars.* Classes that share a shingle of their prefixes form a tile. Every class is compared
   with the first class of each of its tiles: as many pairs as tile members, and most tiles of
   a group of copies have the same first class.
   This is repeated with another hub for each tile that holds several components, as long as
   it lessens the pairs between components by a quarter, and they are more than ``LINEAR`` times
   the rows of tiles.
2. *Tiles.* Tiles that hold more than one component are split into size bands and blocks; in
   each, hashed bitmaps of all pairs of different components bound the overlap from above. A bitmap
   has a bit for each element or more, so that it tells large sets apart as well as small ones.
3. Pairs within the bound are compared exactly by intersecting the sorted arrays, grouped so
   that a task holds a bounded number of elements, in rounds that each send at most half as many
   elements as the sets have (or ``ROUND``), whose files are deleted before the next; components are
   found by star contraction.

A link's two classes share a tile, so they are compared there unless a component has them
already: components are exact. The frequent shingles are counted over all sets among the
lowest quarter of hash values, where prefixes come from; they are fewer than ``HOT`` by
construction, as each counts for more than 1/HOT of all shingles; copies in one task count once.
Texts are read once: the sets are stored, one per class and task, 8 bytes an element. The order decides the work,
never the result. Lists of classes are broadcast up to ``SMALL`` rows, otherwise joined.

Null, empty and blank texts have an empty set, no links, and are components of their own. A
null id is never the smallest one. Repeated rows are copies; other columns are ignored. Shingles
and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from pagesmith.llm.common import discard, stored, whole
from pagesmith.llm.shingles import U, bitmap, set_class, shingle_sets

PERCENT = 80
HOT = 400_000
SMALL = 2_000_000
LOW = U(1 << 62)
BLOCK = 2048
FEW = 16
ELEMENTS = 500_000
SLICE = 1 << 22
LINEAR = 8
SLOW = 0.75
ROUND = 1 << 22
ROWS = 500
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


def _binary(items: list[bytes]) -> pa.Array:
    return pa.array(items, pa.binary())


def shingled(docs: DataFrame) -> DataFrame:
    """``id, c, size, bits, s``: class and set size of every document of ``id, text``.

    The sorted set ``s`` and its bitmap stand in the first row of a class in its task, else null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names = ["id", "c", "size", "bits", "s"]
        for batch in batches:
            ids, at, held = batch.column("id"), 0, 0
            cs, sizes, bits, sets = [], [], [], []

            def part() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(cs)), pa.array(cs, pa.int64()), pa.array(sizes, pa.int64()), _binary(bits), _binary(sets)], names
                )

            for s in (s for i in range(0, len(ids), 500) for s in shingle_sets(_texts(batch.slice(i, 500)))):
                c = set_class(s)
                new = len(s) > 0 and c not in seen
                if new:
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(c)
                    held += s.nbytes
                cs.append(c)
                sizes.append(len(s))
                bits.append(bitmap(s) if new else None)
                sets.append(s.tobytes() if new else None)
                if held > SLICE:
                    yield part()
                    at, held = at + len(cs), 0
                    cs, sizes, bits, sets = [], [], [], []
            yield part()

    schema = StructType([
        docs.schema["id"], StructField("c", LongType()), StructField("size", LongType()),
        StructField("bits", BinaryType()), StructField("s", BinaryType()),
    ])
    return docs.mapInArrow(run, schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of batches of about SLICE bytes of sets, and the sets as views of the batch's memory."""
    for batch in batches:
        column = batch.column("s").cast(pa.large_binary())
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
            yield batch.slice(at, end - at), [data[ends[i] : ends[i + 1]].view(U) for i in range(at, end)]
            at = end


def frequent_shingles(sets: DataFrame, total: int) -> np.ndarray:
    """Shingles among the lowest hash values that stand in more than about ``total / HOT`` stored sets.

    A slice of sets tells only of shingles it holds twice or more, so what stands once in a slice here and there
    may be missed; that changes the work, not the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _slices(batches):
            low = [s[: np.searchsorted(s, LOW)] for s in part]
            tokens, n = np.unique(np.concatenate(low), return_counts=True)
            tokens, n = tokens[n > 1], n[n > 1]
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    counts = sets.select("s").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    hot = counts.filter(F.col("n") > max(32, total // HOT)).select("token").toArrow()["token"]
    return np.sort(hot.to_numpy().astype(np.int64).view(U))


def prefixes(sets: DataFrame, hot: np.ndarray) -> DataFrame:
    """``token, c, size``: the prefix shingles of every stored set."""
    shared = sets.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch, part in _slices(batches):
            tokens, reps, sizes = [], [], []
            for s in part:
                need = len(s) + -(-PERCENT * len(s) // 100) * -1 + 1
                if len(last):
                    at = np.searchsorted(last, s)
                    late = last[np.minimum(at, len(last) - 1)] == s
                    s = np.concatenate([s[~late], s[late]])
                tokens.append(s[:need].copy())
                reps.append(need)
                sizes.append(len(s))
            cs = batch.column("c").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(cs, reps)),
                pa.array(np.repeat(np.array(sizes, np.int64), reps)),
            ], ["token", "c", "size"])

    return sets.select("c", "s").mapInArrow(run, "token long, c long, size long")


def size_fits(a: str, b: str):
    return (PERCENT * F.col(a) <= 100 * F.col(b)) & (PERCENT * F.col(b) <= 100 * F.col(a))


def within_bound(size_a, size_b, bits_a: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """Whether the overlap can be large enough: bitmaps that differ in d places differ in d elements."""
    differ = np.bitwise_count(bits_a ^ bits_b).sum(-1, dtype=np.int64)
    total = size_a + size_b
    return (100 + PERCENT) * ((total - differ) // 2) >= PERCENT * total


def _bits(column: list[bytes]) -> np.ndarray:
    """The bitmaps as rows of the shortest one's width; a longer one is folded, its halves added."""
    rows = [np.frombuffer(x, np.uint64) for x in column]
    width = min(map(len, rows))
    return np.stack([x if len(x) == width else np.bitwise_xor.reduce(x.reshape(-1, width), 0) for x in rows])


@F.pandas_udf(BooleanType())
def bound_udf(sa: pd.Series, sb: pd.Series, ba: pd.Series, bb: pd.Series) -> pd.Series:
    sa, sb, ba, bb = (x.to_numpy() for x in (sa, sb, ba, bb))
    width = np.array([min(len(x), len(y)) for x, y in zip(ba, bb, strict=True)], np.int64)
    out = np.zeros(len(sa), bool)
    for w in np.unique(width):
        same = np.flatnonzero(width == w)
        for i in np.split(same, range(1000, len(same), 1000)):
            bits = _bits([*ba[i], *bb[i]])
            out[i] = within_bound(sa[i], sb[i], bits[: len(i)], bits[len(i) :])
    return pd.Series(out)


def small(df: DataFrame) -> DataFrame:
    """The table, broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def compared(sets: DataFrame, homes: DataFrame, sends: DataFrame) -> DataFrame:
    """``a, b``: the links of hubs ``a`` with the other classes ``c`` sent to the same part.

    A class that several tasks have stored goes there with the set of its home, ``c, task``.
    """

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hub = key[0].item() if hasattr(key[0], "item") else key[0]
        rows = rows.drop_duplicates("c")
        own = rows["s"][rows["c"] == hub]
        if not len(own):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        x = np.frombuffer(own.iloc[0], U)
        found = []
        for c, data in zip(rows["c"], rows["s"], strict=True):
            y = np.frombuffer(data, U)
            if c != hub:
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    found.append(c)
        return pd.DataFrame({"a": np.full(len(found), hub, np.int64), "b": np.array(found, np.int64)})

    needed = stored(homes.join(sends.select("c").distinct(), "c"))
    sent = sets.join(small(needed), ["c", "task"], "left_semi").join(small(sends), "c")
    found = stored(sent.groupBy("a", "part").applyInPandas(compare, "a long, b long"))
    discard(needed)
    return found


def linked(sets: DataFrame, homes: DataFrame, pairs: DataFrame, room: int) -> DataFrame:
    """The pairs ``a, b`` (sizes ``sa, sb``) whose sets link, by exact intersection.

    Pairs are grouped by ``a`` in parts of at most ELEMENTS elements or one set; the set of
    ``a`` is sent to every part. Parts are dealt to as many rounds as it takes for one to send
    about ``room`` elements; a round's shuffle is gone before the next one begins.
    """
    pairs = stored(pairs)
    parts = pairs.groupBy("a").agg(F.ceil(F.sum("sb") / ELEMENTS).cast("int").alias("parts"), F.first("sa").alias("sa"))
    dealt = pairs.join(parts.select("a", "parts"), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    hubs = parts.select("a", "sa", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
    sends = stored(dealt.select("a", "part", F.col("b").alias("c"), F.col("sb").alias("n")).union(
        hubs.select("a", "part", F.col("a").alias("c"), F.col("sa").alias("n"))))
    rounds = max(1, -(-(sends.agg(F.sum("n")).first()[0] or 0) // room))
    discard(pairs)
    # another hash than the shuffle's, so that a round has all partitions
    turn = F.pmod(F.xxhash64("a", "part", F.lit("round")), F.lit(rounds))
    found = [compared(sets, homes, sends.filter(turn == k).select("a", "part", "c")) for k in range(rounds)]
    out = found[0] if rounds == 1 else stored(reduce(DataFrame.union, found).coalesce(rounds))
    discard(sends, *(found if rounds > 1 else []))
    return out


def contract(edges: DataFrame) -> DataFrame:
    """``a, b``: every class of an edge with the smallest class it reaches, itself left out.

    Alternates large and small stars until nothing changes.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before, old = None, []
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.least("m", "a").alias("b")
        ).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = stored(
            large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .filter("a <> b").distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first()
        for table in old:
            discard(table)
        if now == before:
            return edges
        before, old = now, [edges]


def with_root(df: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``c`` with ``root``, the class itself where it has no link."""
    own = roots.select(F.col("a").alias("c"), F.col("b").alias("_root"))
    return df.join(own, "c", "left").withColumn("root", F.coalesce("_root", "c")).drop("_root")


def _block_pairs(
    tile: int, c: np.ndarray, size: np.ndarray, root: np.ndarray, band: np.ndarray, bits: np.ndarray, before: list[list[int]]
) -> np.ndarray:
    """``a, b, sa, sb`` of a pair of blocks: its classes of the tile's band with each other and with those below.

    Two classes that also meet in a tile before this one, by token, are a pair of that tile.
    """
    order = np.argsort(c)
    before = [frozenset(before[i]) for i in order]
    c, size, root, top, bits = c[order], size[order], root[order], band[order] == tile, bits[order]
    places, n, out = np.flatnonzero(top), len(c), []
    step = max(1, (1 << 18) // max(n, 1))
    for at in range(0, len(places), step):
        i = places[at : at + step][:, None]
        j = np.arange(n)[None, :]
        fits = (~top[j] | (j > i)) & (root[j] != root[i])
        fits &= (PERCENT * size[j] <= 100 * size[i]) & (PERCENT * size[i] <= 100 * size[j])
        every, others = np.nonzero(fits)
        some = max(1, SLICE // bits.shape[1] // 8)
        for k in range(0, len(every), some):
            x, y = i[every[k : k + some], 0], others[k : k + some]
            near = within_bound(size[x], size[y], bits[x], bits[y])
            x, y = x[near], y[near]
            first = np.fromiter((before[i].isdisjoint(before[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
            x, y = x[first], y[first]
            low, high = np.minimum(x, y), np.maximum(x, y)
            out.append(np.stack([c[low], c[high], size[low], size[high]], 1))
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs within the bound of rows that are sorted by block; a block may go on in the next batch."""
    keys, rest = ["token", "tile", "lo", "hi"], None

    def pairs_of(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        tile, *columns = [rows[k].to_numpy().astype(np.int64) for k in ("tile", "c", "size", "root", "band")]
        bits, before = rows["bits"].to_pylist(), rows["before"]
        parts, start = [np.zeros((0, 4), np.int64)], 0
        for end in ends:
            parts.append(_block_pairs(tile[start], *[x[start:end] for x in columns], _bits(bits[start:end]), before[start:end].to_pylist()))
            start = end
        got = np.concatenate(parts)
        return pa.RecordBatch.from_arrays([pa.array(got[:, k]) for k in range(4)], ["a", "b", "sa", "sb"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        if not len(rows):
            continue
        names = [rows[k].to_numpy() for k in keys]
        ends = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
        if len(ends):
            yield pairs_of(rows, ends)
            rows = rows.slice(ends[-1])
        rest = rows
    if rest is not None and len(rest):
        yield pairs_of(rest, np.array([len(rest)]))


def tile_pairs(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of different roots within the bound, from the tiles of ``token, c, size, root``.

    A class meets those of its own size band and of the band below; bands are a factor of 1.25.
    Tiles of up to FEW classes are joined with themselves. Larger ones are cut into blocks of
    about BLOCK classes, and each pair of blocks is compared in one group by its bitmaps. The pair
    comes from the first tile the two share, small or large, so it is made once, however many they share.
    """
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(1.25)) + 1e-9).cast("int")
    tiles = members.groupBy("token").agg(F.count("*").alias("n"))
    rows = stored(members.withColumn("band", band).join(tiles, "token"))
    few = rows.filter(F.col("n") <= FEW)
    left = few.select("token", "band", F.col("c").alias("a"), F.col("size").alias("sa"), F.col("root").alias("ra"))
    right = few.select(
        "token", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), F.col("c").alias("b"),
        F.col("size").alias("sb"), F.col("root").alias("rb"),
    )
    plain = left.join(right, ["token", "band"]).filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & size_fits("sa", "sb"))
    plain = bounded(plain.select("a", "b", "sa", "sb").distinct(), sketches)

    many = rows.filter(F.col("n") > FEW).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).join(sketches.select("c", "bits"), "c")
    tokens = rows.groupBy("c").agg(F.collect_set("token").alias("tokens"))
    many = many.join(tokens, "c").withColumn("before", F.filter("tokens", lambda t: t < F.col("token"))).drop("tokens")
    # to the groups (block, k) and (k, block) of its own band and of the one above
    sent = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "tile", F.explode(F.array("band", F.col("band") + 1))
    ).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    keys = ["token", "tile", "lo", "hi"]
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.select(*keys, "c", "size", "root", F.col("band").cast("long").alias("band"), "bits", "before")
    blocks = sent.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(_compare_blocks, "a long, b long, sa long, sb long")
    return plain.union(blocks).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of every document."""
    # texts, sets and bitmaps come to Python in small batches, however large they are
    session = docs.sparkSession
    before = session.conf.get(BATCH)
    session.conf.set(BATCH, min(ROWS, int(before)) if int(before) > 0 else ROWS)
    try:
        return _components(docs, id_col, text_col)
    finally:
        session.conf.set(BATCH, before)


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole_sets = stored(shingled(docs).withColumn("task", F.spark_partition_id()))
    own = stored(whole_sets.select("id", "c", "size"))
    sets = whole_sets.filter("s is not null").select("c", "size", "bits", "s", "task")
    total = sets.agg(F.sum("size")).first()[0] or 0
    sketches = sets.groupBy("c").agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.min("task").alias("task"))
    sets = sets.select("c", "task", "s")
    found = prefixes(sets, frequent_shingles(sets, total)).repartition("token").distinct()
    tiles = found.groupBy("token").agg(
        F.min("c").alias("first"), F.max("c").alias("_last"), F.min_by("size", "c").alias("first_size")
    ).filter("first < _last").drop("_last")
    members = stored(found.join(tiles, "token"))
    del found, tiles  # with them goes the shuffle of all prefixes
    # Only classes that share a prefix shingle with another class are compared from here on.
    met = stored(members.select("c").distinct())
    sketches = stored(sketches.join(small(met), "c", "left_semi"))
    homes = sketches.select("c", "task")
    room = max(ROUND, (sketches.agg(F.sum("size")).first()[0] or 0) // 2)
    discard(met)
    pairs = members.filter((F.col("c") != F.col("first")) & size_fits("size", "first_size")).select(
        F.col("first").alias("a"), F.col("c").alias("b"), F.col("first_size").alias("sa"), F.col("size").alias("sb")
    ).distinct()
    found = linked(sets, homes, bounded(pairs, sketches), room)
    roots = contract(found)
    del pairs
    discard(found)
    members, before, turn = members.select("token", "c", "size"), None, 0
    while True:
        opened = open_tiles(with_root(members, roots))
        discard(members)
        members = opened
        work = pair_work(members)
        if work <= LINEAR * members.count() or (before is not None and work > SLOW * before):
            break
        before, turn = work, turn + 1
        found = linked(sets, homes, bounded(star_pairs(members, turn), sketches), room)
        joined = contract(roots.union(found))
        discard(roots, found)
        roots, members = joined, members.drop("root")
    found = linked(sets, homes, tile_pairs(members, sketches), room)
    joined = contract(roots.union(found))
    discard(roots, found, members, sketches, whole_sets)
    roots = joined
    rooted = with_root(own.select("id", "c", F.col("size").alias("n_shingles")), roots)
    least = rooted.groupBy("root").agg(F.min("id").alias("_least"))
    return rooted.join(least, "root").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("_least")).alias("component_id"),
    )


def open_tiles(placed: DataFrame) -> DataFrame:
    """The rows ``token, c, size, root`` of tiles with several roots; of tiles with the same rows one stays."""
    placed = stored(placed)
    kept = placed.groupBy("token").agg(
        F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("_n"), F.sum(F.xxhash64("c").cast("decimal(20,0)")).alias("_sum")
    ).filter("_lo < _hi").dropDuplicates(["_n", "_lo", "_hi", "_sum"]).select("token")
    opened = stored(placed.join(kept, "token", "left_semi"))
    discard(placed)
    return opened


def pair_work(members: DataFrame) -> float:
    """How many pairs of different roots the tiles hold."""
    same = members.groupBy("token", "root").count().groupBy("token").agg(
        F.sum("count").cast("double").alias("n"), F.sum(F.col("count") * F.col("count").cast("double")).alias("own")
    )
    return same.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()[0] or 0.0


def star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Every class of a tile with the tile's hub of this turn, if their roots differ."""
    hubs = members.groupBy("token").agg(F.min_by(
        F.struct(F.col("c").alias("b"), F.col("size").alias("sb"), F.col("root").alias("rb")), F.xxhash64("c", "token", F.lit(turn))
    ).alias("_hub"))
    met = members.join(hubs.select("token", "_hub.*"), "token").filter((F.col("root") != F.col("rb")) & size_fits("size", "sb"))
    less = F.col("c") < F.col("b")
    return met.select(
        F.least("c", "b").alias("a"), F.greatest("c", "b").alias("b"), F.when(less, F.col("size")).otherwise(F.col("sb")).alias("sa"),
        F.when(less, F.col("sb")).otherwise(F.col("size")).alias("sb"),
    ).distinct()


def bounded(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose bitmaps allow a link."""
    a = sketches.select(F.col("c").alias("a"), F.col("bits").alias("_ba"))
    b = sketches.select(F.col("c").alias("b"), F.col("bits").alias("_bb"))
    return pairs.join(a, "a").join(b, "b").filter(bound_udf("sa", "sb", "_ba", "_bb")).select("a", "b", "sa", "sb")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that of the smallest id; those without words all stay.

    Rows are told apart by the id and a hash of the text, so different texts with the same id, or
    without one, are documents of their own. Of equal ids in a component the one with the least
    hash stays, of repeated rows one.
    """
    digest = F.xxhash64(whole(F.col(text_col)))
    # null ids come last
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), digest.alias("digest"))
    groups = stored(components(docs.select(key.alias("_key"), F.col(text_col).alias("_text")), "_key", "_text"))
    kept = groups.filter("component_id = _key").select(F.col("_key.id").alias("_kept"), F.col("_key.digest").alias("_digest")).distinct()
    rows = docs.join(small(kept), F.col(id_col).eqNullSafe(F.col("_kept")) & (digest == F.col("_digest")), "left_semi")
    if groups.filter("n_shingles > 0").groupBy("_key").count().filter("count > 1").limit(1).count():
        filled = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        rows = rows.withColumn("_digest", digest)
        rows = rows.filter(filled).dropDuplicates([id_col, "_digest"]).union(rows.filter(~filled)).drop("_digest")
    return rows
