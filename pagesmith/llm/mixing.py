"""Operator 6: mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. Words flow
from patterns to sources: the first pass over a pattern costs 0, the second 1, and so on, so
documents are repeated only where a quota asks for it, evenly. The flow network has one node
per pattern and source, never one per document, and is solved on the driver; more than
``MAX_PATTERNS`` patterns are an error, not a cut. A pattern's flow is full passes over all of
its documents and one part pass over the first ones in a seeded order; the last document of the
part pass gives only the words that are missing.

The part pass is found without a global sort: words are summed per pattern and bucket of the
seeded order, the bucket that holds the cut is found from these sums, and only its documents
are ordered. Null texts have size 0 and give nothing; a null source is a source, the last by
order; repeated rows are documents of their own, equal but for the place of the cut; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesmith.llm.common import stored, whole, words

MAX_PATTERNS = 20_000
WEIGHTS = (3, 1, 2)
DRAW = 1.5
PASSES = 2
SEED = 20
BUCKET_DIGITS = 4  # hexadecimal digits of the seeded order, 65,536 buckets per pattern


def targets(sizes: dict, weights: dict, draw: float = DRAW, passes: int = PASSES) -> dict:
    """Words per source: shares by weight, no source above ``passes`` times its size."""
    want, open_, out = draw * sum(sizes.values()), dict(weights), {}
    while open_:
        unit = max(0.0, want - sum(out.values())) / sum(open_.values())
        full = {s for s in open_ if unit * open_[s] > passes * sizes[s]}
        if not full:
            return out | {s: unit * w for s, w in open_.items()}
        for s in full:
            out[s] = float(passes * sizes[s])
            del open_[s]
    return out


def route(sizes: dict, quotas: dict, passes: int = PASSES) -> dict:
    """Words that each (pattern, source) gives: a min-cost flow by successive shortest paths.

    ``sizes``: words of each pattern, a tuple of sources; ``quotas``: whole words per source.
    Pass k over a pattern costs k a word.
    """
    nodes = {("p", p): 1 + i for i, p in enumerate(sizes)}
    nodes |= {("s", s): 1 + len(nodes) + i for i, s in enumerate(quotas)}
    source, sink = 0, len(nodes) + 1
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    head, room, cost = [], [], []

    def arc(a: int, b: int, cap: int, price: int) -> None:
        for u, v, c, k in ((a, b, cap, price), (b, a, 0, -price)):
            graph[u].append(len(head))
            head.append(v)
            room.append(c)
            cost.append(k)

    links = {}
    for p, size in sizes.items():
        for k in range(passes):
            arc(source, nodes["p", p], size, k)
        for s in p:
            if s in quotas:
                links[p, s] = len(head)
                arc(nodes["p", p], nodes["s", s], passes * size, 0)
    for s, quota in quotas.items():
        arc(nodes["s", s], sink, quota, 0)
    height = [0] * (sink + 1)
    while True:
        far: list[float] = [float("inf")] * (sink + 1)
        far[source], via, heap = 0, {}, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in graph[u]:
                v, nd = head[e], d + cost[e] + height[u] - height[head[e]]
                if room[e] > 0 and nd < far[v]:
                    far[v], via[v] = nd, e
                    heapq.heappush(heap, (nd, v))
        if sink not in via:
            break
        height = [h + (f if f < float("inf") else 0) for h, f in zip(height, far, strict=True)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = head[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return {key: room[e ^ 1] for key, e in links.items() if room[e ^ 1]}


def take(sized: DataFrame, flows: dict, pattern_key: Column, order: Column) -> DataFrame:
    """``sized`` with ``taken``: the words each document gives so that patterns give their flow.

    ``flows``: words and size by pattern key.
    """
    spark = sized.sparkSession
    plan = spark.createDataFrame(
        [(k, flow // size, flow % size) for k, (flow, size) in flows.items() if size > 0],
        "_plan_key string, _full long, _part long",
    )
    keyed = sized.withColumn("_key", pattern_key).withColumn("_order", order)
    keyed = keyed.withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    sums = keyed.filter(F.col("size") > 0).groupBy("_key", "_bucket").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("_key").orderBy("_bucket")
    edge = (
        sums.withColumn("_upto", F.sum("_words").over(upto))
        .join(F.broadcast(plan), F.col("_key") == F.col("_plan_key"))
        .filter((F.col("_upto") > F.col("_part")) & (F.col("_upto") - F.col("_words") <= F.col("_part")))
        .select("_plan_key", "_full", F.col("_bucket").alias("_cut"), (F.col("_part") - F.col("_upto") + F.col("_words")).alias("_rest"))
    )
    rows = keyed.join(F.broadcast(stored(edge)), F.col("_key") == F.col("_plan_key"), "left")
    full = F.coalesce(F.col("_full"), F.lit(0)) * F.col("size")
    inside = F.col("_bucket") == F.col("_cut")
    plain = rows.filter(~F.coalesce(inside, F.lit(False))).withColumn(
        "taken", full + F.when(F.col("_bucket") < F.col("_cut"), F.col("size")).otherwise(0)
    )
    before = F.sum("size").over(
        Window.partitionBy("_key").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    cut = rows.filter(inside).withColumn("_before", F.coalesce(before, F.lit(0))).withColumn(
        "taken", full + F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_before")))
    )
    return plain.unionByName(cut.drop("_before")).drop(
        "_key", "_order", "_bucket", "_plan_key", "_full", "_cut", "_rest"
    )


def mix(
    docs: DataFrame, draw: float = DRAW, passes: int = PASSES, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED,
    id_col: str = "doc_id", sources: Column | None = None, text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id, size, source_size, target, taken`` and the columns in ``keep`` of every document.

    ``sources``: an array of the document's sources, by default that of its ``source`` column.
    ``source_size`` and ``target`` are those of its sources, added up.
    """
    members = F.array(F.col("source")) if sources is None else sources
    text = whole(F.col(text_col))
    order = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(text)))
    sized = stored(docs.select(
        F.col(id_col), F.size(words(text)).cast("long").alias("size"), F.array_sort(F.array_distinct(members)).alias("_of"),
        order.alias("_draw"), *keep,
    ))
    found = sized.groupBy("_of").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["_of"]): r["n"] for r in found}
    names = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    reach = {s: sum(n for p, n in patterns.items() if s in p) for s in names}
    goal = targets(reach, {s: weights[i % len(weights)] for i, s in enumerate(names)}, draw, passes)
    flow: dict = {}
    for (p, _), n in route(patterns, {s: floor(goal[s]) for s in names}, passes).items():
        flow[p] = flow.get(p, 0) + n
    label = {p: str(i) for i, p in enumerate(patterns)}
    key_rows = sized.sparkSession.createDataFrame(
        [(label[p], list(p), sum(reach[s] for s in p), float(sum(goal[s] for s in p))) for p in patterns],
        "_label string, _pattern array<string>, source_size long, target double",
    )
    marked = sized.join(F.broadcast(key_rows), F.col("_of").eqNullSafe(F.col("_pattern"))).drop("_pattern", "_of")
    flows = {label[p]: (flow.get(p, 0), patterns[p]) for p in patterns}
    out = take(marked, flows, F.col("_label"), F.col("_draw"))
    return out.select(id_col, "size", "source_size", "target", "taken", *keep)


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """All columns of the documents, ``_size`` and ``_taken``."""
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"), F.struct("*").alias("_row")
    )
    mixed = mix(rows, id_col="_id", text_col="_text", sources=F.array("_source"), keep=("_row",), **options)
    return mixed.select("_row.*", F.col("size").alias("_size"), F.col("taken").alias("_taken"))
