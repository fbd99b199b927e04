"""Operators against brute force on small tables with nulls, repeated rows, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from math import log10

import numpy as np
import pytest

from pagesmith.llm import (
    fingerprint, line_dedup, lm, mixing, ngram_join, packing, quality, secret_scan, sharding, url_filter,
)
from pagesmith.llm.shingles import bitmap

SCHEMA = "doc_id long, text string, source string, size long, rn long, bucket string, _row string"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return BLANK.findall(text or "")


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, source): prose with copies, near copies, shared passages, odd values."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice(["ta", "lo", "ri", "ne", "so"]) for _ in range(rnd.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = [line(20) for _ in range(3)]
    out = []
    for i in range(30):
        lines = [line(rnd.randint(3, 25)) for _ in range(rnd.randint(2, 6))]
        if i % 4 == 0:
            lines[1:1] = passage
        out.append((i, "\n".join(lines), f"s{i % 3}"))
    near = out[1][1].split(" ")
    near[5] = "changed"
    out += [
        (30, out[1][1], "s1"), (31, " ".join(near), None), (32, out[1][1].upper(), "s0"), (33, None, "s0"), (34, "", None),
        (35, " \n\t", "s2"), (36, "one two", "s1"), (37, "one two", "s1"), (2, out[2][1], "s2"), (2, out[2][1], "s2"), (None, "no id here", "s0"),
        (38, "tok " * 3000, "s0"), (39, "é€𝄞 x\n" * 40, "s1"),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, -1, -1, "x", "y") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string")
    for df in (
        sharding.assign_shards(empty), packing.pack(empty), mixing.mix(empty), quality.judge(empty), quality.clean(empty),
        line_dedup.dedup_lines(empty), fingerprint.fingerprint_edits(empty), ngram_join.components(empty),
        secret_scan.scan(empty), lm.score(empty), url_filter.judge(pages),
    ):
        assert df.count() == 0


def test_shards(docs, rows):
    got = sharding.assign_shards(docs, 5).collect()
    assert len(got) == len(rows)
    sizes = {s: sum(r["size"] for r in got if r["shard"] == s) for s in range(5)}
    largest = max(r["size"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert ids == sorted(ids)
    expected = sorted((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == expected


def test_packing(docs, rows):
    got = packing.pack(docs, buckets=3, budget=200).collect()
    lengths = sorted(len(words(t)) for _, t, _ in rows)
    assert sorted(r["n_tokens"] for r in got) == lengths
    values = sorted(set(lengths))
    best = min(
        sum(min(e for e in ends if e >= n) - n for n in lengths)
        for k in range(3) for ends in ([*c, values[-1]] for c in combinations(values[:-1], k))
    )
    assert sum(r["padding"] for r in got) == best
    for key in {(r["bucket"], r["batch"]) for r in got}:
        group = [r for r in got if (r["bucket"], r["batch"]) == key]
        assert len(group) == 1 or len(group) * group[0]["bucket_len"] <= 200 or group[0]["bucket_len"] == 0
        assert sorted(r["slot"] for r in group) == list(range(len(group)))


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = mixing.targets(size, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)})
    assert sum(goal.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(goal[s] <= 2 * size[s] for s in names)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for s in names:
        own = [r for r in got if r["source_size"] == size[s] and r["target"] == pytest.approx(goal[s])]
        assert sum(r["taken"] for r in own) == int(goal[s])
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_flow_shares_overlapping_sources():
    sizes = {("a",): 10, ("a", "b"): 10, ("b",): 2}
    flow = mixing.route(sizes, {"a": 12, "b": 12})
    assert sum(flow.values()) == 24
    used = {p: sum(n for (q, _), n in flow.items() if q == p) for p in sizes}
    # 22 words once cost nothing; only 2 words are repeated
    assert sum(max(0, used[p] - sizes[p]) for p in sizes) == 2


def test_quality(docs, rows):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.judge(docs, min_docs=3, share=0.01).collect()}
    for i, t, _ in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        marked = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)} if len(w) < 500 else set(range(len(w)))
        r = got[i, len(w)]
        assert (r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, w)), len(lines) - len(set(lines)), len(marked))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(marked) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_boilerplate_and_copies(spark):
    own = lambda i: "\n".join(" ".join(f"w{i}x{k}y{j}" for j in range(5)) for k in range(10))
    menu = "\n".join(" ".join(f"menu{k}word{j}" for j in range(60)) for k in range(3))
    table = [(i, f"{menu}\n{own(i)}", "h") for i in range(20)]
    copied = own(99) + "\n" + own(98)
    table += [(100 + i, copied, "h") for i in range(20)] + [(200, own(5) + "\n" + own(6), "other")]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["text"] for r in quality.clean(docs, min_docs=10, share=0.1).collect()}
    assert set(kept) == {*range(100, 120), 200}
    assert kept[100] == copied


@pytest.mark.parametrize(("template", "body"), [(10, 5), (20, 5), (20, 10)])
def test_long_templates_do_not_shield_themselves(spark, template, body):
    menu = [f"menu {k} of the site" for k in range(template)]
    own = lambda i: [" ".join(f"w{i}x{k}y{j}" for j in range(20)) for k in range(body)]
    table = [(i, "\n".join([*menu[: template // 2], *own(i), *menu[template // 2 :]]), "h") for i in range(200)]
    copied = "\n".join([*menu, *own(-1)])
    table += [(1000 + i, copied, "copies") for i in range(60)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["text"] for r in quality.clean(docs, min_docs=50, share=0.1).collect()}
    assert kept == {i: "\n".join(own(i)) for i in range(200)} | {1000 + i: copied for i in range(60)}


def brute_deletions(table, limit):
    """Lines inside a run of ``limit`` words or more that stands at an earlier position."""
    order = sorted({(i is not None, i or 0, t or "") for i, t, _ in table})
    seqs = [[(k, x, len(words(x))) for k, x in enumerate(t.split("\n")) if words(x)] for *_, t in order]
    seen, gone = {}, {}
    for d, seq in enumerate(seqs):
        for a in range(len(seq)):
            for b in range(a + 1, len(seq) + 1):
                if sum(n for *_, n in seq[a:b]) >= limit:
                    seen.setdefault(tuple(x for _, x, _ in seq[a:b]), (d, a))
    for d, seq in enumerate(seqs):
        for a in range(len(seq)):
            for b in range(a + 1, len(seq) + 1):
                if sum(n for *_, n in seq[a:b]) >= limit and seen[tuple(x for _, x, _ in seq[a:b])] < (d, a):
                    gone.setdefault(order[d], set()).update(k for k, *_ in seq[a:b])
    return gone


def test_line_dedup(docs, rows):
    table = [r for r in rows if r[0] != 39]  # equal ids are ordered by hash; these have none with other texts
    got = line_dedup.dedup_lines(docs.filter("doc_id is null or doc_id <> 39"), gone_col="gone").collect()
    gone = brute_deletions(table, 50)
    text = {(i, len(t or "")): t for i, t, _ in table}
    for r in got:
        at = [(i, t) for i, t, _ in table if i == r["doc_id"]][0]
        expected = gone.get((at[0] is not None, at[0] or 0, at[1] or ""), set())
        assert set(r["gone"]) == expected
        if expected:
            assert r["text"] == "\n".join(x for k, x in enumerate(at[1].split("\n")) if k not in expected)
    assert any(r["gone"] for r in got) and text


def test_ngram_join(docs, rows):
    sets = []
    for i, t, _ in rows:
        w = words(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    ids = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    expected = sorted(str((i, len(sets[k]), ids.get(find(k)))) for k, (i, *_) in enumerate(rows))
    assert sorted(str(tuple(r)) for r in ngram_join.components(docs).collect()) == expected


def test_different_texts_with_one_id_or_none_all_stay(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    near = text(1).replace("w1x0 ", "changed ")
    table = [(None, text(k)) for k in (2, 3, 4)] + [(5, text(5)), (5, text(6)), (7, text(7)), (7, text(7)), (None, text(2)), (8, ""), (8, None)]
    table += [(10, text(1)), (11, near), (10, text(8)), (11, text(8)), (11, text(9)), (None, near), (12, text(4))]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    expected = [(None, text(2)), (None, text(3)), (12, text(4)), (5, text(5)), (5, text(6)), (7, text(7)), (8, ""), (8, None)]
    expected += [(10, text(1)), (10, text(8)), (11, text(9))]
    assert sorted(map(str, ngram_join.keep_one(docs).collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in expected)


def test_large_tiles_are_compared_in_blocks(spark, monkeypatch):
    base = [f"w{j}" for j in range(60)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 60, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = sorted(map(str, ngram_join.components(docs).collect()))
    monkeypatch.setattr(ngram_join, "FEW", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "LINEAR", 0)
    assert sorted(map(str, ngram_join.components(docs).collect())) == plain


def test_ngram_join_bound_tells_large_sets_apart():
    rnd = np.random.default_rng(3)
    for n in (300, 1500, 6000, 20000):
        x, y = (np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64)) for _ in range(2))
        near = np.unique(np.concatenate([x[: n * 19 // 20], y[: n // 50]]))
        a, b, c = ngram_join._bits([bitmap(x), bitmap(y), bitmap(near)])
        size = lambda z: np.array([len(z)])
        assert ngram_join.within_bound(size(x), size(near), a[None], c[None]).all()
        assert not ngram_join.within_bound(size(x), size(y), a[None], b[None]).any()
    # a longer bitmap is folded to the width of the shorter
    assert (ngram_join._bits([bitmap(x), bitmap(x[:100], 1024)])[0] == ngram_join._bits([np.packbits(
        np.bincount((x % np.uint64(1024)).astype(int), minlength=1024) & 1).tobytes()])[0]).all()


def test_ngram_join_names_a_pair_in_one_tile(spark):
    """Forty classes that share three tiles, none linked yet: every pair comes from the first tile only."""
    tokens = {0: range(40), 5: range(40), 9: range(10, 40), 11: range(5)}
    members = spark.createDataFrame([(t, c, 100, c) for t, cs in tokens.items() for c in cs], "token long, c long, size long, root long")
    sketches = spark.createDataFrame([(c, bytearray(128)) for c in range(40)], "c long, bits binary")
    assert sorted(tuple(r)[:2] for r in ngram_join.tile_pairs(members, sketches).collect()) == list(combinations(range(40), 2))
    bits, size = np.zeros((40, 16), np.uint64), np.full(40, 100)
    block = lambda before: len(ngram_join._block_pairs(20, np.arange(40), size, np.arange(40), np.full(40, 20), bits, before))
    assert block([[]] * 40) == 780 and block([[0]] * 40) == 0 and block([[0]] * 10 + [[]] * 30) == 735


def test_ngram_join_sends_sets_in_rounds(spark, monkeypatch):
    """Near copies of one long text spread over tasks: a round sends the sets of about ROUND elements, results stay."""
    texts = [" ".join(f"w{j}" for j in range(i, 600 + i)) for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string").repartition(4)
    plain = sorted(map(str, ngram_join.components(docs).collect()))
    sent, compared = [], ngram_join.compared

    def spy(sets, homes, sends):
        sent.append(sends.count())
        return compared(sets, homes, sends)

    monkeypatch.setattr(ngram_join, "compared", spy)
    monkeypatch.setattr(ngram_join, "ELEMENTS", 600)
    monkeypatch.setattr(ngram_join, "ROUND", 4000)
    assert sorted(map(str, ngram_join.components(docs).collect())) == plain
    assert len(sent) > 2 and max(sent) <= 14
    assert {r["component_id"] for r in ngram_join.components(docs).collect()} == {0}


def test_fingerprint(docs, rows):
    got = fingerprint.fingerprint_edits(docs).collect()
    assert len(got) == len(rows)
    order = sorted(((i is not None, i or 0) for i, *_ in rows), reverse=True)
    by_id = {(i is not None, i or 0): t or "" for i, t, _ in rows}
    for r in got:
        key = (r["doc_id"] is not None, r["doc_id"] or 0)
        if r["doc_id"] == 2:
            continue  # repeated rows follow one another
        text, follow = by_id[key], by_id[order[(order.index(key) + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    print_of = {r["doc_id"]: r["fingerprint"] for r in got}
    assert print_of[1] == print_of[30] == print_of[32]
    assert print_of[36] == print_of[37] != print_of[1]


def test_fingerprint_estimates_jaccard(spark):
    a = [f"a{j}" for j in range(400)]
    docs = spark.createDataFrame([(2, " ".join(a)), (1, " ".join(a[:300] + [f"b{j}" for j in range(100)]))], "doc_id long, text string")
    near = {r["doc_id"]: r["near_next"] for r in fingerprint.fingerprint_edits(docs).collect()}
    assert near[1] == near[2] == pytest.approx(296 / 496, abs=0.2)


@pytest.mark.parametrize(("heavy", "others"), [(1000, 70), (300, 30), (10, 200)])
def test_fingerprint_counts_heavy_terms_by_their_weight(spark, heavy, others):
    def shingles(text):
        w = words(lower(text))
        return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))

    texts = [f"same{i // 2} " * (heavy + 4) + " ".join(f"w{i}x{j}" for j in range(others)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = {r["doc_id"]: r["near_next"] for r in fingerprint.fingerprint_edits(docs).collect()}
    a, b = shingles(texts[0]), shingles(texts[1])
    exact = sum((a & b).values()) / sum((a | b).values())
    assert np.mean([near[i] for i in range(1, 40, 2)]) == pytest.approx(exact, abs=0.05)


def test_fingerprint_takes_few_logarithms_and_leaves_out_no_low_sample(spark):
    from pyspark.sql import functions as F

    tau, rows = 12 / 400, spark.range(20_000).select(F.xxhash64("id").alias("term"), F.explode(F.array(F.lit(1.0), F.lit(7.0))).alias("weight"))
    rows = rows.withColumn("slot", (F.col("term") % 64).cast("int"))
    kept = fingerprint.may_be_below(F.lit(tau), F.col("term"), F.col("weight"), F.col("slot"))
    got = rows.select("weight", kept.alias("kept"), fingerprint.sample(F.col("term"), F.log("weight"), F.col("slot")).alias("a"))
    n = {(r["weight"], r["kept"]): (r["n"], r["least"]) for r in got.groupBy("weight", "kept").agg(F.count("*").alias("n"), F.min("a").alias("least")).collect()}
    for weight in (1.0, 7.0):
        assert n[weight, False][1] >= np.log(tau)
    assert n[1.0, True][0] < 0.1 * n[1.0, False][0]


def test_fingerprint_is_the_same_when_many_texts_are_done_again(docs, monkeypatch):
    docs = docs.union(docs.selectExpr("null as doc_id", "concat(text, ' end of a text without an id', doc_id)", *docs.columns[2:]))
    first = sorted(map(repr, fingerprint.fingerprint_edits(docs).collect()))
    monkeypatch.setattr(fingerprint, "SURE", 2)
    assert sorted(map(repr, fingerprint.fingerprint_edits(docs).collect())) == first


def test_secrets(spark):
    rnd = random.Random(3)
    key = lambda n: "".join(rnd.choice(secret_scan.ALPHABET[:62]) for _ in range(n))
    plain = "inter national alisation lisation of_conf configur ration_ values change geability rationof ion_of interna here interchangeability"
    table = [(i, f"{plain} password = '{key(24)}' and é token:{key(30)}") for i in range(40)]
    loose = key(40)
    table += [(100, f"{plain} {loose} end"), (101, None), (102, "token=secret:abcdefgh123 AKIA" + "A" * 12 + " " + "0f" * 16), (101, None), (103, "token=short")]
    docs = spark.createDataFrame([(*r, 1) for r in table], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in secret_scan.scan(docs).collect()}
    assert got[100]["spans"] == f"markov:{len(plain) + 1}:{len(plain) + 41}", got[100]["spans"]
    assert got[101]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[101]["spans"] == ""
    assert (got[102]["n_assign"], got[102]["n_access"], got[102]["n_hex"]) == (0, 1, 1)
    pattern = re.compile(secret_scan.PATTERNS["assign"].replace("(?i:(?:", "(?:(?:"), re.I)
    for i, t in table[:40]:
        spans = ",".join(f"assign:{m.start()}:{m.end()}" for m in pattern.finditer(t))
        assert got[i]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert got[i]["n_markov"] == 0


def test_lm(docs, rows):
    got = lm.score(docs).collect()
    train = [(i, t) for i, t, _ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    counts = {}
    for _, t in train:
        for x in [*words(lower(t)), None]:
            counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    by = {(i, len(t or "")): t for i, t, _ in rows}
    for r in got:
        texts = [t for (i, _), t in by.items() if i == r["doc_id"]]
        tokens = [*words(lower(texts[0])), None]
        base = sum(log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(x in counts for x in tokens), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 1)


def test_lm_bits_are_a_distribution():
    """All words of two letters, and the end, share a probability of at most one."""
    codes = lm.Codes([3, 5, 2])
    index = {lm.END: 1, b"aa": 2}
    size = lm.TABLES << lm.TABLE_BITS
    mixer = lm.Mixer(np.zeros(size), np.zeros(size))
    texts = [[bytes([a, b])] for a in range(33, 127) for b in range(33, 127)] + [[lm.END]]
    assert 10 ** mixer.score(lm.segments(codes, index, texts), len(texts)).sum(0) @ np.ones(len(texts)) <= 1


def test_lm_is_fitted_on_all_training_texts(spark):
    """Weights and refinement are those of sums over every text, however many there are and wherever they lie."""
    texts = [f"w{i % 7} w{i % 11} " + "yes no " * (i % 3) for i in range(2500)]
    tokens = [lm.tokens_of(t) for t in texts]
    counts = {}
    for t in (t for x in tokens for t in x):
        counts[t] = counts.get(t, 0) + 1
    index = {t: i + 1 for i, t in enumerate(sorted(counts))}
    codes = lm.Codes([1, *(counts[t] for t in sorted(counts))])
    training = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    slots = lm.slot_counts(training, codes, index)
    got = lm.fitted(training, codes, index, lm.Mixer(*slots))
    mixer = lm.Mixer(*slots)
    for _ in range(lm.ROUNDS):
        mixer.step(sum(mixer.slopes(s) for s in lm.segments(codes, index, tokens)))
    seen, ones = sum(mixer.outcomes(s) for s in lm.segments(codes, index, tokens)).reshape(2, 2, lm.STEPS)
    assert np.allclose(got.weights, mixer.weights, atol=1e-4) and seen.sum() == sum(len(s.bit) for s in lm.segments(codes, index, tokens))
    assert np.allclose(got.table, (4 * lm.Mixer(*slots).table + ones) / (4 + seen), atol=0.01)


def test_lm_beats_the_base_on_held_out_texts(spark):
    """A chain of words, where the word before tells most of the next; some words are rare."""
    rnd = random.Random(5)
    follow = {k: [rnd.randrange(200) for _ in range(3)] for k in range(200)}

    def text():
        at, out = rnd.randrange(200), []
        for _ in range(80):
            out.append(f"w{at}" if rnd.random() > 0.03 else f"rare{rnd.randrange(3000)}")
            at = rnd.choice(follow[at])
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string").repartition(4)
    held = [r for r in lm.score(docs).collect() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)


def test_urls(spark):
    urls = [
        "http://a.NET/x", "https://example.net/en/1?q", "http://m.example.net/de/1", "http://example.com/de/", "http://b.example.com/en/",
        "ftp://x.org/fr/a#t", "http://notexample.com/de/x", None, "no scheme", "http://a.net", "http://é.org/fr/ü", "http://shop.org/x/cart/1",
        "http://a.org/" + "y" * 5000 + ".exe", "http://a.net?x",
    ]
    docs = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, urls[0], "z")], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge(docs).collect()}
    rules = [(k, h, p) for k, h, p in url_filter.RULES]
    for i, u in enumerate(urls):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else None
        host = lower(re.split("[/?#]", rest)[0]) if rest is not None else ""
        path = re.split("[?#]", rest[len(re.split("[/?#]", rest)[0]) :])[0] if rest is not None else ""
        fits = [(len(h + p), h + p, k) for k, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        blocked = "/cart/" in path or path.endswith(".exe")
        assert r["verdict"] == (max(fits)[2] if fits else "block" if blocked else "allow")


def test_automaton_is_wider_than_a_word():
    globs = [f"*{'x' * k}y?z*" for k in range(1, 40)] + ["abc", "a*c", "*"]
    machine = url_filter.Automaton(globs)
    texts = [b"abc", b"axxc", b"", b"x" * 30 + b"yqz", b"yaz", b"xyz"]
    got = machine.match(texts)
    for t, row in zip(texts, got, strict=True):
        expected = [re.fullmatch(re.escape(g).replace(r"\*", ".*").replace(r"\?", "."), t.decode()) is not None for g in globs]
        assert row.tolist() == expected
