"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesmith.llm import (
    fingerprint, line_dedup, lm, mixing, ngram_join, packing, prefix_trie, quality, secret_scan, sharding,
    structure_repair, token_count, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op4_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@query
def op6_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@query
def op7_url_filter(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"))


@query
def op8_sharding(spark, sf):
    return sharding.assign_shards(table(spark, sf, "documents"))


@query
def op10_quality(spark, sf):
    return quality.judge(table(spark, sf, "documents"))


@query
def op1_line_dedup(spark, sf):
    docs = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"), gone_col="removed_lines")
    return docs.withColumn("n_removed", F.size("removed_lines"))


@query
def op5_fingerprint(spark, sf):
    return fingerprint.fingerprint_edits(table(spark, sf, "documents"))


@query
def op9_ngram_join(spark, sf):
    return ngram_join.components(table(spark, sf, "documents"))


@query
def op3_secrets(spark, sf):
    return secret_scan.scan(table(spark, sf, "documents"))


@query
def op2_lm_score(spark, sf):
    return lm.score(table(spark, sf, "documents"))


@query
def op11_prefix_trie(spark, sf):
    return prefix_trie.conversation_trie(table(spark, sf, "conversations"))


@query
def op12_structure_repair(spark, sf):
    rows = structure_repair.damage(structure_repair.turns(table(spark, sf, "conversations")))
    return structure_repair.repair_report(rows, structure_repair.audits(rows))


@query
def op13_token_counts(spark, sf, path: str | None = None):
    """``path``: the tokenizer file; by default the public one of the contract."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return token_count.count_tokens(table(spark, sf, "documents"), path)


def _crc32(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of ASCII text."""
    shifted = "xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END::UBIGINT)"
    bits = f"list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: z::UBIGINT)), lambda c, z: {shifted})"
    chars = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {chars}), lambda a, b: {bits}), 4294967295::UBIGINT)"


ORACLES["op11_prefix_trie"] = rf"""WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, turn, left(sha256(concat(strlen(role), ':', role, text)), 32) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM t),
p AS (SELECT c, list({{'key': key, 'w': w}} ORDER BY turn NULLS FIRST, key) AS turns, CAST({_crc32("CAST(c AS VARCHAR)")} % 4 AS BIGINT) AS h FROM k GROUP BY c),
r AS (SELECT p.c, list_concat(coalesce(list_slice(b.turns, 1, p.h), []), list_slice(p.turns, p.h + 1, len(p.turns))) AS turns
 FROM p LEFT JOIN p AS b ON b.c = p.c - p.c % 20),
m AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM r),
n AS (SELECT list_slice(list_transform(turns, lambda x: x.key), 1, d) AS node, d AS depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(max(turns[d].w), 0) AS w,
  sha256(coalesce(string_agg(CASE WHEN len(turns) = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
f AS (SELECT n.*, u.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children FROM n
 LEFT JOIN n AS u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.node = list_slice(n.node, 1, n.depth - 1)
 LEFT JOIN (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1) AS k ON k.node = n.node),
a AS (SELECT list_slice(node, 1, d) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
 FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM f) AS e GROUP BY 1)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM f JOIN a USING (node)"""


def _repair_sql() -> str:
    """Edits found by recursion from the last row to the first; a state's value is (cost, audit, repaired text)."""

    def more(value, cost, letter, line=None):
        text = f"concat({line}, CASE WHEN ({value}).n > 0 THEN chr(10) ELSE '' END, ({value}).t)" if line else f"({value}).t"
        return f"{{'c': ({value}).c + {cost}, 'a': concat('{letter}', ({value}).a), 't': {text}, 'n': ({value}).n + {1 if line else 0}}}"

    def insert(to):
        return more(f"i{to}", 3, "I", "'assistant:'" if to == "a" else "'user:'")

    def layer(number, rows):
        """CTE text: states by row edits (e, s, u, a), then with the turns that may be inserted before."""
        one = f"SELECT *, list_min([u, {more('a', 3, 'I', chr(39) + 'assistant:' + chr(39))}]) AS iu, " \
              f"list_min([a, {more('u', 3, 'I', chr(39) + 'user:' + chr(39))}]) AS ia FROM ({rows}) AS x{number}"
        return f"SELECT conv_id, i, list_min([e, {insert('u')}]) AS e, list_min([s, {insert('u')}]) AS s, iu AS u, ia AS a FROM ({one}) AS y{number}"

    nil, lost = ("{" + f"'c': {c}, 'a': '', 't': '', 'n': 0" + "}" for c in (0, 1000000000))
    keeps = {"e": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    rerole = {"e": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "a"), "a": ("user", "u")}
    moved = []
    for state, kept in keeps.items():
        role, to = rerole[state]
        line = f"concat('{role}:', text)"
        choices = [more(state, 4, "D"), f"CASE WHEN must THEN {lost} ELSE {more(to, '3 + extra', 'R', line)} END"]
        for initial, to in kept.items():
            value = more(to, "extra", "K", "concat(role, ':', text)")
            choices.append(f"CASE WHEN must OR ini <> '{initial}' THEN {lost} ELSE {value} END")
        moved.append(f"list_min([{', '.join(choices)}]) AS {state}")
    first = layer(0, f"SELECT c.conv_id, coalesce(s.n, 0) AS i, {nil} AS e, {lost} AS s, {lost} AS u, {nil} AS a "
                     "FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id")
    again = layer(1, f"SELECT q.conv_id, q.i - 1 AS i, {', '.join(moved)} FROM q JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.i = q.i")
    return rf"""WITH RECURSIVE z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS name FROM conversations),
k AS (SELECT *, {_crc32("name")} % 20 AS kind, left(sha256(concat(strlen(role), ':', role, text)), 32) AS key FROM z),
d AS (SELECT conv_id, turn, key, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key, role, copy) AS i FROM d),
w AS (SELECT *, left(role, 1) AS ini, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
  min(i) OVER (PARTITION BY conv_id, role, text) < i AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
f AS (SELECT *, blank OR again AS must, CASE WHEN cut AND NOT (blank OR again) THEN 3 ELSE 0 END AS extra FROM w),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (extra = 3) AS truncated,
  count(*) FILTER (prev IS NOT NULL AND concat(prev, ini) NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM f GROUP BY conv_id),
q AS ({first} UNION ALL {again})
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
 coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST((q.e).c AS BIGINT) AS cost, (q.e).a AS audit,
 sha256((q.e).t) AS repaired_sha256 FROM q LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM q.conv_id WHERE q.i = 0"""


ORACLES["op12_structure_repair"] = _repair_sql()

ORACLES["op7_url_filter"] = r"""WITH cut AS (SELECT page_id,
  coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS tail FROM pages),
named AS (SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, concat('.', host) AS h, CASE
  WHEN ends_with(concat('.', host), '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ends_with(concat('.', host), '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ends_with(concat('.', host), '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ends_with(concat('.', host), '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM named)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN path LIKE '/%login%' OR path LIKE '/%/cart/%' OR path LIKE '%.exe' OR path LIKE '%.zip' OR path LIKE '%.apk'
   OR h LIKE '%.ads.%' OR path LIKE '/%/wp-admin/%' THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""
