"""SQL for the queries, computed from the columns of ``documents`` and never by parsing.

``els`` lists the elements of every page with their place, from the pieces of the
fixture; rewrites are concatenations of the same pieces with one of them changed.
"""

from __future__ import annotations

from pagesmith.constants import CORRECTION_LABELS, ERROR_PATTERNS, LABEL_RULES, NOWIKI_ESCAPES, WORD_CLASSES
from pagesmith.plans.fixture import CTE, PIECES


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TPL_NAME = "CASE WHEN ord % 3 = 0 THEN 'ES' ELSE 'lengua' END"
_EQ = "CASE WHEN ord % 2 = 0 THEN CAST(n_chars AS VARCHAR) ELSE '' END"
_NOINC = "concat('<noinclude>doc ', ord, '</noinclude>')"
_SMALL = "concat('<small id=\"s', ord, '\">nota <i>', lang, '</i></small>')"


# (kind, condition, start, string, rank, nested in another element)
_ELEMENTS = [
    ("ExtensionTag", "k = 0", "o_incl", _NOINC, 11, False),
    ("ExtensionTag", "k = 0", f"o_incl + length({_NOINC})", f"substr(p_incl, length({_NOINC}) + 1)", 11, False),
    ("Template", "true", "o_tpl", "p_tpl", 5, False),
    ("Template", "true", "o_uso", "concat('{{Uso|', etim, '}}')", 5, False),
    ("Template", "true", "o_uso + 6", "etim", 5, True),
    ("Comment", "true", "o_comment", "p_comment", 1, False),
    ("WikiLink", "true", "o_link1", "p_link1", 6, False),
    ("WikiLink", "true", "o_link2 + 1", "trim(p_link2)", 6, False),
    ("ExternalLink", "true", "o_ext", "p_ext", 2, False),
    ("SectionTitle", "k <> 0", "o_h1", "concat('== ', lang, ' ==')", 7, False),
    ("SectionTitle", "true", "o_h2", "'=== Ejemplo ==='", 7, False),
    ("SectionTitle", "true", "o_h3", "'== Fin =='", 7, False),
    ("Bold", "ord % 4 = 0", "o_quote", "trim(p_quote)", 8, False),
    ("Italic", "ord % 4 <> 0", "o_quote", "trim(p_quote)", 8, False),
    ("WikiList", "true", "o_list1", "p_list1", 9, False),
    ("WikiList", "true", "o_list2", "p_list2", 9, False),
    ("Table", "true", "o_table", "p_table", 10, False),
    ("ExtensionTag", "true", "o_ref + 1", "substr(p_ref, 2, length(p_ref) - 2)", 11, False),
    ("Parameter", "true", "o_param", "p_param", 3, False),
    ("ParserFunction", "true", "o_lc + 1", "'{{lc:ABC}}'", 4, False),
    ("Tag", "true", "o_html + 1", _SMALL, 11, False),
    ("Tag", "true", f"o_html + 1 + length('<small id=\"s\">nota ') + length(CAST(ord AS VARCHAR))", "concat('<i>', lang, '</i>')", 11, True),
    ("Tag", "true", f"o_html + 1 + length({_SMALL})", "'<br/>'", 11, False),
]

ELS = CTE + ", els AS (" + " UNION ALL ".join(
    f"""SELECT ord, title, namespace_id, '{kind}' AS kind, CAST({start} AS INT) AS start,
 CAST({start} + length({string}) AS INT) AS "end", {string} AS string, {rank} AS rank, {str(nested).lower()} AS nested
 FROM live WHERE {where}"""
    for kind, where, start, string, rank, nested in _ELEMENTS
) + "), tpl AS (SELECT *, " + _TPL_NAME + " AS tname, " + _EQ + """ AS eqv FROM live),
args AS (
 SELECT ord, title, namespace_id, o_tpl AS start, tname AS owner, 0 AS argno, '1' AS name, source AS value, true AS "positional",
  CAST(o_tpl + 2 + length(tname) AS INT) AS arg_start, CAST(o_tpl + 3 + length(tname) AS INT) AS value_start FROM tpl
 UNION ALL SELECT ord, title, namespace_id, o_tpl, tname, 1, 'n', CAST(n_chars AS VARCHAR), false,
  CAST(o_tpl + 3 + length(tname) + length(source) AS INT), CAST(o_tpl + 6 + length(tname) + length(source) AS INT) FROM tpl
 UNION ALL SELECT ord, title, namespace_id, o_tpl, tname, 2, 'n', eqv, false,
  CAST(o_tpl + 6 + length(tname) + length(source) + length(CAST(n_chars AS VARCHAR)) AS INT),
  CAST(o_tpl + 9 + length(tname) + length(source) + length(CAST(n_chars AS VARCHAR)) AS INT) FROM tpl
 UNION ALL SELECT ord, title, namespace_id, o_uso, 'Uso', 0, '1', etim, true, CAST(o_uso + 5 AS INT), CAST(o_uso + 6 AS INT) FROM tpl
 UNION ALL SELECT ord, title, namespace_id, CAST(o_uso + 6 AS INT), 'etimología', 0, '1', lang, true,
  CAST(o_uso + 18 AS INT), CAST(o_uso + 19 AS INT) FROM tpl)
"""
_KEY = "title, namespace_id"
_NESTED = "('Comment', 'ExtensionTag', 'Parameter', 'ParserFunction', 'Template', 'WikiLink')"


def _body(**changed: str) -> str:
    """A rewrite: all pages, some pieces replaced."""
    new = "concat(" + ", ".join(changed.get(p, p) for p in PIECES) + ")"
    return CTE + f"""SELECT title, namespace_id, CASE WHEN body IS NULL THEN NULL ELSE {new} END AS body,
 CASE WHEN body IS NULL THEN false ELSE body <> {new} END AS changed FROM wiki"""


def _changed(before: str, **pieces: str) -> str:
    """A rewrite of pages whose bodies were first changed to ``before``."""
    new = "concat(" + ", ".join(pieces.get(p, p) for p in PIECES) + ")"
    return CTE + f"""SELECT title, namespace_id, CASE WHEN body IS NULL THEN NULL ELSE {new} END AS body,
 CASE WHEN body IS NULL THEN false ELSE {before} <> {new} END AS changed FROM wiki"""


def _retargeted() -> str:
    new = lambda n, old, made: f"CASE WHEN {n} IS NULL THEN {old} ELSE {made} END"
    pieces = {"p_link1": new("a.ord", "p_link1", "concat('[[Nuevo ', a.ord, '#s|siguiente]]')"),
              "p_link2": new("b.ord", "p_link2", "concat(' [[Nuevo ', b.ord, ']] ')")}
    made = ", ".join(pieces.get(p, p) for p in PIECES)
    return CTE + f""", five AS (SELECT ord FROM wiki WHERE ord % 5 = 0),
m AS (SELECT w.title, w.namespace_id, w.body, concat({made}) AS new_body FROM wiki w LEFT JOIN five a ON a.ord = w.ord + 1 LEFT JOIN five b ON b.ord = w.ord * 7 % 3000)
SELECT title, namespace_id, CASE WHEN body IS NOT NULL THEN new_body END AS body, coalesce(body <> new_body, false) AS changed FROM m"""


def _fixed_links(more: str) -> str:
    """R7 with J5 by joins of its own: a redirect is followed once, to a page that is none.

    ``more`` is put behind every body; of its links only the one to Doc 5 may change.
    """
    pieces = {
        "p_link1": "CASE WHEN new1 IS NULL THEN p_link1 ELSE concat('[[', new1, '#s|siguiente]]') END",
        "p_link2": "CASE WHEN new2 IS NULL THEN p_link2 ELSE concat(' [[', new2, ']] ') END",
    }
    new = ", ".join(pieces.get(p, p) for p in PIECES)
    return CTE + f""", hop AS (SELECT a.title AS t, b.title AS new FROM wiki_pages a JOIN wiki_pages b ON b.title = a.redirect_to AND b.redirect_to IS NULL
 WHERE a.redirect_to IS NOT NULL),
five AS (SELECT max(new) AS new5 FROM hop WHERE t = 'Doc 5'),
n AS (SELECT w.*, {more} AS more, a.new AS new1, b.new AS new2, new5 FROM wiki w CROSS JOIN five
 LEFT JOIN hop a ON a.t = concat('Doc ', ord + 1) LEFT JOIN hop b ON b.t = concat('Doc ', ord * 7 % 3000)),
m AS (SELECT title, namespace_id, concat(body, more) AS body,
 concat({new}, CASE WHEN new5 IS NULL THEN more ELSE replace(more, 'Main:Doc_5#', concat(new5, '#')) END) AS new_body, body IS NULL AS gone FROM n)
SELECT title, namespace_id, CASE WHEN NOT gone THEN new_body END AS body, CASE WHEN gone THEN false ELSE body <> new_body END AS changed FROM m"""


def _text(**changed: str) -> str:
    new = "concat(" + ", ".join(changed.get(p, p) for p in PIECES) + ")"
    return CTE + f"SELECT title, namespace_id, CASE WHEN body IS NULL THEN NULL ELSE {new} END AS text FROM wiki"


def _tpl(name=_TPL_NAME, rest="concat('|', source, '|n=', n_chars, '|n=', " + _EQ + ")") -> str:
    return f"concat('{{{{', {name}, {rest}, '}}}}')"


_ES = "ord % 3 = 0"
_RENDERED = dict(
    p_incl=f"CASE WHEN k <> 0 THEN '' WHEN ord % 20 = 0 THEN concat('doc ', ord, 'core') ELSE concat('doc ', ord, 'inc') END",
    p_tpl="''", p_uso="chr(10)", p_quote="CASE WHEN ord % 4 = 0 THEN 'ejemplo: ' ELSE 'cursiva ' END", p_comment="''",
    p_link1="'siguiente'", p_link2="concat(' Doc ', ord * 7 % 3000, ' ')", p_ext="'ref'",
    p_table="""concat(chr(10), ' ', source, chr(10), chr(10), rpad('a', greatest(1, CAST(length(CAST(n_chars AS VARCHAR)) AS INT)), ' '),
     chr(9), 'b', chr(10), n_chars, chr(9), n_chars, chr(10))""",
    p_ref="concat(chr(10), 'Separación silábica: a-b', chr(10))", p_param="lang", p_lc="' '", p_amp="' &'",
    p_html="concat(' nota ', lang)",
)
_CELL_START = "CAST(o_table AS INT) AS table_start"

_RAW_OK = """ns IN (SELECT id FROM namespaces) AND NOT (title LIKE '%/documentation') AND NOT contains(title, '/testcases')"""
_MODEL_OK = "(redirect IS NOT NULL OR model IN ('wikitext', 'Scribunto', 'json'))"
_SPLIT = """SELECT ord, title, ns AS namespace_id, redirect AS redirect_to,
 CASE WHEN redirect IS NULL THEN coalesce(text, '') END AS body, model FROM raw_pages"""
_NORM = """CASE WHEN starts_with(t, 'Main:') THEN substr(t, 6) ELSE t END"""
_TITLED = f"""titled AS (SELECT p.*, CASE WHEN namespace_id = 0 OR starts_with(title, concat(coalesce(n.name, ''), ':')) THEN title
 ELSE concat(coalesce(n.name, ''), ':', title) END AS t FROM ({{split}}) p LEFT JOIN namespaces n ON n.id = p.namespace_id)"""
_TPL_BODY = "CASE WHEN ord % 20 = 0 THEN 'core' ELSE replace(replace(replace(body, p_comment, ''), {noinc}, ''), '<includeonly>inc</includeonly>', 'inc') END".format(noinc=_NOINC)
# The fixture's dump: kept pages, titles normalised, template bodies reduced.
_INGESTED = CTE + ", " + _TITLED.format(
    split=f"SELECT * FROM (SELECT r.ord, r.title, r.ns AS namespace_id, r.redirect AS redirect_to, CASE WHEN r.redirect IS NULL THEN coalesce(CASE WHEN w.k = 0 THEN ({_TPL_BODY.replace('ord', 'w.ord').replace('p_comment', 'w.p_comment').replace('body', 'w.body')}) ELSE r.text END, '') END AS body, r.model, r.ns AS ns, r.redirect AS redirect FROM raw_pages r JOIN wiki w USING (ord)) WHERE {_RAW_OK} AND {_MODEL_OK}"
) + f", ingested AS (SELECT {_NORM} AS title, namespace_id, redirect_to, body, model FROM titled) "

# A second dump on top of it: replaced and new pages win, by joins of their own.
_SECOND = f""", second AS (SELECT title, ns AS namespace_id, concat('v2 ', ord) AS body FROM raw_pages WHERE (ns IN (10, 14) OR redirect IS NOT NULL) AND {_RAW_OK}
 UNION ALL SELECT concat('Nuevo ', ord), 0, concat('new ', ord) FROM raw_pages WHERE ord % 7 = 0),
second_titled AS (SELECT s.*, CASE WHEN namespace_id = 0 OR starts_with(title, concat(coalesce(n.name, ''), ':')) THEN title
 ELSE concat(coalesce(n.name, ''), ':', title) END AS t FROM second s LEFT JOIN namespaces n ON n.id = s.namespace_id),
newer AS (SELECT {_NORM} AS title, namespace_id, CAST(NULL AS VARCHAR) AS redirect_to, body, 'wikitext' AS model FROM second_titled),
merged AS (SELECT * FROM newer UNION ALL SELECT * FROM ingested i WHERE NOT EXISTS (SELECT 1 FROM newer n WHERE n.title = i.title AND n.namespace_id = i.namespace_id)) """

_CONTAINS_ANY = "(" + " OR ".join(f"contains(body, {_q(p)})" for p in ERROR_PATTERNS) + ")"
_FLAGGED = f"namespace_id = 0 AND {_CONTAINS_ANY}"
_BATCH = """, batch AS (SELECT ord, title, namespace_id, CAST(NULL AS VARCHAR) AS redirect_to, concat('v2 ', ord) AS body, model FROM wiki_pages WHERE namespace_id <> 0
 UNION ALL SELECT ord + 1000000000, title, namespace_id, NULL, concat('v3 ', ord), model FROM wiki_pages WHERE namespace_id <> 0 AND model = 'Scribunto'
 UNION ALL SELECT ord, concat('Nuevo ', ord), 0, NULL, concat('v2 ', ord), model FROM wiki_pages)"""


def _upsert(batch: str) -> str:
    return CTE + batch + """, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, namespace_id ORDER BY ord DESC) AS nth FROM batch) WHERE nth = 1)
 SELECT title, namespace_id, redirect_to, body, model FROM newest UNION ALL
 SELECT title, namespace_id, redirect_to, body, model FROM wiki_pages w
 WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.title = w.title AND n.namespace_id = w.namespace_id)"""


def _lookup(requests: str = "requests", pages: str = "wiki_pages", out: str = "found") -> str:
    """CTEs that look up requests; found has one row per request with a page."""
    return f"""
 {out}_c AS (SELECT request_id, title AS asked, namespace_id AS asked_ns,
   CASE WHEN starts_with(replace(title, '_', ' '), 'Main:') THEN substr(replace(title, '_', ' '), 6) ELSE replace(title, '_', ' ') END AS w FROM {requests}),
 {out}_p AS (SELECT c.*, concat(n.name, ':') AS prefix, n.canonical_name AS cn FROM {out}_c c LEFT JOIN namespaces n ON n.id = c.asked_ns WHERE w <> ''),
 {out}_e AS (SELECT *, CASE WHEN coalesce(asked_ns, 0) = 0 OR starts_with(w, prefix) THEN w ELSE concat(prefix, w) END AS exact FROM {out}_p),
 {out}_t AS (SELECT request_id, asked_ns, 0 AS rank, exact AS t FROM {out}_e
  UNION ALL SELECT request_id, asked_ns, 1, concat(prefix, upper(substr(exact, CAST(length(prefix) AS INT) + 1, 1)), substr(exact, CAST(length(prefix) AS INT) + 2))
   FROM {out}_e WHERE cn IN ('Template', 'Module')),
 {out} AS (SELECT * FROM (SELECT t.request_id, p.title AS found_title, p.namespace_id AS found_ns, p.redirect_to, p.body, p.model,
   row_number() OVER (PARTITION BY t.request_id ORDER BY t.rank, p.namespace_id) AS nth
   FROM {out}_t t JOIN {pages} p ON p.title = t.t AND (t.asked_ns IS NULL OR t.asked_ns = p.namespace_id)) WHERE nth = 1)"""


_REQ = "r.request_id, r.title, r.namespace_id"


def _resolve(requests: str, columns: str) -> str:
    cols = ["found_title", "found_ns", *columns.split(", ")]
    picked = ", ".join(f"CASE WHEN f.redirect_to IS NOT NULL THEN s.{c} ELSE f.{c} END AS {c}" for c in cols)
    return f""", {_lookup(requests)},
 hops AS (SELECT f.request_id, f.redirect_to AS title, r.namespace_id FROM found f JOIN {requests} r USING (request_id) WHERE f.redirect_to IS NOT NULL),
 goal AS (SELECT * FROM wiki_pages WHERE redirect_to IS NULL), {_lookup("hops", "goal", "hop")}
 SELECT {_REQ}, {picked} FROM {requests} r LEFT JOIN found f USING (request_id) LEFT JOIN hop s USING (request_id)"""


_TOP = "(SELECT * FROM els WHERE NOT nested)"
_SEGMENTS = f""", body_end AS (SELECT ord, title, namespace_id, body FROM live),
 tops AS (SELECT e.ord, e.title, e.namespace_id, e.kind, e.start, e."end", e.string,
  coalesce(lag(e."end") OVER (PARTITION BY e.ord ORDER BY e.start), 0) AS prev FROM {_TOP} e),
 segs AS (SELECT ord, title, namespace_id, kind, start, "end", string FROM tops
  UNION ALL SELECT t.ord, t.title, t.namespace_id, 'Text', t.prev, t.start, substr(b.body, t.prev + 1, t.start - t.prev) FROM tops t JOIN body_end b USING (ord) WHERE t.start > t.prev
  UNION ALL SELECT b.ord, b.title, b.namespace_id, 'Text', m.last, CAST(length(b.body) AS INT), substr(b.body, m.last + 1)
   FROM body_end b JOIN (SELECT ord, max("end") AS last FROM tops GROUP BY ord) m USING (ord) WHERE length(b.body) > m.last)"""

_SECTION_ROWS = """, flat AS (
 SELECT *, 0 AS s0, CASE WHEN k = 0 THEN o_h2 ELSE o_h1 END AS s1, o_h2 AS s2, o_h3 AS s3, CAST(length(body) AS INT) AS s4 FROM live),
sections AS (
 SELECT ord AS o, title, namespace_id, 0 AS ord, 0 AS start, s1 AS "end", s1 AS flat_end, 0 AS level, CAST(NULL AS VARCHAR) AS section_title, 0 AS head, body FROM flat
 UNION ALL SELECT ord, title, namespace_id, 1, s1, s3, s2, 2, concat(' ', lang, ' '), CAST(length(p_h1) AS INT), body FROM flat WHERE k <> 0
 UNION ALL SELECT ord, title, namespace_id, CASE WHEN k = 0 THEN 1 ELSE 2 END, s2, s3, s3, 3, ' Ejemplo ', 16, body FROM flat
 UNION ALL SELECT ord, title, namespace_id, CASE WHEN k = 0 THEN 2 ELSE 3 END, s3, s4, s4, 2, ' Fin ', 10, body FROM flat)
"""


def _sections(end: str) -> str:
    return f"""SELECT title, namespace_id, ord, CAST(start AS INT) AS start, CAST({end} AS INT) AS "end", level, section_title,
 substr(body, start + head + 1, {end} - start - head) AS contents FROM sections"""


def _cells(span: bool) -> str:
    rows = [("0", "0", "'a'", "' a '", "true"), ("0", "1", "'b'", "' b'", "true"),
            ("1", "0", "CAST(n_chars AS VARCHAR)", "concat(' ', n_chars)", "false")]
    if span:
        rows.append(("1", "1", "CAST(n_chars AS VARCHAR)", "", "false"))
    return " UNION ALL ".join(
        f"SELECT title, namespace_id, {_CELL_START}, {r} AS \"row\", {c} AS col, {v if span else raw} AS value, {h} AS is_header FROM live"
        for r, c, v, raw, h in rows
    )


def _like_regex(pattern: str) -> str:
    return f"regexp_matches(body, {_q(pattern)})"


_CODES = {"item": 6, "text": 5, "pron": 3}
_SUGGEST = " UNION ALL ".join(
    f"SELECT title, namespace_id, {i} AS rule, '{kind}' AS kind, '{tpl}' AS template, {_CODES[kind]} AS code, "
    f"CAST(length(regexp_extract_all(body, {_q(pattern)})) AS INT) AS n FROM live WHERE {_like_regex(pattern)}"
    for i, (kind, pattern, tpl) in enumerate(LABEL_RULES)
)
_LABELS = ", labels_es AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in enumerate(CORRECTION_LABELS)) + ") AS l(code, label))"
_CORRECTIONS = f""", suggested AS ({_SUGGEST}), codes AS (
 SELECT DISTINCT title, namespace_id, code FROM (
  SELECT title, namespace_id, code FROM suggested UNION ALL SELECT title, namespace_id, 8 FROM live
  UNION ALL SELECT title, namespace_id, 15 FROM live UNION ALL SELECT title, namespace_id, 13 FROM live
  UNION ALL SELECT title, namespace_id, 18 FROM live WHERE {_ES})){_LABELS},
 corrections AS (SELECT title, namespace_id, code, label FROM codes JOIN labels_es USING (code))"""

_TERM = "CASE ord % 5 WHEN 0 THEN 'verbo' WHEN 1 THEN 'forma verbal' WHEN 2 THEN 'símbolo' WHEN 3 THEN 'otro' ELSE 'forma adjetiva' END"
_ESCAPED = "body"
for _char in ["#", "="] + [c for c in NOWIKI_ESCAPES if c not in "#="]:
    # Entities hold # and ; only, so # goes first and nothing is escaped twice.
    _ESCAPED = f"replace({_ESCAPED}, {_q(_char)}, {_q(NOWIKI_ESCAPES[_char])})"
_ROWS1 = "CAST(start AS INT) AS start"

ORACLES: dict[str, str] = {
    "a1_read_dump": CTE + "SELECT title, ns, redirect, model, coalesce(text, '') AS text FROM raw_pages",
    "a2_read_namespaces": CTE + """, spaces AS (SELECT *, 'es' AS lang, name AS local FROM namespaces UNION ALL SELECT *, 'xx', concat('X ', canonical_name) FROM namespaces)
      SELECT title, namespace_id, lang, canonical_name, local AS name, CASE WHEN content AND id >= 0 THEN id + 1 END AS talk_id,
      CASE WHEN NOT (content AND id >= 0) AND istalk THEN id - 1 END AS subject_id FROM wiki_pages JOIN spaces ON id = namespace_id""",
    "a3_read_languages": CTE + "SELECT doc_id, code, name, CAST(l.ord - 1 AS INT) AS ord FROM documents JOIN languages l ON lang = code",
    "a3_lang_name": CTE + "SELECT doc_id, lang, name AS lang_name FROM documents LEFT JOIN languages ON lang = code",
    "a3_lang_code": CTE + """SELECT doc_id, l.name, i.code AS lang_code FROM documents LEFT JOIN languages l ON lang = l.code
      LEFT JOIN (SELECT name, arg_max(code, ord) AS code FROM languages GROUP BY name) i ON i.name = l.name""",
    "a4_filter_terms": CTE + f""", t AS (SELECT title, namespace_id, {_TERM} AS term FROM wiki_pages)
      SELECT *, 'class' AS kind FROM t WHERE term IN ({", ".join(map(_q, WORD_CLASSES))})
      UNION ALL SELECT *, 'inflected' FROM t WHERE term IN ('forma sustantiva', 'forma adjetiva', 'forma verbal')""",
    "a5_write_read_pages": CTE + "SELECT title, namespace_id, redirect_to, body, model FROM wiki_pages",
    "a6_title_report": CTE + f"SELECT title, count(*) OVER () AS total FROM wiki_pages WHERE {_FLAGGED}",
    "b1_eligible": CTE + f"SELECT ord, title, ns FROM raw_pages WHERE {_RAW_OK}",
    "b2_content_model_filter": CTE + f"SELECT ord, title, model FROM raw_pages WHERE {_MODEL_OK}",
    "b3_split_redirect": CTE + _SPLIT,
    "b4_normalise_title": CTE + ", " + _TITLED.format(split=_SPLIT) + f" SELECT ord, {_NORM} AS title, namespace_id, model FROM titled",
    "b4_normalise_title_of_language": CTE + ", spaces AS (SELECT id, concat('X ', canonical_name) AS name FROM namespaces), " + _TITLED.format(
        split=_SPLIT).replace("LEFT JOIN namespaces n", "LEFT JOIN spaces n") + f" SELECT ord, {_NORM} AS title, namespace_id FROM titled",
    "b5_template_body": CTE + f"SELECT title, namespace_id, CASE WHEN k = 0 THEN {_TPL_BODY} ELSE body END AS body FROM wiki",
    "b6_upsert_pages": _upsert(_BATCH),
    "b6_upsert_hot_page": _upsert(""", batch AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN 'Doc 3' ELSE title END AS title,
      CASE WHEN ord % 3 = 0 THEN 0 ELSE namespace_id END AS namespace_id, redirect_to, concat('v2 ', ord) AS body, model FROM wiki_pages)"""),
    "b7_ingest_dump": _INGESTED + "SELECT *, count(*) OVER () AS total FROM ingested",
    "b6s_stream_upsert": _INGESTED + "SELECT * FROM ingested",
    "b7_ingest_second_dump": _INGESTED + _SECOND + "SELECT *, count(*) OVER () AS total FROM merged",
    "b6s_merge": _INGESTED + _SECOND + "SELECT * FROM merged",
    "c1_search_pages": CTE + "SELECT title, namespace_id, model FROM wiki_pages WHERE namespace_id IN (0, 10) AND redirect_to IS NULL AND model = 'wikitext'",
    "c2_search_pattern": CTE + "SELECT title, namespace_id FROM wiki_pages WHERE contains(body, '{ES') OR contains(body, '''''''ej') OR contains(body, 'core')",
    "c3_search_regex": CTE + r"SELECT title, namespace_id FROM wiki_pages WHERE regexp_matches(body, '\{\{ES\|src1?[0-9]\|') OR regexp_matches(body, '== (de|es) ==')",
    "c4_search_exclude": CTE + "SELECT title, namespace_id FROM wiki_pages WHERE NOT contains(body, '{ES') AND NOT contains(body, '== en ==')",
    "c5_regex_exclude": CTE + r"SELECT title, namespace_id FROM wiki_pages WHERE NOT regexp_matches(body, '\{\{ES\|src1?[0-9]\|') AND NOT regexp_matches(body, '== (de|es) ==')",
    "c6_count_pages": CTE + "SELECT count(*) AS n FROM wiki_pages WHERE namespace_id = 0 AND contains(body, '{ES')",
    "c7_all_pages": CTE + """SELECT title, namespace_id, 'space' AS mode FROM wiki_pages WHERE namespace_id = 0 AND contains(body, ' ')
      UNION ALL SELECT title, namespace_id, 'any' FROM wiki_pages WHERE namespace_id = 0""",
    "c8_error_scan": CTE + f"SELECT title FROM wiki_pages WHERE {_FLAGGED}",
    "c8_error_hits": CTE + ", patterns AS (SELECT unnest([" + ", ".join(map(_q, ERROR_PATTERNS)) + """]) AS pattern)
      SELECT title, namespace_id, pattern FROM wiki_pages JOIN patterns ON contains(body, pattern) WHERE namespace_id = 0""",
    "c8_error_counts": CTE + ", patterns AS (SELECT unnest([" + ", ".join(map(_q, ERROR_PATTERNS)) + """]) AS pattern)
      SELECT pattern, count(*) AS pages FROM wiki_pages JOIN patterns ON contains(body, pattern) WHERE namespace_id = 0 GROUP BY pattern""",
    "g1_count": CTE + f"SELECT count(*) AS n FROM wiki_pages WHERE {_FLAGGED}",
    "j1_lookup_pages": CTE + f", {_lookup()} SELECT {_REQ}, found_title, found_ns, redirect_to, body, model FROM requests r LEFT JOIN found USING (request_id)",
    "j1_lookup_no_redirect": CTE + f", goal AS (SELECT * FROM wiki_pages WHERE redirect_to IS NULL), {_lookup(pages='goal')} SELECT {_REQ}, found_title, found_ns, model FROM requests r LEFT JOIN found USING (request_id)",
    "j2_capital_fallback": CTE + f", {_lookup()} SELECT {_REQ}, found_title, found_ns FROM requests r LEFT JOIN found USING (request_id) WHERE starts_with(r.title, 'doc ') AND r.namespace_id IN (10, 828)",
    "j3_lookup_anywhere": CTE + f", {_lookup()} SELECT {_REQ}, found_title, found_ns, model FROM requests r LEFT JOIN found USING (request_id) WHERE r.namespace_id IS NULL",
    "j4_pages_exist": CTE + f", anywhere AS (SELECT request_id, title, CAST(NULL AS INT) AS namespace_id FROM requests), {_lookup('anywhere')} SELECT r.request_id, r.title, found_title IS NOT NULL AS page_exists FROM anywhere r LEFT JOIN found USING (request_id)",
    "j5_resolve_redirects": CTE + _resolve("requests", "redirect_to, body, model"),
    "j5_resolve_hot_title": CTE + """, hot AS (SELECT ord AS request_id, CASE WHEN ord % 3 = 0 THEN 'Doc 5' ELSE title END AS title,
      CASE WHEN ord % 3 = 0 THEN 0 ELSE namespace_id END AS namespace_id FROM wiki_pages)""" + _resolve("hot", "model"),
    "j6_subject_talk_pairs": CTE + """, pairs AS (SELECT n.id, CASE WHEN content AND id >= 0 THEN id + 1 END AS talk_id,
      CASE WHEN NOT (content AND id >= 0) AND istalk THEN id - 1 END AS subject_id FROM namespaces n)
      SELECT title, namespace_id, talk_id, subject_id, o.name AS partner_name FROM wiki_pages LEFT JOIN pairs p ON p.id = namespace_id
      LEFT JOIN namespaces o ON o.id = coalesce(talk_id, subject_id)""",
    "j7_ancestors": ELS + """SELECT title, namespace_id, 'Template' AS kind, CAST(o_uso + 6 AS INT) AS start, CAST(o_uso + 6 + length(etim) AS INT) AS "end",
      'Template' AS outer_kind, o_uso AS outer_start, CAST(o_uso + 8 + length(etim) AS INT) AS outer_end, 1 AS distance FROM live""",
    "j7_parent": ELS + """SELECT title, namespace_id, 'Template' AS kind, CAST(o_uso + 6 AS INT) AS start, CAST(o_uso + 6 + length(etim) AS INT) AS "end",
      'Template' AS outer_kind, o_uso AS outer_start, CAST(o_uso + 8 + length(etim) AS INT) AS outer_end, 1 AS distance FROM live""",
    "j8_nesting_level": ELS + """SELECT title, namespace_id, kind, start, "end", CASE WHEN nested THEN 2 ELSE 1 END AS nesting_level
      FROM els WHERE kind IN ('Template', 'ParserFunction')""",
    "j8_table_nesting": ELS + """SELECT title, namespace_id, kind, start, "end", 0 AS nesting_level FROM els WHERE kind = 'Table'""",
    "j9_contains_element": ELS + f""", pairs AS (SELECT *, lag(start) OVER w AS a_start, lag("end") OVER w AS a_end FROM els
      WHERE kind IN {_NESTED} WINDOW w AS (PARTITION BY ord ORDER BY start))
      SELECT title, namespace_id, kind, start, a_start <= start AND "end" <= a_end AS inside FROM pairs WHERE a_start IS NOT NULL""",
    "g2_mode": ELS + "SELECT title, namespace_id, CAST(n_chars AS VARCHAR) AS mode, CASE WHEN ord % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n FROM live",
    "g3_max_width": ELS + "SELECT owner, CAST(max(length(name)) AS INT) AS width FROM args GROUP BY owner",
    "w1_segment": ELS + _SEGMENTS + """ SELECT title, namespace_id, CAST(row_number() OVER (PARTITION BY ord ORDER BY start) - 1 AS INT) AS ord,
      kind, start, "end", string FROM segs""",
    "w2_outermost": ELS + f"""SELECT title, namespace_id, kind, start, "end" FROM els WHERE kind IN {_NESTED} AND NOT nested""",
    "w3_section_extents": CTE + _SECTION_ROWS + """SELECT title, namespace_id, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", level FROM sections""",
    "w4_positional_numbering": ELS + "SELECT title, namespace_id, start, argno AS ord, name, \"positional\" FROM args",
    "w5_last_duplicates": ELS + "SELECT title, namespace_id, start, name, value FROM args WHERE argno <> 1",
    "o1_document_order": ELS + 'SELECT title, namespace_id, CAST(row_number() OVER (PARTITION BY ord ORDER BY start, rank, "end") AS INT) AS nth, kind, start FROM els',
    "o2_top1": CTE + _BATCH + "SELECT title, namespace_id, redirect_to, body, model FROM (SELECT *, row_number() OVER (PARTITION BY title, namespace_id ORDER BY ord DESC) AS nth FROM batch) WHERE nth = 1",
    "u1_elements": ELS + 'SELECT title, namespace_id, kind, start, "end", string FROM els',
    "x0_spans": ELS + f'SELECT title, namespace_id, kind, start, "end", string FROM els WHERE kind IN {_NESTED}',
    "x0_masked": ELS + """SELECT title, namespace_id, length(body) AS length,
      length(p_tpl) + length(p_uso) - 1 + 10 + length(body) - length(replace(body, 'X', '')) AS template_chars, length(p_comment) AS comment_chars
      FROM live UNION ALL SELECT title, namespace_id, NULL, NULL, NULL FROM wiki WHERE body IS NULL""",
    "x1_comments": ELS + """SELECT title, namespace_id, start, "end", concat(' c', ord, ' == no == ') AS contents FROM els WHERE kind = 'Comment'""",
    "x2_extension_tags": ELS + """SELECT title, namespace_id, start, regexp_extract(string, '^<([a-z]+)', 1) AS name, regexp_extract(string, '>([^<]*)<', 1) AS contents
      FROM els WHERE kind = 'ExtensionTag'""",
    "x3_html_tags": ELS + """SELECT title, namespace_id, start, "end", regexp_extract(string, '^<([a-z]+)', 1) AS name,
      CASE WHEN string = '<br/>' THEN NULL WHEN starts_with(string, '<small') THEN regexp_extract(string, '>(.*)</small>', 1) ELSE regexp_extract(string, '>([^<]*)<', 1) END AS contents
      FROM els WHERE kind IN ('ExtensionTag', 'Tag')""",
    "x3_html_tags_web": "SELECT url AS title, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS contents FROM pages",
    "x4_attributes": ELS + """SELECT title, namespace_id, start, 'name' AS attr, 'r' AS value FROM els WHERE kind = 'ExtensionTag' AND starts_with(string, '<ref')
      UNION ALL SELECT title, namespace_id, start, 'id', concat('s', ord) FROM els WHERE kind = 'Tag' AND starts_with(string, '<small')""",
    "x4_get_attr": ELS + """SELECT title, namespace_id, start, regexp_extract(string, '^<([a-z]+)', 1) AS name,
      CASE WHEN starts_with(string, '<small') THEN concat('s', ord) END AS value, starts_with(string, '<small') AS has_attr FROM els WHERE kind IN ('ExtensionTag', 'Tag')""",
    "x5_parameters": ELS + "SELECT title, namespace_id, o_param AS start, 'p' AS name, true AS has_default, lang AS \"default\" FROM live",
    "x6_parser_functions": ELS + "SELECT title, namespace_id, CAST(o_lc + 1 AS INT) AS start, 'lc' AS owner, 0 AS ord, 'ABC' AS value FROM live",
    "x7_templates": ELS + """SELECT title, namespace_id, start, regexp_extract(string, '^\\{\\{([^|]*)', 1) AS name, string FROM els WHERE kind = 'Template'""",
    "x8_template_args": ELS + "SELECT title, namespace_id, start, owner, argno AS ord, name, value, \"positional\", arg_start, value_start FROM args",
    "x9_normal_name": CTE + """SELECT title, namespace_id, concat(' eN : tEmPlAtE : <!-- c --> t_', ord, ' # b ') AS raw, concat('t ', ord) AS name, concat('T ', ord) AS capital FROM wiki_pages
      UNION ALL SELECT title, namespace_id, concat('Plantilla:  Doc_', ord, '__x#y'), concat('Doc ', ord, ' x'), concat('Doc ', ord, ' x') FROM wiki_pages
      UNION ALL SELECT title, namespace_id, concat(': d', ord, ' '), concat('d', ord), concat('D', ord) FROM wiki_pages""",
    "x10_get_arg": ELS + "SELECT title, namespace_id, start, owner, value, \"positional\" FROM args WHERE argno = 2",
    "x10_has_arg": ELS + """, owners AS (SELECT DISTINCT title, namespace_id, start, owner, first_value(value) OVER (PARTITION BY ord, start ORDER BY argno) AS one FROM args)
      SELECT title, namespace_id, start, owner, owner IN ('ES', 'lengua') AS has_arg FROM owners
      UNION ALL SELECT title, namespace_id, start, owner, one = 'src3' FROM owners""",
    "x11_wikilinks": ELS + """SELECT title, namespace_id, o_link1 AS start, concat('Doc ', ord + 1, '#s') AS target, concat('Doc ', ord + 1) AS link_title, 's' AS fragment, 'siguiente' AS text FROM live
      UNION ALL SELECT title, namespace_id, CAST(o_link2 + 1 AS INT), concat('Doc ', ord * 7 % 3000), concat('Doc ', ord * 7 % 3000), NULL, NULL FROM live""",
    "x12_external_links": ELS + """SELECT title, namespace_id, start, "end", string, concat('https://example.org/', ord) AS url, 'ref' AS text, true AS in_brackets FROM els WHERE kind = 'ExternalLink'""",
    "x13_section_titles": ELS + """SELECT title, namespace_id, start, "end", string, CASE WHEN starts_with(string, '===') THEN 3 ELSE 2 END AS level,
      trim(string, '=') AS section_title FROM els WHERE kind = 'SectionTitle'""",
    "x14_sections": CTE + _SECTION_ROWS + _sections('"end"'),
    "x14_sections_flat": CTE + _SECTION_ROWS + _sections("flat_end") + " WHERE level = 2",
    "x14_sections_top": CTE + _SECTION_ROWS + """SELECT title, namespace_id, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", level FROM sections WHERE level <> 3 OR o % 10 = 0""",
    "x15_bold_italic": ELS + """SELECT title, namespace_id, kind, start, "end", string, CASE WHEN kind = 'Bold' THEN 'ejemplo:' ELSE 'cursiva' END AS text FROM els WHERE kind IN ('Bold', 'Italic')""",
    "x16_lists": ELS + """SELECT title, namespace_id, start, "end", 1 AS level, string FROM els WHERE kind = 'WikiList'""",
    "x16_list_items": ELS + """SELECT title, namespace_id, start, start AS item_start, CASE WHEN starts_with(string, '*') THEN ' uno' ELSE ' tres' END AS item, string AS fullitem FROM els WHERE kind = 'WikiList'""",
    "x16_lists_pattern": ELS + """SELECT title, namespace_id, start, "end", 1 AS level, string FROM els WHERE kind = 'WikiList' AND starts_with(string, '*')""",
    "x17_sublists": ELS + """SELECT title, namespace_id, o_list1 AS list_start, CAST(o_list1 + 6 AS INT) AS start, CAST(o_list1 + 13 AS INT) AS "end", 2 AS level, concat('** dos', chr(10)) AS string FROM live""",
    "x17_sublists_of_item": ELS + """SELECT title, namespace_id, o_list1 AS item_start, CAST(o_list1 + 6 AS INT) AS start, concat('** dos', chr(10)) AS string FROM live""",
    "x18_tables": ELS + """SELECT title, namespace_id, o_table AS start, CAST(o_table + length(p_table) AS INT) AS "end", concat(' ', source) AS caption, CAST(NULL AS VARCHAR) AS caption_attrs, 't' AS class FROM live""",
    "x18_row_attrs": ELS + "SELECT title, namespace_id, o_table AS table_start, 0 AS \"row\", 0 AS n_attrs FROM live",
    "x19_table_cells": CTE + _cells(True),
    "x19_table_cells_no_span": CTE + _cells(False),
    "x19_table_column": CTE + f"SELECT * FROM ({_cells(True)}) WHERE \"row\" = 1 AND col = 1",
    "x20_element_string": ELS + f'SELECT title, namespace_id, kind, start, "end", string FROM els WHERE kind IN {_NESTED}',
    "t1_plain_text": _text(**_RENDERED),
    "t1_plain_text_switched_off": _text(**{p: s for p, s in _RENDERED.items() if p not in ("p_tpl", "p_uso", "p_incl", "p_ref", "p_html", "p_link1", "p_link2", "p_table", "p_amp")}),
    "t2_replacement_table": _text(**{**_RENDERED, "p_table": "p_table", "p_tpl": f"CASE WHEN {_ES} THEN '<es>' ELSE '<lengua>' END"}),
    "t2_replacement_function": _text(**{**_RENDERED, "p_table": "p_table", "p_tpl": "concat('[', length(p_tpl), ']')", "p_uso": "concat('[', length(p_uso) - 1, ']', chr(10))"}),
    "t2_replacement_rows": _text(**{**_RENDERED, "p_table": "p_table", "p_tpl": f"CASE WHEN {_ES} THEN '<es>' ELSE '<lengua>' END"}),
    "t2_table_function": _text(**{**_RENDERED, "p_table": "concat('[', length(p_table), ']')"}),
    "t3_table_text": CTE + f"SELECT title, namespace_id, {_CELL_START}, {_RENDERED['p_table']} AS text FROM live",
    "t4_unescape_entities": "SELECT url AS title, regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g') AS text FROM pages",
    "t4_unescape_basic": CTE + "SELECT title, namespace_id, replace(body, '&amp;', '&') AS text FROM wiki_pages",
    "t5_escape_nowiki": CTE + f"SELECT title, namespace_id, {_ESCAPED} AS escaped FROM wiki_pages",
    "t6_safe_filename": CTE + """, s AS (SELECT title, namespace_id, replace(body, '//', '__slashslash__') AS b FROM wiki_pages)
      SELECT title, namespace_id, CASE WHEN contains(b, '..') THEN replace(b, '.', '__dot__') ELSE b END AS safe FROM s""",
    "t7_codepoint_char": "SELECT doc_id, chr(CAST(doc_id * 7 % 50000 + 33 AS INT)) AS char FROM documents",
    "t8_string_primitives": CTE + """SELECT title, namespace_id, starts_with(body, 'De') AS starts, ends_with(body, '/>') AS ends,
      trim(body, concat(chr(13), chr(10), chr(9), ' ')) AS trimmed, split_part(body, '|', 1) AS head, contains(body, '|') AS found,
      CASE WHEN strpos(body, '|') > 0 THEN substr(body, strpos(body, '|') + 1) WHEN body IS NOT NULL THEN '' END AS tail,
      upper(substr(body, 1, 1)) || substr(body, 2) AS capital, lower(body) AS "lower" FROM wiki_pages""",
    "r0_apply_edits": _body(p_tpl="concat('', length(p_tpl))", p_uso="concat(length(p_uso) - 1, chr(10))", p_comment="concat('', length(p_comment))"),
    "r1_rename_template": _body(p_tpl=_tpl(f"CASE WHEN {_ES} THEN 'lengua es' ELSE 'lengua' END")),
    "r2_set_arg_update": _body(p_tpl=f"CASE WHEN {_ES} THEN concat('{{{{ES|', source, '|n=', n_chars, '|n=nuevo}}}}') ELSE p_tpl END"),
    "r2_set_arg_append": _body(p_tpl=f"CASE WHEN {_ES} THEN concat(substr(p_tpl, 1, length(p_tpl) - 2), '|m=nuevo}}}}') ELSE p_tpl END"),
    "r2_set_arg_spacing": _body(p_tpl=f"CASE WHEN {_ES} THEN p_tpl ELSE concat(substr(p_tpl, 1, length(p_tpl) - 2), '|m=nuevo}}}}') END"),
    "r2_set_arg_after": _body(p_tpl=f"CASE WHEN {_ES} THEN concat('{{{{ES|', source, '|m=nuevo', substr(p_tpl, 6 + length(source))) ELSE p_tpl END"),
    "r2_set_arg_positional": _body(p_tpl=f"CASE WHEN {_ES} THEN concat('{{{{ES|', source, '|n=', n_chars, '|nuevo}}}}') ELSE p_tpl END"),
    "r2_set_arg_many_rules": _body(p_tpl=f"CASE WHEN {_ES} THEN concat('{{{{ES|', source, '|n=', n_chars, '|n=nuevo}}}}') ELSE p_tpl END"),
    "r1_rename_many": _body(p_tpl=_tpl(f"CASE WHEN {_ES} THEN 'lengua es' ELSE 'lengua' END")),
    "r2_set_arg_before": _body(p_tpl=f"CASE WHEN {_ES} THEN concat('{{{{ES|m=nuevo', substr(p_tpl, 5)) ELSE p_tpl END"),
    "r3_del_arg": _body(p_tpl=_tpl(rest="concat('|', source)")),
    "r4_rm_first_of_dup_args": _body(p_tpl=_tpl(rest=f"concat('|', source, '|n=', {_EQ})")),
    "r5_rm_dup_args_safe": _body(p_tpl=_tpl(rest="concat('|', source, '|n=', n_chars)")),
    "r5_rm_dup_args_tag": _changed("replace(body, '|n=', '|n=a|n=')", p_tpl=_tpl(rest=
        "concat('|', source, '|n=a<!-- dup -->|n=', n_chars, CASE WHEN ord % 2 = 0 THEN '' ELSE '<!-- dup -->|n=a' END)")),
    "r6_edit_args_by_column": _body(p_uso="concat('{{Uso|{{etimología|k=v}}}}', chr(10))"),
    "r6_edit_args": _body(p_uso="concat('{{Uso|{{etimología|k=v}}}}', chr(10))"),
    "r7_edit_links": _body(p_link1="concat('[[Doc ', ord + 1, '#s|a Doc ', ord + 1, ']]')", p_link2="concat(' [[Doc ', ord * 7 % 3000, '|a Doc ', ord * 7 % 3000, ']] ')"),
    "r7_edit_targets": _body(p_link2="concat(' [[BDoc ', ord * 7 % 3000, ']] ')"),
    "r7_edit_titles": _body(p_link1="'[[T#s|siguiente]]'"),
    "r7_delete_text": _body(p_link1="concat('[[Doc ', ord + 1, '#s]]')"),
    "r7_retarget_links": _retargeted(),
    "r7_delete_fragment": _body(p_link1="concat('[[Doc ', ord + 1, '|siguiente]]')"),
    "r8_external_link_text": _body(p_ext="concat('[https://example.org/', ord, ' fuente]')"),
    "r8_external_link_url": _body(p_ext="concat('[https://example.org/', ord, '/x]')"),
    "r9_relevel_sections": _body(p_h1="CASE WHEN k = 0 THEN p_h1 ELSE concat('=== ', lang, ' ===', chr(10)) END", p_h2="concat('==== Ejemplo ====', chr(10))", p_h3="concat('=== Fin ===', chr(10))"),
    "r9_drop_titles": _body(p_h3="''"),
    "r9_set_title": _body(p_h3="concat('== Final ==', chr(10))"),
    "r9_set_contents": _body(**{p: "''" for p in list(PIECES)[list(PIECES).index("p_quote") + 1: list(PIECES).index("p_h3")]}, p_quote="concat('nada', chr(10))"),
    "r10_convert_lists": _body(p_list2="concat(': tres', chr(10))"),
    "r11_rename_tags": _body(p_html="replace(p_html, 'small', 'big')"),
    "r11_tag_contents": _body(p_html="replace(p_html, '<br/>', '<br>n</br>')"),
    "r12_set_tag_attr": _body(p_ref="replace(p_ref, 'name=\"r\"', 'name=\"z\"')"),
    "r12_del_tag_attr": _body(p_html="concat(' <small>nota <i>', lang, '</i></small><br/>')"),
    "r12_set_table_attr": _body(p_table="replace(p_table, '{| class=\"t\"', '{| class=\"t\" id=\"t1\"')"),
    "r12_set_cell_attr": _body(p_table="""replace(replace(p_table, '! a !! b', '! class="c" | a !! class="c" | b'), 'colspan="2" |', 'colspan="2" class="c" |')"""),
    "r13_set_cell": _body(p_table="replace(p_table, concat('| colspan=\"2\" | ', n_chars), '| colspan=\"2\" | x')"),
    "r13_set_caption_attrs": _changed("""CASE WHEN ord % 3 = 0 THEN body ELSE replace(body, '|+ ', '|+ id="c" | ') END""",
        p_table="""CASE WHEN ord % 3 = 0 THEN p_table ELSE replace(p_table, '|+ ', '|+ class="k" | ') END"""),
    "r13_set_caption": _body(p_table="replace(p_table, concat('|+ ', source), '|+ nuevo')"),
    "r13_set_row_attrs": _body(p_table="replace(p_table, concat('|-', chr(10)), concat('|- class=\"r\"', chr(10)))"),
    "r14_rename_parameters": _body(p_param="'{{{q|d}}}'"),
    "r14_delete_default": _body(p_param="'{{{p}}}'"),
    "r14_append_default": _body(p_param="concat('{{{p|{{{p3|', lang, '}}}}}}')"),
    "r15_strip_comments": _body(p_comment="''"),
    "r16_insert_at": CTE + """, n AS (SELECT title, namespace_id, body, CASE ord % 3 WHEN 0 THEN length(body) - 2 WHEN 1 THEN 5 ELSE least(999999, length(body)) END AS cutat FROM wiki_pages)
      SELECT title, namespace_id, CASE WHEN body IS NOT NULL THEN concat(substr(body, 1, cutat), 'INS', substr(body, cutat + 1)) END AS body, body IS NOT NULL AS changed FROM n""",
    "r16_delete_span": CTE + "SELECT title, namespace_id, CASE WHEN body IS NOT NULL THEN concat(substr(body, 1, 2), substr(body, 7)) END AS body, body IS NOT NULL AS changed FROM wiki_pages",
    "r7_fix_redirect_links": CTE + """, to_page AS (SELECT title AS t, redirect_to AS new FROM wiki_pages WHERE namespace_id = 0 AND redirect_to IS NOT NULL),
      n AS (SELECT w.*, a.new AS new1, b.new AS new2 FROM wiki w LEFT JOIN to_page a ON a.t = concat('Doc ', ord + 1) LEFT JOIN to_page b ON b.t = concat('Doc ', ord * 7 % 3000)),
      m AS (SELECT title, namespace_id, body, concat(""" + ", ".join(
        {"p_link1": "CASE WHEN new1 IS NULL THEN p_link1 ELSE concat('[[', new1, '#s|siguiente]]') END",
         "p_link2": "CASE WHEN new2 IS NULL THEN p_link2 ELSE concat(' [[', new2, ']] ') END"}.get(p, p) for p in PIECES
    ) + ") AS new_body FROM n) SELECT title, namespace_id, CASE WHEN body IS NOT NULL THEN new_body END AS body, coalesce(body <> new_body, false) AS changed FROM m",
    "r7_fix_hot_redirect_links": _fixed_links("CASE WHEN ord % 3 = 0 THEN concat(' [[Main:Doc_5#x|y]] [[Doc_9]] [[Falta ', ord, ']]') ELSE '' END"),
    "k1_label_suggestions": CTE + f", suggested AS ({_SUGGEST}) SELECT title, namespace_id, rule, kind, template, n FROM suggested",
    "k2_classify_legacy_templates": CTE + f"""SELECT title, namespace_id, o_tpl AS start, 'ES' AS name, 'lengua' AS class, 1 AS nth, 'replace' AS action,
      '{{{{lengua|es}}}}' AS replacement, 18 AS code FROM live WHERE {_ES}""",
    "k3_syllable_refs": ELS + """SELECT title, namespace_id, start, "end", true AS inside, false AS after FROM els WHERE kind = 'ExtensionTag' AND starts_with(string, '<ref')""",
    "k4_page_corrections": CTE + _CORRECTIONS + " SELECT title, namespace_id, code, label FROM corrections",
    "k4_correction_counts": CTE + _CORRECTIONS + " SELECT code, label, count(*) AS pages FROM corrections GROUP BY code, label",
    "k5_correct_pages": _body(p_tpl=f"CASE WHEN {_ES} THEN '{{{{lengua|es}}}}' ELSE p_tpl END", p_comment="''"),
}
