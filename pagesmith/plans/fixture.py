"""wiki_pages: wikitext pages made from the ``documents`` table.

One SQL text that Spark and DuckDB both run. Every document gives one page that holds
its whole text; the markup around it is built from the document's columns, piece by
piece, so an oracle can compute elements and offsets from those columns and never
parses anything. Redirects are further rows: two of ten documents give one besides their page,
with a negative number and no body.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

from pagesmith.session import shared_folder

# The pieces of a body, in order. q2 and q3 are two and three apostrophes.
PIECES = {
    "p_head": "concat(substr(text, 1, 200), chr(10))",
    "p_incl": """CASE WHEN k <> 0 THEN '' ELSE concat('<noinclude>doc ', ord, '</noinclude>',
        CASE WHEN ord % 20 = 0 THEN '<onlyinclude>core</onlyinclude>' ELSE '<includeonly>inc</includeonly>' END) END""",
    "p_h1": "concat('== ', lang, ' ==', chr(10))",
    "p_tpl": """concat(CASE WHEN ord % 3 = 0 THEN '{{ES|' ELSE '{{lengua|' END, source, '|n=', n_chars, '|n=',
        CASE WHEN ord % 2 = 0 THEN concat(n_chars, '') ELSE '' END, '}}')""",
    "p_uso": "concat('{{Uso|', etim, '}}', chr(10))",
    "p_h2": "concat('=== Ejemplo ===', chr(10))",
    "p_quote": "CASE WHEN ord % 4 = 0 THEN concat(q3, 'ejemplo:', q3, ' ') ELSE concat(q2, 'cursiva', q2, ' ') END",
    "p_rest": "concat(substr(text, 201), chr(10))",
    "p_comment": "concat('<!-- c', ord, ' == no == -->')",
    "p_link1": "concat('[[Doc ', ord + 1, '#s|siguiente]]')",
    "p_link2": "concat(' [[Doc ', ord * 7 % 3000, ']] ')",
    "p_ext": "concat('[https://example.org/', ord, ' ref]')",
    "p_nl": "chr(10)",
    "p_list1": "concat('* uno', chr(10), '** dos', chr(10))",
    "p_list2": "concat('# tres', chr(10))",
    "p_table": """concat('{| class="t"', chr(10), '|+ ', source, chr(10), '! a !! b', chr(10), '|-', chr(10),
        '| colspan="2" | ', n_chars, chr(10), '|}')""",
    "p_ref": """concat(chr(10), '<ref name="r">Separación silábica: a-b</ref>', chr(10))""",
    "p_h3": "concat('== Fin ==', chr(10))",
    "p_param": "concat('{{{p|', lang, '}}}')",
    "p_lc": "' {{lc:ABC}}'",
    "p_amp": "' &amp;'",
    "p_html": """concat(' <small id="s', ord, '">nota <i>', lang, '</i></small><br/>')""",
}


def _offset(piece: str) -> str:
    before = [f"length({p})" for p in list(PIECES)[: list(PIECES).index(piece)]]
    return "CAST(" + (" + ".join(before) or "0") + " AS INT)"


# Tables: ``src`` the columns, ``cut`` the pieces, ``wiki`` the page with the start of
# each piece (o_*), ``wiki_pages`` the page table.
CTE = f"""WITH src AS (
 SELECT ord, doc_id, rd, doc_id % 10 AS k, text, lang, source, n_chars,
  concat('{{{{etimología|', lang, '}}}}') AS etim,
  concat(chr(39), chr(39)) AS q2, concat(chr(39), chr(39), chr(39)) AS q3
 FROM (SELECT doc_id AS ord, false AS rd, doc_id, text, lang, source, n_chars FROM documents
  UNION ALL SELECT -1 - doc_id, true, doc_id, text, lang, source, n_chars FROM documents WHERE doc_id % 10 IN (5, 9)) AS d),
cut AS (SELECT src.*, {", ".join(f"{sql} AS {name}" for name, sql in PIECES.items())} FROM src),
wiki AS (SELECT ord, doc_id, rd, k, text, lang, source, n_chars, etim,
 CASE k WHEN 0 THEN concat('Plantilla:Doc ', ord) WHEN 1 THEN concat('Categoría:Doc ', ord)
  WHEN 2 THEN concat('Módulo:Doc ', ord) ELSE concat(CASE WHEN k IN (5, 9) AND NOT rd THEN 'Texto ' ELSE 'Doc ' END, doc_id) END AS title,
 CAST(CASE k WHEN 0 THEN 10 WHEN 1 THEN 14 WHEN 2 THEN 828 ELSE 0 END AS INT) AS namespace_id,
 CASE WHEN rd AND k = 5 THEN concat('Doc ', doc_id + 1) WHEN rd THEN concat('Doc ', doc_id - 4) ELSE NULL END AS redirect_to,
 CASE WHEN rd THEN NULL ELSE concat({", ".join(PIECES)}) END AS body,
 CASE WHEN k = 2 THEN 'Scribunto' WHEN ord % 13 = 5 THEN 'css' ELSE 'wikitext' END AS model,
 {", ".join(PIECES)},
 {", ".join(f"{_offset(p)} AS {p.replace('p_', 'o_')}" for p in PIECES)}
 FROM cut),
wiki_pages AS (SELECT ord, title, namespace_id, redirect_to, body, model FROM wiki),
live AS (SELECT * FROM wiki WHERE body IS NOT NULL),
raw_pages AS (SELECT ord,
 concat(CASE WHEN ord % 23 = 0 THEN 'Main:' ELSE '' END, CASE WHEN k IN (5, 9) AND NOT rd THEN 'Texto ' ELSE 'Doc ' END, doc_id,
  CASE WHEN ord % 11 = 0 THEN '/documentation' WHEN ord % 17 = 0 THEN '/testcases/1' ELSE '' END) AS title,
 CAST(CASE WHEN ord % 19 = 0 THEN 9999 ELSE namespace_id END AS INT) AS ns,
 redirect_to AS redirect, model, body AS text FROM wiki),
namespaces AS (SELECT CAST(id AS INT) AS id, canonical_name, name, content, issubject, istalk FROM (VALUES
 (-2, 'Media', 'Media', false, true, false), (-1, 'Special', 'Especial', false, true, false),
 (0, 'Main', 'Main', true, true, false), (1, 'Talk', 'Discusión', false, false, true),
 (2, 'User', 'Usuario', false, true, false), (3, 'User talk', 'Usuario discusión', false, false, true),
 (10, 'Template', 'Plantilla', false, true, false), (11, 'Template talk', 'Plantilla discusión', false, false, true),
 (14, 'Category', 'Categoría', true, true, false), (15, 'Category talk', 'Categoría discusión', false, false, true),
 (828, 'Module', 'Módulo', false, true, false), (829, 'Module talk', 'Módulo discusión', false, false, true)
 ) AS n(id, canonical_name, name, content, issubject, istalk)),
languages AS (SELECT * FROM (VALUES ('de', 'alemán', 1), ('en', 'inglés', 2), ('es', 'español', 3),
 ('fr', 'francés', 4), ('esp', 'español', 5)) AS l(code, name, ord)),
requests AS (
 SELECT ord AS request_id, title, CAST(namespace_id AS INT) AS namespace_id FROM wiki
 UNION ALL SELECT ord + 1000000000, replace(title, ' ', '_'), namespace_id FROM wiki
 UNION ALL SELECT ord + 2000000000, concat('Main:', title), CAST(NULL AS INT) FROM wiki
 UNION ALL SELECT ord + 3000000000, concat('doc ', ord), namespace_id FROM wiki
 UNION ALL SELECT ord + 4000000000, CASE WHEN ord % 2 = 0 THEN '' ELSE concat('Falta ', ord) END, CAST(0 AS INT) FROM wiki
 UNION ALL SELECT ord + 5000000000, concat('Doc ', ord - ord % 3), CAST(10 AS INT) FROM wiki)
"""


_WRITTEN = ("wiki_pages", "raw_pages", "requests")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the fixture over the documents of that folder.

    The page tables are written once per session to the shared folder and read back, so
    that queries scan a page table as they would scan a real one.
    """
    if name not in _WRITTEN:
        return sql(spark, sf_dir, f"SELECT * FROM {name}")
    digest = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:12]
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{digest}-{name}"
    if path not in _paths:
        made = sql(spark, sf_dir, f"SELECT * FROM {name}")
        # A small file is read by one task however many splits it has, so rows are dealt anew.
        made = made.repartition(max(spark.sparkContext.defaultParallelism, made.rdd.getNumPartitions()))
        made.write.mode("overwrite").parquet(path)
        _paths[path] = made.schema
    return spark.read.schema(_paths[path]).parquet(path)


_paths: dict = {}


def sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
    return spark.sql(CTE + query)
