"""One query per operator over the fixture tables; names are operator id and operator."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesmith.functions import text
from pagesmith.operators import corrections as K
from pagesmith.operators import extract as X
from pagesmith.operators import ingest as B
from pagesmith.operators import intervals as W
from pagesmith.operators import lookup as J
from pagesmith.operators import plaintext as T
from pagesmith.operators import rewrite as R
from pagesmith.operators import search as C
from pagesmith.operators import segments as S
from pagesmith.plans import fixture
from pagesmith.session import shared_folder
from pagesmith.sources import dump, tables
from pagesmith.streaming import upsert

KEY = ["title", "namespace_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def wiki(spark, sf):
    return fixture.table(spark, sf, "wiki_pages")


def names(spark, sf):
    return fixture.table(spark, sf, "namespaces")


def asked(spark, sf):
    return fixture.table(spark, sf, "requests")


def new_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def web(spark, sf):
    """The web pages table as a page table."""
    raw = spark.read.parquet(f"{sf}/pages.parquet")
    return raw.select(F.col("url").alias("title"), F.lit(0).alias("namespace_id"), F.col("html").alias("body"))


def write_dump(spark, sf, raw: DataFrame | None = None, path: str | None = None) -> str:
    """Dump files of the fixture: export elements in order, text escaped, bz2."""
    def esc(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    raw = fixture.table(spark, sf, "raw_pages") if raw is None else raw
    redirect = F.when(F.col("redirect").isNotNull(), F.concat(F.lit('    <redirect title="'), esc("redirect"), F.lit('" />\n'))).otherwise("")
    xml = F.concat(
        F.lit("  <page>\n    <title>"), esc("title"), F.lit("</title>\n    <ns>"), F.col("ns").cast("string"),
        F.lit("</ns>\n    <id>"), F.col("ord").cast("string"), F.lit("</id>\n"), redirect,
        F.lit("    <revision>\n      <model>"), "model", F.lit('</model>\n      <text bytes="1" xml:space="preserve">'),
        esc(F.coalesce("text", F.lit(""))), F.lit("</text>\n    </revision>\n  </page>"),
    )
    path = path or new_folder(spark, "dump")
    raw.select(xml.alias("value")).write.mode("append").option("compression", "bzip2").text(path)
    return path


# --- A ------------------------------------------------------------------------------


@query
def a1_read_dump(spark, sf):
    return dump.read_dump(spark, write_dump(spark, sf) + "/*.bz2").drop("ord")


def _namespace_files(spark, sf) -> str:
    """Files of two languages, ``<lang>/namespaces.json``, written from the fixture's namespaces."""
    folder = new_folder(spark, "languages")
    for lang, name in (("es", F.col("name")), ("xx", F.concat(F.lit("X "), "canonical_name"))):
        entry = F.struct("id", name.alias("name"), "content", F.array().cast("array<string>").alias("aliases"), "issubject", "istalk")
        whole = F.to_json(F.map_from_entries(F.collect_list(F.struct("canonical_name", entry))))
        names(spark, sf).agg(whole.alias("value")).coalesce(1).write.text(f"{folder}/{lang}/namespaces.json")
    return folder


@query
def a2_read_namespaces(spark, sf):
    """Every page with the names of its namespace in two languages."""
    spaces = tables.read_namespaces(spark, _namespace_files(spark, sf))
    named = spaces.select("lang", F.col("id").alias("namespace_id"), "canonical_name", "name", "talk_id", "subject_id")
    return wiki(spark, sf).select(*KEY).join(named, "namespace_id")


@query
def a3_read_languages(spark, sf):
    """Languages read from a file, and the documents in them."""
    path = new_folder(spark, "codes")
    listed = fixture.table(spark, sf, "languages").agg(F.to_json(F.map_from_entries(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "code", "name"))), lambda l: F.struct(l["code"], l["name"])))).alias("value"))
    listed.coalesce(1).write.text(path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("code"))
    return docs.join(tables.read_languages(spark, path), "code")


@query
def a3_lang_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    return tables.lang_name(docs, "lang", fixture.table(spark, sf, "languages"))


@query
def a3_lang_code(spark, sf):
    languages = fixture.table(spark, sf, "languages")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    named = tables.lang_name(docs, "lang", languages, "name")
    return tables.lang_code(named, "name", languages).select("doc_id", "name", "lang_code")


_TERM = "CASE ord % 5 WHEN 0 THEN 'verbo' WHEN 1 THEN 'forma verbal' WHEN 2 THEN 'símbolo' WHEN 3 THEN 'otro' ELSE 'forma adjetiva' END"


@query
def a4_filter_terms(spark, sf):
    rows = wiki(spark, sf).select(*KEY, F.expr(_TERM).alias("term"))
    both = tables.filter_terms(rows, "term", "class").withColumn("kind", F.lit("class"))
    return both.unionByName(tables.filter_terms(rows, "term", "inflected").withColumn("kind", F.lit("inflected")))


@query
def a5_write_read_pages(spark, sf):
    path = new_folder(spark, "pages")
    tables.write_pages(wiki(spark, sf), path)
    return tables.read_pages(spark, path)


@query
def a6_title_report(spark, sf):
    path = new_folder(spark, "titles")
    total = tables.write_title_report(C.error_scan(wiki(spark, sf)), path)
    return spark.read.text(path).select(F.col("value").alias("title"), F.lit(total).cast("bigint").alias("total"))


# --- B ------------------------------------------------------------------------------


@query
def b1_eligible(spark, sf):
    return B.eligible(fixture.table(spark, sf, "raw_pages"), names(spark, sf)).select("ord", "title", "ns")


@query
def b2_content_model_filter(spark, sf):
    return B.content_model_filter(fixture.table(spark, sf, "raw_pages")).select("ord", "title", "model")


@query
def b3_split_redirect(spark, sf):
    return B.split_redirect(fixture.table(spark, sf, "raw_pages"))


@query
def b4_normalise_title(spark, sf):
    pages = B.split_redirect(fixture.table(spark, sf, "raw_pages"))
    return B.normalise_title(pages, names(spark, sf)).select("ord", *KEY, "model")


@query
def b4_normalise_title_of_language(spark, sf):
    """One of two languages of a namespace table."""
    pages = B.split_redirect(fixture.table(spark, sf, "raw_pages"))
    spaces = tables.read_namespaces(spark, _namespace_files(spark, sf))
    return B.normalise_title(pages, spaces, "xx").select("ord", *KEY)


@query
def b5_template_body(spark, sf):
    return B.transclude_templates(wiki(spark, sf), names(spark, sf)).select(*KEY, "body")


def _batch(pages):
    """New versions of all pages outside the main namespace, modules twice, and new pages."""
    others = pages.where("namespace_id <> 0")
    newer = others.selectExpr("ord", "title", "namespace_id", "CAST(NULL AS STRING) redirect_to", "concat('v2 ', ord) body", "model")
    again = others.where("model = 'Scribunto'").selectExpr(
        "ord + 1000000000 ord", "title", "namespace_id", "CAST(NULL AS STRING) redirect_to", "concat('v3 ', ord) body", "model")
    fresh = pages.selectExpr("ord", "concat('Nuevo ', ord) title", "0 namespace_id", "CAST(NULL AS STRING) redirect_to", "concat('v2 ', ord) body", "model")
    return newer.unionByName(again).unionByName(fresh)


@query
def b6_upsert_pages(spark, sf):
    pages = wiki(spark, sf)
    return B.upsert_pages(pages, _batch(pages)).drop("ord")


@query
def b6_upsert_hot_page(spark, sf):
    """A third of the batch are versions of one page."""
    pages = wiki(spark, sf)
    hot = pages.selectExpr("ord", "CASE WHEN ord % 3 = 0 THEN 'Doc 3' ELSE title END title",
                           "CASE WHEN ord % 3 = 0 THEN 0 ELSE namespace_id END namespace_id",
                           "redirect_to", "concat('v2 ', ord) body", "model")
    return B.upsert_pages(pages, hot).drop("ord")


@query
def b7_ingest_dump(spark, sf):
    path = new_folder(spark, "table")
    n = B.ingest_dump(spark, write_dump(spark, sf) + "/*.bz2", names(spark, sf), path)
    return tables.read_pages(spark, path).withColumn("total", F.lit(n).cast("bigint"))


def _second_dump(spark, sf) -> DataFrame:
    """A later dump: the templates and categories with new texts, redirects made pages, and new pages."""
    raw = fixture.table(spark, sf, "raw_pages")
    some = raw.where("ns IN (10, 14) OR redirect IS NOT NULL").selectExpr(
        "ord", "title", "ns", "CAST(NULL AS STRING) redirect", "'wikitext' model", "concat('v2 ', ord) text")
    new = raw.where("ord % 7 = 0").selectExpr(
        "ord", "concat('Nuevo ', ord) title", "0 ns", "CAST(NULL AS STRING) redirect", "'wikitext' model", "concat('new ', ord) text")
    return some.unionByName(new)


@query
def b7_ingest_second_dump(spark, sf):
    path = new_folder(spark, "table")
    B.ingest_dump(spark, write_dump(spark, sf) + "/*.bz2", names(spark, sf), path)
    n = B.ingest_dump(spark, write_dump(spark, sf, _second_dump(spark, sf)) + "/*.bz2", names(spark, sf), path)
    return tables.read_pages(spark, path).withColumn("total", F.lit(n).cast("bigint"))


@query
def b6s_merge(spark, sf):
    """Two runs of the stream, folded in between and after; the second one has the later dump."""
    out, log, folder = new_folder(spark, "stream"), new_folder(spark, "offsets"), new_folder(spark, "dump")
    for raw in (None, _second_dump(spark, sf)):
        write_dump(spark, sf, raw, folder)
        upsert.stream_upsert(spark, folder, out, log, names(spark, sf), fold_every=1).awaitTermination()
    return upsert.current_pages(spark, out)


@query
def b6s_stream_upsert(spark, sf):
    out = new_folder(spark, "stream")
    stream = upsert.stream_upsert(spark, write_dump(spark, sf), out, new_folder(spark, "offsets"), names(spark, sf))
    stream.awaitTermination()
    return upsert.current_pages(spark, out)


# --- C ------------------------------------------------------------------------------


@query
def c1_search_pages(spark, sf):
    return C.search_pages(wiki(spark, sf), [0, 10], include_redirects=False, model="wikitext").select(*KEY, "model")


@query
def c2_search_pattern(spark, sf):
    return C.search_pages(wiki(spark, sf), search_pattern=["{ES", "'''ej", "core"]).select(*KEY)


@query
def c3_search_regex(spark, sf):
    return C.search_pages(wiki(spark, sf), search_regex=[r"\{\{ES\|src1?[0-9]\|", r"== (de|es) =="]).select(*KEY)


@query
def c4_search_exclude(spark, sf):
    return C.search_pages(wiki(spark, sf), search_exclude=["{ES", "== en =="]).select(*KEY)


@query
def c5_regex_exclude(spark, sf):
    return C.search_pages(wiki(spark, sf), regex_exclude=[r"\{\{ES\|src1?[0-9]\|", r"== (de|es) =="]).select(*KEY)


@query
def c6_count_pages(spark, sf):
    return C.count_pages(wiki(spark, sf), namespace_ids=[0], search_pattern="{ES")


@query
def c7_all_pages(spark, sf):
    pages = wiki(spark, sf)
    strict = C.all_pages(pages, namespace_ids=[0]).select(*KEY, F.lit("space").alias("mode"))
    return strict.unionByName(C.all_pages(pages, require_space=False, namespace_ids=[0]).select(*KEY, F.lit("any").alias("mode")))


@query
def c8_error_scan(spark, sf):
    return C.error_scan(wiki(spark, sf)).select("title")


@query
def c8_error_hits(spark, sf):
    return C.error_hits(wiki(spark, sf))


@query
def c8_error_counts(spark, sf):
    return C.error_counts(wiki(spark, sf))


@query
def g1_count(spark, sf):
    return C.error_scan(wiki(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


# --- J ------------------------------------------------------------------------------


@query
def j1_lookup_pages(spark, sf):
    return J.lookup_pages(asked(spark, sf), wiki(spark, sf), names(spark, sf))


@query
def j1_lookup_no_redirect(spark, sf):
    return J.lookup_pages(asked(spark, sf), wiki(spark, sf), names(spark, sf), no_redirect=True, columns=("model",))


@query
def j2_capital_fallback(spark, sf):
    wanted = asked(spark, sf).where(F.col("title").startswith("doc ") & F.col("namespace_id").isin(10, 828))
    return J.lookup_pages(wanted, wiki(spark, sf), names(spark, sf), columns=())


@query
def j3_lookup_anywhere(spark, sf):
    wanted = asked(spark, sf).where("namespace_id IS NULL")
    return J.lookup_pages(wanted, wiki(spark, sf), names(spark, sf), columns=("model",))


@query
def j4_pages_exist(spark, sf):
    return J.pages_exist(asked(spark, sf), wiki(spark, sf), names(spark, sf))


@query
def j5_resolve_redirects(spark, sf):
    return J.resolve_redirects(asked(spark, sf), wiki(spark, sf), names(spark, sf))


@query
def j5_resolve_hot_title(spark, sf):
    """A third of the requests ask for one redirect."""
    pages = wiki(spark, sf)
    hot = pages.selectExpr("ord request_id", "CASE WHEN ord % 3 = 0 THEN 'Doc 5' ELSE title END title",
                           "CASE WHEN ord % 3 = 0 THEN 0 ELSE namespace_id END namespace_id")
    return J.resolve_redirects(hot, pages, names(spark, sf), columns=("model",))


@query
def j6_subject_talk_pairs(spark, sf):
    pairs = tables.subject_talk_pairs(names(spark, sf)).select(F.col("id").alias("namespace_id"), "talk_id", "subject_id", "partner_name")
    return wiki(spark, sf).select(*KEY).join(pairs, "namespace_id", "left")


@query
def j7_ancestors(spark, sf):
    return W.ancestors(X.spans(wiki(spark, sf)))


@query
def j7_parent(spark, sf):
    return W.parent(X.spans(wiki(spark, sf)), ["Template"])


@query
def j8_nesting_level(spark, sf):
    return W.nesting_level(X.spans(wiki(spark, sf)))


@query
def j8_table_nesting(spark, sf):
    return W.nesting_level(X.tables(wiki(spark, sf), recursive=True), ("Table",))


@query
def j9_contains_element(spark, sf):
    """Each pair of an element and the one before it."""
    from pyspark.sql.window import Window

    order = Window.partitionBy(*KEY).orderBy("start")
    rows = X.spans(wiki(spark, sf)).select(*KEY, "kind", "start", "end", F.lag("start").over(order).alias("a_start"), F.lag("end").over(order).alias("a_end"))
    inside = W.contains_element(F.col("a_start"), F.col("a_end"), F.col("start"), F.col("end"))
    return rows.where("a_start IS NOT NULL").select(*KEY, "kind", "start", inside.alias("inside"))


# --- G, W, O, U ---------------------------------------------------------------------


def _args(spark, sf):
    return X.template_args(X.templates(wiki(spark, sf)))


@query
def g2_mode(spark, sf):
    """Most common value of n per page, the first one among ties."""
    return W.first_mode(_args(spark, sf).where("name = 'n'"), KEY, F.col("value"), F.col("ord")).select(*KEY, "mode", "n")


@query
def g3_max_width(spark, sf):
    return W.max_width(_args(spark, sf), ["owner"], text.trim_ws("name"))


@query
def w1_segment(spark, sf):
    return S.segment(wiki(spark, sf))


@query
def w2_outermost(spark, sf):
    return W.outermost(X.spans(wiki(spark, sf))).select(*KEY, "kind", "start", "end")


@query
def w3_section_extents(spark, sf):
    return X.sections(wiki(spark, sf)).select(*KEY, "start", "end", "level")


@query
def w4_positional_numbering(spark, sf):
    return _args(spark, sf).select(*KEY, "start", "ord", "name", "positional")


@query
def w5_last_duplicates(spark, sf):
    ranked = W.last_duplicates(_args(spark, sf), [*KEY, "start"], text.trim_ws("name"))
    return ranked.where("is_last").select(*KEY, "start", "name", "value")


@query
def o1_document_order(spark, sf):
    """The running number of each element in document order."""
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("start", "rank", "end"))
    return S.document_order(S.elements(wiki(spark, sf)).withColumn("nth", nth)).select(*KEY, "nth", "kind", "start")


@query
def o2_top1(spark, sf):
    return B.latest(_batch(wiki(spark, sf)), "ord").drop("ord")


@query
def u1_elements(spark, sf):
    return S.elements(wiki(spark, sf)).select(*KEY, "kind", "start", "end", "string")


# --- X ------------------------------------------------------------------------------


@query
def x0_spans(spark, sf):
    return X.spans(wiki(spark, sf), fields=("string",))


@query
def x0_masked(spark, sf):
    return X.masked(wiki(spark, sf)).select(*KEY, F.length("shadow").cast("bigint").alias("length"),
                                            F.regexp_count("shadow", F.lit("X")).cast("bigint").alias("template_chars"),
                                            F.regexp_count("shadow", F.lit("\\x00")).cast("bigint").alias("comment_chars"))


@query
def x1_comments(spark, sf):
    return X.comments(wiki(spark, sf))


@query
def x2_extension_tags(spark, sf):
    return X.extension_tags(wiki(spark, sf)).select(*KEY, "start", "name", "contents")


@query
def x3_html_tags(spark, sf):
    return X.html_tags(wiki(spark, sf)).select(*KEY, "start", "end", "name", "contents")


@query
def x3_html_tags_web(spark, sf):
    return X.html_tags(web(spark, sf), "li").select("title", "contents")


@query
def x4_attributes(spark, sf):
    return X.attributes(X.html_tags(wiki(spark, sf))).drop("end")


@query
def x4_get_attr(spark, sf):
    return X.get_attr(X.html_tags(wiki(spark, sf)), "id").select(*KEY, "start", "name", "value", "has_attr")


@query
def x5_parameters(spark, sf):
    return X.parameters(wiki(spark, sf)).select(*KEY, "start", "name", "has_default", "default")


@query
def x6_parser_functions(spark, sf):
    functions = X.parser_functions(wiki(spark, sf))
    return X.template_args(functions).select(*KEY, "start", "owner", "ord", "value")


@query
def x7_templates(spark, sf):
    return X.templates(wiki(spark, sf)).select(*KEY, "start", "name", "string")


@query
def x8_template_args(spark, sf):
    return _args(spark, sf).select(*KEY, "start", "owner", "ord", "name", "value", "positional", "arg_start", "value_start")


@query
def x9_normal_name(spark, sf):
    """Variants of a name made from each page."""
    rows = wiki(spark, sf).select(*KEY, F.explode(F.expr(
        "array(concat(' eN : tEmPlAtE : <!-- c --> t_', ord, ' # b '), concat('Plantilla:  Doc_', ord, '__x#y'), concat(': d', ord, ' '))"
    )).alias("raw"))
    plain = text.normal_name("raw", ("Template", "Plantilla"), code="en")
    return rows.select(*KEY, "raw", plain.alias("name"), text.normal_name("raw", ("Template", "Plantilla"), code="en", capitalize=True).alias("capital"))


@query
def x10_get_arg(spark, sf):
    return X.get_arg(_args(spark, sf), "n")


@query
def x10_has_arg(spark, sf):
    args = _args(spark, sf)
    return X.has_arg(args, "n").unionByName(X.has_arg(args, "1", "src3"))


@query
def x11_wikilinks(spark, sf):
    return X.wikilinks(wiki(spark, sf)).select(*KEY, "start", "target", "link_title", "fragment", "text")


@query
def x12_external_links(spark, sf):
    return X.external_links(wiki(spark, sf)).drop("kind")


@query
def x13_section_titles(spark, sf):
    return X.section_titles(wiki(spark, sf)).drop("kind")


@query
def x14_sections(spark, sf):
    return X.sections(wiki(spark, sf))


@query
def x14_sections_flat(spark, sf):
    return X.sections(wiki(spark, sf), include_subsections=False, level=2)


@query
def x14_sections_top(spark, sf):
    return X.sections(wiki(spark, sf), top_levels_only=True).select(*KEY, "start", "end", "level")


@query
def x15_bold_italic(spark, sf):
    return X.bold_italic(wiki(spark, sf))


@query
def x16_lists(spark, sf):
    return X.lists(wiki(spark, sf)).select(*KEY, "start", "end", "level", "string")


@query
def x16_list_items(spark, sf):
    return X.list_items(X.lists(wiki(spark, sf))).select(*KEY, "start", "item_start", "item", "fullitem")


@query
def x16_lists_pattern(spark, sf):
    return X.lists(wiki(spark, sf), r"\*+").select(*KEY, "start", "end", "level", "string")


@query
def x17_sublists(spark, sf):
    return X.sublists(X.lists(wiki(spark, sf))).select(*KEY, "list_start", "start", "end", "level", "string")


@query
def x17_sublists_of_item(spark, sf):
    lists = X.lists(wiki(spark, sf))
    items = X.list_items(lists).select(*KEY, "start", "item_start", "item_end")
    inside = X.sublists(lists.join(items, [*KEY, "start"]), item_span=True)
    return inside.select(*KEY, "item_start", "start", "string")


@query
def x18_tables(spark, sf):
    return X.tables(wiki(spark, sf)).select(*KEY, "start", "end", "caption", "caption_attrs", F.get(F.map_values("attrs"), F.lit(0)).alias("class"))


@query
def x18_row_attrs(spark, sf):
    return X.table_row_attrs(X.tables(wiki(spark, sf))).select(*KEY, "table_start", "row", F.size("attrs").alias("n_attrs"))


_CELLS = [*KEY, "table_start", "row", "col", "value", "is_header"]


@query
def x19_table_cells(spark, sf):
    return X.table_cells(X.tables(wiki(spark, sf))).select(*_CELLS)


@query
def x19_table_cells_no_span(spark, sf):
    return X.table_cells(X.tables(wiki(spark, sf)), span=False, strip=False).select(*_CELLS)


@query
def x19_table_column(spark, sf):
    return X.table_cells(X.tables(wiki(spark, sf)), row=1, column=1).select(*_CELLS)


@query
def x20_element_string(spark, sf):
    pages = wiki(spark, sf)
    return X.element_string(X.spans(pages).select(*KEY, "kind", "start", "end"), pages)


# --- T ------------------------------------------------------------------------------


@query
def t1_plain_text(spark, sf):
    return T.plain_text(wiki(spark, sf))


@query
def t1_plain_text_switched_off(spark, sf):
    return T.plain_text(wiki(spark, sf), replace_templates=False, replace_tags=False, replace_wikilinks=False,
                        replace_tables=False, unescape_html_entities=False)


@query
def t2_replacement_table(spark, sf):
    return T.plain_text(wiki(spark, sf), replacements={"ES": "<es>", "lengua": "<lengua>"}, replace_tables=False)


@query
def t2_replacement_function(spark, sf):
    return T.plain_text(wiki(spark, sf), replace_tables=False, replace_templates=lambda f: F.concat(
        F.lit("["), F.length(f["string"]).cast("string"), F.lit("]")))


@query
def t2_replacement_rows(spark, sf):
    """Texts from a table: one name for every source, and the two of the fixture."""
    pages = wiki(spark, sf)
    rows = pages.select(F.explode(F.expr("array(named_struct('name', concat('Doc ', ord), 'text', 'x'), named_struct('name', 'ES', 'text', '<es>'), named_struct('name', 'lengua', 'text', '<lengua>'))")).alias("r"))
    return T.plain_text(pages, replacements=rows.select("r.*").distinct(), replace_tables=False)


@query
def t2_table_function(spark, sf):
    return T.plain_text(wiki(spark, sf), replace_tables=lambda t: F.concat(F.lit("["), F.length(t).cast("string"), F.lit("]")))


@query
def t3_table_text(spark, sf):
    return X.table_text(X.tables(wiki(spark, sf))).select(*KEY, F.col("start").alias("table_start"), "text")


@query
def t4_unescape_entities(spark, sf):
    return web(spark, sf).select("title", text.unescape_entities("body").alias("text"))


@query
def t4_unescape_basic(spark, sf):
    return wiki(spark, sf).select(*KEY, text.unescape_basic("body").alias("text"))


@query
def t5_escape_nowiki(spark, sf):
    return wiki(spark, sf).select(*KEY, text.escape_nowiki("body").alias("escaped"))


@query
def t6_safe_filename(spark, sf):
    return wiki(spark, sf).select(*KEY, text.safe_filename("body").alias("safe"))


@query
def t7_codepoint_char(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", text.codepoint_char(F.col("doc_id") * 7 % 50000 + 33).alias("char"))


@query
def t8_string_primitives(spark, sf):
    body = F.col("body")
    head, found, tail = text.partition(body, "|")
    return wiki(spark, sf).select(
        *KEY, body.startswith("De").alias("starts"), body.endswith("/>").alias("ends"), text.trim_ws("body").alias("trimmed"),
        head.alias("head"), found.alias("found"), tail.alias("tail"), text.first_upper(body).alias("capital"), F.lower("body").alias("lower"),
    )


# --- R ------------------------------------------------------------------------------


def _bodies(changed: DataFrame) -> DataFrame:
    return changed.select(*KEY, "body", "changed")


@query
def r0_apply_edits(spark, sf):
    """Every template and comment gives way to its length."""
    pages = wiki(spark, sf)
    rows = X.spans(pages, ["Template", "Comment"])
    return _bodies(R.apply_edits(pages, rows.select(*KEY, "start", "end", F.length("string").cast("string").alias("new"))))


@query
def r1_rename_template(spark, sf):
    pages = wiki(spark, sf)
    renames = pages.select(F.lit("ES").alias("name"), F.lit("lengua es").alias("new")).distinct()
    return _bodies(R.rename_template(pages, renames))


def _rules(pages, owner, name, value):
    return pages.select(F.lit(owner).alias("owner"), F.lit(name).alias("name"), F.lit(value).alias("value")).distinct()


@query
def r2_set_arg_update(spark, sf):
    pages = wiki(spark, sf)
    return _bodies(R.set_arg(pages, _rules(pages, "ES", "n", "nuevo")))


@query
def r2_set_arg_append(spark, sf):
    pages = wiki(spark, sf)
    return _bodies(R.set_arg(pages, _rules(pages, "ES", "m", "nuevo")))


@query
def r2_set_arg_spacing(spark, sf):
    pages = wiki(spark, sf)
    return _bodies(R.set_arg(pages, _rules(pages, "lengua", "m", "nuevo"), preserve_spacing=True))


@query
def r2_set_arg_after(spark, sf):
    pages = wiki(spark, sf)
    return _bodies(R.set_arg(pages, _rules(pages, "ES", "m", "nuevo"), after="1"))


@query
def r2_set_arg_positional(spark, sf):
    pages = wiki(spark, sf)
    return _bodies(R.set_arg(pages, _rules(pages, "ES", "n", "nuevo"), positional=True))


@query
def r2_set_arg_many_rules(spark, sf):
    """More rules than ride along as a constant: one for a name per page, and the template of a third of them."""
    pages = wiki(spark, sf)
    many = pages.select(F.concat(F.lit("Doc "), "ord").alias("owner"), F.lit("n").alias("name"), F.lit("x").alias("value"))
    return _bodies(R.set_arg(pages, many.unionByName(_rules(pages, "ES", "n", "nuevo"))))


@query
def r1_rename_many(spark, sf):
    pages = wiki(spark, sf)
    many = pages.select(F.concat(F.lit("Doc "), "ord").alias("name"), F.lit("x").alias("new"))
    return _bodies(R.rename_template(pages, many.unionByName(pages.select(F.lit("ES").alias("name"), F.lit("lengua es").alias("new")).distinct())))


@query
def r2_set_arg_before(spark, sf):
    pages = wiki(spark, sf)
    return _bodies(R.set_arg(pages, _rules(pages, "ES", "m", "nuevo"), before="1"))


@query
def r3_del_arg(spark, sf):
    return _bodies(R.del_arg(wiki(spark, sf), "n"))


@query
def r4_rm_first_of_dup_args(spark, sf):
    return _bodies(R.rm_first_of_dup_args(wiki(spark, sf)))


@query
def r5_rm_dup_args_safe(spark, sf):
    return _bodies(R.rm_dup_args_safe(wiki(spark, sf)))


@query
def r5_rm_dup_args_tag(spark, sf):
    """Duplicates that differ are tagged: every value has another one before it."""
    pages = wiki(spark, sf).withColumn("body", F.replace(F.col("body"), F.lit("|n="), F.lit("|n=a|n=")))
    return _bodies(R.rm_dup_args_safe(pages, tag="<!-- dup -->"))


@query
def r6_edit_args(spark, sf):
    return _bodies(R.edit_args(wiki(spark, sf), new_name="k", new_value="v", where=lambda e: e["owner"] == "etimología"))


@query
def r6_edit_args_by_column(spark, sf):
    return _bodies(R.edit_args(wiki(spark, sf), new_name="k", new_value="v", where=F.col("owner") == "etimología"))


@query
def r7_edit_links(spark, sf):
    return _bodies(R.edit_links(wiki(spark, sf), "text", lambda e: F.concat(F.lit("a "), e["link_title"])))


@query
def r7_edit_targets(spark, sf):
    return _bodies(R.edit_links(wiki(spark, sf), "target", lambda e: F.concat(F.lit("B"), e["target"]), where=lambda e: e["text"].isNull()))


@query
def r7_edit_titles(spark, sf):
    return _bodies(R.edit_links(wiki(spark, sf), "title", "T", where=lambda e: e["fragment"].isNotNull()))


@query
def r7_delete_text(spark, sf):
    return _bodies(R.edit_links(wiki(spark, sf), "text", None))


@query
def r7_retarget_links(spark, sf):
    """A rule for every fifth page."""
    pages = wiki(spark, sf)
    rules = pages.where("ord % 5 = 0").select(F.concat(F.lit("Doc "), "ord").alias("link_title"), F.concat(F.lit("Nuevo "), "ord").alias("new"))
    return _bodies(R.retarget_links(pages, rules))


@query
def r7_delete_fragment(spark, sf):
    return _bodies(R.edit_links(wiki(spark, sf), "fragment", None))


@query
def r7_fix_redirect_links(spark, sf):
    """Links to double redirects and to redirects without target page move too."""
    return _bodies(R.fix_redirect_links(wiki(spark, sf), unresolved=True))


@query
def r7_fix_hot_redirect_links(spark, sf):
    """A third of the pages link to one redirect, with an underscore, and to a double redirect and a missing page."""
    more = "CASE WHEN ord % 3 = 0 THEN concat(' [[Main:Doc_5#x|y]] [[Doc_9]] [[Falta ', ord, ']]') ELSE '' END"
    pages = wiki(spark, sf).withColumn("body", F.concat("body", F.expr(more)))
    return _bodies(R.fix_redirect_links(pages))


@query
def r8_external_link_text(spark, sf):
    return _bodies(R.edit_external_links(wiki(spark, sf), text="fuente"))


@query
def r8_external_link_url(spark, sf):
    return _bodies(R.edit_external_links(wiki(spark, sf), url=lambda e: F.concat(e["url"], F.lit("/x")), delete_text=True))


@query
def r9_relevel_sections(spark, sf):
    return _bodies(R.edit_section_titles(wiki(spark, sf), level=lambda e: e["level"] + 1))


@query
def r9_drop_titles(spark, sf):
    return _bodies(R.edit_section_titles(wiki(spark, sf), drop=True, where=lambda e: F.trim(e["section_title"]) == "Fin"))


@query
def r9_set_contents(spark, sf):
    return _bodies(R.set_section_contents(wiki(spark, sf), "nada\n", lambda e: F.trim(e["section_title"]) == "Ejemplo"))


@query
def r9_set_title(spark, sf):
    return _bodies(R.set_section_title(wiki(spark, sf), " Final ", lambda e: F.trim(e["section_title"]) == "Fin"))


@query
def r10_convert_lists(spark, sf):
    return _bodies(R.convert_lists(wiki(spark, sf), r"\#", ":"))


@query
def r11_rename_tags(spark, sf):
    return _bodies(R.rewrite_tags(wiki(spark, sf), "small", "big"))


@query
def r11_tag_contents(spark, sf):
    return _bodies(R.rewrite_tags(wiki(spark, sf), "br", contents="n"))


@query
def r12_set_tag_attr(spark, sf):
    return _bodies(R.set_tag_attr(wiki(spark, sf), "ref", "name", "z"))


@query
def r12_del_tag_attr(spark, sf):
    return _bodies(R.set_tag_attr(wiki(spark, sf), "small", "id", None))


@query
def r12_set_table_attr(spark, sf):
    return _bodies(R.set_table_attr(wiki(spark, sf), "id", "t1"))


@query
def r12_set_cell_attr(spark, sf):
    return _bodies(R.set_cell_attr(wiki(spark, sf), "class", "c"))


@query
def r13_set_cell(spark, sf):
    return _bodies(R.set_cell(wiki(spark, sf), " x", lambda e: e["row"] == 1))


@query
def r13_set_caption_attrs(spark, sf):
    """Captions get attributes first; those of a third of the pages stay without."""
    with_attrs = F.replace(F.col("body"), F.lit("|+ "), F.lit('|+ id="c" | '))
    pages = wiki(spark, sf).withColumn("body", F.when(F.col("ord") % 3 == 0, F.col("body")).otherwise(with_attrs))
    return _bodies(R.set_caption_attrs(pages, ' class="k" '))


@query
def r13_set_caption(spark, sf):
    return _bodies(R.set_caption(wiki(spark, sf), " nuevo"))


@query
def r13_set_row_attrs(spark, sf):
    return _bodies(R.set_row_attrs(wiki(spark, sf), {"class": "r"}))


@query
def r14_rename_parameters(spark, sf):
    return _bodies(R.edit_parameters(wiki(spark, sf), name="q", default="d"))


@query
def r14_delete_default(spark, sf):
    return _bodies(R.edit_parameters(wiki(spark, sf), delete_default=True))


@query
def r14_append_default(spark, sf):
    return _bodies(R.append_default(wiki(spark, sf), "p3"))


@query
def r15_strip_comments(spark, sf):
    return _bodies(R.strip_comments(wiki(spark, sf)))


@query
def r16_insert_at(spark, sf):
    pages = wiki(spark, sf)
    rows = pages.selectExpr("title", "namespace_id", "CAST(CASE ord % 3 WHEN 0 THEN -2 WHEN 1 THEN 5 ELSE 999999 END AS INT) AS index", "'INS' AS new")
    return _bodies(R.insert_at(pages, rows))


@query
def r16_delete_span(spark, sf):
    pages = wiki(spark, sf)
    return _bodies(R.delete_span(pages, pages.selectExpr("title", "namespace_id", "2 AS start", "6 AS end")))


# --- K ------------------------------------------------------------------------------


@query
def k1_label_suggestions(spark, sf):
    return K.label_suggestions(wiki(spark, sf))


@query
def k2_classify_legacy_templates(spark, sf):
    return K.classify_legacy_templates(wiki(spark, sf)).select(*KEY, "start", "name", "class", "nth", "action", "replacement", "code")


@query
def k3_syllable_refs(spark, sf):
    return K.syllable_refs(wiki(spark, sf))


@query
def k4_page_corrections(spark, sf):
    return K.page_corrections(wiki(spark, sf))


@query
def k4_correction_counts(spark, sf):
    return K.correction_counts(wiki(spark, sf))


@query
def k5_correct_pages(spark, sf):
    return _bodies(K.correct_pages(wiki(spark, sf)))
