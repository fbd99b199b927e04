"""Extraction rules on small bodies."""

from pyspark.sql import functions as F

from conftest import column
from pagesmith.functions import text
from pagesmith.operators import extract as X
from pagesmith.operators import intervals as W
from pagesmith.operators import segments as S


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_links(pages):
    df = pages("[[a#b|c]] [[d]]", "http://example.com{{dead link}}", "[http://example.com{{space template}} text]",
               "[//x.y] HTTP://A.b", "{{c|u=http://t.u |x}}", "[[w:http://no]] <ref>http://in.tag</ref>")
    assert rows(X.wikilinks(df), "title", "target", "link_title", "fragment", "text")[:2] == [
        ("p0", "a#b", "a", "b", "c"), ("p0", "d", "d", None, None)]
    assert rows(X.external_links(df), "title", "url", "in_brackets") == [
        ("p1", "http://example.com{{dead link}}", False), ("p2", "http://example.com{{space template}}", True),
        ("p3", "//x.y", True), ("p3", "HTTP://A.b", False), ("p4", "http://t.u", False), ("p5", "http://in.tag", False)]


def test_arguments(pages):
    df = pages("{{a|x|n=1|y| n =2|{{b|=}}}}", "{{t|[[l|m]]=v|\n== h ==\nz}}")
    args = X.template_args(X.templates(df))
    assert rows(args.where("owner = 'a'"), "ord", "name", "value", "positional") == [
        (0, "1", "x", True), (1, "n", "1", False), (2, "2", "y", True), (3, " n ", "2", False), (4, "3", "{{b|=}}", True)]
    assert rows(args.where("owner = 't'"), "name", "value") == [("1", "\n== h ==\nz"), ("[[l|m]]", "v")]
    assert rows(X.get_arg(args, "n"), "owner", "value") == [("a", "2")]
    assert rows(X.has_arg(args, "n", "2"), "owner", "has_arg") == [("a", True), ("b", False), ("t", False)]
    functions = X.template_args(X.parser_functions(pages("{{#if: a | b }}")))
    assert rows(functions, "owner", "ord", "value") == [("#if", 0, " a "), ("#if", 1, " b ")]


def test_parameters(pages):
    df = pages("{{{a}}}{{{b|}}}{{{c|d|e}}}")
    assert rows(X.parameters(df), "name", "has_default", "default") == [
        ("a", False, None), ("b", True, ""), ("c", True, "d|e")]


def test_normal_name(spark):
    df = spark.createDataFrame([(" eN : tEmPlAtE : <!-- c --> t_1 # b ",), (":template:x",), ("a:b",)], "n string")
    names = df.select(text.normal_name("n", code="en").alias("a"), text.normal_name("n", code="en", capitalize=True).alias("b")).collect()
    assert [tuple(r) for r in names] == [("t 1", "T 1"), ("x", "X"), ("a:b", "A:b")]


def test_attributes(pages):
    df = pages("<b a=1 b='x y' c d=\"\" a=\"2\">t</b>")
    assert rows(X.attributes(X.html_tags(df)), "attr", "value") == [("a", "2"), ("b", "x y"), ("c", ""), ("d", "")]


def test_sections(pages):
    df = pages("lead\n== a ==\nx\n==== b ====\ny\n=== c ===\nz\n= d =\nw", "== c ===\n", "<!--\n== no ==\n-->{{t|\n== no ==\n}}")
    assert rows(X.section_titles(df), "title", "level", "section_title") == [
        ("p0", 1, " d "), ("p0", 2, " a "), ("p0", 3, " c "), ("p0", 4, " b "), ("p1", 2, " c =")]
    nested = X.sections(df).where("title = 'p0'")
    assert rows(nested, "ord", "level", "contents") == [
        (0, 0, "lead\n"), (1, 2, "x\n==== b ====\ny\n=== c ===\nz\n"), (2, 4, "y\n"), (3, 3, "z\n"), (4, 1, "w")]
    assert rows(X.sections(df, top_levels_only=True).where("title = 'p0'"), "ord") == [(0,), (1,), (4,)]
    assert rows(X.sections(df).where("title = 'p2'"), "ord", "level") == [(0, 0)]


def test_lists(pages):
    df = pages("* a\n** b\n*# c\n* d\n# e\n; t : u\n: v", "*# x", "; [http://a:b c: e] : d")
    lists = X.lists(df)
    assert rows(lists, "title", "start", "level", "pattern") == [
        ("p0", 0, 1, r"\*"), ("p0", 18, 1, r"\#"), ("p0", 22, 1, "[:;]"), ("p1", 0, 1, r"\*"), ("p2", 0, 1, "[:;]")]
    items = X.list_items(lists)
    assert rows(items, "title", "item_start", "item", "fullitem") == [
        ("p0", 0, " a", "* a\n** b\n*# c\n"), ("p0", 14, " d", "* d\n"), ("p0", 18, " e", "# e\n"),
        ("p0", 22, " t ", "; t : u\n"), ("p0", 26, " u", ": u"), ("p0", 30, " v", ": v"), ("p1", 0, "", "*# x"),
        ("p2", 0, " [http://a:b c: e] ", "; [http://a:b c: e] : d"), ("p2", 20, " d", ": d")]
    assert rows(X.sublists(lists), "title", "string", "level") == [("p0", "*# c\n", 2), ("p0", "** b\n", 2), ("p1", "*# x", 2)]


def test_tables(pages):
    body = ('{| class="t" id=x\n|+ k="1" | cap\n! h1 !! h2 || h3\n|- style="s"\n| a=1 | c1 || c2\n| rowspan=2 | c3 | d\n'
            "|-\n|\n{|\n| in\n|}\n| {{t|x}} !! y\n|}")
    df = pages(body)
    outer = X.tables(df)
    assert rows(outer, "caption", "caption_attrs") == [(" cap", ' k="1" ')]
    assert outer.first()["attrs"] == {"class": "t", "id": "x"}
    assert [r["attrs"] for r in X.table_row_attrs(outer).orderBy("row").collect()] == [{"style": "s"}, {}]
    assert rows(X.table_cells(outer), "row", "col", "value", "is_header") == [
        (0, 0, "h1", True), (0, 1, "h2", True), (0, 2, "h3", False),
        (1, 0, "c1", False), (1, 1, "c2", False), (1, 2, "c3 | d", False),
        (2, 0, "\n{|\n| in\n|}", False), (2, 1, "{{t|x}} !! y", False), (2, 2, "c3 | d", False)]
    assert rows(W.nesting_level(X.tables(df, recursive=True), ("Table",)), "nesting_level") == [(0,), (1,)]


def test_bold_italic(pages):
    df = pages("'''a''' [[x|''b'']] {{t|'''c'''}} <ref>''d''</ref>")
    assert rows(X.bold_italic(df), "kind", "text") == [("Bold", "a"), ("Bold", "c"), ("Italic", "b"), ("Italic", "d")]
    assert rows(X.bold_italic(df, recursive=False), "kind", "text") == [("Bold", "a")]


def test_ancestors_against_all_pairs(pages):
    df = pages("{{a|{{b|{{{c|[[d]]}}}}}}} <ref>{{e|<!-- f -->}}</ref> [[g|{{h}}]]", "{{a|{{b}}{{c|{{d}}}}}}")
    spans = [tuple(r) for r in X.spans(df).select("title", "kind", "start", "end").collect()]
    brute = sorted((t, s, k2, s2) for t, k, s, e in spans for t2, k2, s2, e2 in spans if t == t2 and s2 < s and e < e2)
    assert rows(W.ancestors(X.spans(df)), "title", "start", "outer_kind", "outer_start") == brute
    level = {}
    chosen = [x for x in spans if x[1] in ("Template", "ParserFunction")]
    for t, k, s, e in chosen:
        level[t, s] = sum(t2 == t and s2 <= s and e <= e2 for t2, _, s2, e2 in chosen)
    assert {(r.title, r.start): r.nesting_level for r in W.nesting_level(X.spans(df)).collect()} == level


def test_segments_rebuild_bodies(spark, pages):
    bodies = ["a {{b}} [[c|'''d''']] * e\n* f\n{|\n| g\n|}\n<b>h</b>", "", "plain", "== x ==\n{{y}}<!-- z", "é {{t|http://a.b}} ''q"]
    segments = S.segment(pages(*bodies))
    joined = segments.groupBy("title").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "string")))["string"], "").alias("body"))
    got = {r.title: r.body for r in joined.collect()}
    assert got == {f"p{i}": b for i, b in enumerate(bodies) if b}


def test_partitions_do_not_matter(pages):
    df = pages(*[f"{{{{a|{i}}}}} [[b{i}]]\n* c\n" for i in range(40)])
    columns = ["title", "kind", "start", "end", "string"]
    assert rows(S.segment(df.repartition(1)), *columns) == rows(S.segment(df.repartition(7)), *columns)


def test_modes(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 0), ("b", 2, 1), ("b", 2, 2)], "g string, v int, o int")
    assert rows(W.first_mode(df, ["g"], F.col("v"), F.col("o")), "g", "mode") == [("a", 1), ("b", 2)]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a=#_<", "x//y..z", 128512)], "a string, b string, c int")
    row = df.select(text.escape_nowiki("a"), text.safe_filename("b"), text.codepoint_char("c"), text.safe_filename(F.lit("a.b"))).first()
    assert tuple(row) == ("a&equals;&num;&#95;&lt;", "x__slashslash__y__dot____dot__z", "😀", "a.b")


def test_comments_column_order(pages):
    df = pages("a<!--b-->", "x", "<!--c")
    assert column(X.comments(df), "contents") == ["b", "c"]


def test_long_start_tag_does_not_overflow_the_stack(pages):
    body = "<ref " + "x" * 100_000 + ">y</ref>"
    assert column(X.extension_tags(pages(body)), "contents") == ["y"]
