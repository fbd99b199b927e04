"""Rewrite jobs and plain text on small bodies."""

import pytest
from pyspark.sql import functions as F

from conftest import column
from pagesmith.operators import corrections as K
from pagesmith.operators import plaintext as T
from pagesmith.operators import rewrite as R
from pagesmith.operators import extract as X


def bodies(df):
    return column(df, "body")


def test_no_edits_change_nothing(spark, pages):
    df = pages("a{{b}}", None)
    edits = spark.createDataFrame([], "title string, namespace_id int, start int, end int, new string")
    result = R.apply_edits(df, edits)
    assert bodies(result) == ["a{{b}}", None] and column(result, "changed") == [False, False]


def test_rename_and_delete(spark, pages):
    renames = spark.createDataFrame([("a", "b")], "name string, new string")
    assert bodies(R.rename_template(pages("{{a|{{ a }}}}", "{{lc:a}}"), renames)) == ["{{b|{{b}}}}", "{{lc:a}}"]
    assert bodies(R.del_arg(pages("{{a|x=1|y|x=3|2}}"), "x")) == ["{{a|y|2}}"]
    assert bodies(R.rm_first_of_dup_args(pages("{{a|x=1|y=2| x =3}}", "{{a|p|1=q}}"))) == ["{{a|y=2| x =3}}", "{{a|1=q}}"]


def test_safe_duplicates(pages):
    df = pages("{{a|x=1|x=|x=1|x=2|x=2}}", "{{a|x=1|x=2|x=}}", "{{a|x=1|x= 1 }}", "{{a|x=3|x=1|x=2|x=1|x=}}")
    assert bodies(R.rm_dup_args_safe(df)) == ["{{a|x=1|x=2}}", "{{a|x=1|x=2}}", "{{a|x= 1 }}", "{{a|x=3|x=1|x=2|x=1}}"]
    assert bodies(R.rm_dup_args_safe(df, "T"))[:2] == ["{{a|x=1T|x=2}}", "{{a|x=1T|x=2}}"]


def test_links_to_redirects_that_do_not_resolve_move_one_hop(spark):
    rows = [("p0", 0, None, "[[a]] [[b]] [[c#x|y]] [[d]] [[p0]]"), ("a", 0, "p0", None), ("b", 0, "a", None), ("c", 0, "gone", None)]
    wiki = spark.createDataFrame(rows, "title string, namespace_id int, redirect_to string, body string")
    fixed = lambda **how: R.fix_redirect_links(wiki, **how).where("title = 'p0'").first().body
    assert fixed() == "[[p0]] [[b]] [[c#x|y]] [[d]] [[p0]]"
    assert fixed(unresolved=True) == "[[p0]] [[a]] [[gone#x|y]] [[d]] [[p0]]"


def test_set_arg(spark, pages):
    rule = spark.createDataFrame([("a", "x", "9")], "owner string, name string, value string")
    df = pages("{{a|x=1|y=2}}", "{{a|y=2|z}}", "{{a}}", "{{b|x=1}}")
    assert bodies(R.set_arg(df, rule)) == ["{{a|x=9|y=2}}", "{{a|y=2|z|x=9}}", "{{a|x=9}}", "{{b|x=1}}"]
    assert bodies(R.set_arg(df, rule, before="y"))[1] == "{{a|x=9|y=2|z}}"
    assert bodies(R.set_arg(df, rule, after="y"))[1] == "{{a|y=2|x=9|z}}"
    assert bodies(R.set_arg(df, rule, positional=True))[:3] == ["{{a|9|y=2}}", "{{a|y=2|z|9}}", "{{a|9}}"]
    spaced = pages("{{a\n| yy = 2\n| z  = 3\n}}", "{{a\n| x = 2\n}}")
    assert bodies(R.set_arg(spaced, rule, preserve_spacing=True)) == ["{{a\n| yy = 2\n| z  = 3\n| x  = 9\n}}", "{{a\n| x = 9\n}}"]


def test_edit_args(pages):
    df = pages("{{a|1|b=2}}")
    assert bodies(R.edit_args(df, new_name="n")) == ["{{a|n=1|n=2}}"]
    assert bodies(R.edit_args(df, new_value="v")) == ["{{a|v|b=v}}"]
    assert bodies(R.edit_args(df, positional=True)) == ["{{a|1|2}}"]
    with pytest.raises(Exception, match="needs a name"):
        R.edit_args(df, positional=False).collect()


@pytest.mark.parametrize("part, new, expected", [
    ("target", "N", ["[[N]]", "[[N|c]]"]), ("target", None, ["[[]]", "[[c]]"]),
    ("title", "N", ["[[N]]", "[[N#b|c]]"]), ("title", None, ["[[]]", "[[b|c]]"]),
    ("fragment", "N", ["[[a#N]]", "[[a#N|c]]"]), ("fragment", None, ["[[a]]", "[[a|c]]"]),
    ("text", "N", ["[[a|N]]", "[[a#b|N]]"]), ("text", None, ["[[a]]", "[[a#b]]"]),
])
def test_edit_links(pages, part, new, expected):
    assert bodies(R.edit_links(pages("[[a]]", "[[a#b|c]]"), part, new)) == expected


def test_external_links(pages):
    df = pages("http://x.y", "[http://x.y]", "[http://x.y t u]")
    assert bodies(R.edit_external_links(df, text="T")) == ["[http://x.y T]"] * 3
    assert bodies(R.edit_external_links(df, url="http://n")) == ["http://n", "[http://n]", "[http://n t u]"]
    assert bodies(R.edit_external_links(df, delete_text=True)) == ["http://x.y", "[http://x.y]", "[http://x.y]"]


def test_sections(pages):
    df = pages("l\n== a ==\nx\n=== b ===\ny")
    assert bodies(R.edit_section_titles(df, level=F.col("level") + 1)) == ["l\n=== a ===\nx\n==== b ====\ny"]
    assert bodies(R.edit_section_titles(df, title="T", where=F.col("level") == 2)) == ["l\n==T==\nx\n=== b ===\ny"]
    assert bodies(R.edit_section_titles(df, drop=True)) == ["l\nx\ny"]
    assert bodies(R.set_section_contents(df, "C\n", F.col("level") == 2)) == ["l\n== a ==\nC\n=== b ===\ny"]
    assert bodies(R.set_section_contents(df, "C", F.col("level") == 2, include_subsections=True)) == ["l\n== a ==\nC"]
    with pytest.raises(Exception, match="lead section"):
        R.set_section_title(df, "T", F.lit(True)).collect()


def test_lists_tags_attributes(pages):
    assert bodies(R.convert_lists(pages("* a\n** b\n* c"), r"\*", "#")) == ["# a\n** b\n# c"]
    assert bodies(R.rewrite_tags(pages("<b>x</b> <br>"), "b", "i")) == ["<i>x</i> <br>"]
    df = pages("<ref name=a />", "<ref>z</ref>")
    assert bodies(R.rewrite_tags(df, "ref", contents="n")) == ["<ref name=a>n</ref>", "<ref>n</ref>"]
    tag = pages("<b a=1 c>x</b>")
    assert bodies(R.set_tag_attr(tag, "b", "a", "2")) == ['<b a="2" c>x</b>']
    assert bodies(R.set_tag_attr(tag, "b", "d", "")) == ["<b a=1 c d>x</b>"]
    assert bodies(R.set_tag_attr(tag, "b", "a", None)) == ["<b c>x</b>"]


TABLE = '{| class="t"\n|+ cap\n! a !! b\n|-\n| x="1" | c || d\n|}'


@pytest.mark.parametrize("job, args, old, new", [
    (R.set_table_attr, ("class", "z"), 'class="t"', 'class="z"'),
    (R.set_table_attr, ("id", "z"), 'class="t"', 'class="t" id="z"'),
    (R.set_caption, ("C",), "|+ cap", "|+C"),
    (R.set_row_attrs, ({"a": "b"},), "|-", '|- a="b"'),
    (R.set_caption_attrs, ("k",), "|+ cap", "|+ cap"),
])
def test_tables(pages, job, args, old, new):
    assert bodies(job(pages(TABLE), *args)) == [TABLE.replace(old, new, 1)]


def test_cells(pages):
    assert bodies(R.set_cell(pages(TABLE), "V", F.col("row") == 1)) == [TABLE.replace('| c || d', "|V||V")]
    assert bodies(R.set_cell_attr(pages(TABLE), "x", "9")) == [
        '{| class="t"\n|+ cap\n! x="9" | a !! x="9" | b\n|-\n| x="9" | c || x="9" | d\n|}']
    assert bodies(R.set_caption(pages("{|\n| a\n|}"), "C")) == ["{|\n|+C\n| a\n|}"]
    assert bodies(R.set_caption_attrs(pages("{|\n| a\n|}"), "C")) == ["{|\n|+C|\n| a\n|}"]


def test_parameters(pages):
    df = pages("{{{p1|{{{p2|}}}}}}", "{{{p1}}}", "{{{p1|{{{p3}}}}}}", "{{{a{{{b}}}|{{{c}}}}}} {{{d}}}")
    assert bodies(R.append_default(df, "p3")) == [
        "{{{p1|{{{p2|{{{p3|}}}}}}}}}", "{{{p1|{{{p3}}}}}}", "{{{p1|{{{p3}}}}}}",
        "{{{a{{{b|{{{p3}}}}}}|{{{c|{{{p3}}}}}}}}} {{{d|{{{p3}}}}}}"]
    df = pages("{{{a|b}}} {{{c}}}")
    assert bodies(R.edit_parameters(df, name="N")) == ["{{{N|b}}} {{{N}}}"]
    assert bodies(R.edit_parameters(df, default="N")) == ["{{{a|N}}} {{{c|N}}}"]
    assert bodies(R.edit_parameters(df, delete_default=True)) == ["{{{a}}} {{{c}}}"]


def test_comments_and_spans(spark, pages):
    df = pages("a<!-- --><!--x-->b")
    assert bodies(R.strip_comments(df)) == ["ab"]
    assert bodies(R.strip_comments(df, blank_only=True)) == ["a<!--x-->b"]

    def at(index):
        return spark.createDataFrame([("p0", 0, index, "X")], "title string, namespace_id int, index int, new string")

    assert [bodies(R.insert_at(pages("abc"), at(i)))[0] for i in (0, 2, -1, 99, -99)] == ["Xabc", "abXc", "abXc", "abcX", "Xabc"]


@pytest.mark.parametrize("body, text", [
    ("{{{a}}}", ""), ("{{{a|b}}}", "b"), ("<s>text</s>", "text"), ("[https://wikimedia.org/ wm]", "wm"),
    ("[https://wikimedia.org/]", ""), ("[[a|b]]", "b"), ("[[a]]", "a"), ("&Sigma;&#931;&#x3a3;", "ΣΣΣ"),
    ("'''b'''", "b"), ("''i''", "i"), ("'''''bi'''''", "bi"), ("[[File:x.png|thumb|''a'' [[b]]]]z", "z"),
    ("[[:File:x.png]]", ":File:x.png"), ("[[File:x.PNG]]", "File:x.PNG"), ("[[File:a.b.png]]", "File:a.b.png"),
    ("x<br>y<br/>z<ref name=a />", "xyz"), ("[[a|''b'' {{t}} c]]", "b  c"), ("http://a.b c", "http://a.b c"),
    ("a\n{|\n|+ cap\n! a !! '''b'''\n|-\n| 1 || [[x|yy]]\n|}\nz", "a\n\n cap\n\na\tb\n1\tyy\n\nz"),
    ("é<!-- c -->{{t|{{u}}}}", "é"), ("", ""), (None, None),
])
def test_plain_text(plain, body, text):
    assert plain[body] == text


@pytest.fixture(scope="module")
def plain(spark, request):
    cases = [p.args[1] for p in test_plain_text.pytestmark if p.name == "parametrize"][0]
    rows = [(f"p{i}", 0, b) for i, (b, _) in enumerate(cases)]
    result = T.plain_text(spark.createDataFrame(rows, "title string, namespace_id int, body string"))
    by_title = {r.title: r.text for r in result.collect()}
    return {b: by_title[t] for t, _, b in rows}


def test_replacements(pages):
    df = pages("a {{t|{{u}}}} {{ u }}")
    assert column(T.plain_text(df, replacements={"t": "T!"}), "text") == ["a T! "]

    def size(f):
        return F.concat(F.lit("<"), F.length(f["string"]).cast("string"), F.lit(">"))

    assert column(T.plain_text(df, replace_templates=size), "text") == ["a <11> <7>"]
    assert column(T.plain_text(df, replace_templates=False), "text") == ["a {{t|{{u}}}} {{ u }}"]


def test_table_text(pages):
    df = pages("{|\n| a || bbb || c\n|-\n| dd\n|}")
    assert column(X.table_text(X.tables(df)), "text") == ["\na \tbbb\tc\ndd\t   \t\n"]


def test_corrections(pages):
    df = pages("{{Plantilla: desambiguación|a}} {{desambiguación|b}} {{unicode|uniact=65|x}} {{EN-ES|q}} {{TAXO}} <!-- c -->t {{ok}}",
               "== a ==\n<ref>x</ref> Separación silábica: y", "nada")
    assert bodies(K.correct_pages(df))[0] == "{{desambiguación|a|b}}  {{mostrar-unicode|A}} {{lengua|en}}  t {{ok}}"
    codes = {(r.title, r.code) for r in K.page_corrections(df).collect()}
    assert codes == {("p0", 0), ("p0", 7), ("p0", 8), ("p0", 18), ("p1", 13), ("p1", 15)}
    refs = [tuple(r) for r in K.syllable_refs(df).select("title", "inside", "after").collect()]
    assert refs == [("p1", False, True)]


def test_rule_literals_occur_in_every_match(spark):
    # Rules are classes, dots and plain letters, so the longest plain run is in each match.
    from pagesmith.constants import LABEL_RULES

    assert [K._literal(p) for _, p, _ in LABEL_RULES[:4]] == ["ronunciaci", "timolog", "jemplo:", "nimo:"]
    assert K._literal("[a|A|á|Á]mbito:") == "mbito:" and all(K._literal(p) in p for _, p, _ in LABEL_RULES)
