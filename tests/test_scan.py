"""The scan of one body against rules and against a slow restatement of them."""

import re
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagesmith.functions import scan
from pagesmith.functions.scan import quote_runs_of, scan_page, splice_text, table_layout_of


def found(body, *kinds):
    return [(k, body[s:e]) for k, s, e, _ in scan_page(body) if k in kinds]


@pytest.mark.parametrize("body, expected", [
    ("{{a|{{b}}}}", [("Template", "{{a|{{b}}}}"), ("Template", "{{b}}")]),
    ("[[a|[b]]]", [("WikiLink", "[[a|[b]]]")]),
    ("[[a|b [[c]] d]]", [("WikiLink", "[[a|b [[c]] d]]"), ("WikiLink", "[[c]]")]),
    ("[[[a]]]", []),
    ("[[http://a b]]", []),
    ("[<!--x-->[a]]", [("WikiLink", "[<!--x-->[a]]")]),
    ("{{{p1|{{{p2|}}}}}}", [("Parameter", "{{{p1|{{{p2|}}}}}}"), ("Parameter", "{{{p2|}}}")]),
    ("{{a|[[x|b}}c]]}}", [("Template", "{{a|[[x|b}}c]]}}"), ("WikiLink", "[[x|b}}c]]")]),
    ("{{a|[[b}}", [("Template", "{{a|[[b}}")]),
    ("{{x|{{a<b}}}}", []),
    ("{{a|{{{b}}", [("Template", "{{b}}")]),
    ("{{ }}", []),
    ("{{lc:A}}{{#if:a|b}}{{PAGENAME}}", [("ParserFunction", "{{lc:A}}"), ("ParserFunction", "{{#if:a|b}}"), ("ParserFunction", "{{PAGENAME}}")]),
    ("{{lc|A}}", [("Template", "{{lc|A}}")]),
    ("<nowiki>{{a}}</nowiki>{{b}}", [("Template", "{{b}}")]),
    ("<ref>{{a}}</ref>", [("Template", "{{a}}")]),
    ("<!-- {{a}} -->{{b}}", [("Template", "{{b}}")]),
    ("é😀{{b}}", [("Template", "{{b}}")]),
])
def test_brackets(body, expected):
    assert found(body, "Template", "WikiLink", "Parameter", "ParserFunction") == expected


@pytest.mark.parametrize("body, expected", [
    ("a<!-- b --> c", [("Comment", "<!-- b -->")]),
    ("a<!-- b", [("Comment", "<!-- b")]),
    ("<ref>a <!-- x</ref> b", [("ExtensionTag", "<ref>a <!-- x</ref>"), ("Comment", "<!-- x")]),
    ("<ref name=a /><REF>b</ref>", [("ExtensionTag", "<ref name=a />"), ("ExtensionTag", "<REF>b</ref>")]),
    ("<ref>a <math>", []),
    ("<b>x<b>y</b>", [("Tag", "<b>"), ("Tag", "<b>y</b>")]),
    ("<b>x<i>y</b></i>", [("Tag", "<b>x<i>y</b>"), ("Tag", "<i>y</b></i>")]),
    ("<br><br/>", [("Tag", "<br>"), ("Tag", "<br/>")]),
])
def test_tags(body, expected):
    assert found(body, "Comment", "ExtensionTag", "Tag") == expected


@pytest.mark.parametrize("piece", ["<b ", "<b \"", "si a <b ''' "])
def test_start_tags_without_end_are_linear(piece):
    start = time.perf_counter()
    assert found(piece * 50_000, "Tag") == []
    assert found("<b>x</b>" + piece * 50_000, "Tag") == [("Tag", "<b>x</b>")]
    assert time.perf_counter() - start < 10


def test_tables():
    body = "a\n{|\n|a\n{|\n|b\n|}\n|}\n{| x\n"
    assert found(body, "Table", "InnerTable") == [
        ("Table", "{|\n|a\n{|\n|b\n|}\n|}"), ("InnerTable", "{|\n|b\n|}"), ("Table", "{| x\n"),
    ]
    assert found("{{a|\n{|\n|}\n}}", "Table") == []


def naive_templates(body):
    """Innermost pairs first, blanked one at a time; for text of braces, letters and pipes."""
    spans, text = [], body
    while m := re.search(r"\{\{[^{}|]*(?:\|[^{}]*)?\}\}", text):
        nameless = re.fullmatch(r"[ _]*", m[0][2:-2].split("|")[0])
        if not nameless:
            spans.append(m.span())
        text = text[:m.start()] + ("_" if nameless else "X") * len(m[0]) + text[m.end():]
    return sorted(spans)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["{{", "}}", "a", "|", " ", "b"]), max_size=16).map("".join))
def test_braces_match_innermost_pairs(body):
    if re.search(r"\{{3}|\}{3}", body):
        return  # longer runs have rules of their own
    assert sorted((s, e) for k, s, e, _ in scan_page(body) if k == "Template") == naive_templates(body)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    ["[[", "]]", "{{", "}}", "{{{", "}}}", "a", "|", "\n", "<ref>", "</ref>", "<b>", "</b>", "<!--", "-->", "{|", "|}", "é", "''", "=", "["]
), max_size=25).map("".join))
def test_spans_nest_and_masks_fit(body):
    spans = scan_page(body)
    nested = [(s, e) for k, s, e, _ in spans if k not in ("Page", "Tag", "Table", "InnerTable")]
    for k, s, e, mask in spans:
        assert 0 <= s <= e <= len(body) and len(mask) == e - s
    for i, (s, e) in enumerate(nested):
        for s2, e2 in nested[i + 1:]:
            assert e <= s2 or e2 <= s or (s <= s2 and e2 <= e) or (s2 <= s and e <= e2)
    quote_runs_of(spans[0][3].decode())


@pytest.mark.parametrize("line, expected", [
    ("'''b''' ''i''", [("Bold", "b"), ("Italic", "i")]),
    ("'''''bi''''' x", [("Italic", "'''bi'''"), ("Bold", "bi")]),
    ("''a '''b''''' c", [("Italic", "a '''b'''"), ("Bold", "b")]),
    ("l'''etto ''x'' y", [("Bold", "etto ''x'' y"), ("Italic", "x")]),
    ("a'''b ''c", [("Italic", "b ")]),
    ("''''x''''", [("Bold", "x'")]),
    ("'''un\n''i", [("Bold", "un"), ("Italic", "i")]),
    ("it's", []),
])
def test_quotes(line, expected):
    assert [(k, line[i:j]) for k, _, _, i, j in quote_runs_of(line)] == expected


def cell(colspan=1, rowspan=1):
    return {"is_break": False, "colspan": colspan, "rowspan": rowspan}


BREAK = {"is_break": True, "colspan": 1, "rowspan": 1}


def grid(slots):
    rows = {}
    for y, x, c in slots:
        rows.setdefault(y, []).append(c)
    return [rows[y] for y in sorted(rows)]


@pytest.mark.parametrize("cells, expected", [
    ([cell(), cell(), BREAK, cell(2)], [[0, 1], [3, 3]]),
    ([cell(rowspan=2), cell(), BREAK, cell()], [[0, 1], [0, 3]]),
    ([cell(rowspan=0), cell(), BREAK, cell(), BREAK, BREAK, cell()], [[0, 1], [0, 3], [0, 6]]),
    ([cell(), BREAK, cell(), cell()], [[0, None], [2, 3]]),
    ([cell(colspan=0)], [[0]]),
    ([cell(rowspan=3)], [[0], [0], [0]]),
])
def test_layout(cells, expected):
    assert grid(table_layout_of(cells, True)) == expected


def test_splice():
    def edit(start, end, new, merge=False):
        return {"start": start, "end": end, "new": new, "merge": merge}

    assert splice_text("abcdef", [edit(1, 2, "X"), edit(3, 3, "-"), edit(3, 4, "Y")], 0, 6) == "aXc-Yef"
    assert splice_text("abcdef", [edit(1, 4, ""), edit(2, 6, "Z")], 0, 6) == "aef"
    assert splice_text("abcdef", [edit(1, 4, "", True), edit(2, 5, "Z", True)], 0, 6) == "af"
    assert splice_text("abc", [], 0, 3) == "abc"
    assert splice_text("abcdef", [edit(1, 3, "", True), edit(4, 5, "", True)], 2, 5) == "d"


def test_stray_quotes_and_open_tags_stay_cheap():
    for body in ("si a <b entonces " + "'''x''' " * 2000, "<b " + '"' * 10_000, "<b ' > c ' d"):
        start = time.perf_counter()
        scan_page(body)
        assert time.perf_counter() - start < 5


def test_few_pages_at_a_time_become_python_objects(spark):
    """A batch of many pages is cut by its bytes, whether the result comes back in one piece or in several."""
    rows = spark.range(4000, numPartitions=1).selectExpr("id", "CASE WHEN id % 7 > 0 THEN repeat('x', 2000) END AS body", "id AS n")
    sizes = lambda *arrays: pa.array([sum(a.nbytes for a in arrays)] * len(arrays[0]), pa.int64())

    @scan.F.arrow_udf("long")
    @scan.sliced
    def whole(body: pa.Array, n: pa.Array) -> pa.Array:
        return sizes(body, n)

    for seen in (whole("body", "n"), scan.streamed(scan.T.LongType(), sizes)("body", "n"), scan.streamed(scan.T.LongType(), sizes)("body")):
        got = rows.select("id", seen.alias("seen")).collect()
        assert [r.id for r in got] == list(range(4000)) and max(r.seen for r in got) < 2 * scan.SLICE


def test_scan_of_many_pages_keeps_their_order(spark):
    texts = [None if i % 5 == 0 else "" if i % 5 == 1 else f"{{{{t{i}|[[l{i}]]}}}}" + "z" * (i % 4000) for i in range(1500)]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string").coalesce(1)
    got = pages.select("i", "body", scan.scan_elements("body", ("Template", "WikiLink"), ("string",)).alias("found")).select(
        "i", "found", scan.splice("body", scan.F.expr("transform(found, f -> struct(f.start AS start, f.end AS end, 'n' AS new, false AS merge))")).alias("new")).collect()
    for r in got:
        t = texts[r.i]
        assert [f.string for f in r.found] == ([] if not t else [f"{{{{t{r.i}|[[l{r.i}]]}}}}", f"[[l{r.i}]]"])
        assert r.new == (t if not t else "n" + "z" * (r.i % 4000))
