"""What the plans must look like: filters at the scan, one scan, no shuffle, few Python stages."""

import html
import random
import re
import time
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from pagesmith.functions import brackets, text
from pagesmith.operators import corrections as K
from pagesmith.operators import extract as X
from pagesmith.operators import plaintext as T
from pagesmith.operators import rewrite as R
from pagesmith.operators import segments as S
from pagesmith.operators.joins import skew_join
from pagesmith.plans import fixture
from pagesmith.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "p")
    tables.write_pages(fixture.table(spark, SF, "wiki_pages"), path)
    return tables.read_pages(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("job", [X.templates, X.wikilinks, X.tables, T.plain_text])
def test_filters_pass_extraction(table, job):
    shown = plan(job(table).where((F.col("namespace_id") == 10) & F.col("title").startswith("Plantilla:Doc 1")))
    assert shown.count("FileScan") == 1
    assert re.search(r"PartitionFilters: \[[^\]]*namespace_id#\d+ = 10", shown)
    assert "StartsWith(title#" in shown.split("FileScan")[1]


@pytest.mark.parametrize("job, mark", [(X.templates, "{{"), (X.wikilinks, "["), (X.tables, "{|"), (X.comments, "<!--")])
def test_only_pages_with_the_mark_are_scanned(table, job, mark):
    assert f"StringContains(body,{mark})" in plan(job(table))


IN_ROW = {
    "segment": S.segment, "corrections": K.page_corrections, "correct": K.correct_pages, "legacy": K.classify_legacy_templates,
    "sections": X.sections, "plain text": T.plain_text, "arguments": lambda p: X.template_args(X.templates(p)), "del_arg": lambda p: R.del_arg(p, "n"),
    "duplicates": R.rm_dup_args_safe, "links": lambda p: R.edit_links(p, "text", "x"), "external": lambda p: R.edit_external_links(p, text="x"),
    "levels": lambda p: R.edit_section_titles(p, level=lambda e: e["level"] + 1), "contents": lambda p: R.set_section_contents(p, "x", lambda e: e["level"] == 2),
    "lists": lambda p: R.convert_lists(p, r"\#", ":"), "tags": lambda p: R.rewrite_tags(p, "small", "big"), "tag attr": lambda p: R.set_tag_attr(p, "ref", "name", "z"),
    "table attr": lambda p: R.set_table_attr(p, "id", "t"), "caption": lambda p: R.set_caption(p, "c"), "row attrs": lambda p: R.set_row_attrs(p, {"a": "b"}),
    "parameters": lambda p: R.edit_parameters(p, name="q"), "comments": R.strip_comments,
}


@pytest.mark.parametrize("name", IN_ROW)
def test_work_inside_the_row(table, name):
    shown = plan(IN_ROW[name](table))
    assert shown.count("FileScan") == 1
    assert "Exchange" not in shown
    assert shown.count("ArrowEvalPython") <= 4


def test_few_rules_need_no_join(spark, table):
    rules = spark.createDataFrame([("ES", "x")], "name string, new string")
    shown = plan(R.rename_template(table, rules))
    assert "Join" not in shown and "Exchange hashpartitioning(title" not in shown


def test_many_rules_meet_hot_names_in_copies(spark, table, monkeypatch):
    """With the joined path, and names spread from ten rows on, the bodies are the same."""
    from pagesmith.operators import joins

    rules = spark.createDataFrame([("ES", "x"), ("lengua", "y"), ("nadie", "z")], "name string, new string")
    args = rules.select(F.col("name").alias("owner"), F.lit("n").alias("name"), F.col("new").alias("value"))
    few = [sorted(R.rename_template(table, rules).collect()), sorted(R.set_arg(table, args).collect())]
    monkeypatch.setattr(R, "MAX_CONSTANT_RULES", 1)
    monkeypatch.setattr(joins, "ROWS_PER_COPY", 10)
    assert [sorted(R.rename_template(table, rules).collect()), sorted(R.set_arg(table, args).collect())] == few


def test_hot_keys_are_spread(spark):
    """A key of a third of the rows: no copy of it gets more than twice its share."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"))
    rules = rows.select("k").distinct().select("k", F.concat("k", F.lit("!")).alias("v"))
    joined = skew_join(rows, rules, ["k"], ["id"], rows_per_copy=1000)
    assert joined.count() == 30_000 and joined.where("v <> concat(k, '!')").count() == 0
    copies = rows.where("k = 'hot'").groupBy(F.pmod(F.xxhash64("id"), F.lit(10))).count().collect()
    assert len(copies) == 10 and max(r["count"] for r in copies) < 2000


@pytest.mark.parametrize("unit, close", [("{{a|[[x|", "]]}}"), ("{{a|", "}}"), ("[[a|", "]]"), ("{{[[x|", "}}"), ("{{{a|", "}}}")])
def test_nested_pairs_take_linear_time(unit, close):
    def seconds(n):
        body, best = unit * n + close * n, 9e9
        for _ in range(3):
            start = time.perf_counter()
            brackets.scan_marked(body, masked=("Page",))
            best = min(best, time.perf_counter() - start)
        return best

    seconds(500)
    assert seconds(8000) < 12 * seconds(2000)


def test_a_wide_cell_is_listed_in_parts(pages):
    df = X.tables(pages('{|\n| colspan="99999999" | a\n|-\n| b\n|}'))
    cells = X.table_cells(df, column=99_999_998).select("row", "value").collect()
    assert sorted((r["row"], r["value"]) for r in cells) == [(0, "a"), (1, None)]
    assert X.table_cells(df, column=3).count() == 2
    assert X.table_cells(df, row=0).limit(5).count() == 5


def test_entities_as_the_library_reads_them(spark):
    rnd = random.Random(1)
    given = ["&Sigma; &#931; &#x3a3;", "&notit; &amp;amp; &ampx &lt &#128; &#0; &#xD800; &#x110000; &#99999999999999999; &#1; &#xFFFE; &#13; & &; &&",
             None, "", "&#xfdd0;&#x7f;&#x85;&#x81;&#000065;x&#X41", "&" + "a" * 40 + ";"]
    given += ["&" + name for name in html5] + ["&" + name.rstrip(";") + "zz;" for name in html5]
    given += ["".join(rnd.choice(["&", "#", "x", "lt", "amp", ";", "a1", " ", "\n", "é", "3", "not", "in", "&#"]) for _ in range(12)) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", text.unescape_entities("t").alias("u"))
    assert "Python" not in plan(rows)
    assert {r["i"]: r["u"] for r in rows.collect()} == {i: None if t is None else html.unescape(t) for i, t in enumerate(given)}


def test_replacements_of_a_large_table(spark, pages, monkeypatch):
    df = pages("{{a}} {{ b |x}} {{c}}", "{{a}}{{a}}", None)
    rows = spark.createDataFrame([("a", "A"), ("b", "B")], "name string, text string")
    few = sorted(T.plain_text(df, replacements=rows).collect())
    monkeypatch.setattr(R, "MAX_CONSTANT_RULES", 1)
    assert sorted(T.plain_text(df, replacements=rows).collect()) == few
    assert [r["text"] for r in few] == ["A B ", "AA", None]
