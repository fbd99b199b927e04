"""Sources, ingest, search, lookup and the stream on small inputs."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from pagesmith.operators import ingest as B
from pagesmith.operators import lookup as J
from pagesmith.operators import search as C
from pagesmith.sources import dump, tables
from pagesmith.streaming import upsert


def page(title, ns, text=None, redirect=None, model="wikitext", older=""):
    target = f'<redirect title="{redirect}" />' if redirect is not None else ""
    body = "" if text is None else f'<text bytes="3" xml:space="preserve">{text}</text>'
    return f"  <page>\n<title>{title}</title><ns>{ns}</ns><id>1</id>{target}<revision><id>2</id><model>{model}</model>{body}</revision>{older}\n  </page>\n"


HEAD = '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/">\n<siteinfo><sitename>x</sitename></siteinfo>\n'


@pytest.fixture(scope="module")
def namespaces(spark, tmp_path_factory):
    entries = {
        "Main": (0, "Main", True, True, False), "Talk": (1, "Discusión", False, False, True),
        "Template": (10, "Plantilla", False, True, False), "Module": (828, "Módulo", False, True, False),
    }
    data = {k: dict(zip(("id", "name", "content", "issubject", "istalk"), v), aliases=[]) for k, v in entries.items()}
    folder = tmp_path_factory.mktemp("data")
    (folder / "es").mkdir()
    (folder / "es" / "namespaces.json").write_text(json.dumps(data))
    return tables.read_namespaces(spark, str(folder)).cache()


def test_namespaces(namespaces):
    assert {r.canonical_name: (r.lang, r.id, r.name, r.talk_id, r.subject_id) for r in namespaces.collect()} == {
        "Main": ("es", 0, "Main", 1, None), "Talk": ("es", 1, "Discusión", None, 0),
        "Template": ("es", 10, "Plantilla", None, None), "Module": ("es", 828, "Módulo", None, None)}
    pairs = {(r.name, r.partner_name) for r in tables.subject_talk_pairs(namespaces).collect() if r.partner_name}
    assert pairs == {("Main", "Discusión"), ("Discusión", "Main")}


def write(path, *pages):
    path.write_bytes(bz2.compress((HEAD + "".join(pages) + "</mediawiki>").encode()))
    return str(path)


def test_read_dump(spark, tmp_path):
    older = "<revision><model>css</model><text>new</text></revision>"
    path = write(tmp_path / "a.xml.bz2", page("a", 0, " x &lt;b&gt;\n &amp;amp; ", older=older), page("b", 10, redirect="c"), page("c", 0),
                 page("é😀", 0, ""))
    rows = [tuple(r) for r in dump.read_dump(spark, path).orderBy("ord").drop("ord").collect()]
    assert rows == [("a", 0, None, "wikitext", " x <b>\n &amp; "), ("b", 10, "c", "wikitext", ""),
                    ("c", 0, None, "wikitext", ""), ("é😀", 0, None, "wikitext", "")]
    with pytest.raises(ValueError):
        dump.read_dump(spark, "a.xml")


def test_dump_order_over_splits(spark, tmp_path):
    filler = "".join(f"{i * 7919 % 1000003} " for i in range(400))
    path = write(tmp_path / "b.xml.bz2", *[page(f"t{i}", 0, filler + str(i)) for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = dump.read_dump(spark, path)
        assert raw.rdd.getNumPartitions() > 1
        assert [r.title for r in raw.orderBy("ord").select("title").collect()] == [f"t{i}" for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ingest_and_stream_agree(spark, tmp_path, namespaces):
    folder = tmp_path / "dumps"
    folder.mkdir()
    first = write(folder / "1.xml.bz2", page("a", 0, "one"), page("a", 0, "two"), page("t", 10, "x&lt;noinclude>y"), page("Main:m", 0, "m"),
                  page("css", 0, "c", model="css"), page("z", 99, "c"), page("q/documentation", 10, "d"), page("r", 0, redirect="a"))
    n = B.ingest_dump(spark, first, namespaces, str(tmp_path / "table"))
    rows = {tuple(r) for r in tables.read_pages(spark, str(tmp_path / "table")).collect()}
    assert (n, rows) == (4, {("a", 0, None, "two", "wikitext"), ("Plantilla:t", 10, None, "x", "wikitext"),
                               ("m", 0, None, "m", "wikitext"), ("r", 0, "a", None, "wikitext")})

    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    upsert.stream_upsert(spark, str(folder), out, log, namespaces).awaitTermination()
    assert {tuple(r) for r in upsert.current_pages(spark, out).collect()} == rows
    write(folder / "2.xml.bz2", page("a", 0, "three"), page("n", 0, "new"))
    upsert.stream_upsert(spark, str(folder), out, log, namespaces).awaitTermination()
    later = {tuple(r) for r in upsert.current_pages(spark, out).collect()}
    assert later == {r for r in rows if r[0] != "a"} | {("a", 0, None, "three", "wikitext"), ("n", 0, None, "new", "wikitext")}


def test_upsert_twice_is_once(spark):
    base = spark.createDataFrame([(1, "a", 0, None, "x", "w"), (2, "b", 0, None, "y", "w")],
                                 "ord int, title string, namespace_id int, redirect_to string, body string, model string")
    batch = base.where("title = 'a'").withColumn("body", F.lit("z"))
    once = B.upsert_pages(base, batch)
    assert sorted(once.collect()) == sorted(B.upsert_pages(once, batch).collect())
    assert {(r.title, r.body) for r in once.collect()} == {("a", "z"), ("b", "y")}


@pytest.mark.parametrize("body, expected", [
    ("a<!-- b -->c", "ac"), ("a<!-- b", "a"), ("a<noinclude>b", "a"), ("a<NoInclude >b</noinclude>c", "ac"),
    ("x<onlyinclude>a</onlyinclude>y<onlyinclude>b\n</onlyinclude>", "ab\n"), ("x<onlyinclude/>y", ""),
    ("a<includeonly>b</ includeonly >c", "abc"), ("a<noinclude/>b", "a<noinclude/>b"),
    ("a<includeonly />b", "ab"),
])
def test_template_body(spark, body, expected):
    df = spark.createDataFrame([(body,)], "body string")
    assert df.select(B.template_body("body")).first()[0] == expected


@pytest.fixture(scope="module")
def wiki(spark):
    rows = [("a", 0, None, "x {ES y", "wikitext"), ("b", 0, "a", None, "wikitext"), ("c", 0, None, "nospace", "json"),
            ("Plantilla:Foo", 10, None, "f", "wikitext"), ("Plantilla:foo", 10, None, "g", "wikitext"),
            ("Plantilla:Bar", 10, None, "h", "wikitext"), ("Foo", 0, None, "'''ej z", "wikitext"), ("d", 0, "Plantilla:Bar", None, "wikitext"),
            ("e", 0, "b", None, "wikitext"), ("Plantilla:r", 10, "Plantilla:Foo", None, "wikitext")]
    return spark.createDataFrame(rows, "title string, namespace_id int, redirect_to string, body string, model string")


def titles(df):
    return sorted(r["title"] for r in df.collect())


def test_search(wiki):
    assert titles(C.search_pages(wiki, namespace_ids=[])) == []
    assert titles(C.search_pages(wiki, include_redirects=False, model="json")) == ["c"]
    assert titles(C.search_pages(wiki, search_pattern="ES")) == ["a"]
    assert titles(C.search_pages(wiki, search_regex=["^f$", "^g$"])) == ["Plantilla:Foo", "Plantilla:foo"]
    assert titles(C.search_pages(wiki, [0], search_exclude=["x", "z"])) == ["c"]
    assert titles(C.search_pages(wiki, [0], regex_exclude="x|z")) == ["c"]
    assert titles(C.all_pages(wiki, namespace_ids=[0])) == ["Foo", "a"]
    assert titles(C.all_pages(wiki, namespace_ids=[0], require_space=False)) == ["Foo", "a", "b", "c", "d", "e"]
    assert titles(C.error_scan(wiki)) == ["Foo", "a"]
    assert C.count_pages(wiki, namespace_ids=[10]).first().n == 4


def test_contains_any_equals_plain_or(spark):
    words = ["'''ab", "'''abc", "'''xy", "'''zz", "TRANS", "TRANSLIT", "q"]
    texts = ["", "'''", "'''abc", "'''xz", "'''zz", "TRANSL", "tq", "'''x'''y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(C.contains_any(F.col("t"), words)).collect()]
    assert got == [any(w in t for w in words) for t in texts]


def test_lookup(spark, wiki, namespaces):
    asked = [("a", 0), ("foo", 10), ("bar", 10), ("Plantilla:bar", 10), ("Main:a", None), ("Foo", None), ("", 0), ("zz", 0), ("Foo", 0), ("b", 0),
             ("d", 0), ("e", 0), ("r", 10), ("a_", 0)]
    requests = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(asked)], "request_id int, title string, namespace_id int")
    found = {r.request_id: r.found_title for r in J.lookup_pages(requests, wiki, namespaces).collect()}
    assert [found[i] for i in range(len(asked))] == [
        "a", "Plantilla:foo", "Plantilla:Bar", "Plantilla:Bar", "a", "Foo", None, None, "Foo", "b", "d", "e", "Plantilla:r", None]
    solved = {r.request_id: r.found_title for r in J.resolve_redirects(requests, wiki, namespaces).collect()}
    assert [solved[i] for i in (9, 10, 11, 12, 0)] == ["a", None, None, "Plantilla:Foo", "a"]
    flags = {r.request_id: r.page_exists for r in J.pages_exist(requests, wiki, namespaces).collect()}
    assert [flags[i] for i in (0, 1, 5, 7)] == [True, False, True, False]


def test_hot_requests_are_spread(spark, wiki, namespaces, monkeypatch):
    monkeypatch.setattr(J, "ROWS_PER_COPY", 10)
    requests = spark.range(500).select(F.col("id").alias("request_id"), F.when(F.col("id") % 3 == 0, "a").otherwise(
        F.concat(F.lit("n"), "id")).alias("title"), F.lit(0).alias("namespace_id"))
    result = J.lookup_pages(requests, wiki, namespaces)
    rows = result.collect()
    assert len(rows) == 500 and sum(r.found_title == "a" for r in rows) == 167
    assert all(r.body == "x {ES y" for r in rows if r.found_title)


def test_languages_and_terms(spark):
    languages = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("c", "x", 3)], "code string, name string, ord int")
    df = spark.createDataFrame([("a",), ("q",)], "lang string")
    assert {tuple(r) for r in tables.lang_name(df, "lang", languages).collect()} == {("a", "x"), ("q", None)}
    named = spark.createDataFrame([("x",), ("y",)], "name string")
    assert {tuple(r) for r in tables.lang_code(named, "name", languages).collect()} == {("x", "c"), ("y", "b")}
    assert tables.terms(spark).groupBy("kind").count().collect() == tables.terms(spark).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in tables.terms(spark).groupBy("kind").count().collect()} == {"class": 89, "inflected": 3}


def test_pushdown_reaches_the_scan(spark, wiki, tmp_path):
    tables.write_pages(wiki, str(tmp_path / "p"))
    scan = C.search_pages(tables.read_pages(spark, str(tmp_path / "p")), [0], include_redirects=False, search_pattern="ES").select("title")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(body,ES)" in plan and "IsNull(redirect_to)" in plan
    assert "PartitionFilters: [isnotnull(namespace_id" in plan or "PartitionFilters: [(namespace_id" in plan
    assert "model" not in plan.split("ReadSchema")[1]
