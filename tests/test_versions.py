"""Versioned tables: second dumps, stopped runs, folded streams."""

import pytest
from pyspark.sql import functions as F

from pagesmith.operators import ingest as B
from pagesmith.plans import fixture
from pagesmith.plans.queries import _second_dump, names, write_dump
from pagesmith.sources import tables, versions
from pagesmith.streaming import upsert

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def dumps(spark):
    return [write_dump(spark, SF) + "/*.bz2", write_dump(spark, SF, _second_dump(spark, SF)) + "/*.bz2"]


def test_second_dump_and_old_readers(spark, dumps, tmp_path):
    path, spaces = str(tmp_path / "t"), names(spark, SF)
    B.ingest_dump(spark, dumps[0], spaces, path)
    old = tables.read_pages(spark, path)
    before = rows(old)
    first = versions.current(spark, path)
    n = B.ingest_dump(spark, dumps[1], spaces, path)
    now = tables.read_pages(spark, path)
    assert now.count() == n > len(before)
    assert rows(old) == before  # a reader that has its paths keeps them
    second = versions.current(spark, path)
    # Only namespaces the second dump has pages of were written.
    changed = {p for p, v in second["parts"].items() if first["parts"].get(p) != v}
    assert changed == {"0", "10", "14"} and second["parts"]["828"] == first["parts"]["828"]
    assert B.ingest_dump(spark, dumps[1], spaces, path) == n and rows(tables.read_pages(spark, path)) == rows(now)


def test_a_stopped_run_leaves_the_table_whole(spark, dumps, tmp_path, monkeypatch):
    path, spaces = str(tmp_path / "t"), names(spark, SF)
    B.ingest_dump(spark, dumps[0], spaces, path)
    before = rows(tables.read_pages(spark, path))

    def stop(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "publish", stop)
        with pytest.raises(KeyboardInterrupt):
            B.ingest_dump(spark, dumps[1], spaces, path)
    assert rows(tables.read_pages(spark, path)) == before
    B.ingest_dump(spark, dumps[1], spaces, path)
    whole = rows(tables.read_pages(spark, path))
    assert whole != before
    assert versions.drop_unused(spark, path, keep=1)
    assert rows(tables.read_pages(spark, path)) == whole


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    pages = fixture.table(spark, SF, "wiki_pages").select(*tables.PAGE_COLUMNS)
    pointer = versions.replace_parts(pages, path, None, "namespace_id")
    versions.replace_parts(pages.where("namespace_id = 10"), path, pointer, "namespace_id")
    with pytest.raises(RuntimeError, match="another writer"):
        versions.replace_parts(pages.where("namespace_id = 14"), path, pointer, "namespace_id")
    assert rows(tables.read_pages(spark, path)) == rows(pages)


def test_pruning_of_a_versioned_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace_parts(fixture.table(spark, SF, "wiki_pages").select(*tables.PAGE_COLUMNS), path, None, "namespace_id")
    plan = tables.read_pages(spark, path).where("namespace_id = 10 AND title = 'x'").select("body")._jdf.queryExecution().executedPlan().toString()
    assert "namespace_id#" in plan.split("PartitionFilters: ")[1].split("]")[0] and "EqualTo(title,x)" in plan


def test_files_follow_the_size_of_a_namespace(spark, tmp_path):
    pages = spark.range(20_000).select(
        F.col("id").cast("string").alias("title"), F.when(F.col("id") < 19_000, 0).otherwise(F.col("id").cast("int") % 5 + 1).alias("namespace_id"),
        F.lit(None).cast("string").alias("redirect_to"), F.repeat(F.sha2(F.col("id").cast("string"), 256), F.lit(20)).alias("body"), F.lit("wikitext").alias("model"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        assert tables.write_pages(pages, str(tmp_path / "p")) == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "p").iterdir() if p.is_dir()}
    assert files["namespace_id=0"] >= 4 and all(n == 1 for p, n in files.items() if p != "namespace_id=0")


def test_folded_batches(spark, tmp_path, monkeypatch):
    """Many batches: few wait, only touched buckets are written, and the rows are those of one merge."""
    spaces, folder, out, log = names(spark, SF), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    raw = fixture.table(spark, SF, "raw_pages")
    later = _second_dump(spark, SF)
    batches = [raw] + [later.where(F.pmod("ord", F.lit(60)) == i) for i in range(4)]
    for i, batch in enumerate(batches):
        write_dump(spark, SF, batch, folder)
        upsert.stream_upsert(spark, folder, out, log, spaces, fold_every=2, buckets=16).awaitTermination()
        assert len(upsert._waiting(spark, out)) < 2
        if i == 1:
            first = versions.current(spark, f"{out}/table")["parts"]
    pointer = versions.current(spark, f"{out}/table")
    assert set(pointer["parts"].values()) > {max(pointer["parts"].values())}  # some buckets kept their version
    assert any(first[b] == v for b, v in pointer["parts"].items())
    want = B.upsert_pages(None, B.prepare(raw.withColumn("ord", F.struct(F.lit(0).alias("b"), "ord")).unionByName(
        later.where(F.pmod("ord", F.lit(60)) < 4).withColumn("ord", F.struct(F.lit(1).alias("b"), "ord"))), spaces)).drop("ord")
    assert rows(upsert.current_pages(spark, out).select(*tables.PAGE_COLUMNS)) == rows(want.select(*tables.PAGE_COLUMNS))
    # A replayed batch that is already folded changes nothing.
    assert upsert.fold(spark, out) in (0, *range(1, 17))
    again = rows(upsert.current_pages(spark, out))
    assert upsert.fold(spark, out) == 0 and rows(upsert.current_pages(spark, out)) == again


def test_one_language_is_needed(spark, pages):
    spaces = spark.createDataFrame([("es", 10, "Template", "Plantilla"), ("fr", 10, "Template", "Modèle")], "lang string, id int, canonical_name string, name string")
    df = spark.createDataFrame([("x", 10, None)], "title string, namespace_id int, model string")
    assert [r["title"] for r in B.normalise_title(df, spaces, "fr").collect()] == ["Modèle:x"]
    with pytest.raises(Exception, match="occurs more than once"):
        B.normalise_title(df, spaces).collect()
