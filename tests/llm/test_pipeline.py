"""The pipeline's stages on odd tables: names of their own, null ids, repeated rows, nothing at all."""

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{c} string" for c in ("_frequent", "_gone", "_digest", "_kept", "_size", "_copy"))


def table(spark, texts):
    rows = [(None if i % 7 == 3 else i, t, "es", f"s{i % 3}" if i % 5 else None, len(t or ""), *(f"{c}{i}" for c in "abcdef"))
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["ta", "lo", "ri", "ne", "so"]) for _ in range(rnd.randint(1, 4)))
    texts = ["\n".join(" ".join(word() for _ in range(15)) for _ in range(8)) for _ in range(25)]
    return table(spark, texts + [texts[0], texts[1], None, "", "short"])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_other_columns(spark, docs, name, stage):
    out = stage(spark, docs, "")
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    given = {tuple(r[5:]): (r["doc_id"], r["lang"], r["source"]) for r in docs.collect()}
    got = out.collect()
    assert len(got) >= 20
    assert all(given[tuple(r[5:])] == (r["doc_id"], r["lang"], r["source"]) for r in got)
    assert all((r["n_chars"] or 0) == len(r["text"] or "") for r in got)


def test_run_of_all_stages(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 20 <= out.count() <= 2 * docs.count()


def test_run_of_an_empty_table(spark, tmp_path):
    table(spark, ["x"]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
