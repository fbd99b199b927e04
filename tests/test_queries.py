"""Every registered query against its SQL on the smallest tables."""

import pytest

from check_oracles import compare, connect
from pagesmith.plans import fixture
from pagesmith.plans.oracles import ORACLES
from pagesmith.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name) is None


def test_every_document_has_a_page_with_its_whole_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id ord", "text")
    held = fixture.table(spark, SF, "wiki_pages").filter("body IS NOT NULL").join(docs, "ord").filter(
        "startswith(body, substr(text, 1, 200)) AND contains(body, substr(text, 201))"
    )
    assert held.count() == docs.count()
