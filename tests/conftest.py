import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pagesmith.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def pages(spark):
    """A page table of the given bodies, titled p0, p1, ..."""

    def make(*bodies):
        rows = [(f"p{i}", 0, b) for i, b in enumerate(bodies)]
        return spark.createDataFrame(rows, "title string, namespace_id int, body string")

    return make


def column(df, name):
    """Values of a column in page order."""
    return [r[name] for r in sorted(df.collect(), key=lambda r: int(r["title"][1:]))]
