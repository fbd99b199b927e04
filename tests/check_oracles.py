"""Compare queries with their SQL: python tests/check_oracles.py SF_DIR [name ...]"""

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from pagesmith.plans.oracles import ORACLES
from pagesmith.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir, name):
    """None when query and SQL agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = df.toArrow()
    want = con.sql(ORACLES[name]).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} / {sorted(want.column_names)}"
    columns = sorted(got.column_names)
    types = [(c, str(got.schema.field(c).type), str(want.schema.field(c).type)) for c in columns]
    odd = [t for t in types if t[1].replace("large_", "") != t[2].replace("large_", "")]
    rows = [Counter(zip(*[t.column(c).to_pylist() for c in columns])) for t in (got, want)]
    extra, missing = rows[0] - rows[1], rows[1] - rows[0]
    if extra or missing:
        return f"{got.num_rows} rows / {want.num_rows}; {columns}\n  extra {list(extra)[:2]}\n  missing {list(missing)[:2]}"
    return f"types {odd}" if odd else None


if __name__ == "__main__":
    from pagesmith.session import get_spark

    spark = get_spark()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1]
    con = connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            result = compare(spark, con, sf_dir, name) if name in ORACLES else f"no SQL, {QUERIES[name](spark, sf_dir).count()} rows"
        except Exception as error:
            result = "ERROR " + str(error)[:1500]
        bad += result is not None
        print(f"{name} {time.time() - start:.1f}s {'ok' if result is None else result[:3000]}", flush=True)
    print("different:", bad)
