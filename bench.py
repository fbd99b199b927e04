"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The page table is written before the clock starts. Every query runs to completion into
the no-op sink, twice: ``cold`` holds first runs, ``queries`` second ones.
"""

from __future__ import annotations

import json
import os
import time

from pagesmith.plans.fixture import table
from pagesmith.plans.queries import QUERIES
from pagesmith.session import get_spark

HEADLINE = [
    "c8_error_scan", "c8_error_counts", "b6_upsert_pages", "b7_ingest_dump", "j5_resolve_redirects", "x0_spans",
    "x8_template_args", "x14_sections", "x19_table_cells", "j7_ancestors", "w1_segment", "t1_plain_text",
    "r5_rm_dup_args_safe", "k4_page_corrections", "k5_correct_pages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = os.environ.get("BENCH_QUERIES")
    spark = get_spark(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("wiki_pages", "raw_pages", "requests"):
        table(spark, sf_dir, name)
    cold, warm = {}, {}
    for name in only.split(",") if only else HEADLINE:
        for times in (cold, warm):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries, second run", "value": round(sum(warm.values()), 3),
        "unit": "sec", "queries": warm, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
