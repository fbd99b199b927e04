"""Incremental dumps as a stream of files (B6s).

A batch is written as a small folder of its own, so its cost follows the input. When ``fold_every``
batches wait, they are folded into the table: pages lie in buckets by a hash of their key, and only the
buckets that have new pages are merged and written anew, as a new version behind a pointer
(``sources.versions``) that also says which batches it holds. A reader takes the table and the batches
behind it: at most ``fold_every``, however many there ever were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesmith.operators.ingest import latest, prepare
from pagesmith.operators.intervals import KEY
from pagesmith.schemas import ORD, PAGES
from pagesmith.sources import versions
from pagesmith.sources.dump import add_ord, parse_records, read_records
from pagesmith.sources.tables import PAGE_COLUMNS

BUCKETS, FOLD_EVERY = 64, 8


def stream_upsert(
    spark: SparkSession, path_in: str, path_out: str, checkpoint: str, namespaces: DataFrame, fold_every: int = FOLD_EVERY,
    buckets: int = BUCKETS,
):
    """B6s: upserts every new dump file into the page table at ``path_out``.

    Replaying a batch overwrites its folder with the same rows; one that is already folded is left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= _folded(versions.current(spark, _table(path_out))):
            return
        pages = latest(prepare(parse_records(add_ord(batch)), namespaces), "ord")
        pages.write.mode("overwrite").parquet(f"{path_out}/batches/batch_no={batch_id}")
        if len(_waiting(spark, path_out)) >= fold_every:
            fold(spark, path_out, buckets)

    records = read_records(spark.readStream, path_in)
    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _table(path_out: str) -> str:
    return f"{path_out}/table"


def _folded(pointer: dict | None) -> int:
    return pointer["folded"] if pointer else -1


def _waiting(spark: SparkSession, path_out: str) -> list[int]:
    """Numbers of the batches that are not folded."""
    done = _folded(versions.current(spark, _table(path_out)))
    numbers = [int(n.split("=")[1]) for n in versions._names(spark, f"{path_out}/batches") if n.startswith("batch_no=")]
    return sorted(n for n in numbers if n > done)


def _delta(spark: SparkSession, path_out: str, numbers: list[int]) -> DataFrame:
    """The last version of every page in these batches."""
    folders = [f"{path_out}/batches/batch_no={n}" for n in numbers]
    batches = spark.read.schema(f"ord {ORD}, {PAGES}, batch_no bigint").option("basePath", f"{path_out}/batches").parquet(*folders)
    return latest(batches, "batch_no", "ord").select(*PAGE_COLUMNS)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def fold(spark: SparkSession, path_out: str, buckets: int = BUCKETS) -> int:
    """Merge the waiting batches into the table; the number of buckets written. The first fold fixes ``buckets``."""
    pointer = versions.current(spark, _table(path_out))
    numbers = _waiting(spark, path_out)
    if not numbers:
        return 0
    buckets = pointer["buckets"] if pointer else buckets
    new = _delta(spark, path_out, numbers).withColumn("bucket", _bucket(buckets))
    merged = new
    if pointer is not None:
        # At most one row per bucket.
        touched = [str(r[0]) for r in new.select("bucket").distinct().collect()]
        old = versions.read_parts(spark, _table(path_out), pointer, f"{PAGES}, bucket int", touched)
        merged = old.join(new.select(*KEY), KEY, "left_anti").select(*PAGE_COLUMNS, "bucket").unionByName(new)
    made = versions.replace_parts(merged, _table(path_out), pointer, "bucket", folded=numbers[-1], buckets=buckets)
    return sum(v == max(made["parts"].values()) for v in made["parts"].values())


def current_pages(spark: SparkSession, path_out: str) -> DataFrame:
    """The page table after all batches: per key the last batch wins, then dump order."""
    pointer = versions.current(spark, _table(path_out))
    numbers = _waiting(spark, path_out)
    if pointer is None:
        return _delta(spark, path_out, numbers)
    folded = versions.read_parts(spark, _table(path_out), pointer, PAGES)
    if not numbers:
        return folded
    new = _delta(spark, path_out, numbers)
    return folded.join(new.select(*KEY), KEY, "left_anti").select(*PAGE_COLUMNS).unionByName(new)
