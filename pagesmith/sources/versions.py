"""Tables in versioned parts behind an atomic pointer.

A table is a folder of versions ``v=<n>/<column>=<part>/*.parquet``. A pointer, a small file
``_current/<n>.json``, says in which version every part lies; readers take the newest pointer, so they
see all of a change or nothing of it, and one that already has its paths keeps the old files. A writer
writes the touched parts into a new version first and publishes the pointer last, by a rename that
fails where another writer was faster. A run that stops leaves a version nobody points to. All goes
through the Hadoop file system, so the folder may lie in any store Spark can write to.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def current(spark: SparkSession, path: str) -> dict | None:
    """The newest pointer: ``number``, ``column``, ``parts`` (part to version) and what its writer added."""
    names = [n for n in _names(spark, f"{path}/_current") if n.endswith(".json")]
    if not names:
        return None
    text = spark.read.text(f"{path}/_current/{names[-1]}", wholetext=True).first()[0]
    return json.loads(text)


def read_parts(spark: SparkSession, path: str, pointer: dict, schema: str, parts: list[str] | None = None) -> DataFrame:
    """Rows of the parts (all by default); filters on the part column prune folders."""
    chosen = pointer["parts"] if parts is None else {p: pointer["parts"][p] for p in parts if p in pointer["parts"]}
    if not chosen:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/v={v}/{pointer['column']}={p}" for p, v in sorted(chosen.items())]
    wanted = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*wanted)


def write_parts(rows: DataFrame, path: str, pointer: dict | None, column: str) -> tuple[int, list[str]]:
    """Rows into a new version; its number and the parts it has. Large parts get several files, small ones share a task."""
    spark = rows.sparkSession
    taken = [int(n[2:]) for n in _names(spark, path) if n.startswith("v=")]
    version = max([*taken, pointer["number"] if pointer else 0]) + 1
    rows.hint("rebalance", column).write.partitionBy(column).parquet(f"{path}/v={version}")
    names = [n for n in _names(spark, f"{path}/v={version}") if n.startswith(f"{column}=")]
    return version, [n.split("=", 1)[1] for n in names]


def publish(spark: SparkSession, path: str, pointer: dict | None, column: str, parts: dict[str, int], **more) -> dict:
    """Make ``parts`` the content of the table. Fails when another writer published since ``pointer`` was read."""
    number = (pointer["number"] if pointer else 0) + 1
    made = {"number": number, "column": column, "parts": parts, **more}
    fs, draft = _fs(spark, f"{path}/_current/.draft-{number}-{spark.sparkContext.applicationId}")
    final = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_current/{number:010d}.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"{path} was changed by another writer; read it again")
    return made


def replace_parts(rows: DataFrame, path: str, pointer: dict | None, column: str, gone: list[str] = (), **more) -> dict:
    """Write rows as the new content of their parts, drop the parts ``gone`` that got no rows, keep the others."""
    version, written = write_parts(rows, path, pointer, column)
    parts = {p: v for p, v in (pointer["parts"] if pointer else {}).items() if p not in gone}
    return publish(rows.sparkSession, path, pointer, column, parts | dict.fromkeys(written, version), **more)


def drop_unused(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete versions no pointer of the last ``keep`` refers to, and older pointers; the deleted names.

    For maintenance, when no reader of older pointers and no writer is at work.
    """
    names = [n for n in _names(spark, f"{path}/_current") if n.endswith(".json")]
    used = set()
    for name in names[-keep:]:
        text = spark.read.text(f"{path}/_current/{name}", wholetext=True).first()[0]
        used |= {f"v={v}" for v in json.loads(text)["parts"].values()}
    old = [f"_current/{n}" for n in names[:-keep]]
    old += [n for n in _names(spark, path) if n.startswith("v=") and n not in used]
    for name in old:
        fs, at = _fs(spark, f"{path}/{name}")
        fs.delete(at, True)
    return old
