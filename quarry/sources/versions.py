"""A warehouse that is rebuilt as a whole or not at all.

Every rebuild writes into a folder of its own. One row in the small table
``_manifest``, appended last, makes it the current version; readers follow that row, so a
rebuild that ends half-way leaves the version before in place. Older versions are
removed once a newer one is published.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

_ROW = "sequence long, version string, tables array<string>"


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _published(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_ROW).parquet(f"{root.rstrip('/')}/_manifest")
    except AnalysisException:
        return None


def current(spark: SparkSession, root: str) -> dict[str, str]:
    """Paths of the tables of the current version, by name; empty before the first one."""
    rows = _published(spark, root)
    last = rows.orderBy(F.desc("sequence"), F.desc("version")).first() if rows is not None else None
    return {} if last is None else {t: f"{root.rstrip('/')}/{last['version']}/{t}" for t in last["tables"]}


def rebuild(spark: SparkSession, root: str, write: Callable[[str], list[str]], keep: int = 1) -> dict[str, str]:
    """``write(folder)`` writes all tables below a new folder and returns their names; then
    that folder becomes the current version. Whatever else ``write`` left there, and all
    but the last ``keep`` versions, are removed. Returns the tables' paths."""
    root = root.rstrip("/")
    version = f"v-{uuid.uuid4().hex[:12]}"
    tables = list(write(f"{root}/{version}"))
    rows = _published(spark, root)
    last = (rows.agg(F.max("sequence")).first()[0] or 0) if rows is not None else 0
    spark.createDataFrame([(last + 1, version, tables)], _ROW).coalesce(1).write.mode("append").parquet(f"{root}/_manifest")
    _tidy(spark, root, version, set(tables), keep)
    return current(spark, root)


def _tidy(spark: SparkSession, root: str, version: str, tables: set[str], keep: int) -> None:
    held = {r["version"] for r in _published(spark, root).orderBy(F.desc("sequence")).limit(keep).collect()}
    fs, folder = _folder(spark, root)
    for entry in fs.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith("v-") and name not in held:
            fs.delete(entry.getPath(), True)
    fs, folder = _folder(spark, f"{root}/{version}")
    for entry in fs.listStatus(folder):
        if entry.getPath().getName() not in tables:
            fs.delete(entry.getPath(), True)
