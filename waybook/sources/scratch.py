"""Shared scratch folders for written intermediates and stream checkpoints."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = f"waybook-{uuid.uuid4().hex[:12]}"
_USED: dict[str, object] = {}


def root(spark: SparkSession) -> str:
    """The folder of this run: under ``spark.checkpoint.dir``, or under the warehouse where that is unset.

    Both are places that the driver and all executors share; a machine-local
    folder is never chosen. The folder is deleted when the driver's Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{_RUN}"
    if path not in _USED:
        if not _USED:
            atexit.register(_remove)
        _USED[path] = spark
    return path


def folder(spark: SparkSession, label: str) -> str:
    """A new folder name; nothing is created yet."""
    return f"{root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            remove(table.sparkSession, file.rsplit("/", 1)[0])


def _remove() -> None:
    for path, spark in _USED.items():
        if spark.sparkContext._jsc is not None:  # else the session has ended and its file systems with it
            remove(spark, path)


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write the rows once, with the writer's `options`, and go on from the written table.

    For results that several later steps read: each of them then scans only
    the columns it needs, nothing upstream is computed twice, and a lost
    executor costs a read instead of the whole lineage.
    """
    path = folder(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
