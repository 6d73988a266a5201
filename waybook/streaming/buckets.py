"""A table with one current record per key, kept as runs of hash buckets.

A batch adds one run: its own latest records, in a folder per bucket. What is asked of some
keys reads their buckets only, and a bucket's runs are merged alone: ``compact`` rewrites the
buckets that hold many runs and leaves the others as they are. A run's name is the range of
batches it covers and a generation; it counts once its ``_SUCCESS`` is there, and hides the
runs of its bucket whose ranges it contains. What is hidden is removed by the compaction after.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from waybook.operators.ordered import last_per_key
from waybook.sources import scratch
from waybook.streaming.streams import _start

_RUN = re.compile(r"run=(-?\d+)_(\d+)")


@dataclass(frozen=True)
class Buckets:
    """``keys`` name a record, the largest ``order`` is the current one, and of equal orders the later batch's.

    The number of buckets stays for the table's life; a bucket should fit a task a few times over.
    """

    path: str
    schema: str
    keys: Sequence[str]
    order: Sequence[str]
    count: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).cast("int").alias("bucket")

    def upsert(self, log: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Each batch of the stream writes its latest records; a repeated batch replaces its own."""

        def each(batch: DataFrame, epoch: int) -> None:
            rows = last_per_key(batch, self.keys, self.order).withColumn("batch", F.lit(epoch).cast("bigint"))
            self._write(rows, f"{self.path}/run={epoch}_{epoch}")

        return _start(log, checkpoint, "append", each, once)

    def _write(self, rows: DataFrame, target: str) -> None:
        rows.withColumn("bucket", self._bucket()).repartition(self.count, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)

    def runs(self, spark: SparkSession) -> tuple[dict[int, list[str]], list[str]]:
        """(the folders that count, by bucket; those that are hidden). As many entries as buckets and uncompacted batches."""
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = lambda path: [f.getPath() for f in system.listStatus(path)] if system.exists(path) else []
        found: dict[int, list[tuple[int, int, str]]] = {}
        for run in names(root):
            named = _RUN.fullmatch(run.getName())
            inside = {p.getName(): p for p in names(run)} if named else {}
            if "_SUCCESS" in inside:
                for name, path in inside.items():
                    if name.startswith("bucket="):
                        found.setdefault(int(name[7:]), []).append((int(named[1]), int(named[2]), path.toString()))
        live, hidden = {}, []
        for bucket, held in found.items():
            for low, high, path in held:
                covered = any(a <= low and high <= b and (a, b) != (low, high) for a, b, _ in held)
                hidden.append(path) if covered else live.setdefault(bucket, []).append(path)
        return live, hidden

    def _records(self, spark: SparkSession, folders: Sequence[str]) -> DataFrame:
        schema = f"{self.schema}, batch bigint"
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*folders)

    def _merged(self, rows: DataFrame) -> DataFrame:
        return last_per_key(rows, self.keys, [*self.order, "batch"])

    def current(self, spark: SparkSession) -> DataFrame:
        """The current record of every key."""
        return self._merged(self._records(spark, [f for fs in self.runs(spark)[0].values() for f in fs])).drop("batch")

    def get(self, wanted: DataFrame) -> DataFrame:
        """The current records of the keys in a table; reads only the buckets these keys are in."""
        spark = wanted.sparkSession
        wanted = wanted.select(*self.keys).distinct()
        buckets = {r["bucket"] for r in wanted.select(self._bucket()).distinct().collect()}  # at most one row per bucket
        live = self.runs(spark)[0]
        return self._merged(self._records(spark, [f for b in buckets for f in live.get(b, [])])).drop("batch").join(wanted, list(self.keys), "left_semi")

    def compact(self, spark: SparkSession, most: int = 8) -> list[int]:
        """Merge the runs of each bucket that has more than `most`; the buckets that were rewritten.

        For one caller at a time, and not while a batch is repeated. Readers that began before keep their
        files until the next call.
        """
        live, hidden = self.runs(spark)
        for path in hidden:
            scratch.remove(spark, path)
        full = sorted(b for b, folders in live.items() if len(folders) > most)
        if full:
            ranges = [tuple(map(int, _RUN.search(f).groups())) for b in full for f in live[b]]
            low, high = min(a for a, _ in ranges) - 1, max(b for _, b in ranges)
            self._write(self._merged(self._records(spark, [f for b in full for f in live[b]])), f"{self.path}/run={low}_{high}")
        return full
