"""Streaming variants: growing logs, progress, liveness, upserts.

All of them read files as they appear and restart from their checkpoint.
Results are written with the batch number in the path, so a repeated batch
replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from waybook import constants as K
from waybook.operators import report
from waybook.operators.ordered import last_per_key
from waybook.operators.report import PARALLEL_RUNS, offline_at
from waybook.sources import scratch


def growing_log(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None, fmt: str = "json") -> DataFrame:
    """New files of a trajectory log as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _start(stream: DataFrame, checkpoint: str, mode: str, each: Callable[[DataFrame, int], None], once: bool) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tool_progress(log: DataFrame) -> DataFrame:
    """Calls, errors and positive latency per tool; the same on a table and on a stream."""
    timed = F.when(F.col("latency_s") > 0, F.col("latency_s"))
    return log.groupBy("tool").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("errors"),
        F.count(timed).alias("timed"), F.coalesce(F.sum(timed), F.lit(0.0)).alias("seconds"),
    )


def question_progress(log: DataFrame) -> DataFrame:
    """Attempts, boxed answers, errors and positive latency per question; the same on a table and on a stream."""
    timed = F.when(F.col("latency_s") > 0, F.col("latency_s"))
    return log.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.coalesce("traj_idx", F.lit(0))).alias("last_attempt"),
        F.count_if(F.coalesce("boxed_answer", F.lit("")) != "").alias("boxed"), F.count_if(F.col("status") == "error").alias("errors"),
        F.count(timed).alias("timed"), F.coalesce(F.sum(timed), F.lit(0.0)).alias("seconds"),
    )


def overall_progress(questions: DataFrame, target: int) -> DataFrame:
    """One progress row out of the questions' current state."""
    one = questions.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("questions"),
        (F.coalesce(F.max("last_attempt"), F.lit(-1)) + 1).alias("attempts"), F.coalesce(F.sum("boxed"), F.lit(0)).alias("boxed"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"),
        F.coalesce(F.try_divide(F.sum("seconds"), F.sum("timed").cast("double")), F.lit(0.0)).alias("avg_s"),
    )
    left = F.lit(target) - F.col("n")
    return one.withColumn("eta_min", F.when((F.col("n") > 0) & (F.col("avg_s") > 0), left * F.col("avg_s") / PARALLEL_RUNS / 60))


def snapshots(aggregate: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the result of a streaming aggregate: each batch writes the groups it changed."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return _start(aggregate, checkpoint, "update", each, once)


def latest_snapshot(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The groups as the last batch that changed them left them."""
    return last_per_key(spark.read.parquet(path), keys, ["epoch"]).drop("epoch")


def upsert(log: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Ingest with last record wins: each batch adds its own latest records.

    Work grows with the new data only; the table is merged when it is read,
    or rewritten by ``compact`` when there are many small batches.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        last_per_key(batch, keys, order).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return _start(log, checkpoint, "append", each, once)


def current(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest record of each key; equal order values fall to the later batch."""
    return last_per_key(spark.read.parquet(path), keys, [*order, "epoch"]).drop("epoch")


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Write the merged table to a new place as its first batch."""
    current(spark, path, keys, order).write.mode("overwrite").parquet(f"{target}/epoch=-1")


def _epochs(spark: SparkSession, path: str) -> list[int]:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(root)] if system.exists(root) else []
    return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))


def worker_lives(events: DataFrame, path: str, checkpoint: str, timeout_s: int = K.HEARTBEAT_TIMEOUT_S, once: bool = True) -> StreamingQuery:
    """Spans without a silence longer than the timeout, per worker, of a stream of ``worker_id, ts, kind``.

    Each batch is cut into spans by itself, and spans are merged with those of the
    batch before where no more than the timeout lies between them. Nothing is ever
    too late, open spans are there like all others, and no worker's events meet
    in one task. A batch writes all spans; the one before it is kept for a
    repeated batch and older ones are removed. Read them with ``current_lives``.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        spans = report.worker_lives(batch, "ts", timeout_s).drop("offline_at")
        before = [e for e in _epochs(spark, path) if e < epoch]
        if before:
            spans = report.merged_lives(spans.unionByName(spark.read.parquet(f"{path}/epoch={before[-1]}")), timeout_s)
        spans.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        for old in before[:-1]:
            scratch.remove(spark, f"{path}/epoch={old}")

    return _start(events, checkpoint, "append", each, once)


def current_lives(spark: SparkSession, path: str, timeout_s: int = K.HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """The spans as of the last batch, open ones among them: their ``offline_at`` lies ahead."""
    return spark.read.parquet(f"{path}/epoch={_epochs(spark, path)[-1]}").withColumn("offline_at", offline_at(timeout_s))


def append_to(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", path)
    return (writer.trigger(availableNow=True) if once else writer).start()


def status_log(events: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the status events ``worker_id, seq, status`` of a stream, whatever order they come in; null says nothing."""
    return append_to(events.where("status IS NOT NULL").select("worker_id", "seq", "status"), path, checkpoint, once)


def status_changes(spark: SparkSession, path: str) -> DataFrame:
    """Every change among the events kept so far, in order of ``seq`` per worker."""
    events = spark.read.schema("worker_id bigint, seq bigint, status string").parquet(path)
    return report.status_changes(events, ["worker_id"], "seq").select("worker_id", "seq", "old_status", "status")
