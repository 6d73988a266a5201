"""Work planning: what to run, what is done, who runs it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybook.operators.ordered import indexed, last_per_key

__all__ = ["duplicates", "expand", "head", "last_per_key", "pending", "record_id", "request_id", "require_unique", "shard"]


def expand(questions: DataFrame, attempts: int, name: str = "traj_idx") -> DataFrame:
    """Every question once per attempt; a row-local explode, no join."""
    return questions.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))


def pending(planned: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Planned minus done. Done keys are made distinct first, so a key logged many times weighs once."""
    return planned.join(done.select(*on).distinct(), list(on), "left_anti")


def shard(df: DataFrame, order: str, rank: int, world: int) -> DataFrame:
    """Every ``world``-th row by position, starting at ``rank``."""
    return indexed(df, order, "_pos").where(F.pmod("_pos", F.lit(world)) == rank).drop("_pos")


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in order; all rows when ``n`` is not positive."""
    if n <= 0:
        return df
    return indexed(df, order, "_pos").where(F.col("_pos") < n).drop("_pos")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows themselves; the query fails when a key occurs twice."""
    worst = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    message = F.lit(f"duplicate key in {', '.join(keys)}")
    return df.where(F.when(F.coalesce(worst, F.lit(0)) > 1, F.raise_error(message).cast("boolean")).otherwise(True))


def record_id(qid: Column, traj_idx: Column) -> Column:
    return F.concat(F.coalesce(qid.cast("string"), F.lit("")), F.lit("_"), F.coalesce(traj_idx, F.lit(0)).cast("string"))


def request_id(qid: Column, traj_idx: Column) -> Column:
    """``{qid}__traj{n}``, or the bare question id when there is no attempt number."""
    suffixed = F.concat(qid.cast("string"), F.lit("__traj"), traj_idx.cast("string"))
    return F.when(traj_idx.isNotNull(), suffixed).otherwise(qid.cast("string"))
