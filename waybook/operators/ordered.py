"""Ordered operators that stay distributed when one key holds much of the data.

A window sends a whole key to one task. That is the best plan while every key is small,
so the largest key is counted first. Beyond ``SEGMENT`` rows the rows are dealt to ranges
of (key, order) of about equal counts, written once, and the window runs within
``(key, range)``; one summary row per range carries the state on. Ranges follow the
rank of the rows, so any order will do: dense numbers, microseconds or hashes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybook.sources.scratch import stage

SEGMENT = 1 << 20
#: Rows of a task at least where there would be more than FEW tasks, and ranges are narrower than that.
TASK, FEW = 1 << 16, 256


def tasks(df: DataFrame, rows: int, width: int) -> int:
    """How many tasks ranges of up to ``width`` rows are dealt to: one each, but beyond FEW no more than rows and cores need."""
    return max(1, min(-(-2 * rows // width), max(FEW, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK))))


def segmented(df: DataFrame, keys: Sequence[str], order: str, width: int = SEGMENT) -> DataFrame:
    """The rows, with their range in ``_seg`` when a key has more than ``width`` rows.

    The number of tasks follows the rows, not the width: what a range partitioner samples
    and what tasks report goes through the driver, so narrow ranges share tasks. Several ``running`` calls over the same keys and order share one such frame.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else df.agg(F.count(F.lit(1)).alias("_n"))
    most, total = counts.agg(F.max("_n"), F.sum("_n")).first()
    if (most or 0) <= width:
        return df
    n = tasks(df, total, width)
    ranges = df.repartitionByRange(n, *keys, order)
    if n == -(-2 * total // width):
        return stage(ranges.withColumn("_seg", F.spark_partition_id().cast("bigint")), "ranges")
    # a task holds many narrow ranges: the id is the task's number in the upper bits and the row's place in the lower 33
    at = F.monotonically_increasing_id()
    place = at.bitwiseAND(F.lit((1 << 33) - 1))
    seg = (at - place) + F.floor(place / F.lit(width))
    return stage(ranges.sortWithinPartitions(*keys, order).withColumn("_seg", seg), "ranges")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    ahead: bool = False,
    width: int = SEGMENT,
) -> DataFrame:
    """Add state over the strictly earlier rows of the key, or the strictly later ones (``ahead``).

    ``sums`` adds up a number, ``lasts`` keeps the nearest non-null value. ``order``
    is unique in a key. A frame from ``segmented`` keeps its ranges.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    values = {**sums, **lasts}
    rows = df if "_seg" in df.columns else segmented(df, keys, order, width)
    hot = "_seg" in rows.columns
    parts = [*keys, "_seg"] if hot else list(keys)
    turn = F.desc if ahead else F.asc
    rows = rows.withColumns({f"_v_{n}": c for n, c in values.items()})
    earlier = Window.partitionBy(*parts).orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns(
        {f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(earlier), F.lit(0)) for n in sums}
        | {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(earlier) for n in lasts}
    )
    kept = [c for c in df.columns if c not in values]
    if not hot:
        return local.select(*kept, *[F.col(f"_l_{n}").alias(n) for n in values])
    local = stage(local, "states")
    nearest = F.min_by if ahead else F.max_by
    totals = local.groupBy(*parts).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[nearest(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_t_{n}") for n in lasts],
    )
    before = Window.partitionBy(*keys).orderBy(turn("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in parts],
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in parts])
    return local.join(carried, same).select(
        *kept,
        *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums],
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in lasts],
    )


def indexed(df: DataFrame, order: str, name: str = "index", width: int = SEGMENT) -> DataFrame:
    """0-based position by a unique column over the whole table.

    A large table is numbered within its ranges; the only step in one task adds
    up the counts of the ranges.
    """
    rows = segmented(df, [], order, width)
    if "_seg" not in rows.columns:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(order)) - 1).cast("bigint"))
    before = Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_seg").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_seg").orderBy(order)) - 1
    return rows.withColumn("_local", local).join(offsets, "_seg").select(*df.columns, (F.col("_local") + F.col("_offset")).cast("bigint").alias(name))


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest record of each key, as a partial aggregate (no per-key sort)."""
    rest = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return latest.select(*keys, "_row.*").select(*df.columns)


def index_percentiles(
    df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = (), width: int = SEGMENT
) -> DataFrame:
    """Exact element ``sorted(values)[int(n * p)]`` per group: columns ``by``, ``p``, ``value``.

    Equal values are counted first. A group with many distinct values is cut into
    ranges of about as many; range counts locate each rank, and only the rows of those
    ranges are ordered.
    """
    by = list(by)
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull()).groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in points]))
    rank = F.least(F.floor(F.col("_total") * F.col("p")), F.col("_total") - 1)
    ranged = segmented(counts, by, "_v", width)
    if "_seg" not in ranged.columns:
        before = F.sum("_n").over(whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
        placed = counts.withColumns({"_below": F.coalesce(before, F.lit(0)), "_total": F.sum("_n").over(whole)}).withColumn("p", wanted)
        return placed.where((F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_n"))).select(*by, "p", F.col("_v").alias("value"))
    counts = ranged
    below = whole.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.groupBy(*by, "_seg").agg(F.sum("_n").alias("_n"))
    ranks = (
        bins.withColumns({"_below": F.coalesce(F.sum("_n").over(below), F.lit(0)), "_total": F.sum("_n").over(whole)})
        .withColumn("p", wanted)
        .withColumn("_rank", rank)
        .where((F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_n")))
        .select(*by, "_seg", "p", (F.col("_rank") - F.col("_below")).alias("_rank"))
    )
    inside = Window.partitionBy(*by, "p", "_seg").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.join(ranks, [*by, "_seg"])
        .withColumn("_below", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .where((F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_n")))
        .select(*by, "p", F.col("_v").alias("value"))
    )


def lookup(
    rows: DataFrame, table: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "left", width: int = SEGMENT
) -> DataFrame:
    """Join rows whose key may be hot to a table with one row per key.

    Keys with more than ``width`` rows are counted first. Their rows go to as many
    tasks as they fill, dealt by the ``spread`` columns, and their table rows are
    repeated as often; all other keys are joined as they are.
    """
    hot = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > width)
    if hot.isEmpty():
        return rows.join(table, list(on), how)
    hot = stage(hot.select(*on, F.ceil(F.col("_n") / width).cast("int").alias("_salts")), "hot")  # at most one per `width` rows
    salts = F.coalesce("_salts", F.lit(1))
    salted = rows.join(hot, list(on), "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")
    copies = table.join(hot, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
