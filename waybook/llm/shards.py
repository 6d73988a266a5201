"""Contiguous shards of about equal bytes, from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybook.sources.scratch import stage


def balanced(docs: DataFrame, shards: int = 24, carry: list[str] | None = None) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, size, text_crc32, shard, slot and the columns of `carry`.

    Rows are put in order of doc_id (null first; repeated ids by their text's
    checksum and size) and dealt to ranges of that order. Each range is added up by
    itself; the totals of all ranges, as many as there are partitions, give each its
    place among the bytes and rows before it. A row belongs to the shard in whose
    equal part of all bytes its middle lies. Slots number the rows of a shard from 0.

    Size is the text's UTF-8 bytes plus 8; a null text has none, and checksum 0.
    Only ids, sizes and checksums are moved, not the texts. A shard stays empty
    where one row is larger than its part. An empty table gives an empty one.
    """
    carry = carry or []
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_nth"),
        F.struct(*carry).alias("_carry") if carry else F.lit(None).cast("int").alias("_carry"),
    )
    order = ["doc_id", "text_crc32", "size", "_nth"]
    narrow = stage(narrow, "sizes")
    parts = stage(narrow.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")

    totals = parts.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
        F.sum("_bytes").over(everything).alias("_all"),
    )
    own = Window.partitionBy("_part").orderBy(*order)
    placed = parts.join(totals, "_part").select(
        "doc_id", "size", "text_crc32", "_carry",
        (F.col("_bytes") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("_start"),
        (F.col("_rows") + F.row_number().over(own) - 1).alias("_row"),
        "_all",
    )
    placed = placed.withColumn("shard", F.expr(f"cast(least({shards - 1}, (2 * _start + size) * {shards} div (2 * _all)) AS int)"))
    heads = placed.groupBy("shard").agg(F.min("_row").alias("_head"))
    out = placed.join(heads, "shard").withColumn("slot", F.col("_row") - F.col("_head"))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", *([F.col(f"_carry.{c}").alias(c) for c in carry]))
