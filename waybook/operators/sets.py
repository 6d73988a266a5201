"""Unions of datasets and of search results."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mix(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Datasets of one shape in one table, with the name of the source."""
    named = [df.withColumn("dataset", F.lit(name)) for name, df in datasets.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def merge_searches(searches: DataFrame, request: str, order: str, strict: bool = False) -> DataFrame:
    """Results of the queries of one request in query order, titles joined.

    ``searches`` is ``request, order, query, results``; ``order`` numbers the
    queries of one request, which is one tool call. ``strict`` makes a request
    without any result an error. Rows that lie together by request, as
    ``tables.dealt`` leaves them, are not shuffled again.
    """
    # a result gets its query's number only behind the grouping, the numbers and the texts are two plain arrays before it
    plain = F.coalesce("results", F.array())
    each = F.struct(order, "query", F.transform(plain, lambda r: r["rank"]).alias("_rank"), F.transform(plain, lambda r: r["url"]).alias("_url"))
    merged = searches.select(request, each.alias("_s")).groupBy(request).agg(F.collect_list("_s").alias("_q"))
    numbered = lambda q: F.transform(F.arrays_zip(q["_rank"], q["_url"]), lambda r: F.struct(q[order].alias(order), r["_rank"].alias("rank"), r["_url"].alias("url")))
    merged = merged.select(request, F.array_sort(F.transform("_q", lambda q: F.struct(q[order].alias(order), q["query"].alias("query"), numbered(q).alias("_r")))).alias("_q"))
    out = merged.select(
        request,
        F.array_join(F.transform("_q", lambda q: q["query"]), " | ").alias("title"),
        F.flatten(F.transform("_q", lambda q: q["_r"])).alias("results"),
    )
    if strict:
        none = F.raise_error(F.lit("no results for any query")).cast("boolean")
        out = out.where(F.when(F.size("results") == 0, none).otherwise(True))
    return out
