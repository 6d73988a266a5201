"""Temperature mixing of sources. DataFrame functions only.

A source's weight is its share of all tokens to the power of an exponent from 0
(all sources alike) to 1 (as they are), normalised. The exponent is found by
bisection: the largest one whose weights reach a target entropy, or the smallest one
whose weights repeat no source more often than a limit. Weights times a budget of
tokens give each source's quota, which passes over its documents realise: whole
passes, and a last one over part of a permutation of the source's blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybook.operators.ordered import running
from waybook.sources.scratch import stage

#: Words of this rule count as tokens.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents per block, on average.
BLOCK = 1024
#: Cuts of the interval per round of the search, and rounds: the exponent is good to 16 ** -10.
CUTS, ROUNDS = 16, 10


def _marks(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def sources(rows: DataFrame) -> DataFrame:
    """(source, tokens, docs) of rows (source, n_tokens); null is a source of its own."""
    return rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def exponent(by_source: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> float:
    """The exponent for a target entropy (as a part of the largest one) or a limit of repeats.

    Without a budget, the least repeated source counts as one pass. Each round
    looks at 16 exponents at once, added up over the sources by Spark; sixteen rows
    come back, however many sources there are. A target that no exponent from 0 to
    1 meets gives the nearest end.
    """
    used = by_source.filter("tokens > 0").select("tokens")
    row = used.agg(F.sum("tokens"), F.count("*"), F.max("tokens")).first()
    total, count, most = row[0], row[1], row[2]
    if not total or count < 2:
        return 1.0
    share = F.log(F.col("tokens") / F.lit(float(total)))
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (high - low) / CUTS
        tried = used.select(share.alias("p"), F.explode(F.array(*[F.lit(low + step * i) for i in range(1, CUTS)])).alias("x"))
        got = tried.groupBy("x").agg(
            F.sum(F.exp(F.col("x") * F.col("p"))).alias("z"), F.sum(F.exp(F.col("x") * F.col("p")) * F.col("p")).alias("zp"), F.max((F.col("x") - 1) * F.col("p")).alias("top")
        )
        good = []
        for r in got.collect():
            if entropy is not None:
                ok = math.log(r["z"]) - r["x"] * r["zp"] / r["z"] >= entropy * math.log(count)
            else:
                least = (r["x"] - 1) * math.log(most / total)
                scale = -least if budget is None else math.log(budget / total) - math.log(r["z"])
                ok = r["top"] + scale > math.log(repeats)  # repeats too often: the exponent must be larger
            good += [r["x"]] if ok else []
        low = max(good, default=low)
        high = min(low + step, high)
    return (low + high) / 2


def mixture(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(decisions, weights) of documents (doc_id, text, source).

    weights: source, tokens, docs, weight, quota (tokens). decisions: one row per
    distinct document: doc_id, source, text_hash, n_tokens, block, copies. Rows equal in
    all three columns are one document of as many tokens as they have together; all of
    them get its copies. Without a budget it is the smallest that uses every document
    once. The last pass takes blocks in the order of their marks and in the last
    block documents in the order of theirs, up to and with the one that fills the quota.

    Null is a source like any other; null and empty texts have no tokens, come along
    with every whole pass and stay out of a last one that has no tokens left to give.
    Sources without tokens get one pass. An empty table gives empty ones.
    """
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")
    )
    rows = stage(found.groupBy("doc_id", "source", "text_hash").agg(F.sum("n_tokens").alias("n_tokens")), "tokens")
    by_source = stage(sources(rows), "sources")
    x = exponent(by_source, entropy, repeats, budget)
    total = by_source.agg(F.sum("tokens")).first()[0] or 0
    raw = by_source.withColumn("_raw", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(x))).otherwise(0.0))
    z, once = raw.agg(F.sum("_raw"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("_raw")))).first()
    scale = (once or 0.0) if budget is None else budget / (z or 1.0)
    weights = raw.select("source", "tokens", "docs", (F.col("_raw") / F.lit(z or 1.0)).alias("weight"), (F.col("_raw") * F.lit(float(scale))).alias("quota"))
    weights = weights.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + 1e-9)).otherwise(1).cast("long"))
    weights = stage(weights.withColumn("rest", F.floor(F.col("quota") - F.col("passes") * F.col("tokens") + 1e-6).cast("long")), "weights")

    part = weights.select(F.col("source").alias("_source"), "passes", "rest", F.ceil(F.col("docs") / BLOCK).alias("_blocks"))
    placed = rows.join(part, rows.source.eqNullSafe(part["_source"])).drop("_source").withColumn("mark", _marks(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.col("text_hash"))), F.coalesce("source", F.lit(""))))
    placed = placed.withColumn("block", F.pmod(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long"), F.col("_blocks")))
    blocks = placed.groupBy("source", "block", "passes").agg(F.sum("n_tokens").alias("_sum"))
    blocks = blocks.withColumn("_order", _marks(F.lit(seed), F.coalesce("source", F.lit("")), F.col("block").cast("string"), (F.col("passes") + 1).cast("string")))
    # a source may have any number of blocks: they are added up by ranges
    blocks = running(stage(blocks.drop("passes"), "blocks"), ["source"], "_order", sums={"_start": F.col("_sum")})
    blocks = blocks.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "_start")
    inside = Window.partitionBy("source", "block").orderBy("mark", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_within", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    placed = placed.join(blocks, placed.source.eqNullSafe(blocks["_source"]) & (placed.block == blocks["_block"]))
    copies = F.col("passes") + (F.col("_start") + F.col("_within") < F.col("rest")).cast("long")
    return placed.select("doc_id", "source", "text_hash", "n_tokens", "block", copies.alias("copies")), weights.select("source", "tokens", "docs", "weight", "quota")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` with all their columns, each as often as `mixture` decides, and never less than that."""
    own = "_mix" + "_" * max(len(c) for c in docs.columns)  # begins no name of the table
    decisions = mixture(docs, **how)[0].toDF(*[f"{own}{c}" for c in ("doc_id", "source", "text_hash", "n_tokens", "block", "copies")])
    same = docs.doc_id.cast("long").eqNullSafe(F.col(f"{own}doc_id")) & docs.source.eqNullSafe(F.col(f"{own}source")) & (F.xxhash64(docs.text) == F.col(f"{own}text_hash"))
    out = docs.join(decisions, same).filter(F.col(f"{own}copies") > 0)
    return out.withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}copies").cast("int")))).select(*docs.columns)
