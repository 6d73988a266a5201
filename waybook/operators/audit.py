"""Benchmark contamination and audit counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybook.functions.strings import contains_any, let
from waybook.operators import markers as many

_GRAM = 3
_PREFIX = 8


def contaminated_turns(turns: Column, markers: Sequence[str]) -> Column:
    """Whether a tool turn of an ``array<struct<role, content, ...>>`` holds a marker."""
    return F.coalesce(
        F.exists(turns, lambda t: (t["role"] == "tool") & contains_any(F.coalesce(t["content"], F.lit("")), markers)),
        F.lit(False),
    )


def contaminated_keys(turns: DataFrame, keys: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """The same over a turn table: a flag per trajectory, one partial aggregate, no text shuffled."""
    hit = (F.col("role") == "tool") & contains_any(F.coalesce("content", F.lit("")), markers)
    return turns.groupBy(*keys).agg(F.bool_or(hit).alias("contaminated"))


def _word_grams(words: Column) -> Column:
    at = lambda i: F.get(words, i)
    grams = F.transform(
        F.sequence(F.lit(0), F.size(words) - _GRAM),
        lambda i: F.xxhash64(*[at(i + j) for j in range(_GRAM)]),
    )
    return F.when(F.size(words) >= _GRAM, grams).otherwise(F.array().cast("array<bigint>"))


def _pieces(text: Column, lengths: Column) -> Column:
    """Hashes of all substrings of the listed lengths, found by a zero-width match at every character."""

    def sized(n: Column) -> Column:
        everywhere = F.concat(F.lit("(?s)(?=(.{"), n.cast("string"), F.lit("}))"))
        return F.transform(F.regexp_extract_all(text, everywhere, 1), lambda g: F.xxhash64(g))

    return F.flatten(F.transform(lengths, sized))


def containing(texts: DataFrame, key: str, text: str, markers: DataFrame, marker_key: str, marker: str) -> DataFrame:
    """Pairs ``(key, marker_key)`` where the text contains the marker, without comparing all pairs.

    Markers of up to ``markers.LARGEST`` bytes are searched in one pass over the texts, and only
    hits leave it; more are joined (``joined``).
    """
    if many.fits(markers, marker):
        return many.pairs(texts, key, text, markers, marker_key, marker)
    return joined(texts, key, text, markers, marker_key, marker)


def joined(texts: DataFrame, key: str, text: str, markers: DataFrame, marker_key: str, marker: str) -> DataFrame:
    """``containing`` for any number of markers.

    Text around a long marker's inner words is delimited as in the marker, so
    its longest inner word triple occurs in every text that holds it: an
    equi-join on triple hashes finds the candidates. Markers too short for
    that are looked up by their first eight characters, or all of them when
    they have fewer (nothing is generated when there are none). Candidates are then checked in full.
    Only keys and hashes shuffle before the check; adaptive execution splits hot triples.
    """
    words = F.split(F.col(marker), " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    long = F.size(inner) >= _GRAM

    def longest(w: Column) -> Column:
        triples = F.transform(
            F.sequence(F.lit(0), F.size(w) - _GRAM),
            lambda i: F.struct(
                F.length(F.concat(*[F.get(w, i + j) for j in range(_GRAM)])).alias("size"),
                F.xxhash64(*[F.get(w, i + j) for j in range(_GRAM)]).alias("hash"),
            ),
        )
        return F.array_max(triples)["hash"]

    anchors = markers.where(F.col(marker).isNotNull()).select(
        marker_key, F.when(long, let(inner, longest)).otherwise(F.xxhash64(F.left(marker, F.lit(_PREFIX)))).alias("_hash")
    )
    lengths = (
        markers.where(~long).agg(F.collect_set(F.least(F.length(marker), F.lit(_PREFIX))).alias("l")).select(F.array_sort("l")).scalar()
    )
    t = F.col(text)
    hashes = F.concat(let(F.split(t, " "), _word_grams), _pieces(t, F.col("_lengths")))
    # The outer explode keeps the optimizer from adding a filter that computes all hashes again.
    sized = texts.select(key, text, lengths.alias("_lengths"))
    candidates = sized.select(key, F.explode_outer(hashes).alias("_hash")).join(anchors, "_hash")
    pairs = candidates.select(key, marker_key).distinct()
    named = markers.select(marker_key, F.col(marker).alias("_marker"))
    checked = pairs.join(named, marker_key)
    return (
        checked.join(texts.select(key, text), key).where(F.contains(t, F.col("_marker"))).select(key, marker_key)
    )


def contaminated_by(texts: DataFrame, key: str, text: str, markers: DataFrame, marker_key: str, marker: str) -> DataFrame:
    """All texts with a ``contaminated`` flag for a table of markers."""
    if many.fits(markers, marker):
        return many.flagged(texts, text, markers, marker)
    hits = containing(texts, key, text, markers, marker_key, marker).select(key).distinct()
    flagged = texts.join(hits.withColumn("_hit", F.lit(True)), key, "left")
    return flagged.withColumn("contaminated", F.coalesce("_hit", F.lit(False))).drop("_hit")


def audit(published: DataFrame) -> DataFrame:
    """Rows, correct, with conversation and contaminated, in one pass."""
    return published.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("correct").alias("correct"),
        F.count_if(F.col("conversation").isNotNull()).alias("with_conversation"),
        F.count_if("contaminated").alias("contaminated"),
    )
