"""Filters over attempts, tool calls and search records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybook.functions.strings import contains_any
from waybook.operators.ordered import lookup


def native_training(df: DataFrame, min_calls: int = 1) -> DataFrame:
    """Successful attempts with enough tool calls; a missing count is 0."""
    return df.where((F.col("status") == "success") & (F.coalesce("num_tool_calls", F.lit(0)) >= min_calls))


def foreign_training(
    df: DataFrame, types: Sequence[str] | None = None, min_calls: int = 1, max_tokens: int = 16384
) -> DataFrame:
    """Wanted types, enough calls, short enough; a missing length is kept."""
    if types:
        df = df.where(F.col("type").isin(*types))
    return df.where(
        (F.coalesce("num_tool_calls", F.lit(0)) >= min_calls)
        & (F.coalesce("tokenized_length", F.lit(0)) <= max_tokens)
    )


def channel_training(df: DataFrame, turns: str = "num_turns", max_calls: int = 100, success_only: bool = True) -> DataFrame:
    """Attempts with a conversation and not too many calls, successful ones unless told otherwise."""
    kept = (F.col(turns) > 0) & (F.coalesce("num_tool_calls", F.lit(0)) <= max_calls)
    return df.where(kept & (F.col("status") == "success") if success_only else kept)


def not_blocked(df: DataFrame, url: str, blocked: Sequence[str]) -> DataFrame:
    """Rows whose URL holds none of the parts (case-sensitive); a missing URL holds none."""
    return df.where(~F.coalesce(contains_any(F.col(url), blocked), F.lit(False)))


def unblocked_records(df: DataFrame, blocked: Sequence[str], columns: Sequence[str] = ("title", "url", "summary")) -> DataFrame:
    """Rows whose joined text holds none of the phrases, any case; blank phrases do not count."""
    phrases = [b.strip().lower() for b in blocked if b and b.strip()]
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    return df.where(~contains_any(text, phrases))


def ranked_results(df: DataFrame, results: str) -> DataFrame:
    """One row per search result with its place in the answer; results without URL go, places stay."""
    rest = [c for c in df.columns if c != results]
    rows = df.select(*rest, F.posexplode(results).alias("_at", "_r"))
    return rows.where(F.coalesce(F.col("_r.url"), F.lit("")) != "").select(
        *rest, (F.col("_at") + 1).alias("rank"), "_r.*"
    )


def valid_tools(df: DataFrame, tool: str, valid: Sequence[str]) -> DataFrame:
    return df.where(F.col(tool).isin(*valid))


def map_names(name: Column, names: Mapping[str, str], drop_dotted: bool = False) -> Column:
    """Mapped name, else the name itself; optionally null for unmapped names with a dot."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    raw = F.when(~name.contains("."), name) if drop_dotted else name
    return F.coalesce(F.element_at(table, name), raw)


def correct_attempts(attempts: DataFrame, verdicts: DataFrame, on: Sequence[str] = ("qid", "traj_idx")) -> DataFrame:
    """Attempts judged correct themselves."""
    return attempts.join(verdicts.where("correct").select(*on).distinct(), list(on), "left_semi")


def correct_questions(attempts: DataFrame, verdicts: DataFrame, qid: str = "qid", spread: Sequence[str] = ("traj_idx",)) -> DataFrame:
    """All attempts of questions with at least one correct attempt."""
    return lookup(attempts, verdicts.where("correct").select(qid).distinct(), [qid], spread, "left_semi")
