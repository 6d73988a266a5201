"""Training conversations: heads, closing turn, alternation, packing.

Turns are rows ``(keys, pos, from, value)``. Structure is decided on the narrow
``(keys, pos, from)`` projection, so turn texts are shuffled once, and only
those of accepted conversations. The array functions serve records that
already hold their turns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybook import constants as K
from waybook.functions.calls import call_text
from waybook.functions.answers import with_thinking
from waybook.operators.ordered import SEGMENT, lookup, running


def trained(role: Column) -> Column:
    """Whether a turn is trained on; prompts and system turns are masked."""
    return role.isin(*K.RESPONSE_ROLES)


def function_call(name: Column, args: Column, thinking: Column) -> Column:
    return with_thinking(thinking, call_text(name, args))


# ---- records with a turn array -------------------------------------------------


def _spoken(turns: Column) -> Column:
    return F.filter(turns, lambda t: t["from"] != "system")


def close(turns: Column) -> Column:
    """Append an empty reply when the last spoken turn is a prompt."""
    last = F.try_element_at(_spoken(turns), F.lit(-1))["from"]
    empty = F.array(F.struct(F.lit("gpt").alias("from"), F.lit("").alias("value")))
    return F.when(F.coalesce(last.isin(*K.PROMPT_ROLES), F.lit(False)), F.concat(turns, empty)).otherwise(turns)


def is_alternating(turns: Column) -> Column:
    """Prompt, response, prompt, response, ... without the system turn, nothing left over."""
    right = F.transform(
        _spoken(turns),
        lambda t, i: F.when(i % 2 == 0, t["from"].isin(*K.PROMPT_ROLES)).otherwise(t["from"].isin(*K.RESPONSE_ROLES)),
    )
    return (F.size(right) % 2 == 0) & F.forall(right, lambda ok: ok)


def explode_turns(records: DataFrame, turns: str) -> DataFrame:
    """Records to turn rows, keeping the order as ``pos``."""
    rest = [c for c in records.columns if c != turns]
    return records.select(*rest, F.posexplode(turns).alias("pos", "_t")).select(*rest, "pos", "_t.*")


# ---- turn tables ---------------------------------------------------------------


def with_heads(turns: DataFrame, heads: DataFrame, keys: Sequence[str], system: Column, question: Column) -> DataFrame:
    """Put the system prompt (when there is one) and the question before the turns, at -2 and -1."""
    lead = F.array(
        F.struct(F.lit(-2).cast("bigint").alias("pos"), F.lit("system").alias("from"), F.coalesce(system, F.lit("")).alias("value")),
        F.struct(F.lit(-1).cast("bigint").alias("pos"), F.lit("human").alias("from"), F.coalesce(question, F.lit("")).alias("value")),
    )
    wanted = F.filter(lead, lambda t: (t["from"] != "system") | (t["value"] != ""))
    rows = heads.select(*keys, F.inline(wanted))
    return rows.unionByName(turns.select(*keys, F.col("pos").cast("bigint"), "from", "value"))


def structure(turns: DataFrame, keys: Sequence[str], width: int = SEGMENT) -> DataFrame:
    """Per conversation: spoken turns, first break of alternation, whether it ends on a prompt."""
    # Sides as numbers keep the aggregates in hash tables of fixed-width rows.
    prompt, response, other = 0, 1, 2
    side = F.when(F.col("from").isin(*K.PROMPT_ROLES), prompt).when(F.col("from").isin(*K.RESPONSE_ROLES), response).otherwise(other)
    spoken = turns.where(F.col("from") != "system").select(*keys, "pos", side.alias("_side"))
    seen = running(spoken, keys, "pos", lasts={"_prev": F.col("_side")}, width=width)
    follows = F.when(F.coalesce("_prev", F.lit(response)) == response, prompt).otherwise(response)
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("spoken"),
        F.count_if(F.col("_side") != follows).alias("breaks"),
        (F.max_by("_side", "pos") == prompt).alias("open_end"),
        F.max("pos").alias("last_pos"),
    )


def assemble(
    turns: DataFrame, keys: Sequence[str], min_turns: int = 0, width: int = SEGMENT
) -> tuple[DataFrame, DataFrame]:
    """Closed, valid conversations as turn rows, and a ``valid`` flag per conversation.

    ``min_turns`` counts spoken turns before the closing turn is added. A
    conversation that starts with a prompt and keeps alternating has an even
    number of turns once it is closed.
    """
    shape = structure(turns, keys, width).withColumn("valid", (F.col("breaks") == 0) & (F.col("spoken") >= min_turns))
    good = shape.where("valid")
    closing = good.where("open_end").select(
        *keys, (F.col("last_pos") + 1).alias("pos"), F.lit("gpt").alias("from"), F.lit("").alias("value")
    )
    kept = lookup(turns, good.select(*keys), keys, ["pos"], "left_semi")
    return kept.unionByName(closing), shape.select(*keys, "spoken", "open_end", "valid")


def pack(turns: DataFrame, keys: Sequence[str], tools: DataFrame | None = None) -> DataFrame:
    """Training records ``(keys, conversations, tools)``, one per conversation; the turn table is the form for huge ones."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "from", "value")))
    packed = turns.groupBy(*keys).agg(
        F.transform(ordered, lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations")
    )
    if tools is None:
        return packed.withColumn("tools", F.lit(""))
    return packed.join(tools, list(keys), "left").withColumn("tools", F.coalesce("tools", F.lit("")))


def used_tools(calls: DataFrame, keys: Sequence[str], tool: str, definitions: Mapping[str, str]) -> DataFrame:
    """JSON list of the definitions of the tools a conversation used, by name; unknown tools drop out.

    The collected set is bounded by the number of definitions.
    """
    table = F.create_map(*[F.lit(x) for pair in definitions.items() for x in pair])
    known = calls.where(F.col(tool).isin(*definitions))
    names = F.array_sort(F.collect_set(tool))
    listed = F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.element_at(table, n)), ", "), F.lit("]"))
    return known.groupBy(*keys).agg(listed.alias("tools"))


def all_tools(definitions: Mapping[str, str]) -> Column:
    return F.lit("[" + ", ".join(definitions.values()) + "]" if definitions else "")
