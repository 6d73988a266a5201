"""What a model saw: kept tool results, repeats, prompt growth, budgets, streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybook import constants as K
from waybook.functions.strings import json_text, let
from waybook.operators.ordered import SEGMENT, running, segmented


def keep_last(
    turns: DataFrame, keys: Sequence[str], order: str, is_result: Column, keep: int, content: str = "content",
    placeholder: str = K.OMITTED_RESULT, width: int = SEGMENT,
) -> DataFrame:
    """All but the last ``keep`` tool results replaced; -1 keeps all, 0 none."""
    if keep == -1:
        return turns
    later = running(turns.withColumn("_is", is_result), keys, order, sums={"_later": F.col("_is").cast("int")}, ahead=True, width=width)
    omit = F.col("_is") & (F.col("_later") >= keep)
    return later.withColumn(content, F.when(omit, F.lit(placeholder)).otherwise(F.col(content))).select(*turns.columns)


def repeated(
    calls: DataFrame, keys: Sequence[str], order: str, key: Column, ok: Column, name: str = "repeated", width: int = SEGMENT
) -> DataFrame:
    """Whether an earlier call of the trajectory with the same key went through; no key, no repeat."""
    keyed = calls.withColumns({"_key": F.coalesce(key, F.lit("")), "_has": key.isNotNull(), "_ok": ok})
    out = running(keyed, [*keys, "_key"], order, sums={"_before": F.col("_ok").cast("int")}, width=width)
    return out.withColumn(name, F.col("_has") & (F.col("_before") > 0)).select(*calls.columns, name)


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, width: int = SEGMENT
) -> DataFrame:
    """The latest earlier non-null value."""
    return running(df, keys, order, lasts={name: value}, width=width)


def growth(rounds: DataFrame, keys: Sequence[str], order: str, tokens: str, width: int = SEGMENT) -> DataFrame:
    """New tokens of each round: its prompt tokens minus the previous round's."""
    out = running(rounds, keys, order, lasts={"_prev": F.col(tokens)}, width=width)
    return out.withColumn("new_tokens", F.col(tokens) - F.coalesce("_prev", F.lit(0))).drop("_prev")


def prompt_sizes(turns: DataFrame, keys: Sequence[str], order: str, rendered: Column, width: int = SEGMENT) -> DataFrame:
    """Length of the prompt up to and with each turn, from lengths alone."""
    size = F.length(rendered)
    out = running(turns.withColumn("_size", size), keys, order, sums={"_before": F.col("_size")}, width=width)
    return out.withColumn("prompt_chars", F.col("_before") + F.col("_size")).drop("_before", "_size")


def prompts(turns: DataFrame, keys: Sequence[str], order: str, rendered: Column, upto: Column | None = None) -> DataFrame:
    """The whole prompt text up to a turn, one row per conversation; it has to fit a model's context, and so a row."""
    rows = turns if upto is None else turns.where(F.col(order) <= upto)
    text = F.struct(order, rendered.alias("text"))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda t: t["text"]), "").alias("prompt")
    )


def ascii_json(c: Column) -> Column:
    """A JSON string with everything beyond ASCII escaped."""
    escape = lambda ch: F.regexp_replace(
        F.lower(F.hex(F.encode(ch, "UTF-16BE"))), r"(.{4})", r"\\u$1"
    )
    return let(
        json_text(c),
        lambda j: F.when(
            F.regexp_like(j, F.lit(r"[^\x00-\x7f]")),
            F.array_join(
                F.transform(F.split(j, ""), lambda ch: F.when(F.regexp_like(ch, F.lit(r"[^\x00-\x7f]")), escape(ch)).otherwise(ch)), ""
            ),
        ).otherwise(j),
    )


def channel_round(output: Column, namespace: Column, tool: Column, response: Column) -> Column:
    """Text a tool round adds to a channel-format prompt."""
    code = namespace == "python"
    caller = F.when(code, F.lit("python")).otherwise(F.concat(namespace, F.lit("."), tool))
    return F.concat(
        output, F.lit("<|call|><|start|>"), caller, F.lit(" to=assistant<|channel|>commentary<|message|>"),
        F.when(code, response).otherwise(ascii_json(response)), F.lit("<|end|><|start|>assistant"),
    )


def tagged_round(output: Column, response: Column, thinking: bool = True) -> Column:
    """Text a tool round adds to a tagged-format prompt."""
    lead = "<think>\n" if thinking else "<think>\n\n</think>\n\n"
    return F.concat(
        output, F.lit("</tool_call><|im_end|>\n<|im_start|>user\n<tool_response>\n"), response,
        F.lit(f"\n</tool_response><|im_end|>\n<|im_start|>assistant\n{lead}"),
    )


def channel_user_turn(answer: Column, message: Column) -> Column:
    return F.concat(answer, F.lit("<|end|><|start|>user<|message|>"), message, F.lit("<|end|><|start|>assistant"))


def tagged_user_turn(answer: Column, message: Column, thinking: bool = True) -> Column:
    lead = "<think>\n" if thinking else "<think>\n\n</think>\n\n"
    return F.concat(
        answer, F.lit("<|im_end|>\n<|im_start|>user\n"), message, F.lit(f"<|im_end|>\n<|im_start|>assistant\n{lead}")
    )


def budget(prompt: Column, wanted: int, limit: int) -> Column:
    """``struct(tokens, forced, overflow)``: tokens a round may generate in the rest of the context."""
    rest = F.lit(limit) - prompt - 256
    last = F.least(F.lit(2048), F.lit(limit) - prompt - 64)
    tight = (prompt + wanted) > limit
    forced = tight & (rest < 256)
    return F.struct(
        F.when(~tight, F.lit(wanted)).when(~forced, rest).otherwise(last).cast("bigint").alias("tokens"),
        forced.alias("forced"),
        (forced & (last <= 0)).alias("overflow"),
    )


def summary_fits(
    prompt: Column, completion: Column, last_user: Column, summary: Column, max_tokens: int, limit: int
) -> Column:
    """Whether a closing summary still fits: 1.5 times the estimated texts, plus 1000."""
    padded = lambda c: F.floor(c * 1.5)
    estimate = prompt + completion + padded(last_user) + padded(summary) + max_tokens + 1000
    return estimate < limit


def number_calls(calls: DataFrame, keys: Sequence[str], order: str, limit: int, width: int = SEGMENT) -> DataFrame:
    """Round number of each call and whether the limit is reached with it."""
    out = running(calls, keys, order, sums={"_before": F.lit(1)}, width=width)
    return out.withColumn("round", F.col("_before") + 1).withColumn("at_limit", F.col("round") >= limit).drop("_before")


def bad_steps(
    steps: DataFrame, keys: Sequence[str], order: str, fault: Column, max_rollbacks: int = K.MAX_ROLLBACKS, width: int = SEGMENT
) -> DataFrame:
    """What happened to each logged step: kept, rolled_back, error_row, end or after_end.

    ``fault`` is null for a good step, ``'repeat'`` for a repeated query, any
    other text for a bad reply. Faults share one counter that a good step
    resets: all below the maximum are rolled back, the one that reaches it
    ends the run, or, for a repeat, becomes an error row and starts anew.
    """
    marked = segmented(steps.withColumns({"_fault": fault, "_bad": fault.isNotNull().cast("int")}), keys, order, width)
    seen = running(marked, keys, order, sums={"_before": F.col("_bad")}, width=width)
    good = F.when(F.col("_bad") == 0, F.col("_before"))
    streak = running(seen, keys, order, lasts={"_base": good}, width=width).withColumn(
        "streak", F.when(F.col("_bad") == 1, F.col("_before") + 1 - F.coalesce("_base", F.lit(0))).otherwise(0)
    )
    full = (F.col("_bad") == 1) & (F.pmod("streak", F.lit(max_rollbacks)) == 0)
    action = (
        F.when(F.col("_bad") == 0, "kept").when(~full, "rolled_back").when(F.col("_fault") == "repeat", "error_row").otherwise("end")
    )
    acted = streak.withColumn("action", action)
    ended = running(acted, keys, order, sums={"_ended": (F.col("action") == "end").cast("int")}, width=width)
    return ended.withColumn("action", F.when(F.col("_ended") > 0, "after_end").otherwise(F.col("action"))).select(
        *steps.columns, "streak", "action"
    )


def fallback_answers(steps: DataFrame, keys: Sequence[str], order: str, boxed: str, final: Column) -> DataFrame:
    """The final boxed answer, else the last non-empty intermediate one, per trajectory."""
    filled = F.nullif(F.col(boxed), F.lit(""))
    latest = lambda cond: F.max_by(filled, F.when(cond & filled.isNotNull(), F.col(order)))
    return steps.groupBy(*keys).agg(F.coalesce(latest(final), latest(~final), F.lit("")).alias("boxed_answer"))


def final_response(messages: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Content of the last assistant message on the final channel, else of the last one, else ''."""
    assistant = F.col("role") == "assistant"
    final = assistant & F.coalesce(F.col("channel") == "final", F.lit(False))
    content = F.struct(F.coalesce("content", F.lit("")).alias("text"))
    latest = lambda cond: F.max_by(content, F.when(cond, F.col(order)))["text"]
    return messages.groupBy(*keys).agg(
        F.coalesce(latest(final), latest(assistant), F.lit("")).alias("response"),
        F.coalesce(F.bool_or(final), F.lit(False)).alias("has_final"),
    )


def resolve_links(
    calls: DataFrame, results: DataFrame, keys: Sequence[str], order: str, width: int = SEGMENT
) -> DataFrame:
    """URLs of ``open`` calls by result id.

    ``calls`` has ``op, cursor, id`` and ``new_cursor`` (the cursor a search
    or open got, null when it failed); ``results`` has ``cursor, id, url``.
    ``id`` is JSON text: ``3`` is a number, ``"3"`` a string. A call without a
    cursor (null, 0, -1) uses the latest cursor made before it. It resolves
    when that cursor is a search holding the id as a number; an id that is a
    URL string is its own target, any other string never matches.
    """
    made = running(calls, keys, order, lasts={"_latest": F.col("new_cursor")}, width=width)
    given = F.when(~F.coalesce("cursor", F.lit(0)).isin(0, -1), F.col("cursor"))
    url_id = F.col("id").startswith('"http')
    real = F.col("id").try_cast("double")
    whole = F.when(real == F.floor(real), real.try_cast("bigint"))  # 2.0 is 2
    opens = made.where((F.col("op") == "open") & F.col("id").isNotNull() & ~F.col("id").isin("-1", "null")).withColumns(
        {
            "used_cursor": F.when(~url_id, F.coalesce(given, "_latest")),
            "_number": F.when(~F.col("id").startswith('"'), F.coalesce(F.col("id").try_cast("bigint"), whole)),
        }
    )
    hits = results.select(*keys, F.col("cursor").alias("used_cursor"), F.col("id").alias("_number"), "url")
    # only numbered opens are joined; the others would all meet under the null key
    numbered = F.col("_number").isNotNull() & F.col("used_cursor").isNotNull()
    found = opens.where(numbered).join(hits, [*keys, "used_cursor", "_number"], "left").select(*keys, order, "id", "used_cursor", "url")
    target = F.when(url_id, F.try_parse_json("id").cast("string"))
    others = opens.where(~numbered).select(*keys, order, "id", "used_cursor", target.alias("url"))
    return found.union(others).withColumn("not_found", F.col("url").isNull())
