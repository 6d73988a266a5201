"""Whole jobs: conversions to training conversations, evaluation, publishing, reports, work plans."""

from __future__ import annotations

import ast
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybook import constants as K
from waybook.functions import answers, payloads, verdicts
from waybook.functions import calls as wire
from waybook.functions.strings import strip
from waybook.operators import audit, context, conversation, plan, report, score, select
from waybook.operators.ordered import last_per_key, lookup
from waybook.sources import scratch, tables


@dataclass
class Conversion:
    """Accepted conversations as turn rows, and what became of every input record."""

    keys: list[str]
    turns: DataFrame
    outcomes: DataFrame
    tools: DataFrame | None
    every_tool: Column | None = None

    def records(self) -> DataFrame:
        """``id, conversations, tools``: the definitions of the tools used, or all of them where the format lists all."""
        packed = conversation.pack(self.turns, self.keys, self.tools)
        id_ = F.col("id") if self.keys == ["id"] else plan.record_id(F.col("qid"), F.col("traj_idx"))
        tools = F.col("tools") if self.every_tool is None else self.every_tool
        return packed.select(id_.alias("id"), "conversations", tools.alias("tools"))

    def accounting(self) -> DataFrame:
        """Loaded, filtered out, converted and skipped records, in one pass."""
        count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
        return self.outcomes.agg(F.count(F.lit(1)).alias("loaded"), count("filtered"), count("converted"), count("skipped"))

    def roles(self) -> DataFrame:
        return score.most_common(score.counts(self.turns, "from"), "from")

    def calls_per_conversation(self) -> DataFrame:
        calls = F.count_if(F.col("from") == "function_call").alias("calls")
        n = self.turns.groupBy(*self.keys).agg(calls)
        return n.agg(F.min("calls").alias("min_calls"), F.avg("calls").alias("avg_calls"), F.max("calls").alias("max_calls"))


def _convert(
    records: DataFrame, accepted: DataFrame, rows: DataFrame, keys: Sequence[str], system: Column, question: Column,
    min_turns: int, definitions: Mapping[str, str] | None = None, need_turns: bool = False, list_all: bool = False,
) -> Conversion:
    """Close, check and collect converted turns ``(keys, pos, from, value, tool)``; a null ``from`` drops a turn.

    The parsed turns are written once: the structure check then reads only
    keys and roles, the tool lists only tool names, the output the texts.
    """
    keys = list(keys)
    parsed = scratch.stage(rows, "turns")
    heads = accepted.join(parsed.select(*keys).distinct(), keys, "left_semi") if need_turns else accepted
    full = conversation.with_heads(parsed.where(F.col("from").isNotNull()), heads, keys, system, question)
    turns, shape = conversation.assemble(full, keys, min_turns)
    state = (
        records.select(*keys)
        .join(accepted.select(*keys, F.lit(True).alias("_accepted")), keys, "left")
        .join(shape.select(*keys, "valid"), keys, "left")
    )
    outcome = F.when(F.col("_accepted").isNull(), "filtered").when(F.col("valid"), "converted").otherwise("skipped")
    tools = None
    if definitions is not None and not list_all:
        tools = conversation.used_tools(parsed.where(F.col("tool").isNotNull()), keys, "tool", definitions)
    every = conversation.all_tools(definitions) if definitions is not None and list_all else None
    return Conversion(keys, turns, state.select(*keys, outcome.alias("outcome")), tools, every)


def _turns_of(turns: DataFrame, accepted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lookup(turns, accepted.select(*keys), list(keys), ["pos"], "left_semi")


# ---- conversions ---------------------------------------------------------------


def native_conversations(
    records: DataFrame, turns: DataFrame, definitions: Mapping[str, str], min_calls: int = 1
) -> Conversion:
    """Own trajectories: ``records`` is ``id, status, num_tool_calls, system_prompt, question``, ``turns`` is ``id, pos, role, content``."""
    accepted = select.native_training(records, min_calls)
    mine = _turns_of(turns, accepted, ["id"])
    assistant = F.col("role") == "assistant"
    parsed = mine.withColumn("_call", wire.tagged_call(F.when(assistant, F.col("content"))))
    called = F.col("_call").isNotNull()
    rows = parsed.select(
        "id", "pos",
        F.when(called, "function_call").when(assistant, "gpt").when(F.col("role") == "tool", "observation").alias("from"),
        F.when(called, conversation.function_call(F.col("_call.name"), F.col("_call.args"), F.col("_call.think")))
        .when(assistant, answers.cut_at_end_mark(F.col("content")))
        .otherwise(F.col("content")).alias("value"),
        F.col("_call.name").alias("tool"),
    )
    return _convert(
        records, accepted, rows, ["id"], F.col("system_prompt"), F.col("question"), 0, definitions, need_turns=True
    )


def _literal_parts(text: str) -> str | None:
    try:
        parts = ast.literal_eval(text)
        return " ".join(p.get("text", "") for p in parts if isinstance(p, dict))
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _literal_parts_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_literal_parts, na_action="ignore")


def foreign_conversations(
    records: DataFrame, messages: DataFrame, definitions: Mapping[str, str], system_prompt: str,
    types: Sequence[str] | None = None, min_calls: int = 1, max_tokens: int = 16384,
) -> Conversion:
    """Foreign function-call data.

    ``records`` is ``id, question, type, num_tool_calls, tokenized_length``;
    ``messages`` is ``id, pos, role, content`` (VARIANT) ``, function_calls``.
    """
    accepted = select.foreign_training(records, types, min_calls, max_tokens)
    mine = _turns_of(messages, accepted, ["id"]).withColumn("_text", F.coalesce(F.col("content").cast("string"), F.lit("")))

    user = mine.where("role = 'user'").groupBy("id").agg(F.min_by("content", "pos").alias("content"))
    asked = payloads.content_text(F.col("content"), " ", typed=False)
    user = user.select("id", asked.alias("_asked"))
    spelled = _literal_parts_udf(F.when(F.col("_asked").startswith("[{"), F.col("_asked")))
    user = user.select("id", F.coalesce(spelled, "_asked").alias("_user"))
    heads = accepted.join(user, "id", "left").withColumn("_question", F.coalesce(F.nullif("_user", F.lit("")), "question"))

    spoken = mine.where(F.col("role").isin("assistant", "environment"))
    assistant = F.col("role") == "assistant"
    has_call = assistant & (strip(F.coalesce("function_calls", F.lit(""))) != "")
    parsed = spoken.withColumn("_call", wire.keyword_call(F.when(has_call, F.col("function_calls"))))
    parsed = parsed.withColumn("_tool", wire.renamed(F.col("_call.name"), K.FOREIGN_TOOL_NAMES))
    filled = context.forward_fill(parsed, ["id"], "pos", F.col("_tool"), "_last_tool")
    filled = filled.withColumn("_env", payloads.environment_text(F.when(~assistant, F.col("_text"))))
    call_value = conversation.function_call(
        F.col("_tool"), wire.foreign_args(F.col("_tool"), F.col("_call.args")), answers.thinking(F.col("_text"))
    )
    rows = filled.select(
        "id", "pos",
        F.when(has_call & F.col("_call").isNotNull(), "function_call").when(assistant & ~has_call, "gpt").when(~assistant, "observation").alias("from"),
        F.when(has_call, call_value).when(assistant, answers.unwrap_answer(strip(F.col("_text"))))
        .otherwise(payloads.response_text(F.coalesce("_last_tool", F.lit("")), F.col("_env"))).alias("value"),
        F.col("_tool").alias("tool"),
    )
    return _convert(records, heads, rows, ["id"], F.lit(system_prompt), F.col("_question"), 2, definitions)


def channel_conversations(
    records: DataFrame, turns: DataFrame, system_prompt: str, max_calls: int = 100, verdict_rows: DataFrame | None = None,
    definitions: Mapping[str, str] | None = None,
) -> Conversion:
    """Channel-format trajectories keyed ``qid, traj_idx``; with verdicts, only correct attempts. Records list all definitions.

    ``turns`` is ``qid, traj_idx, pos, role, content, tool, args`` (JSON) ``, final_answer``.
    """
    keys = ["qid", "traj_idx"]
    sized = records if verdict_rows is None else select.correct_attempts(records, verdict_rows, keys)
    accepted = select.channel_training(sized, "num_turns", max_calls)
    mine = _turns_of(turns, accepted, keys)
    assistant = F.col("role") == "assistant"
    called = assistant & (F.coalesce("tool", F.lit("")) != "")
    name = select.map_names(F.col("tool"), K.CHANNEL_TOOL_NAMES, drop_dotted=True)
    content = F.coalesce("content", F.lit(""))
    args = wire.cleaned_args(name, F.coalesce(wire.object_args(F.col("args")), wire.no_args()))
    rows = mine.select(
        *keys, "pos",
        F.when(called, F.when(name.isNotNull(), "function_call")).when(assistant, "gpt").when(F.col("role") == "tool", "observation").alias("from"),
        F.when(called, conversation.function_call(name, args, answers.channel_thinking(content)))
        .when(assistant, answers.channel_reply(content, F.col("final_answer")))
        .otherwise(content).alias("value"),
    )
    return _convert(records, accepted, rows, keys, F.lit(system_prompt), F.col("question"), 2, definitions, list_all=True)


def selfplay_conversations(
    records: DataFrame, turns: DataFrame, verdict_rows: DataFrame, system_prompt: str, max_calls: int = 80,
    definitions: Mapping[str, str] | None = None,
) -> Conversion:
    """Tagged-format trajectories of questions with a correct attempt, keyed ``qid, traj_idx``. Records list all definitions."""
    keys = ["qid", "traj_idx"]
    passed = select.correct_questions(records, verdict_rows, "qid", ["traj_idx"])
    accepted = select.channel_training(passed, "num_turns", max_calls, success_only=False)
    mine = _turns_of(turns, accepted, keys)
    assistant = F.col("role") == "assistant"
    content = F.coalesce("content", F.lit(""))
    tagged = assistant & content.contains("<tool_call>")
    parsed = mine.withColumn("_call", wire.tagged_call(F.when(tagged, content)))
    rows = parsed.select(
        *keys, "pos",
        F.when(tagged, F.when(F.col("_call").isNotNull(), "function_call")).when(assistant, "gpt").when(F.col("role") == "tool", "observation").alias("from"),
        F.when(tagged, conversation.function_call(F.col("_call.name"), F.col("_call.args"), answers.thinking(content, missing_open=True)))
        .when(assistant, answers.with_opening_think(content))
        .otherwise(content).alias("value"),
    )
    return _convert(records, accepted, rows, keys, F.lit(system_prompt), F.col("question"), 2, definitions, list_all=True)


# ---- evaluation ----------------------------------------------------------------


def evaluate(log: DataFrame, order: Sequence[str], verdict: Column | None = None, k: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Judged attempts, per-question scores and metrics of a trajectory log.

    The last record of an attempt counts. ``verdict`` is a
    ``struct(correct, explanation)`` column; without one the offline rule judges.
    """
    attempts = last_per_key(log, ["qid", "traj_idx"], order)
    rule = verdicts.offline(F.col("status"), F.col("reference_answer"), F.col("boxed_answer"), F.col("answer")) if verdict is None else verdict
    judged = attempts.withColumn("_v", rule).select("*", "_v.*").drop("_v")
    questions = score.per_question(judged)
    one = score.summary(questions)
    extra = judged.agg(
        F.avg(F.coalesce("num_tool_calls", F.lit(0))).alias("avg_tool_calls"), F.avg(F.coalesce("latency_s", F.lit(0.0))).alias("avg_latency_s")
    )
    metrics = score.metrics(one, k).unionByName(score.metrics(extra, k))
    return judged, questions, metrics


def ground_truth_report(records: DataFrame, truth: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graded records against ground truth: CSV rows, summary, calls per result.

    ``records`` is ``query_id, question, response, is_completed, judge_reply``
    with unique ids; incomplete or empty responses are not graded.
    """
    unique = plan.require_unique(records, ["query_id"])
    matched = score.match_ground_truth(unique, truth, ["query_id"])
    graded = F.col("is_completed") & (F.coalesce("response", F.lit("")) != "")
    reply = verdicts.grader_reply(F.when(graded, F.col("judge_reply")))
    results = matched.withColumn("_v", reply).select("*", "_v.*").drop("_v")
    counted = calls.join(results.select("query_id"), "query_id", "left_semi")
    return tables.judge_csv(results), report.grader_summary(results), score.calls_per_result(counted, results, "tool")


def publish(
    attempts: DataFrame, judged: DataFrame, questions: DataFrame, turns: DataFrame, markers: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """The published table and its audit counts; contamination is decided on the turn table."""
    flags = audit.contaminated_keys(turns, ["qid", "traj_idx"], markers)
    rows = score.with_verdicts(attempts, judged, questions).join(flags, ["qid", "traj_idx"], "left")
    out = tables.published(rows.withColumn("contaminated", F.coalesce("contaminated", F.lit(False))))
    return out, audit.audit(out)


def accuracy_estimate(attempts: DataFrame) -> DataFrame:
    """One row of scores by loose containment of the reference, before any judge has run; the boxed answer counts, else the answer."""
    answer = F.coalesce(F.nullif("boxed_answer", F.lit("")), "answer", F.lit(""))
    told = attempts.withColumn("_answer", answer)
    return score.summary(score.loose_accuracy(told, "qid", "traj_idx", "reference_answer", "_answer", ["traj_idx"])[1])


def progress_report(attempts: DataFrame, calls: DataFrame, target: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Progress row, status histogram and the six most used tools; ``accuracy_estimate`` completes the report."""
    return (
        report.progress(attempts, target),
        report.status_counts(attempts),
        score.most_common(score.counts(calls, "tool", "seq"), "tool", 6),
    )


def load_report(requests: DataFrame, seconds: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Latency percentiles with extremes, throughput, error groups."""
    points, spread = report.latency(requests)
    named = points.select(F.format_string("p%.0f", F.col("p") * 100).alias("metric"), "value")
    extremes = spread.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("min", "max", "avg")])))
    return named.unionByName(extremes), report.throughput(requests, seconds), report.error_groups(requests.where(~F.col("success")))


def cache_report(samples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Averaged rounds, cold against warm, warm rounds against the first."""
    averaged = report.rounds(samples, ["label"])
    return averaged, report.cold_warm(averaged, ["label"]), report.round_speedups(averaged, ["label"])


def work_plan(
    questions: DataFrame, done: DataFrame, attempts: int, order: str, rank: int = 0, world: int = 1, first: int = 0
) -> DataFrame:
    """This shard's outstanding attempts: first N questions, every ``world``-th of them, minus what is done."""
    mine = plan.shard(plan.head(questions, order, first), order, rank, world) if world > 1 else plan.head(questions, order, first)
    return plan.pending(plan.expand(mine, attempts), done, ["qid", "traj_idx"]).withColumn(
        "request_qid", plan.request_id(F.col("qid"), F.when(F.lit(attempts) > 1, F.col("traj_idx")))
    )
