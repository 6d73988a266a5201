"""Dataset card: aggregates stay on Spark, only the small results are laid out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybook import constants as K
from waybook.operators import score, select

#: What the published columns hold.
COLUMNS = {
    "qid": "Id of the question", "traj_idx": "Number of the attempt", "question": "The question", "reference_answer": "The right answer",
    "boxed_answer": "The answer the model boxed", "correct": "The judge's verdict", "judge_explanation": "The judge's reasons",
    "question_accuracy": "Part of the question's attempts that are correct (0 hardest, 1 easiest)", "num_tool_calls": "Number of tool calls",
    "tool_calls": "The tool calls (JSON)", "conversation": "All turns (JSON)", "contaminated": "Whether a tool result held a page of the benchmark",
    "latency_s": "Seconds the attempt took",
}


def _table(head: Sequence[str], align: str, rows: Sequence[Column]) -> list[Column]:
    return [F.lit("| " + " | ".join(head) + " |"), F.lit(align), *rows]


def _row(*cells: Column | str) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.lit(c) if isinstance(c, str) else c for c in cells]), F.lit(" |"))


def _percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def card(
    summary: DataFrame, calls: DataFrame, audit: DataFrame, title: str, k: int = 4, about: str = "", tags: Sequence[str] = (),
    setup: Mapping[str, str] | None = None, columns: Mapping[str, str] = COLUMNS,
) -> DataFrame:
    """One row with the card text: results, setup, tool usage, contamination note and columns.

    ``summary`` and ``audit`` are the one-row results of the operators of that
    name, ``calls`` has one row per call. The only collected list is bounded by the valid tools.
    """
    used = score.counts(select.valid_tools(calls, "tool", K.VALID_TOOLS), "tool")
    tool_line = _row(F.concat(F.lit("`"), F.col("tool"), F.lit("`")), F.format_number("n", 0), score.share_label(F.col("n"), F.col("share")))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "tool", tool_line.alias("line"))))
    tools = used.agg(F.transform(listed, lambda r: r["line"]).alias("lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    one = audit.withColumns(
        {"s": summary.select(F.struct("*")).scalar(), "tools": tools.select("lines").scalar(), "total": tools.select("total").scalar()}
    )
    n, text = F.col("s.total_trajectories"), lambda c: c.cast("string")
    each = F.coalesce(F.try_divide(F.col("total").cast("double"), n.cast("double")), F.lit(0.0))
    lines = [F.lit(x) for x in (["---", "tags:", *[f"- {t}" for t in tags], "---", ""] if tags else [])]
    lines += [F.lit(f"# {title}"), F.lit(""), *([F.lit(about), F.lit("")] if about else []), F.lit("## Results"), F.lit("")]
    lines += _table(["Metric", "Value"], "|---|---|", [
        _row(f"**pass@{k}**", F.concat(F.lit("**"), _percent(F.col("s.pass_at_k")), F.lit("**"))),
        _row(f"**avg@{k}**", F.concat(F.lit("**"), _percent(F.col("s.avg_at_k")), F.lit("**"))),
        _row("Trajectory accuracy", F.concat(_percent(F.col("s.trajectory_accuracy")), F.lit(" ("), text(F.col("s.correct_trajectories")), F.lit("/"), text(n), F.lit(")"))),
        _row("Questions", text(F.col("s.num_questions"))),
        _row("Trajectories", F.concat(text(n), F.lit(f" ({k} per question)"))),
        _row("Avg tool calls", F.format_string("%.1f", each)),
        _row("Full conversations", F.when(F.col("with_conversation") > 0, "yes").otherwise("no")),
    ])
    if setup:
        lines += [F.lit(""), F.lit("## Setup"), F.lit(""), *_table(["", ""], "|---|---|", [_row(f"**{a}**", b) for a, b in setup.items()])]
    lines += [F.lit(""), F.lit("## Tool usage"), F.lit(""), *_table(["Tool", "Calls", "%"], "|---|--:|--:|", [])]
    after = [F.concat(F.lit("**Total: "), F.format_number("total", 0), F.lit(" tool calls** ("), F.format_string("%.1f", each), F.lit(" per trajectory)"))]
    note = F.concat(F.lit("**Contamination**: "), text(F.col("contaminated")), F.lit("/"), text(F.col("rows")), F.lit(" trajectories flagged."))
    flagged = F.when(F.col("contaminated") > 0, F.array(F.lit(""), note)).otherwise(F.array().cast("array<string>"))
    last = [F.lit(""), F.lit("## Columns"), F.lit(""), *_table(["Column", "Description"], "|---|---|", [_row(f"`{c}`", d) for c, d in columns.items()])]
    return one.select(F.array_join(F.concat(F.array(*lines), F.col("tools"), F.array(*after), flagged, F.array(*last)), "\n").alias("card"))
