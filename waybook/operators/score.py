"""Scores: per question, pass@k and avg@k, verdict lookup, tool usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybook.functions.strings import strip
from waybook.functions.verdicts import loose_match
from waybook.operators.ordered import last_per_key, lookup


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def per_question(judged: DataFrame, qid: Sequence[str] = ("qid",), correct: str = "correct") -> DataFrame:
    """``n, num_correct, accuracy, pass`` per question: one partial aggregate."""
    right = F.coalesce(F.col(correct), F.lit(False))
    return (
        judged.groupBy(*qid)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("num_correct"))
        .withColumns({"accuracy": F.col("num_correct") / F.col("n"), "pass": F.col("num_correct") > 0})
    )


def summary(questions: DataFrame) -> DataFrame:
    """One row: questions, trajectories, correct, pass@k, avg@k, trajectory accuracy; zero when empty."""
    n, right = F.sum("n"), F.sum("num_correct")
    return questions.agg(
        F.count(F.lit(1)).alias("num_questions"),
        F.coalesce(n, F.lit(0)).alias("total_trajectories"),
        F.coalesce(right, F.lit(0)).alias("correct_trajectories"),
        F.count_if("pass").alias("passed"),
        _ratio(F.count_if("pass"), F.count(F.lit(1))).alias("pass_at_k"),
        F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("avg_at_k"),
        _ratio(right, n).alias("trajectory_accuracy"),
    )


def metrics(one_row: DataFrame, k: int) -> DataFrame:
    """A summary row as ``(metric, value)`` rows with the attempt count in the names."""
    names = {"pass_at_k": f"pass@{k}", "avg_at_k": f"avg@{k}"}
    pairs = F.array(
        *[F.struct(F.lit(names.get(c, c)).alias("metric"), F.col(c).cast("double").alias("value")) for c in one_row.columns]
    )
    return one_row.select(F.inline(pairs))


def summary_json(long_metrics: DataFrame) -> DataFrame:
    """The metrics as one JSON object (a bounded number of named values)."""
    return long_metrics.agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))).alias("json")
    )


def answer_rows(judged: DataFrame, qid: str = "qid", order: str = "traj_idx", fields: Sequence[str] = ()) -> DataFrame:
    """One flat row per answer: the form for questions of any number of attempts."""
    return judged.select(qid, order, *fields)


def answers(judged: DataFrame, qid: str = "qid", order: str = "traj_idx", fields: Sequence[str] = ()) -> DataFrame:
    """One row per question with its answers in attempt order, as in a result file; see ``answer_rows`` for huge questions."""
    rows = answer_rows(judged, qid, order, fields)
    return rows.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("answers"))


def with_verdicts(
    attempts: DataFrame, verdicts: DataFrame, questions: DataFrame, qid: str = "qid", traj_idx: str = "traj_idx"
) -> DataFrame:
    """Verdict and question accuracy with defaults: not correct, no explanation, 0.0.

    Of several verdicts on an attempt a correct one counts, then the larger explanation.
    """
    _rank = F.struct("correct", "explanation")
    v = verdicts.groupBy(qid, traj_idx).agg(F.max_by("correct", _rank).alias("_c"), F.max_by("explanation", _rank).alias("_e"))
    q = questions.select(qid, F.col("accuracy").alias("_a"))
    joined = lookup(attempts.join(v, [qid, traj_idx], "left"), q, [qid], [traj_idx])
    return joined.select(
        *attempts.columns,
        F.coalesce("_c", F.lit(False)).alias("correct"),
        F.coalesce("_e", F.lit("")).alias("judge_explanation"),
        F.coalesce("_a", F.lit(0.0)).alias("question_accuracy"),
    )


def ground_truth(rows: DataFrame, order: str) -> DataFrame:
    """One answer per trimmed question; the last row of a question wins."""
    keyed = rows.withColumn("question_key", strip(F.col("question")))
    return last_per_key(keyed, ["question_key"], [order])


def match_ground_truth(records: DataFrame, truth: DataFrame, spread: Sequence[str], how: str = "inner") -> DataFrame:
    """Records with the answer to their trimmed question; ``left_anti`` lists the unmatched."""
    keyed = records.withColumn("question_key", strip(F.col("question")))
    answers_only = truth.select("question_key", F.col("answer").alias("correct_answer"))
    return lookup(keyed, answers_only, ["question_key"], spread, how).drop("question_key")


def counts(df: DataFrame, by: str, first_seen: str | None = None) -> DataFrame:
    """Rows per value with their share of all rows; ties are ordered by first appearance."""
    n = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), *([F.min(first_seen).alias("first_seen")] if first_seen else [])
    )
    total = n.agg(F.sum("n")).scalar()
    return n.withColumn("share", F.col("n") / total)


def most_common(counted: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """Largest first; a limit runs as a distributed top-n."""
    ties = "first_seen" if "first_seen" in counted.columns else by
    ranked = counted.orderBy(F.desc("n"), ties)
    return ranked.limit(n) if n else ranked


def share_label(n: Column, share: Column) -> Column:
    """Percentage text: one decimal below 1 % (unless nothing was counted), else none."""
    pct = share * 100
    return F.concat(F.when((pct < 1) & (n > 0), F.format_string("%.1f", pct)).otherwise(F.format_string("%.0f", F.bround(pct))), F.lit("%"))


def calls_per_result(calls: DataFrame, results: DataFrame, tool: str) -> DataFrame:
    """Calls of each tool divided by all evaluated results."""
    total = results.agg(F.count(F.lit(1))).scalar()
    return calls.groupBy(tool).agg(F.count(F.lit(1)).alias("calls")).withColumn(
        "per_result", F.try_divide(F.col("calls").cast("double"), total.cast("double"))
    )


def averages(df: DataFrame, *columns: str) -> DataFrame:
    """Means over all rows, missing values counting 0."""
    return df.agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"avg_{c}") for c in columns])


def loose_accuracy(
    attempts: DataFrame, qid: str, order: str, reference: str, prediction: str, spread: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Judged attempts and per-question scores by loose containment in the question's first reference."""
    refs = attempts.groupBy(qid).agg(F.min_by(F.coalesce(F.col(reference), F.lit("")), order).alias("_ref"))
    judged = lookup(attempts, refs, [qid], spread).withColumn("correct", loose_match(F.col("_ref"), F.col(prediction)))
    return judged.drop("_ref"), per_question(judged, [qid])
