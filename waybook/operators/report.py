"""Run reports: progress, code runs, grader summary, load and cache measurements, fleet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybook import constants as K
from waybook.functions.strings import strip
from waybook.operators.ordered import index_percentiles, last_per_key, running, segmented

PARALLEL_RUNS = 32


def progress(attempts: DataFrame, target: int = 0) -> DataFrame:
    """One row: rows, questions, attempts, progress, times, boxed and error counts, minutes left."""
    latency = F.coalesce(F.col("latency_s").cast("double"), F.lit(0.0))
    timed = F.when(latency > 0, latency)
    goal = F.lit(target) if target > 0 else F.col("n")
    one = attempts.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("qid").alias("questions"),
        (F.coalesce(F.max(F.coalesce("traj_idx", F.lit(0))), F.lit(-1)) + 1).alias("attempts"),
        F.coalesce(F.avg(timed), F.lit(0.0)).alias("avg_s"),
        (F.coalesce(F.sum(timed), F.lit(0.0)) / 3600).alias("total_h"),
        F.count_if(F.coalesce("boxed_answer", F.lit("")) != "").alias("boxed"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
    return (
        one.withColumn("target", goal.cast("bigint"))
        .withColumn("target_questions", F.when(F.col("target") > F.col("n"), F.floor(F.col("target") / F.greatest("attempts", F.lit(1)))).otherwise(F.col("questions")))
        .withColumn("done_pct", F.col("n") * 100.0 / F.greatest("target", F.lit(1)))
        .withColumn("boxed_pct", F.col("boxed") * 100.0 / F.greatest("n", F.lit(1)))
        .withColumn(
            "eta_min",
            F.when((F.col("n") > 0) & (F.col("avg_s") > 0), (F.col("target") - F.col("n")) * F.col("avg_s") / PARALLEL_RUNS / 60),
        )
    )


def status_counts(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy(F.coalesce("status", F.lit("?")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def run_counts(attempts: DataFrame) -> DataFrame:
    return attempts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.coalesce(F.col("status") != "success", F.lit(True))).alias("errors"),
    )


def code_stats(attempts: DataFrame, stats: str = "python_stats") -> DataFrame:
    """Sums of the code-run counters; percentages only when anything ran."""
    fields = ["total", "success", "error", "timeout", "no_output"]
    sums = attempts.agg(*[F.coalesce(F.sum(F.col(f"{stats}.{f}")), F.lit(0)).alias(f) for f in fields])
    pct = lambda f: F.when(F.col("total") > 0, F.col(f) * 100.0 / F.greatest("total", F.lit(1))).alias(f"{f}_pct")
    return sums.select(*fields, pct("success"), pct("error"), pct("no_output"))


def grader_summary(results: DataFrame, correct: str = "correct") -> DataFrame:
    """Results, correct (no verdict is incorrect) and accuracy in percent."""
    right = F.count_if(F.coalesce(F.col(correct), F.lit(False)))
    n = F.count(F.lit(1))
    return results.agg(
        n.alias("num_results"),
        right.alias("num_correct"),
        F.coalesce(F.try_divide(right * 100.0, n.cast("double")), F.lit(0.0)).alias("accuracy_percent"),
    )


def any_reference(questions: DataFrame, reference: str = "reference_answer") -> DataFrame:
    """Whether any question has a non-blank reference; without one, judging is skipped."""
    return questions.agg(F.coalesce(F.bool_or(strip(F.coalesce(F.col(reference), F.lit(""))) != ""), F.lit(False)).alias("has_references"))


def latency(requests: DataFrame, points: Sequence[float] = (0.5, 0.9, 0.99), by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Element percentiles and min, max, mean of the successful requests."""
    good = requests.where("success")
    spread = good.groupBy(*by).agg(F.min("latency").alias("min"), F.max("latency").alias("max"), F.avg("latency").alias("avg"))
    return index_percentiles(good, "latency", points, by), spread


def throughput(requests: DataFrame, seconds: Column) -> DataFrame:
    """Requests of all kinds and tokens of successful ones per second of the run."""
    one = requests.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("success").alias("successful"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("tokens_generated"))), F.lit(0)).alias("tokens"),
        seconds.cast("double").alias("seconds"),
    )
    rate = lambda c: F.try_divide(F.col(c).cast("double"), F.col("seconds"))
    return one.select("*", rate("requests").alias("requests_per_s"), rate("tokens").alias("tokens_per_s"))


def error_groups(requests: DataFrame, error: str = "error") -> DataFrame:
    """Failed requests by the first 100 characters of their error."""
    message = F.coalesce(F.nullif(F.col(error), F.lit("")), F.lit("unknown"))
    return requests.groupBy(F.left(message, F.lit(100)).alias("error_key")).agg(F.count(F.lit(1)).alias("n"))


def rounds(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Repeats averaged per round: token counts of the first repeat, whole completion tokens."""
    return samples.groupBy(*by, "round_num").agg(
        F.min_by("prompt_tokens", "rep").alias("prompt_tokens"),
        F.min_by("new_tokens", "rep").alias("new_tokens"),
        F.floor(F.avg("completion_tokens")).alias("completion_tokens"),
        F.avg("ttft_ms").alias("ttft_ms"),
        F.avg("total_time_s").alias("total_time_s"),
        F.avg("tokens_per_sec").alias("tokens_per_sec"),
    )


def cold_warm(averaged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First round against the mean of the later ones; effective when warm is under 0.8 of cold."""
    warm = lambda c: F.avg(F.when(F.col("round_num") > 1, F.col(c)))
    one = averaged.groupBy(*by).agg(
        F.max(F.when(F.col("round_num") == 1, F.col("ttft_ms"))).alias("cold_ms"),
        warm("ttft_ms").alias("warm_ms"),
        warm("prompt_tokens").alias("warm_prompt"),
        warm("new_tokens").alias("warm_new"),
    )
    return one.withColumns(
        {
            "new_ratio": F.when(F.col("warm_prompt") > 0, F.col("warm_new") / F.col("warm_prompt")),
            "effective": F.col("warm_ms") < F.col("cold_ms") * 0.8,
        }
    )


def round_speedups(averaged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Time to first token of each warm round against the first, and per token."""
    first = averaged.where("round_num = 1").select(*by, F.col("ttft_ms").alias("_cold"))
    warm = averaged.where("round_num > 1")
    joined = warm.join(first, list(by)) if by else warm.withColumn("_cold", first.select("_cold").scalar())
    per = lambda c: F.when(F.col(c) > 0, F.col("ttft_ms") / F.greatest(c, F.lit(1))).otherwise(0.0)
    return joined.select(
        *by, "round_num", (F.col("_cold") / F.greatest("ttft_ms", F.lit(0.001))).alias("speedup"),
        (F.col("ttft_ms") / F.greatest("prompt_tokens", F.lit(1))).alias("ms_per_prompt_token"),
        per("new_tokens").alias("ms_per_new_token"),
    )


def ab(on: DataFrame, off: DataFrame) -> DataFrame:
    """Two averaged runs side by side; speed-up is off over on."""
    pair = on.select("round_num", F.col("ttft_ms").alias("on_ms")).join(
        off.select("round_num", F.col("ttft_ms").alias("off_ms")), "round_num"
    )
    return pair.withColumn("speedup", F.col("off_ms") / F.greatest("on_ms", F.lit(0.001)))


def ab_overall(on: DataFrame, off: DataFrame) -> DataFrame:
    """Mean warm time of both runs and their ratio."""
    warm = lambda c: F.coalesce(F.avg(F.when(F.col("round_num") > 1, F.col(c))), F.lit(0.0))
    one = ab(on, off).agg(warm("on_ms").alias("on_ms"), warm("off_ms").alias("off_ms"))
    return one.withColumn("speedup", F.col("off_ms") / F.greatest("on_ms", F.lit(0.001)))


def first_chunk(chunks: DataFrame, keys: Sequence[str], ts: str, text: str) -> DataFrame:
    """Milliseconds to the first non-empty chunk of each request; the whole time when there is none."""
    filled = F.when(F.coalesce(F.col(text), F.lit("")) != "", F.col(ts))
    micros = lambda c: F.unix_micros(c)
    one = chunks.groupBy(*keys).agg(F.min(ts).alias("_start"), F.max(ts).alias("_end"), F.min(filled).alias("_first"))
    return one.select(
        *keys,
        ((micros(F.coalesce("_first", "_end")) - micros(F.col("_start"))) / 1000.0).alias("ttft_ms"),
        ((micros(F.col("_end")) - micros(F.col("_start"))) / 1e6).alias("total_time_s"),
    )


# ---- fleet ---------------------------------------------------------------------


def gauges(lines: DataFrame) -> DataFrame:
    """Latest gauge values per worker from text metrics: line prefix, last word, cache usage in percent."""
    value = F.element_at(F.split(F.rtrim("line"), r"\s+"), -1).try_cast("double")
    latest = lambda prefix: F.max_by(value, F.when(F.col("line").startswith(prefix), F.col("line_no")))
    wanted = lines.where(" or ".join(f"startswith(line, '{p}')" for p in K.GAUGE_PREFIXES.values()))
    return wanted.groupBy("worker").agg(
        latest(K.GAUGE_PREFIXES["running"]).alias("running"),
        latest(K.GAUGE_PREFIXES["waiting"]).alias("waiting"),
        (latest(K.GAUGE_PREFIXES["cache_usage"]) * 100).alias("cache_pct"),
    )


def fleet(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Workers by their latest status."""
    latest = last_per_key(events.select("worker_id", "status", *order), ["worker_id"], order)
    count = lambda s: F.count_if(F.col("status") == s).alias(f"{s.lower()}_workers")
    return latest.agg(F.count(F.lit(1)).alias("total_workers"), count("READY"), count("LOADING"), count("OFFLINE"))


def nodes(node_events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Active (pending or running) and pending nodes by their latest state."""
    latest = last_per_key(node_events.select("node_id", "status", *order), ["node_id"], order)
    return latest.agg(
        F.count_if(F.col("status").isin("PENDING", "RUNNING")).alias("active_nodes"),
        F.count_if(F.col("status") == "PENDING").alias("pending_nodes"),
    )


def liveness(events: DataFrame, order: str, timeout_s: float = K.HEARTBEAT_TIMEOUT_S, as_of: Column | None = None) -> DataFrame:
    """Each worker event with ``accepted`` and, where it went silent, ``offline_at``.

    ``events`` has ``worker_id, ts, kind`` with kind ``register`` or
    ``heartbeat``. More than the timeout without an event takes a worker
    offline for good: later heartbeats are rejected until it registers again,
    and so are heartbeats of a worker that never registered.
    """
    us = F.unix_micros("ts")
    timed = segmented(events.withColumns({"_us": us, "_reg": F.col("kind") == "register"}), ["worker_id"], order)
    seen = running(timed, ["worker_id"], order, lasts={"_prev": F.col("_us")})
    gap = F.col("_us") - F.col("_prev") > timeout_s * 1_000_000
    flagged = seen.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("int"))
    # Silence before a registration does not count against the new life, so
    # the count of gaps is taken up to and with each registration.
    gaps = running(flagged, ["worker_id"], order, sums={"_gaps": F.col("_gap")}).withColumn(
        "_gaps", F.col("_gaps") + F.col("_gap")
    )
    lives = running(gaps, ["worker_id"], order, lasts={"_base": F.when(F.col("_reg"), F.col("_gaps"))})
    alive = F.col("_reg") | F.coalesce(F.col("_gaps") == F.col("_base"), F.lit(False))
    judged = lives.withColumn("accepted", alive)
    ahead = running(judged, ["worker_id"], order, lasts={"_next": F.col("_us")}, ahead=True)
    until = F.coalesce("_next", F.unix_micros(as_of) if as_of is not None else F.lit(None).cast("bigint"))
    silent = F.col("accepted") & (until - F.col("_us") > timeout_s * 1_000_000)
    return ahead.select(
        *events.columns, "accepted",
        F.when(silent, F.timestamp_micros((F.col("_us") + int(timeout_s * 1_000_000)).cast("bigint"))).alias("offline_at"),
    )


def worker_lives(events: DataFrame, order: str, timeout_s: float = K.HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """Spans without a silence longer than the timeout, per worker, as a table.

    A span counts from its first registration on (``registered``, null when
    there is none: all its heartbeats are rejected) and the worker is offline
    from ``offline_at``. Gaps are found and numbered by segments, then each
    span is a partial aggregate, so a worker with most of the events is not
    one task's work.
    """
    timed = segmented(events.withColumn("_us", F.unix_micros("ts")), ["worker_id"], order)
    seen = running(timed, ["worker_id"], order, lasts={"_prev": F.col("_us")})
    gap = F.coalesce(F.col("_us") - F.col("_prev") > timeout_s * 1_000_000, F.lit(False)).cast("int")
    numbered = running(seen.withColumn("_gap", gap), ["worker_id"], order, sums={"_before": F.col("_gap")})
    spans = numbered.groupBy("worker_id", (F.col("_before") + F.col("_gap")).alias("span")).agg(
        F.min("ts").alias("first_seen"),
        F.min(F.when(F.col("kind") == "register", F.col("ts"))).alias("registered"),
        F.max("ts").alias("last_seen"),
        F.count(F.lit(1)).alias("events"),
    )
    return spans.drop("span").withColumn("offline_at", offline_at(timeout_s))


def merged_lives(spans: DataFrame, timeout_s: float = K.HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """Spans of several parts of a log as spans of the whole: those no more than the timeout apart become one."""
    us = spans.withColumns({"_from": F.unix_micros("first_seen"), "_to": F.unix_micros("last_seen")})
    mine = Window.partitionBy("worker_id").orderBy("_from", "_to")
    reach = F.max("_to").over(mine.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("_from") - reach > timeout_s * 1_000_000, F.lit(False)).cast("int")
    numbered = us.withColumn("_apart", apart).withColumn("span", F.sum("_apart").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("worker_id", "span").agg(
        F.min("first_seen").alias("first_seen"), F.min("registered").alias("registered"), F.max("last_seen").alias("last_seen"), F.sum("events").alias("events")
    ).drop("span")


def offline_at(timeout_s: float) -> Column:
    """When a span's worker went offline; never, when it was not registered."""
    end = F.timestamp_micros(F.unix_micros("last_seen") + int(timeout_s * 1_000_000))
    return F.when(F.col("registered").isNotNull(), end)


def searched_urls(records: DataFrame, qid: str = "qid", url: str = "url") -> DataFrame:
    """The distinct non-blank URLs of each question, one row each."""
    return records.where(F.coalesce(url, F.lit("")) != "").select(qid, url).distinct()


def status_changes(events: DataFrame, keys: Sequence[str], order: str, status: str = "status") -> DataFrame:
    """Rows whose status differs from the worker's previous one; events without a status do not count."""
    said = events.where(F.col(status).isNotNull())
    out = running(said, keys, order, lasts={"old_status": F.col(status)})
    return out.where(F.col("old_status").isNotNull() & (F.col("old_status") != F.col(status)))


def failed_nodes(workers: DataFrame) -> DataFrame:
    """Nodes that have workers, none of them alive; ``workers`` is ``node_id, worker_id, offline``."""
    return workers.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("workers"), F.bool_and("offline").alias("failed")
    )
