"""Scores and reports (E1-E24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybook.catalog.registry import query
from waybook.catalog.tables import CALLS_SQL, JUDGED_SQL, attempts, calls, judged, r6, table, turns
from waybook.functions import payloads
from waybook.operators import audit, report, score
from waybook.operators.select import valid_tools
from waybook.sources import scratch, tables


@query(
    "e1_per_question",
    f"""WITH {JUDGED_SQL}
    SELECT qid, count(*) AS n, CAST(sum(correct::INT) AS BIGINT) AS num_correct,
           round(sum(correct::INT) / count(*), 6) AS accuracy, bool_or(correct) AS pass
    FROM judged GROUP BY qid""",
)
def e1_per_question(spark, sf):
    return score.per_question(judged(spark, sf)).withColumn("accuracy", r6("accuracy"))


@query(
    "e2_summary",
    f"""WITH {JUDGED_SQL}, q AS (
      SELECT qid, count(*) AS n, sum(correct::INT) AS c FROM judged GROUP BY qid)
    SELECT count(*) AS num_questions, CAST(sum(n) AS BIGINT) AS total_trajectories,
           CAST(sum(c) AS BIGINT) AS correct_trajectories, CAST(sum((c > 0)::INT) AS BIGINT) AS passed,
           round(avg((c > 0)::INT), 6) AS pass_at_k, round(avg(c / n), 6) AS avg_at_k,
           round(sum(c) / sum(n), 6) AS trajectory_accuracy FROM q""",
)
def e2_summary(spark, sf):
    out = score.summary(score.per_question(judged(spark, sf)))
    return out.withColumns({c: r6(c) for c in ("pass_at_k", "avg_at_k", "trajectory_accuracy")})


@query(
    "e3_answers",
    f"""WITH {JUDGED_SQL}
    SELECT qid, string_agg(traj_idx || '=' || correct::VARCHAR, ',' ORDER BY traj_idx) AS answers
    FROM judged GROUP BY 1""",
)
def e3_answers(spark, sf):
    nested = score.answers(judged(spark, sf).withColumn("correct", F.coalesce("correct", F.lit(False))), fields=["correct"])
    items = F.transform("answers", lambda a: F.concat(a["traj_idx"].cast("string"), F.lit("="), a["correct"].cast("string")))
    return nested.select("qid", F.array_join(items, ",").alias("answers"))


@query("e3_nested_file", f"WITH {JUDGED_SQL} SELECT qid, CAST(traj_idx AS BIGINT) AS traj_idx, correct FROM judged")
def e3_nested_file(spark, sf):
    """Written in ranges far smaller than a question and read back."""
    path = scratch.folder(spark, "nested")
    rows = judged(spark, sf).select("qid", "traj_idx", F.coalesce("correct", F.lit(False)).alias("correct"))
    tables.write_nested(rows, path, "qid", "traj_idx", width=50)
    return tables.read_nested(spark, path, "qid", "traj_idx bigint, correct boolean")


@query(
    "e4_averages",
    """SELECT round(avg(k), 6) AS avg_calls, round(avg(value), 6) AS avg_latency_s FROM (
      SELECT coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k, coalesce(value, 0) AS value FROM events)""",
)
def e4_averages(spark, sf):
    out = score.averages(calls(spark, sf).selectExpr("k AS calls", "value AS latency_s"), "calls", "latency_s")
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("e5_roles", "SELECT role, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM conversations GROUP BY role")
def e5_roles(spark, sf):
    return score.most_common(score.counts(turns(spark, sf), "role"), "role").withColumn("share", r6("share"))


@query(
    "e6_tool_usage",
    """WITH c AS (SELECT event_type AS tool, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1)
    SELECT tool, n, round(n / sum(n) OVER (), 6) AS share,
           round(n / (SELECT count(DISTINCT user_id) FROM events), 6) AS per_trajectory,
           format('{:.0f}%', round_even(100.0 * n / sum(n) OVER (), 0)) AS label FROM c""",
)
def e6_tool_usage(spark, sf):
    rows = calls(spark, sf)
    used = valid_tools(rows, "tool", ["click", "view", "signup", "purchase"])
    trajectories = rows.agg(F.count_distinct("traj")).scalar()
    return score.counts(used, "tool").select(
        "tool", "n", r6("share").alias("share"), r6(F.col("n") / trajectories).alias("per_trajectory"),
        score.share_label(F.col("n"), F.col("share")).alias("label"),
    )


@query(
    "e7_calls_per_result",
    """SELECT event_type AS tool, count(*) AS calls, round(count(*) / (SELECT count(*) FROM labels), 6) AS per_result
    FROM events GROUP BY 1""",
)
def e7_calls_per_result(spark, sf):
    out = score.calls_per_result(calls(spark, sf), table(spark, sf, "labels"), "tool")
    return out.withColumn("per_result", r6("per_result"))


@query(
    "e8_calls_per_conversation",
    """SELECT min(n) AS min_calls, round(avg(n), 6) AS avg_calls, max(n) AS max_calls FROM (
      SELECT conv_id, CAST(sum((role = 'assistant')::INT) AS BIGINT) AS n FROM conversations GROUP BY 1)""",
)
def e8_calls_per_conversation(spark, sf):
    n = turns(spark, sf).groupBy("traj").agg(F.count_if(F.col("role") == "assistant").alias("n"))
    return n.agg(F.min("n").alias("min_calls"), r6(F.avg("n")).alias("avg_calls"), F.max("n").alias("max_calls"))


def _runs(spark, sf):
    return calls(spark, sf).selectExpr(
        "concat('q', k) AS qid", "traj AS traj_idx", "CASE WHEN tool = 'error' THEN 'error' WHEN tool = 'view' THEN NULL ELSE 'success' END AS status",
        "if(k % 3 = 0, '', tool) AS boxed_answer", "if(k % 7 = 0, 0, value) AS latency_s",
    )


_RUNS_SQL = f"""{CALLS_SQL}, runs AS (
  SELECT 'q' || k AS qid, traj AS traj_idx, CASE WHEN tool = 'error' THEN 'error' WHEN tool = 'view' THEN NULL ELSE 'success' END AS status,
         CASE WHEN k % 3 = 0 THEN '' ELSE tool END AS boxed_answer, CASE WHEN k % 7 = 0 THEN 0 ELSE value END AS latency_s FROM calls)"""


@query("e9_status", f"WITH {_RUNS_SQL} SELECT coalesce(status, '?') AS status, count(*) AS n FROM runs GROUP BY 1")
def e9_status(spark, sf):
    return report.status_counts(_runs(spark, sf))


@query(
    "e9_run_counts",
    f"""WITH {_RUNS_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success,
    count(*) FILTER (status IS DISTINCT FROM 'success') AS errors FROM runs""",
)
def e9_run_counts(spark, sf):
    return report.run_counts(_runs(spark, sf))


@query(
    "e10_positive_latency",
    f"""WITH {_RUNS_SQL} SELECT round(avg(latency_s) FILTER (latency_s > 0), 6) AS avg_s,
    round(sum(latency_s) FILTER (latency_s > 0) / 3600, 6) AS total_h FROM runs""",
)
def e10_positive_latency(spark, sf):
    return report.progress(_runs(spark, sf)).select(r6("avg_s").alias("avg_s"), r6("total_h").alias("total_h"))


@query(
    "e11_progress",
    f"""WITH {_RUNS_SQL}, p AS (
      SELECT count(*) AS n, count(DISTINCT qid) AS questions, max(traj_idx) + 1 AS attempts,
             avg(latency_s) FILTER (latency_s > 0) AS a, count(*) FILTER (boxed_answer <> '') AS boxed,
             count(*) FILTER (status = 'error') AS errors FROM runs)
    SELECT n, questions, attempts, boxed, errors, 5000000 AS target, 5000000 // attempts AS target_questions,
           round(n * 100.0 / 5000000, 6) AS done_pct, round(boxed * 100.0 / n, 6) AS boxed_pct,
           round((5000000 - n) * a / 32 / 60, 6) AS eta_min FROM p""",
)
def e11_progress(spark, sf):
    out = report.progress(_runs(spark, sf), target=5_000_000).drop("avg_s", "total_h")
    return out.withColumns({c: r6(F.col(c).cast("double")) for c in ("done_pct", "boxed_pct", "eta_min")}).withColumn("target", F.col("target").cast("int"))


@query(
    "e12_code_stats",
    f"""WITH {CALLS_SQL}, s AS (
      SELECT sum(k) AS total, sum(k // 2) AS success, sum(k // 3) AS error, sum(k % 2) AS timeout, sum(k // 5) AS no_output FROM calls)
    SELECT CAST(total AS BIGINT) AS total, CAST(success AS BIGINT) AS success, CAST(error AS BIGINT) AS error,
           CAST(timeout AS BIGINT) AS timeout, CAST(no_output AS BIGINT) AS no_output,
           round(100.0 * success::DOUBLE / total::DOUBLE, 6) AS success_pct, round(100.0 * error::DOUBLE / total::DOUBLE, 6) AS error_pct,
           round(100.0 * no_output::DOUBLE / total::DOUBLE, 6) AS no_output_pct FROM s""",
)
def e12_code_stats(spark, sf):
    rows = calls(spark, sf).selectExpr(
        "named_struct('total', k, 'success', k div 2, 'error', k div 3, 'timeout', k % 2, 'no_output', k div 5) AS python_stats"
    )
    out = report.code_stats(rows)
    return out.withColumns({c: r6(F.col(c).cast("double")) for c in out.columns if c.endswith("_pct")})


@query(
    "e13_grader_summary",
    f"""WITH {JUDGED_SQL} SELECT count(*) AS num_results, CAST(sum(correct::INT) AS BIGINT) AS num_correct,
    round(100.0 * sum(correct::INT)::DOUBLE / count(*), 6) AS accuracy_percent FROM judged""",
)
def e13_grader_summary(spark, sf):
    out = report.grader_summary(judged(spark, sf))
    return out.withColumn("accuracy_percent", r6(F.col("accuracy_percent").cast("double")))


def _requests(spark, sf):
    return calls(spark, sf).selectExpr(
        "tool", "tool <> 'error' AS success", "value AS latency", "k AS tokens_generated",
        "if(tool = 'error', if(k % 4 = 0, '', concat('E', k % 5, repeat('x', 150))), NULL) AS error",
    )


@query(
    "e14_latency_percentiles",
    """WITH s AS (SELECT event_type AS tool, value AS v,
             row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
           FROM events WHERE event_type <> 'error')
    SELECT tool, p, v AS value FROM s, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) AS ps(p) WHERE i = CAST(floor(n * p) AS BIGINT)""",
)
def e14_latency_percentiles(spark, sf):
    return report.latency(_requests(spark, sf), by=["tool"])[0]


@query(
    "e14_latency_overall",
    """WITH s AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE event_type <> 'error')
    SELECT p, v AS value FROM s, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) AS ps(p) WHERE i = CAST(floor(n * p) AS BIGINT)""",
)
def e14_latency_overall(spark, sf):
    return report.latency(_requests(spark, sf))[0]


@query(
    "e15_throughput",
    f"""WITH {CALLS_SQL} SELECT count(*) AS requests, count(*) FILTER (tool <> 'error') AS successful,
      CAST(sum(k) FILTER (tool <> 'error') AS BIGINT) AS tokens, round(sum(value), 6) AS seconds,
      round(count(*) / sum(value), 6) AS requests_per_s, round(sum(k) FILTER (tool <> 'error') / sum(value), 6) AS tokens_per_s FROM calls""",
)
def e15_throughput(spark, sf):
    out = report.throughput(_requests(spark, sf), F.sum("latency"))
    return out.withColumns({c: r6(c) for c in ("seconds", "requests_per_s", "tokens_per_s")})


@query(
    "e16_error_groups",
    f"""WITH {CALLS_SQL} SELECT CASE WHEN k % 4 = 0 THEN 'unknown' ELSE left('E' || (k % 5) || repeat('x', 150), 100) END AS error_key,
      count(*) AS n FROM calls WHERE tool = 'error' GROUP BY 1""",
)
def e16_error_groups(spark, sf):
    failed = _requests(spark, sf).where(~F.col("success"))
    return score.most_common(report.error_groups(failed), "error_key")


def _samples(spark, sf, where="true"):
    """Timed rounds: round = k % 6 + 1, repeat = event."""
    return calls(spark, sf).where(where).selectExpr(
        "k % 6 + 1 AS round_num", "seq AS rep", "seq % 1000 AS prompt_tokens", "traj AS new_tokens", "k AS completion_tokens",
        "value AS ttft_ms", "value / 10 AS total_time_s", "k / greatest(value / 10, 0.001) AS tokens_per_sec",
    )


_ROUNDS_SQL = f"""{CALLS_SQL}, samples AS (
  SELECT k % 6 + 1 AS round_num, seq AS rep, seq % 1000 AS prompt_tokens, traj AS new_tokens, k AS completion_tokens,
         value AS ttft_ms, value / 10 AS total_time_s, k / greatest(value / 10, 0.001) AS tokens_per_sec, tool FROM calls),
rounds AS (
  SELECT round_num, arg_min(prompt_tokens, rep) AS prompt_tokens, arg_min(new_tokens, rep) AS new_tokens,
         CAST(floor(avg(completion_tokens)) AS BIGINT) AS completion_tokens, avg(ttft_ms) AS ttft_ms,
         avg(total_time_s) AS total_time_s, avg(tokens_per_sec) AS tokens_per_sec FROM samples GROUP BY 1)"""


@query(
    "e17_rounds",
    f"""WITH {_ROUNDS_SQL} SELECT round_num, prompt_tokens, new_tokens, completion_tokens, round(ttft_ms, 6) AS ttft_ms,
      round(total_time_s, 6) AS total_time_s, round(tokens_per_sec, 6) AS tokens_per_sec FROM rounds""",
)
def e17_rounds(spark, sf):
    out = report.rounds(_samples(spark, sf))
    return out.withColumns({c: r6(c) for c in ("ttft_ms", "total_time_s", "tokens_per_sec")})


@query(
    "e18_searched_urls",
    """SELECT DISTINCT lower(regexp_extract(url, 'example[.]([a-z]+)', 1)) AS qid, url FROM pages WHERE url <> ''""",
)
def e18_searched_urls(spark, sf):
    pages = table(spark, sf, "pages").select(F.lower(F.regexp_extract("url", r"example[.]([a-z]+)", 1)).alias("qid"), "url")
    return report.searched_urls(pages)


@query(
    "e19_audit",
    f"""WITH {JUDGED_SQL} SELECT count(*) AS rows, CAST(sum(correct::INT) AS BIGINT) AS correct,
      count(*) FILTER (n_chars > 500) AS with_conversation, count(*) FILTER (contains(text, 'ation')) AS contaminated FROM judged""",
)
def e19_audit(spark, sf):
    rows = judged(spark, sf, "if(n_chars > 500, lang, NULL) AS conversation", "contains(text, 'ation') AS contaminated")
    return audit.audit(rows.withColumn("correct", F.coalesce("correct", F.lit(False))))


@query("e20_any_reference", "SELECT bool_or(trim(CASE WHEN doc_id % 50 = 7 THEN lang ELSE '  ' END) <> '') AS has_references FROM documents")
def e20_any_reference(spark, sf):
    return report.any_reference(table(spark, sf, "documents").selectExpr("if(doc_id % 50 = 7, lang, '  ') AS reference_answer"))


@query(
    "e22_loose_accuracy",
    f"""WITH a AS (
      SELECT concat(d.source, ':', d.lang) AS qid, d.doc_id, d.text, b.text AS ref FROM documents d
      JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
    f AS (SELECT qid, arg_min(ref, doc_id) AS ref FROM a GROUP BY 1),
    n AS (SELECT a.qid, replace(replace(lower(trim(f.ref, E' \\n')), ',', ''), ' ', '') AS r,
                 replace(replace(lower(trim(a.text, E' \\n')), ',', ''), ' ', '') AS p FROM a JOIN f USING (qid)),
    m AS (SELECT qid, r <> '' AND p <> '' AND (contains(p, r) OR contains(r, p)) AS ok FROM n)
    SELECT qid, count(*) AS n, CAST(sum(ok::INT) AS BIGINT) AS num_correct FROM m GROUP BY 1""",
)
def e22_loose_accuracy(spark, sf):
    bench = table(spark, sf, "benchmark")
    items = bench.agg(F.count(F.lit(1))).scalar()
    rows = attempts(spark, sf, "text").withColumn("item_id", F.col("traj_idx") % items)
    rows = rows.join(bench.select("item_id", F.col("text").alias("reference")), "item_id")
    _, questions = score.loose_accuracy(rows, "qid", "traj_idx", "reference", "text", ["traj_idx"])
    return questions.select("qid", "n", "num_correct")


_FLEET = "CASE tool WHEN 'error' THEN 'OFFLINE' WHEN 'signup' THEN 'LOADING' WHEN 'view' THEN 'STARTING' ELSE 'READY' END AS status"


@query(
    "e23_fleet",
    f"""WITH {CALLS_SQL}, w AS (SELECT traj, arg_max(tool, seq) AS tool FROM calls GROUP BY 1), s AS (SELECT {_FLEET} FROM w)
    SELECT count(*) AS total_workers, count(*) FILTER (status = 'READY') AS ready_workers,
      count(*) FILTER (status = 'LOADING') AS loading_workers, count(*) FILTER (status = 'OFFLINE') AS offline_workers FROM s""",
)
def e23_fleet(spark, sf):
    return report.fleet(calls(spark, sf).selectExpr("traj AS worker_id", "seq", _FLEET), ["seq"])


@query(
    "e23_nodes",
    f"""WITH {CALLS_SQL}, w AS (SELECT traj, arg_max(tool, seq) AS tool FROM calls GROUP BY 1)
    SELECT count(*) FILTER (tool IN ('signup', 'view')) AS active_nodes, count(*) FILTER (tool = 'signup') AS pending_nodes FROM w""",
)
def e23_nodes(spark, sf):
    state = "CASE tool WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status"
    return report.nodes(calls(spark, sf).selectExpr("traj AS node_id", "seq", state), ["seq"])


@query(
    "e24_cold_warm",
    f"""WITH {_ROUNDS_SQL}, c AS (
      SELECT max(ttft_ms) FILTER (round_num = 1) AS cold, avg(ttft_ms) FILTER (round_num > 1) AS warm,
             avg(prompt_tokens) FILTER (round_num > 1) AS p, avg(new_tokens) FILTER (round_num > 1) AS n FROM rounds)
    SELECT round(cold, 6) AS cold_ms, round(warm, 6) AS warm_ms, round(p, 6) AS warm_prompt, round(n, 6) AS warm_new,
           CASE WHEN p > 0 THEN round(n / p, 6) END AS new_ratio, warm < cold * 0.8 AS effective FROM c""",
)
def e24_cold_warm(spark, sf):
    out = report.cold_warm(report.rounds(_samples(spark, sf)))
    return out.withColumns({c: r6(c) for c in out.columns if c != "effective"})


@query(
    "e24_round_speedups",
    f"""WITH {_ROUNDS_SQL} SELECT r.round_num, round(c.ttft_ms / greatest(r.ttft_ms, 0.001), 6) AS speedup,
      round(r.ttft_ms / greatest(r.prompt_tokens, 1), 6) AS ms_per_prompt_token,
      CASE WHEN r.new_tokens > 0 THEN round(r.ttft_ms / r.new_tokens, 6) ELSE 0.0 END AS ms_per_new_token
      FROM rounds r, rounds c WHERE r.round_num > 1 AND c.round_num = 1""",
)
def e24_round_speedups(spark, sf):
    out = report.round_speedups(report.rounds(_samples(spark, sf)))
    return out.withColumns({c: r6(c) for c in out.columns if c != "round_num"})


@query(
    "i28_code_outcome",
    """SELECT CASE WHEN contains(text, 'timed out') THEN 'timeout' WHEN contains(text, 'Error') OR contains(text, 'Traceback') THEN 'error'
      WHEN trim(text, E' \\n') IN ('', '(no output)') THEN 'no_output' ELSE 'success' END AS outcome, count(*) AS n FROM (
      SELECT CASE doc_id % 5 WHEN 0 THEN 'run timed out: Error' WHEN 1 THEN text || ' ValueError' WHEN 2 THEN ' (no output)' WHEN 3 THEN '  ' ELSE lang END AS text
      FROM documents) GROUP BY 1""",
)
def i28_code_outcome(spark, sf):
    output = (
        "CASE doc_id % 5 WHEN 0 THEN 'run timed out: Error' WHEN 1 THEN text || ' ValueError' "
        "WHEN 2 THEN ' (no output)' WHEN 3 THEN '  ' ELSE lang END AS output"
    )
    rows = table(spark, sf, "documents").selectExpr(output)
    return rows.groupBy(payloads.code_outcome(F.col("output")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
