"""Whole jobs (J1-J11) and conversion accounting (E21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybook.catalog.aggregates import _RUNS_SQL, _requests, _runs
from waybook.catalog.registry import query
from waybook.catalog.tables import CALLS_SQL, JUDGED_SQL, QID, calls, judged, r6, table, turns, verdicts
from waybook.functions import strings
from waybook.operators import score
from waybook.plans import jobs
from waybook.sources import scratch
from waybook.streaming import keyed, streams

# A conversation as a trajectory: the first user turn is the question, later
# user turns are tool output, every reply but the last is a tool call. One
# turn is missing in every seventh conversation, which breaks alternation.
_BASE = """t AS (
  SELECT conv_id AS id, turn AS pos, role, text, trim(text, E' \\n\\t') AS s,
         min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS q, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
r AS (SELECT * FROM t WHERE role <> 'system' AND pos > q AND NOT (id % 7 = 1 AND pos = q + 2)),
rec AS (SELECT id, max(text) FILTER (role = 'system') AS sys, max(text) FILTER (pos = q) AS question, max(last) - max(q) AS n FROM t GROUP BY id)"""

_VALID = """sh AS (SELECT id, role, pos, lag(role, 1, 'user') OVER (PARTITION BY id ORDER BY pos) AS prev FROM {rows}),
ok AS (SELECT id, bool_and(role <> prev) AS valid, arg_max(role, pos) = 'user' AS open_end, max(pos) AS last_pos, count(*) AS n FROM sh GROUP BY id)"""


def _records(spark, sf):
    rows = turns(spark, sf)
    first = rows.where("role = 'user'").groupBy("traj").agg(F.min("pos").alias("q"), F.min_by("content", "pos").alias("question"))
    rest = rows.groupBy("traj").agg(
        F.max("pos").alias("last"), F.max(F.when(F.col("role") == "system", F.col("content"))).alias("system_prompt")
    )
    both = first.join(rest, "traj").withColumnRenamed("traj", "id")
    shaped = both.withColumns(
        {
            "status": F.when(F.col("id") % 9 == 0, "error").otherwise("success"), "num_tool_calls": F.col("id") % 4,
            "num_turns": F.col("last") - F.col("q"), "type": F.when(F.col("id") % 5 == 0, "skip").otherwise("long_form"),
            "tokenized_length": F.col("num_turns") * 100,
        }
    )
    # One record per trajectory, as a log table would hold it.
    return scratch.stage(shaped, "records")


def _turns(spark, sf, records):
    rows = turns(spark, sf).withColumnRenamed("traj", "id").join(records.select("id", "q", "last"), "id")
    kept = rows.where("role <> 'system' AND pos > q AND NOT (id % 7 = 1 AND pos = q + 2)")
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("tool")
    return kept.select("id", "pos", role.alias("role"), "content", (F.col("pos") == F.col("last")).alias("last"), F.col("role").alias("spoken"))


def _lit(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _tagged(last):
    call = _lit(
        "<think>\n", F.col("content"), "\n</think>\n\n<tool_call>\n<function=web_search>\n<parameter=query>\n", F.col("content"),
        "\n</parameter>\n</function>\n</tool_call>",
    )
    return F.when((F.col("role") == "assistant") & ~F.col("last"), call).when(F.col("role") == "assistant", last).otherwise(F.col("content"))


def _native(spark, sf):
    content = _tagged(_lit(F.col("content"), "<|im_end|>\nmore"))
    records = _records(spark, sf)
    return jobs.native_conversations(
        records, _turns(spark, sf, records).select("id", "pos", "role", content.alias("content")), {"web_search": '{"name": "web_search"}'}, 1
    )


_CALL_VALUE = """'<think>' || chr(10) || s || chr(10) || '</think>' || chr(10) || chr(10) || '<tool_call>' || chr(10) || '[{"name": "web_search", "arguments": {"query": ' || to_json(s)::VARCHAR || '}}]' || chr(10) || '</tool_call>'"""
_J1 = f"""{_BASE}, acc AS (SELECT * FROM rec WHERE id % 9 <> 0 AND id % 4 >= 1 AND id IN (SELECT id FROM r)),
rr AS (SELECT id, pos, role FROM r UNION ALL SELECT id, -1, 'user2' FROM acc), x AS (SELECT id, pos, role FROM r WHERE id IN (SELECT id FROM acc)), {_VALID.format(rows='x')}"""


@query(
    "j1_native_conversations",
    f"""WITH {_J1}
    SELECT id, pos, CASE WHEN role = 'user' THEN 'observation' WHEN pos = last THEN 'gpt' ELSE 'function_call' END AS "from",
      CASE WHEN role = 'user' THEN text WHEN pos = last THEN s ELSE {_CALL_VALUE} END AS value FROM r WHERE id IN (SELECT id FROM ok WHERE valid)
    UNION ALL SELECT id, -2, 'system', sys FROM acc WHERE sys IS NOT NULL AND id IN (SELECT id FROM ok WHERE valid)
    UNION ALL SELECT id, -1, 'human', question FROM acc WHERE id IN (SELECT id FROM ok WHERE valid)
    UNION ALL SELECT id, last_pos + 1, 'gpt', '' FROM ok WHERE valid AND open_end""",
)
def j1_native_conversations(spark, sf):
    return _native(spark, sf).turns


@query(
    "e21_accounting",
    f"""WITH {_J1} SELECT (SELECT count(*) FROM rec) AS loaded, (SELECT count(*) FROM rec WHERE id % 9 = 0 OR id % 4 < 1) AS filtered,
      (SELECT count(*) FROM ok WHERE valid) AS converted, (SELECT count(*) FROM rec WHERE id % 9 <> 0 AND id % 4 >= 1) - (SELECT count(*) FROM ok WHERE valid) AS skipped""",
)
def e21_accounting(spark, sf):
    return _native(spark, sf).accounting()


@query(
    "j1_records",
    f"""WITH {_J1}, c AS (SELECT r.id, count(*) FILTER (role = 'assistant' AND pos < last) AS calls, count(*) AS n FROM r JOIN ok USING (id) WHERE valid GROUP BY 1)
    SELECT id, (c.n + 1 + (sys IS NOT NULL)::INT + open_end::INT)::INT AS turns, CASE WHEN calls > 0 THEN '[{{"name": "web_search"}}]' ELSE '' END AS tools
    FROM c JOIN acc USING (id) JOIN ok USING (id)""",
)
def j1_records(spark, sf):
    packed = _native(spark, sf).records()
    return packed.select("id", F.size("conversations").alias("turns"), "tools")


def _foreign(spark, sf):
    records = _records(spark, sf)
    rows = _turns(spark, sf, records)
    plain = F.trim(F.regexp_replace("content", r"[^A-Za-z]+", " "))
    call = _lit("serper_google_webpage_search(query='", plain, "', num_results=5)")
    called = (F.col("role") == "assistant") & ~F.col("last")
    payload = F.to_json(
        F.struct(F.struct(F.lit("q").alias("q")).alias("searchParameters"), F.array(F.struct(F.lit("t").alias("title"), F.lit("u").alias("link"), F.col("content").alias("snippet"))).alias("organic"))
    )
    content = (
        F.when(called, _lit("<think> ", F.col("content"), " </think>")).when(F.col("role") == "assistant", _lit(" <answer>", F.col("content"), "</answer> "))
        .otherwise(F.when(F.col("id") % 2 == 0, payload).otherwise(_lit("plain ", F.col("content"))))
    )
    broken = (F.col("id") % 11 == 3) & called
    messages = rows.select(
        "id", "pos", F.when(F.col("role") == "assistant", "assistant").otherwise("environment").alias("role"),
        F.try_parse_json(strings.json_text(content)).alias("content"), F.when(broken, "not a call").when(called, call).alias("function_calls"),
    )
    asked = records.select("id", F.lit(-5).cast("bigint").alias("pos"), F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("question").alias("text"))).alias("c"))
    user = asked.select("id", "pos", "role", F.try_parse_json(F.to_json("c")).alias("content"), F.lit(None).cast("string").alias("function_calls"))
    return jobs.foreign_conversations(
        records, messages.unionByName(user), {"web_search": '{"name": "web_search"}'}, "You search.", ["long_form"], 1, 500
    )


@query(
    "j2_foreign_conversations",
    f"""WITH {_BASE}, acc AS (SELECT * FROM rec WHERE id % 5 <> 0 AND id % 4 >= 1 AND n * 100 <= 500),
    x AS (SELECT * FROM r WHERE id IN (SELECT id FROM acc) AND NOT (id % 11 = 3 AND role = 'assistant' AND pos < last)), {_VALID.format(rows='x')},
    v AS (SELECT x.*, first_value(x.pos) OVER (PARTITION BY x.id ORDER BY x.pos) AS p0 FROM x JOIN ok USING (id) WHERE valid)
    SELECT id, pos, CASE WHEN role = 'user' THEN 'observation' WHEN pos = last THEN 'gpt' ELSE 'function_call' END AS "from",
      CASE WHEN role = 'user' AND id % 2 = 0 THEN 'Searched for "q"' || chr(10) || chr(10) || '[1] t' || chr(10) || '    URL: u' || chr(10) || '    Snippet: ' || text || chr(10)
        WHEN role = 'user' THEN 'plain ' || s WHEN pos = last THEN text
        ELSE '<think>' || chr(10) || s || chr(10) || '</think>' || chr(10) || chr(10) || '<tool_call>' || chr(10) || '[{{"name": "web_search", "arguments": {{"query": "' || trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) || '", "topn": 5}}}}]' || chr(10) || '</tool_call>' END AS value FROM v
    UNION ALL SELECT id, -2, 'system', 'You search.' FROM ok WHERE valid UNION ALL SELECT id, -1, 'human', question FROM acc WHERE id IN (SELECT id FROM ok WHERE valid)
    UNION ALL SELECT id, last_pos + 1, 'gpt', '' FROM ok WHERE valid AND open_end""",
)
def j2_foreign_conversations(spark, sf):
    return _foreign(spark, sf).turns


def _keyed(spark, sf):
    """The records and turns under a question of three attempts; attempts divisible by 5 or 8 are correct."""
    key = [F.concat(F.lit("q"), F.floor(F.col("id") / 3).cast("string")).alias("qid"), F.col("id").alias("traj_idx")]
    records = _records(spark, sf)
    judged_rows = records.select(*key, ((F.col("id") % 5 == 0) | (F.col("id") % 8 == 0)).alias("correct"))
    return records.select(*key, "*"), _turns(spark, sf, records).select(*key, "*"), judged_rows


@query(
    "j3_channel_conversations",
    f"""WITH {_BASE}, acc AS (SELECT * FROM rec WHERE id % 9 <> 0 AND n > 0 AND id % 4 <= 2 AND (id % 5 = 0 OR id % 8 = 0)),
    x AS (SELECT * FROM r WHERE id IN (SELECT id FROM acc)), o AS (SELECT id, role, pos FROM x UNION ALL SELECT id, 'user', -1 FROM acc),
    sh AS (SELECT id, role, pos, lag(role, 1, 'none') OVER (PARTITION BY id ORDER BY pos) AS prev FROM o),
    ok AS (SELECT id, bool_and(role <> prev) AS valid, arg_max(role, pos) = 'user' AS open_end, max(pos) AS last_pos, count(*) AS n FROM sh GROUP BY id),
    g AS (SELECT * FROM ok WHERE valid AND n >= 2)
    SELECT 'q' || (id // 3) AS qid, id AS traj_idx, pos, CASE WHEN role = 'user' THEN 'observation' WHEN pos = last THEN 'gpt' ELSE 'function_call' END AS "from",
      CASE WHEN role = 'user' THEN text WHEN pos = last THEN '<think>' || chr(10) || 'done' || chr(10) || '</think>' || chr(10) || chr(10) || s
        ELSE {_CALL_VALUE} END AS value FROM x WHERE id IN (SELECT id FROM g)
    UNION ALL SELECT 'q' || (id // 3), id, -2, 'system', 'You search.' FROM g UNION ALL SELECT 'q' || (id // 3), id, -1, 'human', question FROM acc WHERE id IN (SELECT id FROM g)
    UNION ALL SELECT 'q' || (id // 3), id, last_pos + 1, 'gpt', '' FROM g WHERE open_end""",
)
def j3_channel_conversations(spark, sf):
    return _channel(spark, sf).turns


_TWO = {"web_search": '{"name": "web_search"}', "open_url": '{"name": "open_url"}'}
_KEYED_RECORDS = """SELECT 'q' || (id // 3) || '_' || id AS id, (n + 1 + open_end::INT)::INT AS turns, '[{"name": "web_search"}, {"name": "open_url"}]' AS tools FROM g"""


def _channel(spark, sf):
    records, rows, judged_rows = _keyed(spark, sf)
    called = (F.col("role") == "assistant") & ~F.col("last")
    content = (
        F.when(called, _lit("<|channel|>analysis<|message|>", F.col("content"), "<|end|>"))
        .when(F.col("role") == "assistant", _lit("<|channel|>analysis<|message|>done<|end|><|channel|>final<|message|>", F.col("content"), "<|return|>"))
        .otherwise(F.col("content"))
    )
    args = F.to_json(F.struct(strings.strip(F.col("content")).alias("query"), F.lit(10).alias("top_n"), F.lit("x").alias("other")))
    shaped = rows.select(
        "qid", "traj_idx", "pos", "role", content.alias("content"), F.when(called, "browser.search").alias("tool"), args.alias("args"),
        F.lit(None).cast("string").alias("final_answer"),
    )
    return jobs.channel_conversations(records, shaped, "You search.", 2, judged_rows, _TWO)


@query(
    "j4_selfplay_conversations",
    f"""WITH {_BASE}, acc AS (SELECT * FROM rec WHERE n > 0 AND id % 4 <= 2 AND id // 3 IN (SELECT id // 3 FROM rec WHERE id % 5 = 0 OR id % 8 = 0)),
    x AS (SELECT * FROM r WHERE id IN (SELECT id FROM acc)), o AS (SELECT id, role, pos FROM x UNION ALL SELECT id, 'user', -1 FROM acc),
    sh AS (SELECT id, role, pos, lag(role, 1, 'none') OVER (PARTITION BY id ORDER BY pos) AS prev FROM o),
    ok AS (SELECT id, bool_and(role <> prev) AS valid, arg_max(role, pos) = 'user' AS open_end, max(pos) AS last_pos, count(*) AS n FROM sh GROUP BY id),
    g AS (SELECT * FROM ok WHERE valid AND n >= 2)
    SELECT 'q' || (id // 3) AS qid, id AS traj_idx, pos, CASE WHEN role = 'user' THEN 'observation' WHEN pos = last THEN 'gpt' ELSE 'function_call' END AS "from",
      CASE WHEN role = 'user' THEN text WHEN pos = last THEN '<think>' || chr(10) || text || '</think>ok' ELSE {_CALL_VALUE} END AS value FROM x WHERE id IN (SELECT id FROM g)
    UNION ALL SELECT 'q' || (id // 3), id, -2, 'system', 'You search.' FROM g UNION ALL SELECT 'q' || (id // 3), id, -1, 'human', question FROM acc WHERE id IN (SELECT id FROM g)
    UNION ALL SELECT 'q' || (id // 3), id, last_pos + 1, 'gpt', '' FROM g WHERE open_end""",
)
def j4_selfplay_conversations(spark, sf):
    return _selfplay(spark, sf).turns


def _selfplay(spark, sf):
    records, rows, judged_rows = _keyed(spark, sf)
    content = F.regexp_replace(_tagged(_lit(F.col("content"), "</think>ok")), r"\A<think>\n", "")
    shaped = rows.select("qid", "traj_idx", "pos", "role", content.alias("content"))
    return jobs.selfplay_conversations(records, shaped, judged_rows, "You search.", 2, _TWO)


def _shown(conversion):
    return conversion.records().select("id", F.size("conversations").alias("turns"), "tools")


@query(
    "j2_records",
    f"""WITH {_BASE}, acc AS (SELECT * FROM rec WHERE id % 5 <> 0 AND id % 4 >= 1 AND n * 100 <= 500),
    x AS (SELECT * FROM r WHERE id IN (SELECT id FROM acc) AND NOT (id % 11 = 3 AND role = 'assistant' AND pos < last)), {_VALID.format(rows='x')}
    SELECT id, (count(*) + 2 + any_value(open_end)::INT)::INT AS turns, CASE WHEN bool_or(role = 'assistant' AND pos < last) THEN '[{{"name": "web_search"}}]' ELSE '' END AS tools
    FROM x JOIN (SELECT id, valid, open_end FROM ok) o USING (id) WHERE valid GROUP BY id""",
)
def j2_records(spark, sf):
    return _shown(_foreign(spark, sf))


@query(
    "j3_records",
    f"""WITH {_BASE}, acc AS (SELECT * FROM rec WHERE id % 9 <> 0 AND n > 0 AND id % 4 <= 2 AND (id % 5 = 0 OR id % 8 = 0)),
    x AS (SELECT * FROM r WHERE id IN (SELECT id FROM acc)), o AS (SELECT id, role, pos FROM x UNION ALL SELECT id, 'user', -1 FROM acc),
    sh AS (SELECT id, role, pos, lag(role, 1, 'none') OVER (PARTITION BY id ORDER BY pos) AS prev FROM o),
    ok AS (SELECT id, bool_and(role <> prev) AS valid, arg_max(role, pos) = 'user' AS open_end, count(*) AS n FROM sh GROUP BY id),
    g AS (SELECT * FROM ok WHERE valid AND n >= 2) {_KEYED_RECORDS}""",
)
def j3_records(spark, sf):
    return _shown(_channel(spark, sf))


@query(
    "j4_records",
    f"""WITH {_BASE}, acc AS (SELECT * FROM rec WHERE n > 0 AND id % 4 <= 2 AND id // 3 IN (SELECT id // 3 FROM rec WHERE id % 5 = 0 OR id % 8 = 0)),
    x AS (SELECT * FROM r WHERE id IN (SELECT id FROM acc)), o AS (SELECT id, role, pos FROM x UNION ALL SELECT id, 'user', -1 FROM acc),
    sh AS (SELECT id, role, pos, lag(role, 1, 'none') OVER (PARTITION BY id ORDER BY pos) AS prev FROM o),
    ok AS (SELECT id, bool_and(role <> prev) AS valid, arg_max(role, pos) = 'user' AS open_end, count(*) AS n FROM sh GROUP BY id),
    g AS (SELECT * FROM ok WHERE valid AND n >= 2) {_KEYED_RECORDS}""",
)
def j4_records(spark, sf):
    return _shown(_selfplay(spark, sf))


def _log(spark, sf):
    """Every attempt logged twice, first as an error; the answer holds the reference when the label says so."""
    rows = judged(spark, sf, "lang", "n_chars", "source")
    log = rows.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    answer = F.when(F.col("correct"), _lit("It is ", F.upper("source"), ".")).when(F.col("traj_idx") % 6 == 0, "").otherwise("none")
    return log.select(
        "qid", "traj_idx", F.col("again").alias("line_no"), F.when(F.col("again") == 0, "error").otherwise("success").alias("status"),
        F.col("source").alias("reference_answer"), answer.alias("answer"), F.lit("").alias("boxed_answer"),
        (F.col("n_chars") % 9).alias("num_tool_calls"), (F.col("n_chars") / 4).alias("latency_s"),
    )


@query(
    "j5_evaluation",
    f"""WITH {JUDGED_SQL}, q AS (SELECT qid, count(*) AS n, sum(correct::INT) AS c FROM judged GROUP BY 1),
    s AS (SELECT count(*)::DOUBLE AS nq, sum(n)::DOUBLE AS nt, sum(c)::DOUBLE AS nc, sum((c > 0)::INT)::DOUBLE AS p, avg((c > 0)::INT) AS pk, avg(c / n) AS ak, sum(c) / sum(n) AS ta,
      (SELECT avg(n_chars % 9) FROM judged) AS mt, (SELECT avg(n_chars / 4) FROM judged) AS ml FROM q)
    SELECT unnest(['num_questions', 'total_trajectories', 'correct_trajectories', 'passed', 'pass@4', 'avg@4', 'trajectory_accuracy', 'avg_tool_calls', 'avg_latency_s']) AS metric,
           round(unnest([nq, nt, nc, p, pk, ak, ta, mt, ml]), 6) AS value FROM s""",
)
def j5_evaluation(spark, sf):
    return jobs.evaluate(_log(spark, sf), ["line_no"])[2].withColumn("value", r6("value"))


def _graded(spark, sf):
    docs = table(spark, sf, "documents")
    verdict = F.when(F.col("doc_id") % 3 == 0, "yes").when(F.col("doc_id") % 3 == 1, "no").otherwise("maybe")
    records = docs.select(
        F.col("doc_id").alias("query_id"), F.expr(f"concat(' ', {QID})").alias("question"), F.col("lang").alias("response"), (F.col("doc_id") % 10 > 0).alias("is_completed"),
        _lit("**extracted_final_answer:** ", F.col("source"), "\nreasoning: r\n**correct:** ", verdict).alias("judge_reply"),
    )
    truth = score.ground_truth(docs.where("lang <> 'de'").selectExpr(f"{QID} AS question", "lang AS answer", "doc_id"), "doc_id")
    used = calls(spark, sf).selectExpr("seq % 1500 AS query_id", "tool")
    return jobs.ground_truth_report(records, truth, used)


@query(
    "j6_graded_csv",
    """SELECT doc_id AS query_id, CASE WHEN doc_id % 10 > 0 THEN source ELSE lang END AS predicted_answer, lang AS correct_answer,
      CASE WHEN doc_id % 10 > 0 AND doc_id % 3 < 2 THEN doc_id % 3 = 0 END AS judge_correct, doc_id % 10 > 0 AS is_completed, doc_id % 10 = 0 OR doc_id % 3 = 2 AS parse_error
    FROM documents WHERE lang <> 'de'""",
)
def j6_graded_csv(spark, sf):
    return _graded(spark, sf)[0]


@query(
    "j6_grader_summary",
    """SELECT count(*) AS num_results, count(*) FILTER (doc_id % 10 > 0 AND doc_id % 3 = 0) AS num_correct,
      round(100.0 * (count(*) FILTER (doc_id % 10 > 0 AND doc_id % 3 = 0))::DOUBLE / count(*), 6) AS accuracy_percent FROM documents WHERE lang <> 'de'""",
)
def j6_grader_summary(spark, sf):
    return _graded(spark, sf)[1].withColumn("accuracy_percent", r6(F.col("accuracy_percent").cast("double")))


@query(
    "j6_calls_per_result",
    """WITH d AS (SELECT doc_id FROM documents WHERE lang <> 'de') SELECT event_type AS tool, count(*) AS calls, round(count(*) / (SELECT count(*) FROM d), 6) AS per_result
    FROM events WHERE event_id % 1500 IN (SELECT doc_id FROM d) GROUP BY 1""",
)
def j6_calls_per_result(spark, sf):
    return _graded(spark, sf)[2].withColumn("per_result", r6("per_result"))


def _published(spark, sf):
    docs = judged(spark, sf, "source", "lang", "text", "n_chars")
    attempts = docs.withColumns(
        {
            "question": F.col("source"), "reference_answer": F.col("lang"), "boxed_answer": F.lit(""), "num_tool_calls": F.lit(1),
            "tool_calls": F.array(F.struct(F.col("lang").alias("tool"))), "latency_s": F.lit(1.5), "status": F.lit("success"),
            "conversation": F.when(F.col("n_chars") > 500, F.array(F.struct(F.lit("tool").alias("role")))),
        }
    ).drop("correct")
    v = verdicts(spark, sf)
    tool_turns = docs.select("qid", "traj_idx", F.lit("tool").alias("role"), F.col("text").alias("content"))
    return jobs.publish(attempts, v, score.per_question(v), tool_turns, ["heron", "eau de "])


@query(
    "j7_published",
    f"""WITH {JUDGED_SQL} SELECT qid, traj_idx, source AS question, correct, CASE WHEN toxic IS NULL THEN '' ELSE 't' || toxic END AS judge_explanation,
      round(coalesce(sum(correct::INT) OVER (PARTITION BY qid) / nullif(count(toxic) OVER (PARTITION BY qid), 0), 0.0), 6) AS question_accuracy,
      contains(text, 'heron') OR contains(text, 'eau de ') AS contaminated, '[{{"tool":"' || lang || '"}}]' AS tool_calls FROM judged""",
)
def j7_published(spark, sf):
    out = _published(spark, sf)[0].select("qid", "traj_idx", "question", "correct", "judge_explanation", "question_accuracy", "contaminated", "tool_calls")
    return out.withColumn("question_accuracy", r6("question_accuracy"))


@query(
    "j7_audit",
    f"""WITH {JUDGED_SQL} SELECT count(*) AS rows, CAST(sum(correct::INT) AS BIGINT) AS correct, count(*) FILTER (n_chars > 500) AS with_conversation,
      count(*) FILTER (contains(text, 'heron') OR contains(text, 'eau de ')) AS contaminated FROM judged""",
)
def j7_audit(spark, sf):
    return _published(spark, sf)[1]


@query(
    "j8_progress_tools",
    "SELECT event_type AS tool, count(*) AS n, min(event_id) AS first_seen, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 6",
)
def j8_progress_tools(spark, sf):
    return jobs.progress_report(_runs(spark, sf), calls(spark, sf), 0)[2].withColumn("share", r6("share"))


@query(
    "j8_progress",
    f"""WITH {_RUNS_SQL} SELECT count(*) AS n, count(DISTINCT qid) AS questions, max(traj_idx) + 1 AS attempts, count(*) FILTER (boxed_answer <> '') AS boxed,
      count(*) FILTER (status = 'error') AS errors, count(*) AS target, count(DISTINCT qid) AS target_questions, 0.0::DOUBLE AS eta_min FROM runs""",
)
def j8_progress(spark, sf):
    out = jobs.progress_report(_runs(spark, sf), calls(spark, sf), 0)[0]
    return out.select("n", "questions", "attempts", "boxed", "errors", "target", "target_questions", r6("eta_min").alias("eta_min"))


@query(
    "j8_accuracy",
    f"""WITH {JUDGED_SQL}, a AS (SELECT qid, CASE WHEN correct THEN 'It is ' || upper(source) || '.' WHEN traj_idx % 6 = 0 THEN '' ELSE 'none' END AS answer, source FROM judged),
    m AS (SELECT qid, answer <> '' AND contains(replace(lower(answer), ' ', ''), lower(source)) AS ok FROM a),
    q AS (SELECT qid, count(*) AS n, sum(ok::INT) AS c FROM m GROUP BY 1)
    SELECT count(*) AS num_questions, CAST(sum(n) AS BIGINT) AS total_trajectories, CAST(sum(c) AS BIGINT) AS correct_trajectories, count(*) FILTER (c > 0) AS passed,
      round(avg((c > 0)::INT), 6) AS pass_at_k, round(sum(c) / sum(n), 6) AS trajectory_accuracy FROM q""",
)
def j8_accuracy(spark, sf):
    out = jobs.accuracy_estimate(_log(spark, sf).where("line_no = 1")).drop("avg_at_k")
    return out.withColumns({c: r6(c) for c in ("pass_at_k", "trajectory_accuracy")})


@query(
    "j8_accuracy_stream",
    f"""WITH {JUDGED_SQL}, a AS (SELECT qid, CASE WHEN correct THEN 'It is ' || upper(source) || '.' WHEN traj_idx % 6 = 0 THEN '' ELSE 'none' END AS answer, source FROM judged),
    m AS (SELECT qid, answer <> '' AND contains(replace(lower(answer), ' ', ''), lower(source)) AS ok FROM a),
    q AS (SELECT qid, count(*) AS n, sum(ok::INT) AS c FROM m GROUP BY 1)
    SELECT count(*) AS num_questions, CAST(sum(n) AS BIGINT) AS total_trajectories, CAST(sum(c) AS BIGINT) AS correct_trajectories, count(*) FILTER (c > 0) AS passed,
      round(avg((c > 0)::INT), 6) AS pass_at_k, round(sum(c) / sum(n), 6) AS trajectory_accuracy FROM q""",
)
def j8_accuracy_stream(spark, sf):
    """The log comes in files that hold any attempts of a question, so that later ones bring earlier references."""
    path, out, state = (scratch.folder(spark, x) for x in ("log", "accuracy", "state"))
    rows = _log(spark, sf).where("line_no = 1").select("qid", "traj_idx", "reference_answer", F.coalesce(F.nullif("boxed_answer", F.lit("")), "answer").alias("answer"))
    rows.repartition(3).write.parquet(path)
    log = streams.growing_log(spark, path, "qid string, traj_idx bigint, reference_answer string, answer string", 1, fmt="parquet")
    keyed.accuracy_deltas(log, out, state).awaitTermination()
    return keyed.accuracy(spark, out).withColumns({c: r6(c) for c in ("pass_at_k", "trajectory_accuracy")})


@query(
    "j9_load_report",
    """WITH s AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE event_type <> 'error')
    SELECT m AS metric, v AS value FROM s, (VALUES ('p50', 0.5), ('p90', 0.9), ('p99', 0.99)) AS ps(m, p) WHERE i = CAST(floor(n * p::DOUBLE) AS BIGINT)
    UNION ALL SELECT 'min', min(v) FROM s UNION ALL SELECT 'max', max(v) FROM s UNION ALL SELECT 'avg', round(avg(v), 6) FROM s""",
)
def j9_load_report(spark, sf):
    return jobs.load_report(_requests(spark, sf), F.sum("latency"))[0].withColumn("value", r6("value"))


@query(
    "j10_cache_report",
    f"""WITH {CALLS_SQL}, rounds AS (SELECT tool AS label, k % 6 + 1 AS round_num, avg(value) AS ttft_ms, arg_min(seq % 1000, seq) AS p, arg_min(traj, seq) AS n FROM calls GROUP BY 1, 2),
    c AS (SELECT label, max(ttft_ms) FILTER (round_num = 1) AS cold, avg(ttft_ms) FILTER (round_num > 1) AS warm, avg(p) FILTER (round_num > 1) AS p, avg(n) FILTER (round_num > 1) AS n FROM rounds GROUP BY 1)
    SELECT label, round(cold, 6) AS cold_ms, round(warm, 6) AS warm_ms, round(p, 6) AS warm_prompt, round(n, 6) AS warm_new, round(n / p, 6) AS new_ratio, warm < cold * 0.8 AS effective FROM c""",
)
def j10_cache_report(spark, sf):
    out = jobs.cache_report(_labelled_samples(spark, sf))[1]
    return out.withColumns({c: r6(c) for c in out.columns if c not in ("label", "effective")})


def _labelled_samples(spark, sf):
    return calls(spark, sf).selectExpr(
        "tool AS label", "k % 6 + 1 AS round_num", "seq AS rep", "seq % 1000 AS prompt_tokens", "traj AS new_tokens", "k AS completion_tokens",
        "value AS ttft_ms", "value / 10 AS total_time_s", "double(k) AS tokens_per_sec",
    )


@query(
    "j11_work_plan",
    """WITH q AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
    p AS (SELECT doc_id, a::INT AS traj_idx FROM q, range(3) r(a) WHERE i < 300 AND i % 4 = 2)
    SELECT doc_id::VARCHAR AS qid, traj_idx, doc_id || '__traj' || traj_idx AS request_qid FROM p
    WHERE (doc_id, traj_idx) NOT IN (SELECT doc_id, toxic FROM labels)""",
)
def j11_work_plan(spark, sf):
    questions = table(spark, sf, "documents").selectExpr("doc_id", "string(doc_id) AS qid")
    done = table(spark, sf, "labels").selectExpr("string(doc_id) AS qid", "toxic AS traj_idx")
    return jobs.work_plan(questions, done, 3, "doc_id", 2, 4, 300).drop("doc_id")


@query(
    "j10_round_speedups",
    f"""WITH {CALLS_SQL}, rounds AS (SELECT tool AS label, k % 6 + 1 AS round_num, avg(value) AS ttft_ms, arg_min(seq % 1000, seq) AS p FROM calls GROUP BY 1, 2)
    SELECT label, r.round_num, round(c.ttft_ms / greatest(r.ttft_ms, 0.001), 6) AS speedup, round(r.ttft_ms / greatest(r.p, 1), 6) AS ms_per_prompt_token
    FROM rounds r JOIN rounds c USING (label) WHERE r.round_num > 1 AND c.round_num = 1""",
)
def j10_round_speedups(spark, sf):
    out = jobs.cache_report(_labelled_samples(spark, sf))[2]
    return out.select("label", "round_num", r6("speedup").alias("speedup"), r6("ms_per_prompt_token").alias("ms_per_prompt_token"))
