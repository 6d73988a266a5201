"""Scans and sinks (A1-A10, B1-B6): table rows are written in the source's format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybook.catalog.registry import query
from waybook.catalog.tables import CALLS_SQL, JUDGED_SQL, calls, judged, r6, table, turns
from waybook.operators import audit, conversation, plan, report, score, select
from waybook.plans.card import card
from waybook.sources import scratch, tables, tail
from waybook.streaming import streams


@query("a1_strict_jsonl", "SELECT conv_id AS traj, turn AS pos, role, text AS content FROM conversations")
def a1_strict_jsonl(spark, sf):
    path = scratch.folder(spark, "jsonl")
    turns(spark, sf).write.json(path)
    return tables.read_jsonl(spark, path, "traj bigint, pos bigint, role string, content string")


@query(
    "a2_lenient_jsonl",
    "SELECT user_id AS qid, event_id AS seq, event_type AS tool FROM events WHERE event_id % 10 <> 0 AND event_id % 7 <> 0",
)
def a2_lenient_jsonl(spark, sf):
    rows = calls(spark, sf)
    whole = F.to_json(F.struct(F.col("traj").alias("qid"), "seq", "tool"))
    line = F.when(F.col("seq") % 10 == 0, F.left(whole, F.length(whole) - 3)).when(F.col("seq") % 7 == 0, F.to_json(F.struct("seq", "tool"))).otherwise(whole)
    path = scratch.folder(spark, "lines")
    rows.select(line.alias("value")).write.text(path)
    return tables.read_jsonl_lenient(spark, path, "qid bigint, seq bigint, tool string")


@query(
    "a3_result_files",
    f"""WITH {JUDGED_SQL} SELECT qid, traj_idx, correct, round(avg(correct::INT) OVER (PARTITION BY qid), 6) AS accuracy FROM judged""",
)
def a3_result_files(spark, sf):
    rows = judged(spark, sf).withColumn("correct", F.coalesce("correct", F.lit(False)))
    nested = score.answers(rows, fields=["correct"]).join(score.per_question(rows), "qid")
    result = nested.select(F.array(F.struct("qid", "num_correct", "accuracy", "pass", "answers")).alias("per_question"))
    path = scratch.folder(spark, "results")
    result.write.json(path)
    # One object per line here; a result file of the original tool is one multi-line object.
    read = spark.read.schema(tables.RESULT_SCHEMA).json(path)
    return tables.result_answers(read).select("qid", "traj_idx", "correct", r6("accuracy").alias("accuracy"))


@query("a4_question_set", "SELECT doc_id, substr(md5(text), 1, 8) AS qid, text AS question, lang AS reference_answer FROM documents")
def a4_question_set(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", "text AS query", "lang AS answer")
    return tables.questions(rows).select("doc_id", "qid", "question", "reference_answer")


@query(
    "a5_training_questions",
    "SELECT CASE WHEN doc_id % 4 = 0 THEN 'd' || doc_id ELSE (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR END AS id, source AS question, lang AS answer FROM documents",
)
def a5_training_questions(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", "if(doc_id % 4 = 0, concat('d', doc_id), NULL) AS qid", "source AS input", "lang AS target")
    return tables.training_questions(plan.indexed(rows, "doc_id"), F.col("index"))


@query("a6_named_split", "SELECT page_id, url FROM pages")
def a6_named_split(spark, sf):
    root, name = sf.rstrip("/").rsplit("/", 1)
    return tables.read_split(spark, root, name, "pages.parquet").select("page_id", "url")


@query("a7_shards", "SELECT event_id AS seq, event_type AS tool, (event_id % 4)::INT AS rank FROM events")
def a7_shards(spark, sf):
    path = scratch.folder(spark, "shards")
    for rank in range(4):
        calls(spark, sf).where(f"seq % 4 = {rank}").select("seq", "tool").write.json(f"{path}/node_{rank}.jsonl")
    return tables.read_shards(spark, path, "seq bigint, tool string")


@query(
    "a8_reused_verdicts",
    "SELECT d.doc_id, l.quality = 1 AS correct, l.doc_id IS NULL AS pending FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def a8_reused_verdicts(spark, sf):
    path = scratch.folder(spark, "verdicts")
    table(spark, sf, "labels").selectExpr("doc_id", "quality = 1 AS correct").write.json(path)
    kept = tables.verdict_files(spark, path, "doc_id bigint, correct boolean", one_per_file=False).drop("source_id")
    docs = table(spark, sf, "documents").select("doc_id")
    pending = plan.pending(docs, kept, ["doc_id"]).select("doc_id", F.lit(None).cast("boolean").alias("correct"), F.lit(True).alias("pending"))
    return kept.withColumn("pending", F.lit(False)).unionByName(pending)


@query(
    "a9_gauges",
    f"""WITH {CALLS_SQL} SELECT 'w' || traj AS worker, arg_max(value, seq) FILTER (tool = 'click') AS running, arg_max(value, seq) FILTER (tool = 'view') AS waiting,
      round(arg_max(value, seq) FILTER (tool = 'error') * 100, 6) AS cache_pct FROM calls WHERE tool IN ('click', 'view', 'error') GROUP BY 1""",
)
def a9_gauges(spark, sf):
    prefix = (
        "CASE tool WHEN 'click' THEN 'vllm:num_requests_running{engine=\"0\"} ' WHEN 'view' THEN 'vllm:num_requests_waiting{} ' "
        "WHEN 'error' THEN 'vllm:kv_cache_usage_perc{} ' ELSE '# HELP ' END"
    )
    lines = calls(spark, sf).selectExpr("concat('w', traj) AS worker", "seq AS line_no", f"concat({prefix}, value, '  ') AS line")
    return report.gauges(lines).withColumn("cache_pct", r6("cache_pct"))


@query("a10_growing_log", "SELECT event_id AS seq, event_type AS tool, value FROM events")
def a10_growing_log(spark, sf):
    path, out, state = (scratch.folder(spark, x) for x in ("log", "drained", "state"))
    calls(spark, sf).select("seq", "tool", "value").repartition(4).write.json(path)
    schema = "seq bigint, tool string, value double"
    streams.append_to(streams.growing_log(spark, path, schema, 2), out, state).awaitTermination()
    return spark.read.schema(schema).parquet(out)


@query("a10_tailed_log", "SELECT event_id AS seq, event_type AS tool, value FROM events")
def a10_tailed_log(spark, sf):
    """Files that grow between two runs of the stream, each with a line cut in two at the border."""
    path, out, state = (scratch.folder(spark, x) for x in ("log", "drained", "state"))
    rows = calls(spark, sf).select("seq", F.to_json(F.struct("seq", "tool", "value")).alias("line"))
    rows.repartition(3, "seq").sortWithinPartitions("seq").select("line").write.text(path)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema, log = "seq bigint, tool string, value double", f"{path}-live"

    def grow(whole):
        def run(it):
            for batch in it:
                for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    half = len(data) // 2 + 3
                    tail.append(f"{log}/{file.rsplit('/', 1)[1]}", data[half:] if whole else data[:half], half if whole else 0)
                yield batch.select(["path"])

        files.mapInArrow(run, "path string").count()

    for whole in (False, True):
        grow(whole)
        made = tail.tailed_log(spark, log, schema, ["seq"], width=1 << 16).drop("file", "at")
        streams.append_to(made, out, state).awaitTermination()
    return spark.read.schema(schema).parquet(out)


# ---- sinks ---------------------------------------------------------------------


@query("b1_appended_jsonl", "SELECT conv_id AS traj, turn AS pos, role FROM conversations")
def b1_appended_jsonl(spark, sf):
    path = scratch.folder(spark, "append")
    rows = turns(spark, sf).select("traj", "pos", "role")
    tables.append_jsonl(rows.where("traj % 2 = 0"), path)
    tables.append_jsonl(rows.where("traj % 2 = 1"), path)
    return tables.read_jsonl(spark, path, "traj bigint, pos bigint, role string")


@query(
    "b2_conversation_dataset",
    "SELECT conv_id AS traj, count(*)::INT AS n, CAST(sum(length(text)) AS BIGINT) AS chars, '' AS tools FROM conversations GROUP BY 1",
)
def b2_conversation_dataset(spark, sf):
    rows = turns(spark, sf).select("traj", "pos", F.col("role").alias("from"), F.col("content").alias("value"))
    path = scratch.folder(spark, "dataset")
    tables.write_conversations(conversation.pack(rows, ["traj"]), path)
    read = spark.read.schema("traj bigint, conversations array<struct<from:string,value:string>>, tools string").json(path)
    chars = F.aggregate("conversations", F.lit(0).cast("bigint"), lambda a, t: a + F.length(t["value"]))
    return read.select("traj", F.size("conversations").alias("n"), chars.alias("chars"), "tools")


@query(
    "b3_summary_metrics",
    f"""WITH {JUDGED_SQL}, q AS (SELECT qid, count(*) AS n, sum(correct::INT) AS c FROM judged GROUP BY 1),
    s AS (SELECT count(*)::DOUBLE AS nq, sum(n)::DOUBLE AS nt, sum(c)::DOUBLE AS nc, sum((c > 0)::INT)::DOUBLE AS p, avg((c > 0)::INT) AS pk, avg(c / n) AS ak, sum(c) / sum(n) AS ta FROM q)
    SELECT unnest(['num_questions', 'total_trajectories', 'correct_trajectories', 'passed', 'pass@4', 'avg@4', 'trajectory_accuracy']) AS metric,
           round(unnest([nq, nt, nc, p, pk, ak, ta]), 6) AS value FROM s""",
)
def b3_summary_metrics(spark, sf):
    one = score.summary(score.per_question(judged(spark, sf)))
    return score.metrics(one, 4).withColumn("value", r6("value"))


@query(
    "b3_summary_json",
    f"""WITH {JUDGED_SQL}, q AS (SELECT qid, count(*) AS n, sum(correct::INT) AS c FROM judged GROUP BY 1),
    s AS (SELECT count(*)::DOUBLE AS nq, sum(n)::DOUBLE AS nt, sum(c)::DOUBLE AS nc, sum((c > 0)::INT)::DOUBLE AS p, avg((c > 0)::INT) AS pk, avg(c / n) AS ak, sum(c) / sum(n) AS ta FROM q)
    SELECT unnest(['num_questions', 'total_trajectories', 'correct_trajectories', 'passed', 'pass@4', 'avg@4', 'trajectory_accuracy']) AS metric,
           round(unnest([nq, nt, nc, p, pk, ak, ta]), 6) AS value FROM s""",
)
def b3_summary_json(spark, sf):
    """The fields of the JSON object, read back from its text."""
    text = score.summary_json(score.metrics(score.summary(score.per_question(judged(spark, sf))), 4))
    return text.select(F.explode(F.from_json("json", "map<string,double>")).alias("metric", "value")).withColumn("value", r6("value"))


@query(
    "b4_judge_csv",
    """SELECT doc_id AS query_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS predicted_answer,
      lang AS correct_answer, CASE WHEN doc_id % 5 > 0 THEN doc_id % 2 = 0 END AS judge_correct, true AS is_completed, doc_id % 5 = 0 AS parse_error FROM documents""",
)
def b4_judge_csv(spark, sf):
    rows = table(spark, sf, "documents").selectExpr(
        "doc_id AS query_id", "CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN '' END AS extracted_final_answer", "text AS response", "lang AS correct_answer",
        "if(doc_id % 5 > 0, doc_id % 2 = 0, NULL) AS correct", "true AS is_completed", "doc_id % 5 = 0 AS parse_error",
    )
    path = scratch.folder(spark, "csv")
    tables.write_csv(tables.judge_csv(rows), path)
    schema = "query_id bigint, predicted_answer string, correct_answer string, judge_correct boolean, is_completed boolean, parse_error boolean"
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def published(spark, sf):
    rows = judged(spark, sf, "source", "lang", "text", "n_chars").withColumns(
        {
            "correct": F.coalesce("correct", F.lit(False)), "judge_explanation": F.lit(""), "question_accuracy": F.lit(0.5),
            "contaminated": F.col("text").contains("ation"), "question": F.col("source"), "reference_answer": F.col("lang"),
            "boxed_answer": F.lit(None).cast("string"), "num_tool_calls": F.when(F.col("traj_idx") % 2 == 0, F.col("n_chars") % 7),
            "tool_calls": F.when(F.col("traj_idx") % 3 > 0, F.array(F.struct(F.col("traj_idx").alias("round"), F.col("lang").alias("tool")))),
            "latency_s": F.col("n_chars") / 2, "status": F.when(F.col("traj_idx") % 4 > 0, F.lit("success")),
            "conversation": F.when(F.col("n_chars") > 500, F.array(F.struct(F.lit("tool").alias("role"), F.col("text").alias("content")))),
        }
    )
    return tables.published(rows)


@query(
    "b5_published",
    f"""WITH {JUDGED_SQL} SELECT qid, traj_idx, source AS question, lang AS reference_answer, '' AS boxed_answer, correct, '' AS judge_explanation, 0.5::DOUBLE AS question_accuracy,
      contains(text, 'ation') AS contaminated, CASE WHEN traj_idx % 2 = 0 THEN n_chars % 7 ELSE 0 END AS num_tool_calls,
      CASE WHEN traj_idx % 3 > 0 THEN '[{{"round":' || traj_idx || ',"tool":"' || lang || '"}}]' ELSE '[]' END AS tool_calls, n_chars / 2 AS latency_s,
      CASE WHEN traj_idx % 4 > 0 THEN 'success' ELSE '' END AS status,
      CASE WHEN n_chars > 500 THEN '[{{"role":"tool","content":' || to_json(text)::VARCHAR || '}}]' END AS conversation FROM judged""",
)
def b5_published(spark, sf):
    path = scratch.folder(spark, "published")
    published(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


_CARD_COLUMNS = {"qid": "The question's id", "correct": "The verdict"}


@query(
    "b6_dataset_card",
    f"""WITH {JUDGED_SQL}, q AS (SELECT qid, count(*) AS n, sum(correct::INT) AS c FROM judged GROUP BY 1),
    s AS (SELECT count(*) AS nq, sum(n)::BIGINT AS nt, sum(c)::BIGINT AS nc, avg((c > 0)::INT) AS pk, avg(c / n) AS ak, sum(c) / sum(n) AS ta FROM q),
    u AS (SELECT CASE event_type WHEN 'click' THEN 'browser.search' WHEN 'view' THEN 'browser.open' ELSE 'functions.paper_search' END AS tool, count(*) AS n
      FROM events WHERE event_type IN ('click', 'view', 'signup') GROUP BY 1),
    t AS (SELECT tool, n, n / sum(n) OVER () AS p, row_number() OVER (ORDER BY n DESC, tool) AS i, sum(n) OVER ()::BIGINT AS total, count(*) OVER () AS k FROM u),
    e AS (SELECT any_value(total) AS total, any_value(k) AS k, printf('%.1f', any_value(total) / any_value(nt)) AS each FROM t, s),
    d AS (SELECT count(*) AS rows, count(*) FILTER (contains(text, 'ation')) AS bad, bool_or(n_chars > 500) AS conv FROM judged),
    l AS (
      SELECT unnest(['---', 'tags:', '- evaluation', '---', '', '# Attempts', '', 'About.', '', '## Results', '', '| Metric | Value |', '|---|---|',
        '| **pass@4** | **' || printf('%.1f', pk * 100) || '%** |', '| **avg@4** | **' || printf('%.1f', ak * 100) || '%** |',
        '| Trajectory accuracy | ' || printf('%.1f', ta * 100) || '% (' || nc || '/' || nt || ') |', '| Questions | ' || nq || ' |', '| Trajectories | ' || nt || ' (4 per question) |',
        '| Avg tool calls | ' || each || ' |', '| Full conversations | ' || CASE WHEN conv THEN 'yes' ELSE 'no' END || ' |', '', '## Setup', '', '|  |  |', '|---|---|', '| **Model** | m |',
        '', '## Tool usage', '', '| Tool | Calls | % |', '|---|--:|--:|']) AS line, generate_subscripts(range(31), 1) AS i FROM s, e, d
      UNION ALL SELECT '| `' || tool || '` | ' || format('{{:,}}', n) || ' | ' || CASE WHEN p * 100 < 1 THEN printf('%.1f', p * 100) ELSE printf('%.0f', round_even(p * 100, 0)) END || '% |', 31 + i FROM t
      UNION ALL SELECT unnest(['**Total: ' || format('{{:,}}', total) || ' tool calls** (' || each || ' per trajectory)', '', '**Contamination**: ' || bad || '/' || rows || ' trajectories flagged.',
        '', '## Columns', '', '| Column | Description |', '|---|---|', '| `qid` | The question''s id |', '| `correct` | The verdict |']), 31 + k + generate_subscripts(range(10), 1) FROM e, d)
    SELECT CAST(i - 1 AS INT) AS line_no, line FROM l""",
)
def b6_dataset_card(spark, sf):
    """The card, one row per line."""
    one = score.summary(score.per_question(judged(spark, sf)))
    names = {"click": "browser.search", "view": "browser.open", "signup": "functions.paper_search"}
    used = calls(spark, sf).select(select.map_names(F.col("tool"), names).alias("tool"))
    made = card(one, used, audit.audit(published(spark, sf)), "Attempts", 4, "About.", ["evaluation"], {"Model": "m"}, _CARD_COLUMNS)
    return made.select(F.posexplode(F.split("card", "\n")).alias("line_no", "line"))


@query("a4_question_ids", "SELECT doc_id::VARCHAR AS qid, text AS question, '' AS reference_answer FROM documents")
def a4_question_ids(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id AS id", "text AS question")
    return tables.questions(rows).select("qid", "question", "reference_answer")
