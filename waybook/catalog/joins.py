"""Joins (D1-D11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybook.catalog.aggregates import _ROUNDS_SQL, _samples
from waybook.catalog.registry import query
from waybook.catalog.tables import CALLS_SQL, JUDGED_SQL, QID, attempts, calls, r6, table, texts, turns, verdicts
from waybook.operators import audit, context, plan, report, score, select
from waybook.operators.conversation import used_tools


@query(
    "d1_pending",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def d1_pending(spark, sf):
    return plan.pending(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("d2_expand", f"SELECT DISTINCT {QID} AS qid, t::INT AS traj_idx FROM documents, range(4) r(t)")
def d2_expand(spark, sf):
    return plan.expand(attempts(spark, sf).select("qid").distinct(), 4)


@query("d3_correct_attempts", f"WITH {JUDGED_SQL} SELECT qid, traj_idx FROM judged WHERE correct")
def d3_correct_attempts(spark, sf):
    return select.correct_attempts(attempts(spark, sf), verdicts(spark, sf))


@query(
    "d4_correct_questions",
    f"WITH {JUDGED_SQL} SELECT qid, traj_idx FROM judged WHERE qid IN (SELECT qid FROM judged WHERE correct)",
)
def d4_correct_questions(spark, sf):
    return select.correct_questions(attempts(spark, sf), verdicts(spark, sf))


@query(
    "d5_with_verdicts",
    f"""WITH {JUDGED_SQL} SELECT qid, traj_idx, correct, CASE WHEN toxic IS NULL THEN '' ELSE 't' || toxic END AS judge_explanation,
      round(coalesce(sum(correct::INT) OVER (PARTITION BY qid) / nullif(count(toxic) OVER (PARTITION BY qid), 0), 0.0), 6) AS question_accuracy FROM judged""",
)
def d5_with_verdicts(spark, sf):
    v = verdicts(spark, sf)
    out = score.with_verdicts(attempts(spark, sf), v, score.per_question(v))
    return out.withColumn("question_accuracy", r6("question_accuracy"))


def _truth(spark, sf):
    rows = table(spark, sf, "documents").where("lang <> 'es'")
    truth = rows.selectExpr(f"concat(' ', {QID}, if(doc_id % 2 = 0, '\\n', '')) AS question", "md5(text) AS answer", "doc_id")
    return score.ground_truth(truth, "doc_id")


def _records(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", f"concat('\\t', {QID}, '  ') AS question")


@query(
    "d6_ground_truth",
    f"""WITH t AS (SELECT {QID} AS q, arg_max(md5(text), doc_id) AS correct_answer FROM documents WHERE lang <> 'es' GROUP BY 1)
    SELECT doc_id, correct_answer FROM documents d JOIN t ON concat(d.source, ':', d.lang) = t.q""",
)
def d6_ground_truth(spark, sf):
    return score.match_ground_truth(_records(spark, sf), _truth(spark, sf), ["doc_id"]).select("doc_id", "correct_answer")


@query("d6_unmatched", "SELECT doc_id FROM documents WHERE lang = 'es'")
def d6_unmatched(spark, sf):
    return score.match_ground_truth(_records(spark, sf), _truth(spark, sf), ["doc_id"], "left_anti").select("doc_id")


_DOTTED = {"click": "browser.search", "view": "functions.web", "signup": "functions.run", "purchase": "python.execute", "error": "error"}


@query(
    "d7_tool_names",
    """SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'web_search' WHEN 'view' THEN 'web_search' WHEN 'purchase' THEN 'python' WHEN 'error' THEN 'error' END AS mapped,
      CASE event_type WHEN 'click' THEN 'web_search' WHEN 'view' THEN 'open_url' ELSE event_type END AS kept FROM events""",
)
def d7_tool_names(spark, sf):
    from waybook import constants as K

    rows = calls(spark, sf)
    foreign = {"click": "serper_google_webpage_search", "view": "serper_fetch_webpage_content"}
    return rows.select(
        "seq",
        select.map_names(select.map_names(F.col("tool"), _DOTTED), K.CHANNEL_TOOL_NAMES, drop_dotted=True).alias("mapped"),
        select.map_names(select.map_names(F.col("tool"), foreign), K.FOREIGN_TOOL_NAMES).alias("kept"),
    )


DEFINITIONS = {"view": '{"name": "view"}', "click": '{"name": "click"}', "error": '{"name": "error"}'}


@query(
    "d8_used_tools",
    """SELECT user_id AS traj, '[' || string_agg(DISTINCT '{"name": "' || event_type || '"}', ', ' ORDER BY '{"name": "' || event_type || '"}') || ']' AS tools
    FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1""",
)
def d8_used_tools(spark, sf):
    return used_tools(calls(spark, sf), ["traj"], "tool", DEFINITIONS)


def _browser_calls(spark, sf):
    """click = search that got the event id as cursor, view = page that got one, error = open by id."""
    return calls(spark, sf).selectExpr(
        "traj", "seq", "CASE tool WHEN 'click' THEN 'search' WHEN 'view' THEN 'page' WHEN 'error' THEN 'open' END AS op",
        "if(tool IN ('click', 'view'), seq, NULL) AS new_cursor",
        "CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE seq - traj END AS cursor",
        "CASE WHEN k = 9 THEN '\"https://x.org/1\"' WHEN k = 8 THEN '\"2\"' ELSE cast(k AS string) END AS id",
    )


@query(
    "d9_resolved_links",
    f"""WITH {CALLS_SQL}, m AS (
      SELECT *, last_value(CASE WHEN tool IN ('click', 'view') THEN seq END IGNORE NULLS) OVER (
        PARTITION BY traj ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM calls),
    o AS (SELECT traj, seq, k, CASE WHEN k = 9 THEN '"https://x.org/1"' WHEN k = 8 THEN '"2"' ELSE k::VARCHAR END AS id,
            CASE WHEN k = 9 THEN NULL WHEN k % 4 = 3 AND seq - traj NOT IN (0, -1) THEN seq - traj ELSE latest END AS used_cursor FROM m WHERE tool = 'error'),
    r AS (SELECT traj, seq AS cursor, unnest(generate_series(1, k)) AS id FROM calls WHERE tool = 'click' AND k > 0)
    SELECT o.traj, o.seq, o.id, used_cursor,
           CASE WHEN k = 9 THEN 'https://x.org/1' WHEN k <> 8 THEN 'u' || r.cursor || '-' || r.id END AS url,
           CASE WHEN k = 9 THEN false WHEN k <> 8 THEN r.id IS NULL ELSE true END AS not_found
    FROM o LEFT JOIN r ON o.traj = r.traj AND o.used_cursor = r.cursor AND o.k = r.id AND k NOT IN (8, 9)""",
)
def d9_resolved_links(spark, sf):
    found = calls(spark, sf).where("tool = 'click' AND k > 0").selectExpr("traj", "seq AS cursor", "explode(sequence(1L, bigint(k))) AS id")
    results = found.selectExpr("*", "concat('u', cursor, '-', id) AS url")
    return context.resolve_links(_browser_calls(spark, sf), results, ["traj"], "seq")


@query(
    "d10_contaminated",
    "SELECT doc_id, EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text)) AS contaminated FROM documents d",
)
def d10_contaminated(spark, sf):
    docs = texts(spark, sf, "documents").select("doc_id", "text")
    return audit.contaminated_by(docs, "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text").drop("text")


@query(
    "d10_contaminated_short_markers",
    """WITH m AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN array_to_string(string_split(text, ' ')[1:3], ' ') ELSE substr(text, 3, 9) END AS marker FROM benchmark)
    SELECT doc_id, item_id FROM documents d JOIN m ON contains(d.text, m.marker)""",
)
def d10_contaminated_short_markers(spark, sf):
    words = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    marker = F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, words).otherwise(F.substring("text", 3, 9))
    markers = table(spark, sf, "benchmark").select("item_id", marker.alias("marker"))
    docs = texts(spark, sf, "documents").select("doc_id", "text")
    return audit.containing(docs, "doc_id", "text", markers, "item_id", "marker")


@query(
    "d10_marker_list",
    "SELECT conv_id AS traj, bool_or(role = 'assistant' AND (contains(text, 'heron') OR contains(text, 'eau de '))) AS contaminated FROM conversations GROUP BY 1",
)
def d10_marker_list(spark, sf):
    rows = turns(spark, sf).withColumn("role", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")))
    return audit.contaminated_keys(rows, ["traj"], ["heron", "eau de "])


@query(
    "d11_ab",
    f"""WITH {_ROUNDS_SQL.replace("FROM samples GROUP BY 1)", "FROM samples WHERE tool IN ('click', 'view') GROUP BY 1, tool)").replace("SELECT round_num, arg_min", "SELECT tool, round_num, arg_min").replace("GROUP BY 1, tool", "GROUP BY tool, round_num")}
    SELECT a.round_num, round(a.ttft_ms, 6) AS on_ms, round(b.ttft_ms, 6) AS off_ms, round(b.ttft_ms / greatest(a.ttft_ms, 0.001), 6) AS speedup
    FROM rounds a JOIN rounds b USING (round_num) WHERE a.tool = 'click' AND b.tool = 'view'""",
)
def d11_ab(spark, sf):
    on, off = (report.rounds(_samples(spark, sf, f"tool = '{t}'")) for t in ("click", "view"))
    out = report.ab(on, off)
    return out.withColumns({c: r6(c) for c in ("on_ms", "off_ms", "speedup")})


@query(
    "d11_ab_overall",
    """WITH r AS (SELECT event_type AS tool, CAST(json_extract_string(props, '$.k') AS INT) % 6 + 1 AS round_num, avg(value) AS v FROM events GROUP BY 1, 2),
    w AS (SELECT avg(v) FILTER (tool = 'click') AS a, avg(v) FILTER (tool = 'view') AS b FROM r WHERE round_num > 1)
    SELECT round(a, 6) AS on_ms, round(b, 6) AS off_ms, round(b / greatest(a, 0.001), 6) AS speedup FROM w""",
)
def d11_ab_overall(spark, sf):
    on, off = (report.rounds(_samples(spark, sf, f"tool = '{t}'")) for t in ("click", "view"))
    out = report.ab_overall(on, off)
    return out.select(*[r6(c).alias(c) for c in out.columns])
