"""Liveness, status and streaming (K1-K6). Streams are drained and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybook.catalog.aggregates import _FLEET, _RUNS_SQL, _runs
from waybook.catalog.registry import query
from waybook.catalog.tables import CALLS_SQL, TS, calls, r6
from waybook.operators import report
from waybook.sources import scratch
from waybook.streaming import keyed, streams
from waybook.streaming.buckets import Buckets

_TIMEOUT = 6 * 3600
_STATUS = "CASE tool WHEN 'error' THEN 'OFFLINE' WHEN 'signup' THEN 'LOADING' WHEN 'view' THEN NULL ELSE 'READY' END AS status"


def _worker_events(spark, sf):
    """users are workers, a signup registers, anything else is a heartbeat"""
    return calls(spark, sf, TS).selectExpr(
        "traj AS worker_id", "seq", "ts", "if(tool = 'signup', 'register', 'heartbeat') AS kind", "tool"
    )


_SPANS = f"""{CALLS_SQL}, e AS (SELECT traj AS w, seq, ts, epoch_us(ts) AS us, tool = 'signup' AS reg FROM calls),
g AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY w ORDER BY seq) > {_TIMEOUT} * 1000000::BIGINT, true)::INT AS gap FROM e),
s AS (SELECT *, sum(gap) OVER (PARTITION BY w ORDER BY seq) AS span FROM g)"""


@query(
    "k1_progress_stream",
    """SELECT event_type AS tool, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 100) AS timed,
      round(coalesce(sum(value) FILTER (value > 100), 0), 6) AS seconds FROM events GROUP BY 1""",
)
def k1_progress_stream(spark, sf):
    path, out, state = (scratch.folder(spark, x) for x in ("log", "snapshots", "state"))
    rows = calls(spark, sf).selectExpr("tool", "if(tool = 'error', 'error', 'success') AS status", "if(value > 100, value, 0) AS latency_s")
    rows.repartition(4).write.json(path)
    log = streams.growing_log(spark, path, "tool string, status string, latency_s double", 2)
    streams.snapshots(streams.tool_progress(log), out, state).awaitTermination()
    return streams.latest_snapshot(spark, out, ["tool"]).withColumn("seconds", r6("seconds"))


@query(
    "k1_question_stream",
    f"""WITH {_RUNS_SQL} SELECT count(*) AS n, count(DISTINCT qid) AS questions, max(traj_idx) + 1 AS attempts, count(*) FILTER (boxed_answer <> '') AS boxed,
      count(*) FILTER (status = 'error') AS errors, round(avg(latency_s) FILTER (latency_s > 0), 6) AS avg_s,
      round((5000000 - count(*)) * avg(latency_s) FILTER (latency_s > 0) / 32 / 60, 6) AS eta_min FROM runs""",
)
def k1_question_stream(spark, sf):
    path, out, state = (scratch.folder(spark, x) for x in ("runs", "questions", "state"))
    _runs(spark, sf).repartition(3).write.json(path)
    log = streams.growing_log(spark, path, "qid string, traj_idx bigint, status string, boxed_answer string, latency_s double", 1)
    streams.snapshots(streams.question_progress(log), out, state).awaitTermination()
    return streams.overall_progress(streams.latest_snapshot(spark, out, ["qid"]), 5_000_000).withColumns({c: r6(c) for c in ("avg_s", "eta_min")})


@query(
    "k2_liveness",
    f"""WITH {_SPANS}, f AS (SELECT *, min(seq) FILTER (reg) OVER (PARTITION BY w, span) AS r, lead(us) OVER (PARTITION BY w ORDER BY seq) AS nxt FROM s)
    SELECT w AS worker_id, seq, coalesce(seq >= r, false) AS accepted,
      CASE WHEN seq >= r AND coalesce(nxt, (SELECT max(us) FROM e)) - us > {_TIMEOUT} * 1000000::BIGINT THEN us + {_TIMEOUT} * 1000000::BIGINT END AS offline_us FROM f""",
)
def k2_liveness(spark, sf):
    events = _worker_events(spark, sf)
    end = events.agg(F.max("ts")).scalar()
    out = report.liveness(events, "seq", _TIMEOUT, end)
    return out.select("worker_id", "seq", "accepted", F.unix_micros("offline_at").alias("offline_us"))


_LIVES = f"""WITH {_SPANS}, a AS (
  SELECT w AS worker_id, min(us) AS first_us, min(us) FILTER (reg) AS registered_us, max(us) AS last_us, count(*) AS events FROM s GROUP BY w, span)
SELECT *, CASE WHEN registered_us IS NOT NULL THEN last_us + {_TIMEOUT} * 1000000::BIGINT END AS offline_us FROM a"""


def _micros(lives):
    return lives.select(
        "worker_id", "events", *[F.unix_micros(c).alias(n) for c, n in
                                 (("first_seen", "first_us"), ("registered", "registered_us"), ("last_seen", "last_us"), ("offline_at", "offline_us"))]
    )


@query("k2_worker_lives", _LIVES)
def k2_worker_lives(spark, sf):
    return _micros(report.worker_lives(_worker_events(spark, sf), "seq", _TIMEOUT))


@query("k2_worker_lives_stream", _LIVES)
def k2_worker_lives_stream(spark, sf):
    path, out, state = (scratch.folder(spark, x) for x in ("beats", "lives", "state"))
    _worker_events(spark, sf).select("worker_id", "ts", "kind").repartition(3).write.parquet(path)
    beats = streams.growing_log(spark, path, "worker_id bigint, ts timestamp, kind string", 1, fmt="parquet")
    streams.worker_lives(beats, out, state, _TIMEOUT).awaitTermination()
    return _micros(streams.current_lives(spark, out, _TIMEOUT))


@query(
    "k3_status_changes",
    f"""WITH {CALLS_SQL}, s AS (SELECT * FROM (SELECT traj AS worker_id, seq, {_STATUS} FROM calls) WHERE status IS NOT NULL),
    l AS (SELECT *, lag(status) OVER (PARTITION BY worker_id ORDER BY seq) AS old_status FROM s)
    SELECT worker_id, seq, old_status, status FROM l WHERE old_status IS NOT NULL AND old_status <> status""",
)
def k3_status_changes(spark, sf):
    events = calls(spark, sf).selectExpr("traj AS worker_id", "seq", _STATUS)
    return report.status_changes(events, ["worker_id"], "seq").select("worker_id", "seq", "old_status", "status")


@query(
    "k4_failed_nodes",
    f"""WITH {_SPANS}, w AS (SELECT w, max(us) FILTER (span = m) AS last, bool_or(reg) FILTER (span = m) AS r FROM (SELECT *, max(span) OVER (PARTITION BY w) AS m FROM s) GROUP BY w)
    SELECT 'n' || (w % 40) AS node_id, count(*) AS workers, bool_and(NOT r OR (SELECT max(us) FROM e) - last > {_TIMEOUT} * 1000000::BIGINT) AS failed FROM w GROUP BY 1""",
)
def k4_failed_nodes(spark, sf):
    events = _worker_events(spark, sf)
    end = events.agg(F.max("ts")).scalar()
    latest = report.worker_lives(events, "seq", _TIMEOUT).groupBy("worker_id").agg(F.max_by("offline_at", "last_seen").alias("offline_at"))
    offline = F.col("offline_at").isNull() | (F.col("offline_at") < end)
    return report.failed_nodes(latest.select(F.concat(F.lit("n"), (F.col("worker_id") % 40).cast("string")).alias("node_id"), "worker_id", offline.alias("offline")))


@query("k5_upserted", f"WITH {CALLS_SQL} SELECT traj, k, max(seq) AS seq, arg_max(tool, seq) AS tool FROM calls GROUP BY traj, k")
def k5_upserted(spark, sf):
    path, out, state = (scratch.folder(spark, x) for x in ("records", "table", "state"))
    calls(spark, sf).select("traj", "k", "seq", "tool").repartition(4).write.json(path)
    log = streams.growing_log(spark, path, "traj bigint, k int, seq bigint, tool string", 1)
    streams.upsert(log, ["traj", "k"], ["seq"], out, state).awaitTermination()
    return streams.current(spark, out, ["traj", "k"], ["seq"])


@query(
    "k6_first_chunk",
    f"""WITH {CALLS_SQL}, c AS (SELECT traj, seq // 500 AS request, epoch_us(ts) AS us, tool IN ('click') AS filled FROM calls),
    f AS (SELECT traj, request, min(us) AS a, max(us) AS z, min(us) FILTER (filled) AS f FROM c GROUP BY 1, 2)
    SELECT traj, request, round((coalesce(f, z) - a) / 1000.0, 6) AS ttft_ms, round((z - a) / 1000000.0, 6) AS total_time_s FROM f""",
)
def k6_first_chunk(spark, sf):
    chunks = calls(spark, sf, TS).selectExpr("traj", "seq div 500 AS request", "ts", "if(tool = 'click', tool, '') AS text")
    out = report.first_chunk(chunks, ["traj", "request"], "ts", "text")
    return out.withColumns({c: r6(F.col(c).cast("double")) for c in ("ttft_ms", "total_time_s")})


@query(
    "k3_status_stream",
    f"""WITH {CALLS_SQL}, s AS (SELECT * FROM (SELECT traj AS worker_id, seq, {_STATUS} FROM calls) WHERE status IS NOT NULL),
    l AS (SELECT *, lag(status) OVER (PARTITION BY worker_id ORDER BY seq) AS old_status FROM s)
    SELECT worker_id, seq, old_status, status FROM l WHERE old_status IS NOT NULL AND old_status <> status""",
)
def k3_status_stream(spark, sf):
    path, out, state = (scratch.folder(spark, x) for x in ("status", "changes", "state"))
    calls(spark, sf).selectExpr("traj AS worker_id", "seq", _STATUS).repartition(3).write.parquet(path)
    log = streams.growing_log(spark, path, "worker_id bigint, seq bigint, status string", 1, fmt="parquet")
    streams.status_log(log, out, state).awaitTermination()
    return streams.status_changes(spark, out)


def _beats(spark, sf):
    """Worker events as a stream of files, each of which holds events of all times."""
    path = scratch.folder(spark, "beats")
    _worker_events(spark, sf).select("worker_id", "ts", "kind").repartition(3).write.parquet(path)
    return streams.growing_log(spark, path, "worker_id bigint, ts timestamp, kind string", 1, fmt="parquet")


@query(
    "k2_liveness_stream",
    f"""WITH {_SPANS}, f AS (SELECT *, min(seq) FILTER (reg) OVER (PARTITION BY w, span) AS r FROM s)
    SELECT w AS worker_id, min(us) AS first_us, min(us) FILTER (reg) AS registered_us, max(us) AS last_us, count(*) AS events, count(*) FILTER (seq >= r) AS accepted,
      CASE WHEN bool_or(reg) THEN max(us) + {_TIMEOUT} * 1000000::BIGINT END AS offline_us FROM f GROUP BY w, span""",
)
def k2_liveness_stream(spark, sf):
    out, state = (scratch.folder(spark, x) for x in ("spans", "state"))
    keyed.worker_spans(_beats(spark, sf), out, state, _TIMEOUT).awaitTermination()
    lives = keyed.current_spans(spark, out, _TIMEOUT)
    return _micros(lives).join(lives.select("worker_id", F.unix_micros("first_seen").alias("first_us"), "accepted"), ["worker_id", "first_us"])


@query(
    "k3_changes_stream",
    f"""WITH {CALLS_SQL}, s AS (SELECT * FROM (SELECT traj AS worker_id, seq, {_STATUS} FROM calls) WHERE status IS NOT NULL),
    l AS (SELECT *, lag(status) OVER (PARTITION BY worker_id ORDER BY seq) AS old_status FROM s)
    SELECT worker_id, seq, old_status, status FROM l WHERE old_status IS NOT NULL AND old_status <> status""",
)
def k3_changes_stream(spark, sf):
    path, out, state = (scratch.folder(spark, x) for x in ("status", "changes", "state"))
    calls(spark, sf, TS).selectExpr("traj AS worker_id", "seq", "ts", _STATUS).repartition(3).write.parquet(path)
    log = streams.growing_log(spark, path, "worker_id bigint, seq bigint, ts timestamp, status string", 1, fmt="parquet")
    keyed.status_changes(log, out, state).awaitTermination()
    return keyed.current_changes(spark, out)


@query(
    "k4_failed_nodes_stream",
    f"""WITH {_SPANS}, w AS (SELECT w, max(us) FILTER (span = m) AS last, bool_or(reg) FILTER (span = m) AS r FROM (SELECT *, max(span) OVER (PARTITION BY w) AS m FROM s) GROUP BY w)
    SELECT 'n' || (w % 40) AS node_id, count(*) AS workers, bool_and(NOT r OR (SELECT max(us) FROM e) - last > {_TIMEOUT} * 1000000::BIGINT) AS failed FROM w GROUP BY 1""",
)
def k4_failed_nodes_stream(spark, sf):
    """Two streams in a chain: spans of workers, then nodes over what the first one writes."""
    spans, out, *states = (scratch.folder(spark, x) for x in ("spans", "nodes", "state", "state"))
    keyed.worker_spans(_beats(spark, sf), spans, states[0], _TIMEOUT).awaitTermination()
    schema = "worker_id bigint, first_us bigint, last_us bigint, registered_us bigint, accepted bigint, events bigint, gone boolean, closed boolean"
    log = streams.growing_log(spark, f"{spans}/*", schema, fmt="parquet")
    node = F.concat(F.lit("n"), (F.col("worker_id") % 40).cast("string"))
    keyed.node_lives(log.withColumn("node_id", node), out, states[1], _TIMEOUT).awaitTermination()
    return keyed.failed_nodes(spark, out, _worker_events(spark, sf).agg(F.max(F.unix_micros("ts"))).scalar())


@query(
    "e23_fleet_stream",
    f"""WITH {CALLS_SQL}, w AS (SELECT traj, arg_max(tool, seq) AS tool FROM calls GROUP BY 1), s AS (SELECT {_FLEET} FROM w)
    SELECT count(*) AS total_workers, count(*) FILTER (status = 'READY') AS ready_workers,
      count(*) FILTER (status = 'LOADING') AS loading_workers, count(*) FILTER (status = 'OFFLINE') AS offline_workers FROM s""",
)
def e23_fleet_stream(spark, sf):
    path, out, state = (scratch.folder(spark, x) for x in ("status", "fleet", "state"))
    calls(spark, sf).selectExpr("traj AS worker_id", "seq", _FLEET).repartition(3).write.parquet(path)
    log = streams.growing_log(spark, path, "worker_id bigint, seq bigint, status string", 1, fmt="parquet")
    keyed.latest_statuses(log, "worker_id", out, state).awaitTermination()
    return keyed.fleet(spark, out)


@query("k5_bucketed", f"WITH {CALLS_SQL} SELECT traj, k, max(seq) AS seq, arg_max(tool, seq) AS tool FROM calls GROUP BY traj, k")
def k5_bucketed(spark, sf):
    """Four batches, compacted between them, read as a whole."""
    path, out, state = (scratch.folder(spark, x) for x in ("records", "table", "state"))
    rows = calls(spark, sf).select("traj", "k", "seq", "tool")
    rows.repartition(4).write.json(path)
    records = Buckets(out, "traj bigint, k int, seq bigint, tool string", ["traj", "k"], ["seq"], 16)
    records.upsert(streams.growing_log(spark, path, "traj bigint, k int, seq bigint, tool string", 1), state).awaitTermination()
    records.compact(spark, 2)
    return records.current(spark)


@query(
    "k6_first_chunk_stream",
    f"""WITH {CALLS_SQL}, c AS (SELECT traj, seq // 500 AS request, epoch_us(ts) AS us, tool IN ('click') AS filled FROM calls),
    f AS (SELECT traj, request, min(us) AS a, max(us) AS z, min(us) FILTER (filled) AS f FROM c GROUP BY 1, 2)
    SELECT traj, request, round((coalesce(f, z) - a) / 1000.0, 6) AS ttft_ms, round((z - a) / 1000000.0, 6) AS total_time_s FROM f""",
)
def k6_first_chunk_stream(spark, sf):
    """Chunks of a request come in any file; a batch writes the requests it changed."""
    path, out, state = (scratch.folder(spark, x) for x in ("chunks", "requests", "state"))
    chunks = calls(spark, sf, TS).selectExpr("traj", "seq div 500 AS request", "ts", "if(tool = 'click', tool, '') AS text")
    chunks.repartition(3).write.parquet(path)
    log = streams.growing_log(spark, path, "traj bigint, request bigint, ts timestamp, text string", 1, fmt="parquet")
    streams.snapshots(report.first_chunk(log, ["traj", "request"], "ts", "text"), out, state).awaitTermination()
    made = streams.latest_snapshot(spark, out, ["traj", "request"])
    return made.withColumns({c: r6(F.col(c).cast("double")) for c in ("ttft_ms", "total_time_s")})
