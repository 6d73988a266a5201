"""The given tables in the shapes the operators read.

documents are attempts (question = source and language, attempt = document),
labels are verdicts, events are tool calls or worker events, conversations are
turns, pages are search results and fetched pages, benchmark holds markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybook.sources.tables import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table with long texts, spread over the cores by its id."""
    key = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}[name]
    return spread(table(spark, sf, name), key)


# The files hold wall-clock times without a zone; they count as UTC whatever the session's zone is.
TS = "cast(convert_timezone('UTC', current_timezone(), ts) AS timestamp) AS ts"
QID = "concat(source, ':', lang)"


def attempts(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(f"{QID} AS qid", "doc_id AS traj_idx", *more)


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts by question and attempt; documents without a label have none."""
    labels = table(spark, sf, "labels").selectExpr("doc_id AS traj_idx", "quality = 1 AS correct", "concat('t', toxic) AS explanation")
    return attempts(spark, sf).join(labels, "traj_idx").select("qid", "traj_idx", "correct", "explanation")


def judged(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    labels = table(spark, sf, "labels").selectExpr("doc_id AS traj_idx", "quality = 1 AS correct")
    return attempts(spark, sf, *more).join(labels, "traj_idx", "left")


def calls(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "user_id AS traj", "event_id AS seq", "event_type AS tool", "value", "cast(get_json_object(props, '$.k') AS int) AS k", *more
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr("conv_id AS traj", "turn AS pos", "role", "text AS content")


def r6(c: Column | str) -> Column:
    """Doubles from different summation orders agree to 6 digits."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# SQL fragments shared by the oracles
JUDGED_SQL = f"""
judged AS (
  SELECT {QID} AS qid, d.doc_id AS traj_idx, d.*, coalesce(l.quality = 1, false) AS correct, l.toxic
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
CALLS_SQL = """
calls AS (
  SELECT user_id AS traj, event_id AS seq, event_type AS tool, value, ts,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""
