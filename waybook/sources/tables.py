"""Scans and sinks of question sets, trajectory logs and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybook.functions.strings import cut, strip
from waybook.operators.ordered import SEGMENT, running, segmented, tasks

RESULT_SCHEMA = (
    "model string, dataset string, split string, num_questions bigint, num_trajectories_per_q int, "
    "per_question array<struct<qid:string,question:string,reference:string,num_correct:bigint,accuracy:double,pass:boolean,"
    "answers:array<struct<traj_idx:bigint,answer:string,boxed_answer:string,correct:boolean,explanation:string,"
    "num_tools:bigint,time_s:double>>>>"
)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType, provenance: bool = False) -> DataFrame:
    """Strict scan: a line that is not the schema's JSON fails the job; blank lines are skipped."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file_path")) if provenance else rows


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores when the scan has fewer splits than there are cores.

    For costly per-row work on a small scan only: a scan with enough splits
    is left alone, so large inputs are never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str, rows: int = 1 << 13) -> DataFrame:
    """Rows that lie together by a key, of about ``rows`` or fewer a task.

    For rows that become many or wide before they are grouped by the key: dealt
    like this they are shuffled while they are narrow, and the grouping needs no other shuffle.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return df.repartition(n, key)


def parse_lines(lines: DataFrame, line: str, schema: str, required: Sequence[str] = ("qid",)) -> DataFrame:
    """Lenient scan of text lines: broken lines and lines without the required fields drop out.

    A line is read as the only item of an array, so trailing text breaks it.
    Repeated keys (the last one counts), ``NaN`` and lines of any length are read.
    """
    rest = [c for c in lines.columns if c != line]
    items = T.ArrayType(T.StructType.fromDDL(schema))
    whole = F.from_json(F.concat(F.lit("["), F.col(line), F.lit("]")), items, {"allowSingleQuotes": "false"})
    rows = lines.select(*rest, whole.alias("_r")).where(F.size("_r") == 1).select(*rest, F.inline("_r"))
    for field in required:
        rows = rows.where(F.col(field).isNotNull())
    return rows


def read_jsonl_lenient(spark: SparkSession, path: str | list[str], schema: str, required: Sequence[str] = ("qid",)) -> DataFrame:
    return parse_lines(spark.read.text(path).withColumnRenamed("value", "line"), "line", schema, required)


def read_shards(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All ``node_{rank}.jsonl`` files (or folders of part files) with the rank they came from."""
    rows = read_jsonl(spark, f"{folder}/node_*.jsonl", schema, provenance=True)
    return rows.withColumn("rank", F.regexp_extract("file_path", r"node_(\d+)\.jsonl", 1).cast("int")).drop("file_path")


def read_split(spark: SparkSession, root: str, name: str, split: str) -> DataFrame:
    """One split of a named dataset."""
    return spark.read.parquet(f"{root}/{name}/{split}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result objects flattened to one row per judged answer."""
    return result_answers(spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(path))


def result_answers(results: DataFrame) -> DataFrame:
    questions = results.select(F.inline("per_question"))
    return questions.select(
        "qid", "question", "reference", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        F.col("pass").alias("passed"), F.inline("answers"),
    ).withColumns(
        {
            "traj_idx": F.coalesce("traj_idx", F.lit(0)),
            "correct": F.coalesce("correct", F.lit(False)),
            "explanation": F.coalesce("explanation", F.lit("")),
        }
    )


def verdict_files(spark: SparkSession, folder: str, schema: str, one_per_file: bool = True) -> DataFrame:
    """A folder of evaluations, one object per file or one per line; file names give the record ids."""
    rows = spark.read.schema(schema).option("multiLine", one_per_file).json(folder)
    return rows.withColumn("source_id", F.regexp_extract(F.col("_metadata.file_name"), r"(.*)_eval\.json$", 1))


def _first_of(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def questions(df: DataFrame) -> DataFrame:
    """Evaluation questions: ``qid, question, reference_answer`` and the other columns.

    The text is ``question``, else ``query`` (an error if neither exists); the
    id is ``id``, else the first 8 digits of the text's MD5; the reference is
    ``reference_answer``, else ``answer``, else ''.
    """
    text = _first_of(df, ["question", "query"])
    if text is None:
        raise ValueError("a question set needs a question or query column")
    asked = F.col(text).cast("string")
    qid = F.col("id").cast("string") if "id" in df.columns else F.substring(F.md5(asked), 1, 8)
    ref = _first_of(df, ["reference_answer", "answer"])
    reference = F.coalesce(F.col(ref).cast("string"), F.lit("")) if ref else F.lit("")
    rest = [c for c in df.columns if c not in {"qid", "question", "reference_answer"}]
    return df.select(*rest, qid.alias("qid"), asked.alias("question"), reference.alias("reference_answer"))


def training_questions(df: DataFrame, index: Column) -> DataFrame:
    """Training questions: id from ``id``, ``qid`` or the row index, text and answer from either name."""
    pick = lambda names, last: F.coalesce(*[F.col(n).cast("string") for n in names if n in df.columns], last)
    return df.select(
        pick(["id", "qid"], index.cast("string")).alias("id"),
        pick(["question", "input"], F.lit("")).alias("question"),
        pick(["answer", "target"], F.lit("")).alias("answer"),
    )


# ---- sinks ---------------------------------------------------------------------


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_conversations(records: DataFrame, path: str) -> None:
    """One training record per line."""
    records.write.mode("overwrite").json(path)


def judge_csv(results: DataFrame) -> DataFrame:
    """The six CSV columns; without an extracted answer the start of the response stands in."""
    extracted = F.coalesce("extracted_final_answer", F.lit(""))
    start = cut(F.coalesce("response", F.lit("")), 200, "...")
    return results.select(
        "query_id",
        F.when(extracted != "", extracted).otherwise(start).alias("predicted_answer"),
        "correct_answer",
        F.col("correct").alias("judge_correct"),
        "is_completed",
        F.coalesce("parse_error", F.lit(False)).alias("parse_error"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def published(judged: DataFrame) -> DataFrame:
    """The published columns: arrays as JSON text, no conversation column value when there is none."""
    return judged.select(
        F.col("qid"), "traj_idx",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("question", "reference_answer", "boxed_answer")],
        "correct", "judge_explanation", "question_accuracy", "contaminated",
        F.coalesce("num_tool_calls", F.lit(0)).alias("num_tool_calls"),
        F.coalesce(F.to_json("tool_calls"), F.lit("[]")).alias("tool_calls"),
        F.coalesce("latency_s", F.lit(0.0)).alias("latency_s"),
        F.coalesce("status", F.lit("")).alias("status"),
        F.when(F.size("conversation") > 0, F.to_json("conversation")).alias("conversation"),
    )


def blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


# ---- nested results of any size --------------------------------------------------


def write_nested(rows: DataFrame, path: str, key: str, order: str, nested: str = "answers", width: int = SEGMENT) -> None:
    """One JSON object per key, with its rows in order in an array, written from ranges of (key, order).

    ``{"qid":"a","answers":[`` stands before a key's first row, ``]}`` behind its last; each row is
    one line. The part files in order of their names are one text, in which a key's rows may go on from
    file to file, so no key is ever held in a row or a task. ``key`` and ``order`` together are unique.
    """
    fields = [c for c in rows.columns if c != key]
    at = F.struct(key, order)
    marked = segmented(rows.select("*", at.alias("_at")), [], "_at", width)
    told = F.struct(F.col(key).alias("key"))  # a key may be null, a row before is not
    behind = running(marked, [], "_at", lasts={"_before": told}, width=width)
    both = running(behind, [], "_at", lasts={"_after": told}, ahead=True, width=width)
    same = lambda c: F.col(c).isNotNull() & F.col(c)["key"].eqNullSafe(F.col(key))
    named = F.to_json(F.struct(key), {"ignoreNullFields": "false"})
    head = F.concat(F.left(named, F.length(named) - 1), F.lit(f',"{nested}":[\n'))
    line = F.concat(
        F.when(same("_before"), F.lit("")).otherwise(head), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}),
        F.when(same("_after"), F.lit(",")).otherwise(F.lit("\n]}")),
    )
    lines = both.select("_at", line.alias("line"))
    parts = lines.repartitionByRange("_at") if "_seg" not in marked.columns else lines.repartitionByRange(tasks(rows, marked.count(), width), "_at")
    parts.sortWithinPartitions("_at").select("line").write.text(path)


def read_nested(spark: SparkSession, path: str, key: str, schema: str, nested: str = "answers") -> DataFrame:
    """The rows of ``write_nested``, each with its key and the fields in the schema."""
    text = spark.read.text(path).select(
        "value", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).alias("_at")
    )
    text = text.where(~F.col("value").isin("", "]}"))
    mark = f',"{nested}":['
    head = F.when(F.col("value").endswith(mark), F.left("value", F.length("value") - len(mark)))
    told = F.when(head.isNotNull(), F.struct(F.concat(head, F.lit("}")).alias("json")))
    filled = running(text.withColumn("_head", told), [], "_at", lasts={"_key": F.col("_head")}).where("_head IS NULL")
    row = F.from_json(F.regexp_replace("value", r",$", ""), schema)
    return filled.select(F.get_json_object(F.col("_key.json"), f"$.{key}").alias(key), row.alias("_row")).select(key, "_row.*")
