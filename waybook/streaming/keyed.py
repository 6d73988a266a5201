"""Keyed streaming state: worker lives with rejected heartbeats, status changes, failed nodes, the fleet, accuracy.

Each processor keeps what it needs of one worker or node in the RocksDB state store and gives
only what a batch changed, so the cost of a batch follows its own rows. Rows may come in any
order: a late one takes back what it makes untrue (rows with ``gone``), and readers keep the
latest row of each key. With a lateness, state older than it is settled: timers close spans,
and events that come even later are dropped by the watermark.

Processors of many keys with few rows each get rows (``transformWithState``), which spares building a
frame for each key, and keep what they read whole as one value; the others get frames
(``transformWithStateInPandas``). The query needs the RocksDB provider, which is set for the time
of its start only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ValueState

from waybook import constants as K
from waybook.functions.strings import loose
from waybook.operators.ordered import last_per_key
from waybook.operators.report import offline_at
from waybook.streaming.streams import _start

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_SPANS = "first_us array<bigint>, last_us array<bigint>, registered_us array<bigint>, accepted array<bigint>, events array<bigint>, early array<array<bigint>>"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _run(stream: DataFrame, path: str, checkpoint: str, once: bool) -> StreamingQuery:
    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    with _rocks(stream.sparkSession):
        return _start(stream, checkpoint, "update", each, once)


def _frame(rows: Sequence[tuple], columns: Sequence[str]) -> pd.DataFrame:
    """Numbers stay whole beside nulls."""
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(columns)})


def _rows(rows: Sequence[tuple], columns: Sequence[str]) -> Iterator[Row]:
    return map(lambda values: Row(*columns)(*values), rows)


def _listed(state: ValueState) -> list[tuple]:
    """A key's rows, kept as one value with an array for each column: the store is asked once, and converts one value."""
    held = state.get()
    return list(zip(*held, strict=True)) if held else []


def _columns(rows: Sequence[tuple]) -> tuple[list, ...]:
    return tuple(map(list, zip(*rows, strict=True)))


# ---- spans of a worker -----------------------------------------------------------


def merge_spans(spans: Sequence[tuple], timeout_us: int) -> list[tuple]:
    """Spans ``(first, last, registered, accepted, events, early)`` with those no more than the timeout apart merged.

    ``early`` has the times of heartbeats that no registration of the span precedes; one that
    comes to light later accepts those at or after it.
    """
    out: list[list] = []
    for first, last, registered, accepted, events, early in sorted(spans, key=lambda s: s[:2]):
        if out and first - out[-1][1] <= timeout_us:
            to = out[-1]
            to[1] = max(to[1], last)
            to[2] = registered if to[2] is None else to[2] if registered is None else min(to[2], registered)
            to[3], to[4], to[5] = to[3] + accepted, to[4] + events, to[5] + list(early)
        else:
            out.append([first, last, registered, accepted, events, list(early)])
    for span in out:
        if span[2] is not None and span[5]:
            left = [t for t in span[5] if t < span[2]]
            span[3], span[5] = span[3] + len(span[5]) - len(left), left
    return [tuple(s) for s in out]


class WorkerSpans(StatefulProcessor):
    """Spans of one worker; see ``worker_spans``."""

    COLUMNS = ("worker_id", "first_us", "last_us", "registered_us", "accepted", "events", "gone", "closed")

    def __init__(self, timeout_us: int, settle: bool):
        self.timeout_us, self.settle = timeout_us, settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getValueState("spans", _SPANS)

    def _held(self) -> list[tuple]:
        return [(*s[:5], list(s[5])) for s in _listed(self.spans)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before, new = self._held(), []
        for row in rows:
            us, registers = row.us, row.kind == "register"
            new.append((us, us, us if registers else None, int(registers), 1, [] if registers else [us]))
        after = merge_spans([*before, *new], self.timeout_us)
        self.spans.update(_columns(after))
        old, now = {s[0]: s for s in before}, {s[0]: s for s in after}
        changed = [(key[0], *s[:5], False, False) for f, s in now.items() if s != old.get(f)]
        changed += [(key[0], *s[:5], True, False) for f, s in old.items() if f not in now]
        if self.settle:
            for s in after:
                if old.get(s[0]) != s:
                    self.handle.registerTimer(self._due(s))
        return _rows(changed, self.COLUMNS)

    def _due(self, span: tuple) -> int:
        """The first millisecond at which no event in time can extend the span."""
        return (span[1] + self.timeout_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        done = [s for s in held if self._due(s) <= now]
        left = [s for s in held if self._due(s) > now]
        if done:
            self.spans.update(_columns(left)) if left else self.spans.clear()
        return _rows([(key[0], *s[:5], False, True) for s in done], self.COLUMNS)

    def close(self) -> None:
        pass


def worker_spans(
    events: DataFrame, path: str, checkpoint: str, timeout_s: int = K.HEARTBEAT_TIMEOUT_S, lateness: str | None = None, once: bool = True
) -> StreamingQuery:
    """Spans without a silence longer than the timeout of a stream ``worker_id, ts, kind``, with the terminal rule.

    A heartbeat before the span's registration, or in a span without one, is rejected; ``accepted``
    counts the others and the registrations. A registration at the very time of a heartbeat comes
    first. Without a lateness every span is kept open to late events; with one, a span whose timeout
    the watermark has passed is ``closed`` and leaves the state. Read with ``current_spans``.
    """
    rows = events.withWatermark("ts", lateness) if lateness else events
    rows = rows.select("worker_id", "kind", F.unix_micros("ts").alias("us"), *(["ts"] if lateness else [])).groupBy("worker_id")
    kinds = "worker_id bigint, first_us bigint, last_us bigint, registered_us bigint, accepted bigint, events bigint, gone boolean, closed boolean"
    out = rows.transformWithState(WorkerSpans(timeout_s * 1_000_000, lateness is not None), kinds, "Update", "EventTime" if lateness else "None")
    return _run(out, path, checkpoint, once)


def current_spans(spark: SparkSession, path: str, timeout_s: int = K.HEARTBEAT_TIMEOUT_S) -> DataFrame:
    """``worker_id, first_seen, registered, last_seen, accepted, events, closed, offline_at`` as of the last batch."""
    latest = last_per_key(spark.read.parquet(path), ["worker_id", "first_us"], ["epoch", "closed"]).where("NOT gone")
    times = [F.timestamp_micros(f"{c}_us").alias(n) for c, n in (("first", "first_seen"), ("registered", "registered"), ("last", "last_seen"))]
    return latest.select("worker_id", *times, "accepted", "events", "closed").withColumn("offline_at", offline_at(timeout_s))


# ---- status changes --------------------------------------------------------------


def changes_of(events: Sequence[tuple]) -> dict[int, tuple]:
    """seq -> (old status, status) of events ``(seq, status)`` in order, where the two differ."""
    return {seq: (old, status) for (_, old), (seq, status) in zip(events, events[1:]) if old != status}


class StatusChanges(StatefulProcessor):
    """Status changes of one worker; see ``status_changes``."""

    COLUMNS = ("worker_id", "seq", "old_status", "status", "gone")

    def __init__(self, settle: bool):
        self.settle = settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getValueState("said", "seq array<bigint>, status array<string>, ms array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {s[0]: (s[1], s[2]) for s in _listed(self.said)}
        before = changes_of([(seq, held[seq][0]) for seq in sorted(held)])
        held.update((row.seq, (row.status, row.ms)) for row in rows)
        order = sorted(held)
        after = changes_of([(seq, held[seq][0]) for seq in order])
        if self.settle:  # nothing can come before the last event that the watermark has passed
            now = timerValues.getCurrentWatermarkInMs()
            at = max((i for i, seq in enumerate(order) if held[seq][1] < now), default=0)
            order = order[at:]
        self.said.update(_columns([(seq, *held[seq]) for seq in order]))
        out = [(key[0], seq, *pair, False) for seq, pair in after.items() if before.get(seq) != pair]
        out += [(key[0], seq, *pair, True) for seq, pair in before.items() if seq not in after]
        return _rows(out, self.COLUMNS)

    def close(self) -> None:
        pass


def status_changes(events: DataFrame, path: str, checkpoint: str, lateness: str | None = None, once: bool = True) -> StreamingQuery:
    """Changes of status in a stream ``worker_id, seq, status, ts`` in order of ``seq`` per worker, whatever order it comes in.

    A null status says nothing; of equal ``seq`` the later row counts. A batch gives the changes that are
    new and takes back those that an event in between has undone. With a lateness only events that
    can still get a neighbour are kept; ``ts`` must then not fall as ``seq`` grows. Read with ``current_changes``.
    """
    rows = events.where("status IS NOT NULL")
    rows = rows.withWatermark("ts", lateness) if lateness else rows
    rows = rows.select("worker_id", "seq", "status", F.unix_millis("ts").alias("ms"), *(["ts"] if lateness else [])).groupBy("worker_id")
    kinds = "worker_id bigint, seq bigint, old_status string, status string, gone boolean"
    out = rows.transformWithState(StatusChanges(lateness is not None), kinds, "Update", "EventTime" if lateness else "None")
    return _run(out, path, checkpoint, once)


def current_changes(spark: SparkSession, path: str) -> DataFrame:
    latest = last_per_key(spark.read.parquet(path), ["worker_id", "seq"], ["epoch"])
    return latest.where("NOT gone").select("worker_id", "seq", "old_status", "status")


# ---- nodes over spans ------------------------------------------------------------


class NodeLives(StatefulProcessor):
    """Until when a node has a live worker; see ``node_lives``. Nodes are few and their rows many, so they come as frames."""

    COLUMNS = ("node_id", "workers", "alive_until_us")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.workers = handle.getMapState("workers", "worker_id long", "last_us long, offline_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = dict(self._held())
        now = dict(before)
        for batch in rows:
            for worker, last, offline in zip(batch["worker_id"].tolist(), batch["last_us"].tolist(), batch["offline_us"].tolist(), strict=True):
                offline = None if pd.isna(offline) else int(offline)
                # of rows of one span the one that knows a registration is the newer one
                if worker not in now or (last, offline is not None, offline or 0) > (now[worker][0], now[worker][1] is not None, now[worker][1] or 0):
                    now[worker] = (last, offline)
        for worker, value in now.items():
            if before.get(worker) != value:
                self.workers.updateValue((worker,), value)
        if now != before:
            until = max((o for _, o in now.values() if o is not None), default=None)
            yield _frame([(key[0], len(now), until)], self.COLUMNS)

    def _held(self) -> Iterator[tuple]:
        if self.workers.exists():
            for worker, value in self.workers.iterator():
                yield worker[0], (value[0], value[1])

    def close(self) -> None:
        pass


def node_lives(
    spans: DataFrame, path: str, checkpoint: str, timeout_s: int = K.HEARTBEAT_TIMEOUT_S, once: bool = True
) -> StreamingQuery:
    """``workers`` and ``alive_until_us`` per node, of a stream of ``node_id`` with the rows that ``worker_spans`` writes.

    A worker lives until the timeout after its latest span, not at all where that has no registration;
    a node as long as one of its workers does. A batch gives the nodes it changed. Read with ``failed_nodes``.
    """
    offline = F.when(F.col("registered_us").isNotNull(), F.col("last_us") + timeout_s * 1_000_000)
    rows = spans.where("NOT gone").select("node_id", "worker_id", "last_us", offline.alias("offline_us")).groupBy("node_id")
    out = rows.transformWithStateInPandas(NodeLives(), "node_id string, workers bigint, alive_until_us bigint", "Update", "None")
    return _run(out, path, checkpoint, once)


def failed_nodes(spark: SparkSession, path: str, as_of_us: int) -> DataFrame:
    """``node_id, workers, failed``: whether no worker of the node is alive at a time."""
    latest = last_per_key(spark.read.parquet(path), ["node_id"], ["epoch"])
    failed = F.col("alive_until_us").isNull() | (F.col("alive_until_us") < as_of_us)
    return latest.select("node_id", "workers", failed.alias("failed"))


# ---- the fleet -------------------------------------------------------------------


class LatestStatus(StatefulProcessor):
    """One off the old status and one on the new whenever a key's latest status changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "seq long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.latest.get()) if self.latest.exists() else None
        seq, status = before or (None, None)
        for batch in rows:
            for s, what in zip(batch["seq"].tolist(), batch["status"].tolist(), strict=True):
                if seq is None or s > seq:
                    seq, status = s, what
        if before is None or seq != before[0]:
            self.latest.update((seq, status))
        if before is None or status != before[1]:
            yield _frame([(status, 1)] + ([(before[1], -1)] if before else []), ("status", "n"))

    def close(self) -> None:
        pass


def latest_statuses(events: DataFrame, key: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep how many keys have each latest status, of a stream ``key, seq, status``; a batch writes one row per status it changed."""
    rows = events.select(key, "seq", "status").groupBy(key)
    out = rows.transformWithStateInPandas(LatestStatus(), "status string, n bigint", "Update", "None")

    def each(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("status").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    with _rocks(events.sparkSession):
        return _start(out, checkpoint, "update", each, once)


def status_counts(spark: SparkSession, path: str) -> DataFrame:
    """``status, n`` as of the last batch."""
    return spark.read.parquet(path).groupBy("status").agg(F.sum("n").alias("n")).where("n <> 0")


def fleet(spark: SparkSession, path: str) -> DataFrame:
    """Workers by their latest status, in one row; the same as ``report.fleet`` on a table."""
    count = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(f"{s.lower()}_workers")
    return status_counts(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_workers"), count("READY"), count("LOADING"), count("OFFLINE"))


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """Active (pending or running) and pending nodes, in one row; the same as ``report.nodes`` on a table."""
    count = lambda *s: F.coalesce(F.sum(F.when(F.col("status").isin(*s), F.col("n"))), F.lit(0))
    return status_counts(spark, path).agg(count("PENDING", "RUNNING").alias("active_nodes"), count("PENDING").alias("pending_nodes"))


# ---- accuracy of a running evaluation ----------------------------------------------


class LooseAccuracy(StatefulProcessor):
    """Scores of one question that are revised when an earlier reference arrives; see ``accuracy_deltas``."""

    COLUMNS = ("questions", "n", "correct", "passed")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "place long, reference string")
        self.score = handle.getValueState("score", "n long, correct long")
        self.answers = handle.getMapState("answers", "answer string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.first.get()
        n, correct = tuple(self.score.get()) if before else (0, 0)
        first, new = before, {}
        for row in rows:
            new[row.answer] = new.get(row.answer, 0) + 1
            if first is None or (row.place, row.reference) < first:
                first = (row.place, row.reference)
        right = lambda answer: bool(first[1]) and bool(answer) and (first[1] in answer or answer in first[1])
        now = sum(c for answer, c in new.items() if right(answer))
        if before and first[1] != before[1]:  # what was judged by the later reference is judged again
            now += sum(value[0] for answer, value in self.answers.iterator() if right(answer[0]))
        elif before:
            now += correct
        for answer, c in new.items():
            held = self.answers.getValue((answer,)) if before else None
            self.answers.updateValue((answer,), ((held[0] if held else 0) + c,))
        self.first.update(first)
        self.score.update((n + sum(new.values()), now))
        delta = (int(before is None), sum(new.values()), now - correct, int(now > 0) - int(correct > 0))
        return _rows([delta], self.COLUMNS)

    def close(self) -> None:
        pass


def accuracy_deltas(
    log: DataFrame, path: str, checkpoint: str, qid: str = "qid", order: str = "traj_idx", reference: str = "reference_answer", answer: str = "answer", once: bool = True
) -> StreamingQuery:
    """Keep the loose accuracy estimate of a growing log: each batch writes one row of what it added and took back.

    A question's reference is that of its smallest ``order``, null counts as empty; an earlier one that
    comes late revises the question's verdicts. Of a question its distinct answers are kept with their
    counts. Every row of the stream is an attempt. Read with ``accuracy``.
    """
    loosely = lambda c: loose(F.coalesce(c, F.lit("")))
    rows = log.select(qid, F.coalesce(order, F.lit(0)).cast("bigint").alias("place"), loosely(reference).alias("reference"), loosely(answer).alias("answer"))
    out = rows.groupBy(qid).transformWithState(LooseAccuracy(), "questions bigint, n bigint, correct bigint, passed bigint", "Update", "None")

    def each(batch: DataFrame, epoch: int) -> None:
        batch.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in LooseAccuracy.COLUMNS]).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    with _rocks(log.sparkSession):
        return _start(out, checkpoint, "update", each, once)


def accuracy(spark: SparkSession, path: str) -> DataFrame:
    """Questions, trajectories, correct ones, passed questions, pass@k and trajectory accuracy in one row, zero when empty."""
    total = spark.read.parquet(path).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in LooseAccuracy.COLUMNS])
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return total.select(
        F.col("questions").alias("num_questions"), F.col("n").alias("total_trajectories"), F.col("correct").alias("correct_trajectories"),
        "passed", share("passed", "questions").alias("pass_at_k"), share("correct", "n").alias("trajectory_accuracy"),
    )
