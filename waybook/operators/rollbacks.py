"""What became of every step and call of a raw step log, replayed as a state machine.

A trajectory's state is its rollback counter (or that it has ended) and the query keys it has
used. Which calls are made depends on the counter, and what is made decides which later calls
are repeats, so neither sums nor last values can express it. A trajectory is replayed in one
piece while it is small. A large one is cut into ranges: each range is run from every counter it
could start with, which gives it as a map from counter to counter; the maps are composed in
order, and each range is then run from its own. What keys are used at the start of a range is
first taken to be all that came through in any earlier range, and taken again from the
outcome until nothing changes. The first range is right from the start and each round makes at
least one more right for good, so the result is exact; as a rule one round is enough.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from waybook import constants as K
from waybook.functions.strings import contains_any, found_in
from waybook.operators.ordered import SEGMENT, segmented
from waybook.sources.scratch import discard, stage

#: Steps that are replayed in one call; fewer where there are tasks for more calls, many narrow ranges share a call.
TOGETHER = 1 << 17
ENDED = -1


def step_fault(text: Column, calls: Column) -> Column:
    """``tags`` without a call, a ``refusal`` or a ``final`` answer; null for a step with calls."""
    refused = F.size(found_in(text, K.REFUSAL_PHRASES)) > 0
    bare = F.when(contains_any(text, K.PROTOCOL_TAGS), F.lit("tags")).when(refused, F.lit("refusal")).otherwise(F.lit("final"))
    return F.when(F.coalesce(F.size(calls), F.lit(0)) <= 0, bare)


def replay(steps: Sequence[tuple], counter: int, used: set[str], most: int) -> tuple[int, list[tuple[str, int, list[str]]]]:
    """(counter at the end, (action, counter, what became of each call) per step) of steps ``(fault, keys, oks)`` in order.

    ``used`` is added to. A call with a key that went through before rolls its step back, or
    gives an error line when the counter is full; calls behind one that rolls back are not made.
    """
    out = []
    for fault, keys, oks in steps:
        if counter == ENDED:
            out.append(("after_end", most, ["not_made"] * len(keys)))
        elif fault == "final":
            counter = ENDED
            out.append(("final", most, []))
        elif fault is not None:
            if counter < most - 1:
                counter += 1
                out.append(("rolled_back", counter, []))
            else:
                counter = ENDED
                out.append(("end", most, []))
        else:
            made, back = [], False
            for key, ok in zip(keys, oks, strict=True):
                if back:
                    made.append("not_made")
                elif key is not None and key in used:
                    if counter < most - 1:
                        counter, back = counter + 1, True
                        made.append("repeat")
                    else:
                        counter = 0
                        made.append("error_line")
                else:
                    made.append("made")
                    if key is not None and ok:
                        used.add(key)
            if not back:
                counter = 0
            out.append(("rolled_back" if back else "kept", counter, made))
    return counter, out


def _codes(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """One number per distinct key, nulls included."""
    code = np.zeros(len(table), np.int64)
    for name in names:
        column = table[name].combine_chunks().dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code


def _units(steps: pa.Table, state: pa.Table, keys: Sequence[str], order: str):
    """(rows in order, steps, state rows) of each trajectory or range of one call."""
    both = _codes(pa.concat_tables([steps.select(keys), state.select(keys)]), keys)
    own, theirs = both[: len(steps)], both[len(steps) :]
    place = pa.compute.rank(steps[order], tiebreaker="first").to_numpy()
    at = np.lexsort((place, own))
    by_state: dict[int, list[int]] = {}
    for i, code in enumerate(theirs.tolist()):
        by_state.setdefault(code, []).append(i)
    faults, calls = steps["_fault"].to_pylist(), steps["_calls"].to_pylist()
    rows = lambda part: [(faults[i], [c["key"] for c in calls[i] or []], [c["ok"] for c in calls[i] or []]) for i in part]
    for part in np.split(at, np.flatnonzero(np.diff(own[at])) + 1) if len(at) else []:
        yield part.tolist(), rows(part.tolist()), by_state.get(int(own[part[0]]), [])


def _run(rows: DataFrame, state: DataFrame, keys: Sequence[str], order: str, most: int, calls: int) -> DataFrame:
    """Rows with ``action``, ``rollbacks`` and ``made``; state is ``keys`` with ``key`` (used at the start) or ``start``."""
    schema = StructType([*rows.schema.fields]).add("action", StringType()).add("rollbacks", IntegerType()).add("made", ArrayType(StringType()))
    names = rows.columns

    def run(steps: pa.Table, state: pa.Table) -> pa.Table:
        action, counter, made = [None] * len(steps), [0] * len(steps), [None] * len(steps)
        used, starts = state["key"].to_pylist(), state["start"].to_pylist()
        for part, own, at in _units(steps, state, keys, order):
            begin = next((starts[i] for i in at if starts[i] is not None), 0)
            _, out = replay(own, begin, {used[i] for i in at if used[i] is not None}, most)
            for i, (what, count, each) in zip(part, out, strict=True):
                action[i], counter[i], made[i] = what, count, each
        steps = steps.select(names)
        for name, column, kind in (("action", action, pa.string()), ("rollbacks", counter, pa.int32()), ("made", made, pa.list_(pa.string()))):
            steps = steps.append_column(name, pa.array(column, kind))
        return steps

    return _together(rows, keys, calls).cogroup(_together(state, keys, calls)).applyInArrow(run, schema)


def _maps(rows: DataFrame, used: DataFrame, keys: Sequence[str], order: str, most: int, calls: int) -> DataFrame:
    """(keys, ends): the counter each range ends with, for every counter it could start with."""
    names = list(keys)

    def run(steps: pa.Table, state: pa.Table) -> pa.Table:
        first, ends, known = [], [], state["key"].to_pylist()
        for part, own, at in _units(steps, state, keys, order):
            first.append(part[0])
            ends.append([replay(own, counter, {known[i] for i in at}, most)[0] for counter in range(most)])
        return steps.select(names).take(pa.array(first, pa.int64())).append_column("ends", pa.array(ends, pa.list_(pa.int32())))

    return _together(rows, keys, calls).cogroup(_together(used, keys, calls)).applyInArrow(run, StructType([*rows.select(*keys).schema.fields]).add("ends", ArrayType(IntegerType())))


def _together(rows: DataFrame, keys: Sequence[str], calls: int):
    call = F.pmod(F.xxhash64(*keys), F.lit(calls)).alias("_call")
    return rows.select(*[F.col(c).alias(c) for c in rows.columns], call).groupBy("_call")


def _used(through: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _seg, key): the keys of a range that came through in an earlier range; ``through`` has (keys, _seg, key, ok)."""
    once = through.groupBy(*keys, "_seg", "key").agg(F.max("ok").alias("ok"))
    before = Window.partitionBy(*keys, "key").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    return once.withColumn("_before", F.max("ok").over(before)).filter("_before").select(*keys, "_seg", "key")


def replayed(
    steps: DataFrame, keys: Sequence[str], order: str, fault: Column, calls: Column, max_rollbacks: int = K.MAX_ROLLBACKS, width: int = SEGMENT
) -> DataFrame:
    """The steps with ``action``, ``rollbacks`` and ``made``.

    ``fault`` is ``final`` for an answer that ends the run, any other text for a bad reply, null for a
    step with calls; ``calls`` is ``array<struct<key, ok>>`` in order, a null key never repeats.
    ``action`` is kept, rolled_back, final, end (the counter is full) or after_end; ``rollbacks`` the
    counter after the step, the maximum once the run has ended; ``made`` has made, repeat, error_line or
    not_made for each call. ``order`` is unique within a key. No steps, no rows.
    """
    keys, kept = list(keys), steps.columns
    marked = steps.withColumns({"_fault": fault, "_calls": calls})
    rows = segmented(marked, keys, order, width)
    n = rows.count()
    total = max(1, min(-(-n // min(TOGETHER, width)), max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TOGETHER))))
    unit = [*keys, "_seg"]
    if "_seg" not in rows.columns:
        state = rows.select(*keys, F.lit("").alias("key"), F.lit(0).alias("start")).limit(0)
        return _run(rows, state, keys, order, max_rollbacks, total).select(*kept, "action", "rollbacks", "made")

    each = rows.select(*unit, F.explode("_calls").alias("c")).select(*unit, "c.key", "c.ok").filter("key IS NOT NULL")
    through = stage(each.groupBy(*unit, "key").agg(F.max("ok").alias("ok")), "through")
    used = stage(_used(through, keys), "used")
    while True:
        maps = stage(_maps(rows, used, unit, order, max_rollbacks, total), "maps")
        starts = _starts(maps, keys, total)
        state = used.select(*unit, "key", F.lit(None).cast("int").alias("start")).unionByName(starts.withColumn("key", F.lit(None).cast("string")))
        out = stage(_run(rows, state, unit, order, max_rollbacks, total), "replayed")
        came = out.select(*unit, F.explode(F.arrays_zip("_calls", "made")).alias("c"))
        came = came.filter("c.made = 'made'").select(*unit, F.col("c._calls.key").alias("key"), F.col("c._calls.ok").alias("ok"))
        # a key that does not come through in a range is still one that a later call of it asks for
        now = stage(_used(through.withColumn("ok", F.lit(False)).unionByName(came.filter("key IS NOT NULL")), keys), "used")
        same = now.exceptAll(used).isEmpty() and used.exceptAll(now).isEmpty()
        discard(maps, used)
        if same:
            return out.select(*kept, "action", "rollbacks", "made")
        discard(out)
        used = now


def _starts(maps: DataFrame, keys: Sequence[str], calls: int) -> DataFrame:
    """(keys, _seg, start): the maps of a trajectory's ranges, composed in order; one row per range."""
    names = [*keys, "_seg"]

    def run(table: pa.Table) -> pa.Table:
        code, seg, ends, start = _codes(table, keys), table["_seg"].to_numpy(), table["ends"].to_pylist(), [0] * len(table)
        before, counter = -1, 0
        for i in np.lexsort((seg, code)).tolist():
            counter = 0 if code[i] != before else counter
            before, start[i] = code[i], counter
            counter = ends[i][counter] if counter != ENDED else ENDED
        return table.select(names).append_column("start", pa.array(start, pa.int32()))

    return _together(maps, keys, calls).applyInArrow(run, StructType([*maps.select(*names).schema.fields]).add("start", IntegerType()))
