"""Order-dependent log analytics over streams, with state that Spark keeps for each key.

Events may come late, and a batch may cut anywhere. So each key holds its events back until the watermark
has passed them; then they are taken in the order of (time, file_ord, line_no), as a batch over all of
them would take them. A timer wakes a key when the watermark passes its first event held, also
if nothing new comes. Events later than the watermark allows are dropped by Spark before they get here.

The session must keep state in RocksDB: ``spark.sql.streaming.stateStore.providerClass`` is set by ``prepared``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veldspar.functions import logs as fn

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "ms bigint, file_ord bigint, line_no bigint, value string, cost bigint"
KEPT = 64


def prepared(spark: SparkSession) -> None:
    """Have Spark keep state where lists, timers and single values can be."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Ordered(StatefulProcessor):
    """Events of a key in order. What ``fold`` makes of (state, event) is a new state and result rows; the state is a JSON value."""

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", EVENT)
        self.state = handle.getValueState("state", "json string")
        self.timer = handle.getValueState("timer", "ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in EVENT.split(", ")]
        new = [(int(ms), int(f), int(n), v, None if cost is None or cost != cost else int(cost)) for frame in rows for ms, f, n, v, cost in frame[names].itertuples(index=False, name=None)]  # pandas has no integers beside nulls
        yield from self._take(key, [*self.held.get(), *new], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._take(key, list(self.held.get()), timerValues.getCurrentWatermarkInMs())

    def _take(self, key: Any, events: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        events = sorted((tuple(e) for e in events), key=lambda e: e[:3])
        ready, wait = [e for e in events if e[0] <= watermark], [e for e in events if e[0] > watermark]
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        out: list[tuple] = []
        for event in ready:
            state, found = self.fold(state, event)
            out += [(key[0], *row) for row in found]
        state = self.idle(state, watermark)
        if state is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
        if wait:
            self.held.put(wait)
        else:
            self.held.clear()
        wake = wait[0][0] if wait else self.wake(state)
        set_to = self.timer.get()[0] if self.timer.exists() else None
        if wake is None and (set_to is None or set_to <= watermark):
            self.timer.clear()
        elif wake is not None and (set_to is None or set_to <= watermark or wake < set_to):  # one that is set early only looks again
            wake = max(wake, watermark + 1)
            self.handle.registerTimer(wake)
            self.timer.update((wake,))
        yield pd.DataFrame(out, columns=["key", *self.columns])

    def fold(self, state: Any, event: tuple) -> tuple[Any, list[tuple]]:
        raise NotImplementedError

    def idle(self, state: Any, watermark: int) -> Any:
        """The state that is worth keeping at a watermark."""
        return state

    def wake(self, state: Any) -> int | None:
        """When a key without events held must be looked at again."""
        return None

    def close(self) -> None:
        pass


class Pairs(Ordered):
    """Dispatch ends beyond a threshold whose thread's mark before is a start. A start is forgotten after ``forget_ms``."""

    columns = ["start_time", "end_time", "duration_ms"]

    def __init__(self, threshold_ms: int, forget_ms: int) -> None:
        self.threshold_ms, self.forget_ms = threshold_ms, forget_ms

    def fold(self, state: Any, event: tuple) -> tuple[Any, list[tuple]]:
        ms, _, _, value, cost = event
        if value.startswith("+"):
            return [ms, value[1:]], []
        stuck = state is not None and ms - state[0] <= self.forget_ms and cost is not None and cost > self.threshold_ms
        return None, [(state[1], value[1:], int(cost))] if stuck else []

    def idle(self, state: Any, watermark: int) -> Any:
        return None if state is not None and watermark - state[0] > self.forget_ms else state

    def wake(self, state: Any) -> int | None:
        return None if state is None else state[0] + self.forget_ms + 1


class Runs(Ordered):
    """Runs of events of one value. A run ends where another value begins, or ``quiet_ms`` after its last event."""

    columns = ["run", "value", "entries"]

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms, self.done = quiet_ms, []

    def fold(self, state: Any, event: tuple) -> tuple[Any, list[tuple]]:
        ms, value = event[0], event[3]
        if state is None:
            return [1, value, 1, ms], []
        run, now, n, last = state
        if value == now and ms - last <= self.quiet_ms:
            return [run, now, n + 1, ms], []
        return [run + 1, value, 1, ms], [(run, now, n)] if n else []

    def _take(self, key: Any, events: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        yield from super()._take(key, events, watermark)
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        if state is not None and state[2] and watermark - state[3] > self.quiet_ms:
            self.state.update((json.dumps([state[0], None, 0, state[3]]),))  # its number goes on
            yield pd.DataFrame([(key[0], *state[:3])], columns=["key", *self.columns])

    def wake(self, state: Any) -> int | None:
        return state[3] + self.quiet_ms + 1 if state is not None and state[2] else None


class Latest(Ordered):
    """The last KEPT values of a key, first in first out: the whole list after each change."""

    columns = ["values"]

    def __init__(self, kept: int) -> None:
        self.kept = kept

    def fold(self, state: Any, event: tuple) -> tuple[Any, list[tuple]]:
        state = [*(state or []), event[3]][-self.kept :]
        return state, [(state,)]

    def _take(self, key: Any, events: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        for frame in super()._take(key, events, watermark):
            yield frame.tail(1)  # once a batch


def _applied(events: DataFrame, key: str, processor: Ordered, schema: str, mode: str) -> DataFrame:
    """``events`` has time (with a watermark), the key, file_ord, line_no, value and cost."""
    prepared(events.sparkSession)
    rows = events.select(F.col(key).alias("key"), "time", F.unix_millis(F.col("time").cast("timestamp")).alias("ms"), F.col("file_ord").cast("bigint").alias("file_ord"), F.col("line_no").cast("bigint").alias("line_no"), "value", F.col("cost").cast("bigint").alias("cost"))
    return rows.groupBy("key").transformWithStateInPandas(processor, f"key {events.schema[key].dataType.simpleString()}, {schema}", mode, "EventTime")


def _timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("time", F.to_timestamp("ts", "yyyy-MM-dd HH:mm:ss.SSS")).withWatermark("time", late)


def stuck_threads(rows: DataFrame, threshold_ms: int = 10_000, late: str = "10 minutes", forget_ms: int = 86_400_000) -> DataFrame:
    """Stuck dispatches (thread, start_time, end_time, duration_ms) of a stream of entries, as ``operators.logs`` finds them in a table.

    ``rows`` has file_ord, line_no, ts, thread and message. Threads are keys. A dispatch start that
    no end has followed for ``forget_ms`` is dropped, so threads that are gone leave no state. Time goes on with dispatch marks only.
    """
    starts, ends = F.col("message").startswith("[DISPATCH-START]"), F.col("message").startswith("[DISPATCH-END]")
    marks = _timed(rows.where(starts | ends), late)
    marks = marks.select("time", "thread", "file_ord", "line_no", F.concat(F.when(F.col("message").startswith("[DISPATCH-START]"), "+").otherwise("-"), "ts").alias("value"), fn.dispatch_cost(F.col("message")).cast("bigint").alias("cost"))
    return _applied(marks, "thread", Pairs(threshold_ms, forget_ms), "start_time string, end_time string, duration_ms bigint", "append").withColumnRenamed("key", "thread")


def heatmap(rows: DataFrame, minutes: int = 10, late: str = "10 minutes", quiet_ms: int = 3_600_000) -> DataFrame:
    """Runs (file_ord, run, hour, entries) of consecutive entries of a file in one time bucket, each when it has ended.

    Files are keys, so each has runs of its own. A run is taken to have ended when ``quiet_ms`` have
    passed without an entry.
    """
    keyed = _timed(rows, late).select("time", "file_ord", F.col("file_ord").alias("file"), "line_no", fn.bucket(F.col("ts"), minutes).alias("value"), F.lit(None).cast("bigint").alias("cost"))
    out = _applied(keyed.where("value is not null"), "file", Runs(quiet_ms), "run bigint, value string, entries bigint", "append")
    return out.select(F.col("key").alias("file_ord"), "run", F.col("value").alias("hour"), "entries")


def latest(rows: DataFrame, key: str, value: str, late: str = "10 minutes", kept: int = KEPT) -> DataFrame:
    """The last ``kept`` values (key, values) of each key of a stream of entries, again whenever they change."""
    events = _timed(rows, late).select("time", F.col(key).alias("of"), "file_ord", "line_no", F.col(value).cast("string").alias("value"), F.lit(None).cast("bigint").alias("cost"))
    return _applied(events, "of", Latest(kept), "values array<string>", "update").withColumnRenamed("key", key)
