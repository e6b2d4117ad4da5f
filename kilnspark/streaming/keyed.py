"""Streams with typed state per key on RocksDB: lists, maps and values, with timers by the clock or by event time.

Rows go to Python one by one as they are, so whole numbers of 64 bits keep
their digits. A stream with timers by the clock looks for idle keys as long as
it runs.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from kilnspark.operators.folds import rate_step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(df: DataFrame, key: str, processor: StatefulProcessor, out: str, mode: str, time: str) -> DataFrame:
    """The stream with the processor's state kept in RocksDB, which the session then uses for all its streams."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return df.groupBy(key).transformWithState(processor, StructType.fromDDL(out), mode, time)


def _set_timer(handle: Any, at: int) -> None:
    """The key's only timer."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at)


class _RateLimit(StatefulProcessor):
    """The times of accepted hits in a list, gone when the key was idle."""

    def __init__(self, limit: int, window: int, idle_ms: int):
        self.step, self.idle = rate_step(limit, window), idle_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long", ttlDurationMs=2 * self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = tuple(r[0] for r in self.held.get()) if self.held.exists() else ()
        for row in sorted(rows, key=lambda r: r.at):
            held, (accepted,) = self.step(held, row)
            yield Row(key=key[0], at=row.at, accepted=accepted)
        if held:
            self.held.put([(at,) for at in held])
        _set_timer(self.handle, timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(hits: DataFrame, limit: int, window_ms: int, idle_ms: int = 3_600_000) -> DataFrame:
    """hits(key string, at long) with accepted; the state of a key that had no hit for idle_ms by the clock goes, at the latest after twice that."""
    own = hits.select(F.col("key").cast("string").alias("key"), F.col("at").cast("long").alias("at"))
    return _run(own, "key", _RateLimit(limit, window_ms, idle_ms), "key string, at long, accepted boolean", "append", "processingTime")


class _Stalled(StatefulProcessor):
    """The state of a job in process, told when it had no update for a time by the clock."""

    def __init__(self, after_ms: int):
        self.after = after_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = max(rows, key=lambda r: r.seq).status
        if last == "processing":
            self.status.update((last,))
            _set_timer(self.handle, timerValues.getCurrentProcessingTimeInMs() + self.after)
        else:
            self.status.clear()
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.status.exists():
            yield Row(id=key[0], status=self.status.get()[0])
            self.status.clear()

    def close(self) -> None:
        pass


def stalled(jobs: DataFrame, after_ms: int) -> DataFrame:
    """(id, status) of jobs(id string, seq long, status) in process without an update for after_ms by the clock; each once."""
    return _run(jobs.select(F.col("id").cast("string").alias("id"), F.col("seq").cast("long").alias("seq"), "status"), "id", _Stalled(after_ms), "id string, status string", "append", "processingTime")


class _LastTwo(StatefulProcessor):
    """The last path and the last tool of a subject, which don't depend on each other."""

    def init(self, handle: Any) -> None:
        self.last = {name: handle.getValueState(name, "value string") for name in ("path", "tool")}

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = {name: state.get()[0] if state.exists() else None for name, state in self.last.items()}
        before = dict(now)
        for row in sorted(rows, key=lambda r: r.at):
            for name, value in (("path", row.path), ("tool", row.tool)):
                if value is not None and value != now[name]:
                    now[name] = value
                    yield Row(subject=key[0], at=row.at, kind=name, value=value)
        for name, state in self.last.items():
            if now[name] != before[name]:
                state.update((now[name],))

    def close(self) -> None:
        pass


def changes_of_view(views: DataFrame) -> DataFrame:
    """(subject, at, kind, value) of views(subject string, at long, path, tool): a row where the path differs from the one before, and one where the tool differs from the last tool, with other views between or not."""
    own = views.select(F.col("subject").cast("string").alias("subject"), F.col("at").cast("long").alias("at"), "path", "tool")
    return _run(own, "subject", _LastTwo(), "subject string, at long, kind string, value string", "append", "none")


class _Ordered(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them; then they go through a step in order.

    A key's rows of a micro-batch are one element of it, pickled, with one timer
    for the first of them; of rows of equal ms and seq the last one counts.

    step(state, row) gives the state after it and a row to show, or None.
    until(state) is when, in ms of event time, the state is of no more use.
    """

    def __init__(self, row: str, state: str, out: str, step: Callable, until: Callable | None = None):
        self.fields, self.out = ([f.name for f in StructType.fromDDL(x).fields] for x in (row, out))
        self.state, self.step, self.until = state, step, until

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.held = handle.getValueState("held", self.state)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        new = [(row.ms, row.seq, *(row[f] for f in self.fields)) for row in rows if row.ms > mark]
        if new:
            self.waiting.appendValue((pickle.dumps(new),))
            self.handle.registerTimer(min(row[0] for row in new))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        mark, named, made = timerValues.getCurrentWatermarkInMs(), Row(*self.fields), Row(*self.out)
        waiting = {row[:2]: row[2:] for part in self.waiting.get() for row in pickle.loads(part[0])}
        due = sorted(at for at in waiting if at[0] <= mark)
        state = self.held.get()
        state = None if state is None else tuple(state)
        for at in due:
            state, shown = self.step(state, named(*waiting[at]), *at)
            if shown is not None:
                yield made(*shown)
        if due:
            later = [(*at, *row) for at, row in waiting.items() if at[0] > mark]
            if later:
                self.waiting.put([(pickle.dumps(later),)])
                self.handle.registerTimer(min(row[0] for row in later))
            else:
                self.waiting.clear()
        end = None if state is None or self.until is None else self.until(state)
        if state is None or (end is not None and end <= mark):
            self.held.clear()
        elif due:
            self.held.update(state)
            if end is not None:
                self.handle.registerTimer(end)

    def close(self) -> None:
        pass


def _timed(df: DataFrame, key: str, *columns: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias(key), "ts", F.unix_millis("ts").alias("ms"), F.col("seq").cast("long").alias("seq"), *columns)


def job_state_by_time(changes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(id, ms, seq, status, progress, stage) after each of changes(id, ts, seq, status, progress, stage), in order of ts and seq.

    A change is shown when the watermark, delay behind the latest ts, has
    passed it, so rows may come in any order within the delay. Later ones are
    dropped. Blank and null fields change nothing.
    """

    def step(state: tuple | None, row: Row, ms: int, seq: int) -> tuple[tuple, tuple]:
        status, progress, stage = state or (None, None, None)
        now = (row.status or status, progress if row.progress is None else row.progress, row.stage or stage)
        return now, (row.id, ms, seq, *now)

    own = _timed(changes.withWatermark("ts", delay), "id", F.col("progress").cast("int").alias("progress"), "status", "stage")
    out = "id string, ms long, seq long, status string, progress int, stage string"
    processor = _Ordered("id string, status string, progress int, stage string", "status string, progress int, stage string", out, step)
    return _run(own, "id", processor, out, "append", "eventTime")


def consented(consents: DataFrame, events: DataFrame, version: str, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """(subject, ms, seq) of events(subject, ts, seq) under the consent in force: the last of consents(subject, ts, seq, version, state) up to it.

    Both streams are watermarked and united; an event waits until the watermark
    has passed it, so every consent that comes within the delay counts. A
    consent that comes later is dropped: what was let through stays. At the same
    ts consents come first. A consent's state is dropped when its time is over.
    """

    def step(last: tuple | None, row: Row, ms: int, seq: int) -> tuple[tuple | None, tuple | None]:
        if row.kind == "consent":
            return (ms, row.version, row.state), None
        ok = last is not None and last[2] == "granted" and last[1] == version and ms < last[0] + seconds * 1000
        return last, (row.subject, ms, row.own) if ok else None

    none = F.lit(None).cast("string")
    given = _timed(consents.withWatermark("ts", delay), "subject", "version", "state", F.lit("consent").alias("kind"), F.col("seq").cast("long").alias("own"))
    asked = _timed(events.withWatermark("ts", delay), "subject", none.alias("version"), none.alias("state"), F.lit("event").alias("kind"), F.col("seq").cast("long").alias("own"))
    both = given.withColumn("seq", F.col("seq") * 2).unionByName(asked.withColumn("seq", F.col("seq") * 2 + 1))
    first = both.withColumn("seq", F.when(F.col("kind") == "consent", F.col("seq") - (1 << 61)).otherwise(F.col("seq")))
    out = "subject string, ms long, seq long"
    processor = _Ordered("subject string, version string, state string, kind string, own long", "ms long, version string, state string", out, step, lambda state: state[0] + seconds * 1000)
    return _run(first, "subject", processor, out, "append", "eventTime")
