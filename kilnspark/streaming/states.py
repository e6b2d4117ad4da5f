"""Streaming forms of the ledgers, with one state per key and the batch folds' steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kilnspark.operators.folds import rate_step


def _rows(batches: Iterator[pd.DataFrame], order: str) -> Iterator[Any]:
    frames = list(batches)  # a key's rows of one micro-batch
    if frames:
        yield from pd.concat(frames).sort_values(order, kind="stable").itertuples(index=False)


def stream_rate_limit(hits: DataFrame, limit: int, window: float, idle_ms: int | None = 3_600_000) -> DataFrame:
    """hits(key, at) with accepted; a key idle for that long, by the clock, is forgotten (None: never).

    A query with a clock timeout looks for idle keys for as long as it runs.
    """
    step = rate_step(limit, window)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, out = tuple(state.get[0]) if state.exists else (), []
        for row in _rows(batches, "at"):
            held, (ok,) = step(held, row)
            out.append((key[0], row.at, ok))
        state.update((list(held),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "at", "accepted"])

    return hits.groupBy("key").applyInPandasWithState(run, "key string, at double, accepted boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def stream_job_state(changes: DataFrame) -> DataFrame:
    """The state(id, status, progress, stage) after each batch of changes(id, seq, status, progress, stage); later arrivals win."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, progress, stage = state.get if state.exists else (None, None, None)
        for row in _rows(batches, "seq"):
            status = row.status or status
            progress = progress if pd.isna(row.progress) else int(row.progress)
            stage = row.stage or stage
        state.update((status, progress, stage))
        yield pd.DataFrame([(key[0], status, progress, stage)], columns=["id", "status", "progress", "stage"])

    return changes.groupBy("id").applyInPandasWithState(run, "id string, status string, progress int, stage string", "status string, progress int, stage string", "update", GroupStateTimeout.NoTimeout)


def _keyed(df: DataFrame, key: str, out: str, state: str, step: Callable, order: str) -> DataFrame:
    """Append the rows that step(state, row) -> (state, row or None) lets through."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(own: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, made = (tuple(held.get) if held.exists else None), []
        for row in _rows(batches, order):
            now, shown = step(now, row)
            if shown is not None:
                made.append((own[0], *shown))
        if now is None:
            if held.exists:
                held.remove()
        else:
            held.update(now)
        yield pd.DataFrame(made, columns=names)

    return df.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def stream_drop_repeats(views: DataFrame) -> DataFrame:
    """views(subject, at, path) whose path differs from the subject's view before."""
    return _keyed(views, "subject", "subject string, at double, path string", "path string", lambda last, r: ((r.path,), None if last and last[0] == r.path else (r.at, r.path)), "at")


def stream_progress(feed: DataFrame, cap: float = 100) -> DataFrame:
    """feed(job_id, seq, type, progress) with progress that never falls; a result or error ends the key's state."""

    def step(last: tuple | None, r: Any) -> tuple[tuple | None, tuple]:
        if r.type != "progress":
            return None, (r.seq, r.type, cap if r.type == "result" else (last or (0.0,))[0])
        now = min(cap, max((last or (0.0,))[0], r.progress))
        return (now,), (r.seq, r.type, now)

    return _keyed(feed, "job_id", "job_id string, seq long, type string, shown double", "shown double", step, "seq")


def stream_consent_gate(marks: DataFrame, version: str, seconds: int) -> DataFrame:
    """Of the union marks(subject, at, kind, version, state) the events (kind event) under a granted, valid consent."""

    def step(last: tuple | None, r: Any) -> tuple[tuple | None, tuple | None]:
        if r.kind == "consent":
            return (r.at, r.version, r.state), None
        ok = last is not None and last[2] == "granted" and last[1] == version and r.at < last[0] + seconds
        return last, (r.at,) if ok else None

    return _keyed(marks, "subject", "subject string, at double", "at double, version string, state string", step, "at")


#: Groups that keys with deadlines are kept in; it can't change while a stream's checkpoint is in use.
GROUPS = 4096


def _timed(df: DataFrame, key: str, waits: dict[str, int], groups: int = GROUPS) -> DataFrame:
    """(key, status): one row for each key whose last row's deadline, waits[status] ms of event time after it, has passed.

    Keys are kept together in groups by hash, each a state of its own with one
    timer, for its next deadline: a call takes the rows of all its keys.
    """
    held_as = {key: "object", "status": "object", "until": "int64"}

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = pd.DataFrame(dict(zip(held_as, state.get if state.exists else ([], [], [])))).astype(held_as)
        frames = [] if state.hasTimedOut else list(batches)
        if frames:
            last = pd.concat(frames).sort_values("us", kind="stable").drop_duplicates(key, keep="last")
            held = held[~held[key].isin(last[key])]
            new = last.assign(until=last["us"] // 1000 + last["status"].map(waits)).dropna(subset=["until"])
            new = new.astype({"until": "int64"}).assign(until=lambda n: n["until"].clip(lower=mark + 1))
            held = pd.concat([held, new[list(held_as)]])
        over = held["until"] < mark
        due, held = held[over], held[~over]
        if len(held):
            state.update(tuple(held[c].tolist() for c in held_as))
            state.setTimeoutTimestamp(max(int(held["until"].min()), mark))
        elif state.exists:
            state.remove()
        yield due[[key, "status"]]

    own = df.select(F.col(key).cast("string").alias(key), "ts", F.unix_micros("ts").alias("us"), "status").withColumn("group", F.pmod(F.xxhash64(key), F.lit(groups)))
    return own.groupBy("group").applyInPandasWithState(run, f"{key} string, status string", f"{key} array<string>, status array<string>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout)


#: Milliseconds a request stays in each state.
TTL = {"pending": 24 * 3_600_000, "redeemed": 3_600_000, "declined": 30 * 60_000, "approved": 24 * 3_600_000}


def stream_expiry(requests: DataFrame, ttl: dict[str, int] | None = None, groups: int = GROUPS) -> DataFrame:
    """(id, status) of requests(id, ts, status) whose state has outlived its time, at the deadline; ts needs a watermark."""
    return _timed(requests, "id", ttl or TTL, groups)


def stream_stalled_jobs(jobs: DataFrame, after_ms: int, groups: int = GROUPS) -> DataFrame:
    """(id, status) of jobs(id, ts, status) in process that had no update for a time; ts needs a watermark."""
    return _timed(jobs, "id", {"processing": after_ms}, groups)


def stream_usage_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events(ts, event) counted by window; those later than the watermark don't count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "n")
