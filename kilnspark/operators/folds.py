"""Ordered folds per key, where each step depends on what the steps before accepted.

A fold runs over the rows of a key in order, a batch at a time, and keeps only
its state; a key with many rows is never held as a whole. A key that holds a
large share of all rows is walked in ranges at once (`spread_fold`).
"""

from __future__ import annotations

import json
import pickle
from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from kilnspark.sources.scratch import discard, stored

#: Rows that a task turns into Python objects at a time.
ROWS = 4096

#: A key of more rows is walked in ranges. Results are the same for any value.
CROWD = 2_000_000

#: Crowded keys that are broadcast; with more of them all rows are walked in ranges.
MANY = 10_000


def _sliced(batches: Iterator[pa.RecordBatch], seen: list[str], row_of: Any) -> Iterator[tuple[pa.RecordBatch, Iterator[Any]]]:
    """Batches of at most ROWS rows, each with its rows as tuples of the columns `seen`."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            yield batch, map(row_of._make, zip(*(batch.column(c).to_pylist() for c in seen)))


def fold(df: DataFrame, keys: list[str], order: list[str | Column], step: Callable[[Any, Any], tuple[Any, tuple]], start: Any, schema: str, needs: list[str] | None = None) -> DataFrame:
    """df's rows with the outputs of step(state, row) -> (state, outputs) added, per key in order.

    schema names the added columns. Rows are dealt by key and sorted, so that
    a task streams through them. step sees the columns `needs` (None: all) and
    the keys; df's own columns pass as they are.
    """
    added = to_arrow_schema(StructType.fromDDL(schema))
    seen = df.columns if needs is None else list(dict.fromkeys([*keys, *needs]))
    row_of, n_keys = namedtuple("row", seen, rename=True), [seen.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch, rows in _sliced(batches, seen, row_of):
            made = []
            for row in rows:
                own = tuple(row[i] for i in n_keys)
                if own != key:
                    key, state = own, start() if callable(start) else start
                state, out = step(state, row)
                made.append(out)
            new = [pa.array(c, f.type) for c, f in zip(zip(*made), added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added.names])

    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{full}, {schema}")


def _last_states(df: DataFrame, keys: list[str], order: list[str | Column], step: Callable, start: Any, needs: list[str]) -> DataFrame:
    """(keys, end_) with the state, pickled, after the last row of each key."""
    seen = list(dict.fromkeys([*keys, *needs]))
    row_of, n_keys = namedtuple("row", seen, rename=True), [seen.index(k) for k in keys]
    out = StructType([*[StructField(k, df.schema[k].dataType) for k in keys], *StructType.fromDDL("end_ binary").fields])
    form = to_arrow_schema(out)

    def table(ended: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ended), form)], schema=form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, ended = None, None, []
        for _, rows in _sliced(batches, seen, row_of):
            for row in rows:
                own = tuple(row[i] for i in n_keys)
                if own != key:
                    if key is not None:
                        ended.append((*key, pickle.dumps(state)))
                    key, state = own, start() if callable(start) else start
                state, _ = step(state, row)
            if len(ended) >= ROWS:
                yield table(ended)
                ended = []
        if key is not None:
            yield table([*ended, (*key, pickle.dumps(state))])

    return df.select(*seen, *[c for c in order if isinstance(c, str) and c not in seen]).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def spread_fold(df: DataFrame, keys: list[str], order: list[str], step: Callable[[Any, Any], tuple[Any, tuple]], start: Any, schema: str, needs: list[str], crowd: int | None = None) -> DataFrame:
    """fold() for steps with small states, in which a key of more than `crowd` rows is spread over many tasks.

    Such keys are cut into ranges of the order. Each range is walked from
    `start`, as if nothing had been before it. Then ranges whose predecessor
    ended otherwise than they began are walked again from there, until none is
    left; the states of most steps soon forget how they began, so this takes few
    rounds. In the worst case each round settles one range, which is what one
    task would do. Keys are counted when this is called. Null keys are a key.
    """
    heavy = stored(df.groupBy(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)]).agg(F.count("*").alias("rows_")).where(F.col("rows_") > (CROWD if crowd is None else crowd)).drop("rows_"), "heavy")
    n = heavy.limit(MANY + 1).count()
    if not n:
        discard(heavy)
        return fold(df, keys, order, step, start, schema, needs)
    if n > MANY:
        return _in_ranges(df, keys, order, step, start, schema, needs)
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"k{i}_"))
    few = F.broadcast(heavy)
    hot = _in_ranges(df.join(few, met, "left_semi"), keys, order, step, start, schema, needs)
    return fold(df.join(few, met, "left_anti"), keys, order, step, start, schema, needs).unionByName(hot)


def _in_ranges(df: DataFrame, keys: list[str], order: list[str], step: Callable, start: Any, schema: str, needs: list[str]) -> DataFrame:
    """fold() of keys that may each hold most rows; see spread_fold."""
    split, first = [*keys, "piece_"], pickle.dumps(start() if callable(start) else start)
    blank = (None,) * len(StructType.fromDDL(schema).fields)
    rows = stored(df.repartitionByRange(*keys, *order).withColumn("piece_", F.spark_partition_id()), "ranges")
    after = [F.col("begins_").asc_nulls_last(), *order]  # the row with the state a range begins with comes first

    def given(of: DataFrame, states: DataFrame) -> DataFrame:
        return of.withColumn("begins_", F.lit(None).cast("binary")).unionByName(states.select(*split, "begins_"), allowMissingColumns=True)

    def begun(state: Any, row: Any) -> tuple[Any, tuple]:
        return step(state, row) if row.begins_ is None else (pickle.loads(row.begins_), blank)

    pieces = Window.partitionBy(*keys).orderBy("piece_")
    known = stored(_last_states(rows, split, order, step, start, needs).withColumn("begins_", F.lit(first)).withColumn("nth_", F.row_number().over(pieces)), "states")
    settled = 1
    while True:
        wanted = known.withColumn("was_", F.col("begins_")).withColumn("begins_", F.coalesce(F.lag("end_").over(pieces), F.lit(first)))
        stale = [r.piece_ for r in wanted.where((F.col("nth_") > settled) & (F.col("begins_") != F.col("was_"))).select("piece_").distinct().collect()]  # no more than ranges
        if not stale:
            break
        again = wanted.where(F.col("piece_").isin(stale)).select(*split, "begins_", "nth_")
        ended = _last_states(given(rows.where(F.col("piece_").isin(stale)), again), split, after, begun, start, [*needs, "begins_"])
        versions = known.withColumn("v_", F.lit(0)).unionByName(again.withColumn("v_", F.lit(1)), allowMissingColumns=True).unionByName(ended.withColumn("v_", F.lit(1)), allowMissingColumns=True)
        newest = {c: F.coalesce(F.max(F.when(F.col("v_") == 1, F.col(c))), F.max(F.when(F.col("v_") == 0, F.col(c)))).alias(c) for c in ("end_", "begins_", "nth_")}
        newer = stored(versions.groupBy(*split).agg(*newest.values()), "states")
        discard(known)
        known, settled = newer, settled + 1
    states = known.withColumn("begins_", F.coalesce(F.lag("end_").over(pieces), F.lit(first)))
    whole = fold(given(rows, states), split, after, begun, start, schema, [*needs, "begins_"])
    return whole.where("begins_ is null").drop("piece_", "begins_")


def throttle_step(least: float, cap: float) -> Callable:
    """Emit progress if it moved by `least` since the last one emitted, or first reaches the cap."""

    def step(last: float | None, row: Any) -> tuple[float | None, tuple]:
        now = min(row.progress, cap)
        emit = last is None or now - last >= least or (now >= cap and last < cap)
        return (now if emit else last), (bool(emit),)

    return step


def rate_step(limit: int, window: float) -> Callable:
    """Accept a hit unless `limit` accepted ones lie within the window before it; refused ones don't count."""

    def step(held: tuple, row: Any) -> tuple[tuple, tuple]:
        live = tuple(t for t in held or () if t > row.at - window)
        fits = len(live) < limit
        return (live + (row.at,) if fits else live), (fits,)

    return step


def transition_step(state: dict | None, row: Any) -> tuple[dict, tuple]:
    """One event(kind, at) on a request: create, approve, decline or redeem; ttl_ms after its creation it is expired.

    Output: accepted, status after, reason. An expired request refuses approval
    and redemption but keeps its status, as the sweep is what ends it.
    """
    state = state or {"status": None, "expires": None}
    now, kind, status = row.at, row.kind, state["status"]
    if kind == "create":
        if status is not None:
            return state, (False, status, "exists")
        state = {"status": "pending", "expires": now + row.ttl_ms}
        return state, (True, "pending", None)
    wanted = {"approve": ("pending", "approved"), "decline": ("pending", "declined"), "redeem": ("approved", "redeemed")}.get(kind)
    if wanted is None:
        return state, (False, status, "unknown event")
    if status != wanted[0]:
        return state, (False, status, f"not {wanted[0]}")
    if kind != "decline" and state["expires"] <= now:
        return state, (False, status, "expired")
    return state | {"status": wanted[1]}, (True, wanted[1], None)


#: What a request's events leave in the audit, by kind.
AUDITED = {"create": ["request.created"], "approve": ["request.approved"], "decline": ["request.declined"], "redeem": ["license.redeemed", "device.activity"]}


def ledger_step(state: dict | None, row: Any) -> tuple[dict, tuple]:
    """transition_step with the fields of a request and what is written to the audit.

    An approval gives a license, the hash of its code and the code; a redemption
    names the same license and hash, clears the code and is told twice, under
    the device's origin; other events are told under the request's.
    """
    state = state or {"status": None, "expires": None, "license_id": None, "code_hash": None, "code": None, "origin": None}
    if row.kind == "redeem" and (row.license_id, row.code_hash) != (state["license_id"], state["code_hash"]):
        return state, (False, state["status"], "unknown code", state["license_id"], state["code"], [])
    after, (accepted, status, reason) = transition_step(state if state["status"] else None, row)
    if not accepted:
        return state, (False, state["status"], reason, state["license_id"], state["code"], [])
    after = state | after
    told = {"create": {"requesterLabel": row.label}, "approve": {"licenseId": row.license_id}, "decline": {"reason": row.why or "Declined by owner"}}.get(row.kind, {"licenseId": row.license_id, "deviceId": row.device_id})
    if row.kind == "create":
        after["origin"] = row.origin
    elif row.kind == "approve":
        after |= {"license_id": row.license_id, "code_hash": row.code_hash, "code": row.code}
    elif row.kind == "redeem":
        after["code"] = None
    origin = row.origin if row.kind == "redeem" else after["origin"]
    audit = [{"event": e, "origin": origin, "details": json.dumps(({"activity": "license.redeemed"} if e == "device.activity" else {}) | told)} for e in AUDITED[row.kind]]
    return after, (True, status, None, after["license_id"], after["code"], audit)


def request_ledger(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, audit, consumptions) of events(request_id, seq, at, kind, ttl_ms, label, license_id, code_hash, code, device_id, origin, why).

    Redemptions carry no request id: they go to the request that an approval
    with their license and code hash is of, the first by seq; without one they
    are refused. Events come with accepted, status, reason, license and code
    after them. audit(request_id, seq, place, at, event, origin, details) and
    consumptions(license_id, code_hash, device_id, origin, redeemed_at) hold
    what accepted events write.
    """
    codes = events.where("kind = 'approve' and license_id is not null and code_hash is not null").groupBy("license_id", "code_hash").agg(F.min_by("request_id", "seq").alias("_of"))
    known = events.join(codes.hint("merge"), ["license_id", "code_hash"], "left").withColumn("request_id", F.when(F.col("kind") == "redeem", F.col("_of")).otherwise(F.col("request_id"))).select(*events.columns)
    kind = "accepted boolean, status string, reason string, license string, held_code string, audit array<struct<event: string, origin: string, details: string>>"
    needs = ["at", "kind", "ttl_ms", "label", "license_id", "code_hash", "code", "device_id", "origin", "why"]
    done = fold(known.where("request_id is not null"), ["request_id"], ["seq"], ledger_step, None, kind, needs)
    lost = known.where("request_id is null")
    gone = {"accepted": F.lit(False), "status": F.lit(None), "reason": F.lit("unknown code"), "license": F.lit(None), "held_code": F.lit(None), "audit": F.array()}
    every = done.unionByName(lost.withColumns({f.name: gone[f.name].cast(f.dataType) for f in StructType.fromDDL(kind).fields}))
    audit = every.select("request_id", "seq", "at", F.posexplode("audit").alias("place", "a")).select("request_id", "seq", "place", "at", "a.event", "a.origin", "a.details")
    used = every.where("accepted and kind = 'redeem'").select("license_id", "code_hash", "device_id", "origin", F.col("at").alias("redeemed_at"))
    return every.drop("audit"), audit, used


def throttle(df: DataFrame, keys: list[str], order: list[str], least: float = 5, cap: float = 75, crowd: int | None = None) -> DataFrame:
    """df(progress) with emit: whether a step of the progress is shown."""
    return spread_fold(df, keys, order, throttle_step(least, cap), None, "emit boolean", ["progress"], crowd)


def rate_limit(df: DataFrame, keys: list[str], order: list[str], limit: int, window: float, crowd: int | None = None) -> DataFrame:
    """df(at) with accepted."""
    return spread_fold(df, keys, order, rate_step(limit, window), (), "accepted boolean", ["at"], crowd)


def request_transitions(events: DataFrame) -> DataFrame:
    """events(request_id, seq, at, kind, ttl_ms) with accepted, status and reason, as transition_step has them; seq is unique in a request.

    Each change of a request is the first event of its kind that is in time, so
    three aggregates over requests say what all events meet, and a request with
    most events needs no task of its own. Null request ids are one request.
    """
    own = F.struct("request_id").alias("of_")
    marks = events.where("kind = 'create'").groupBy(own).agg(F.min_by(F.struct("seq", (F.col("at") + F.col("ttl_ms")).alias("expires")), "seq").alias("made_"))
    met = events.withColumn("of_", own).join(marks.hint("merge"), "of_", "left")
    in_time = "(made_.expires is null or coalesce(made_.expires > at, false))"
    ends = met.where(f"seq > made_.seq and (kind = 'decline' or kind = 'approve' and {in_time})").groupBy("of_").agg(F.min_by(F.struct("seq", "kind"), "seq").alias("ruled_"))
    met = met.join(ends.hint("merge"), "of_", "left")
    used = met.where(f"ruled_.kind = 'approve' and seq > ruled_.seq and kind = 'redeem' and {in_time}").groupBy("of_").agg(F.min("seq").alias("used_"))
    met = met.join(used.hint("merge"), "of_", "left")
    now = F.expr("case when seq > used_ then 'redeemed' when seq > ruled_.seq then if(ruled_.kind = 'approve', 'approved', 'declined') when seq > made_.seq then 'pending' end")
    reason = F.expr(f"""case when kind = 'create' then if(before_ is null, null, 'exists')
        when kind is null or kind not in ('approve', 'decline', 'redeem') then 'unknown event'
        when not before_ <=> if(kind = 'redeem', 'approved', 'pending') then concat('not ', if(kind = 'redeem', 'approved', 'pending'))
        when kind <> 'decline' and not {in_time} then 'expired' end""")
    told = met.withColumn("before_", now).withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    status = F.expr("if(accepted, element_at(map('create', 'pending', 'approve', 'approved', 'decline', 'declined', 'redeem', 'redeemed'), kind), before_)")
    return told.withColumn("status", status).select(*events.columns, "accepted", "status", "reason")


def unique_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """df with free_name: the first free stem(n).ext, ignoring case; a null name stays null.

    Names that differ in case and number alone can collide, so they are a key;
    its state is its distinct names.
    """
    from kilnspark.functions.scalars import extension, stem

    bare = F.lower(F.regexp_replace(stem(F.col(name)), "(\\(\\d+\\))+$", ""))
    keyed = df.withColumn("stem_key", F.concat_ws("\u0001", bare, extension(F.col(name))))

    def step(taken: dict, row: Any) -> tuple[dict, tuple]:
        own = getattr(row, name)
        if own is None:
            return taken, (None,)
        low = own.lower()
        if low not in taken:
            taken[low] = 1
            return taken, (own,)
        dot = own.rfind(".") if own.rfind(".") > 0 else len(own)
        n = taken[low]
        while (free := f"{own[:dot]}({n}){own[dot:]}").lower() in taken:
            n += 1
        taken[low], taken[free.lower()] = n + 1, 1
        return taken, (free,)

    return fold(keyed, ["stem_key"], order, step, dict, "free_name string", [name]).drop("stem_key")
