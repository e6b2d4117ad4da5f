"""Folds whose keys are walked in ranges, and transitions by aggregates, against a walk of all rows in order."""

import random
from types import SimpleNamespace

import pytest

from kilnspark.operators import folds


def walked(rows, key, step, start):
    """The outputs of step over rows in order, by the row's place."""
    states, out = {}, {}
    for i, row in enumerate(rows):
        states[key(row)], out[i] = step(states.get(key(row), start), SimpleNamespace(**row))
    return out


def hits(n, seed):
    rng, at, rows = random.Random(seed), 0.0, []
    for i in range(n):
        at += rng.choice([0, 0.5, 1, 1, 2, 9])
        rows.append({"key": rng.choice(["hot", "hot", "hot", None, "a", "b"]), "at": at, "seq": i})
    return rows


@pytest.mark.parametrize("limit, window, crowd", [(2, 6.0, 20), (3, 25.0, 0), (1, 1e9, 20), (0, 5.0, 20), (5, 40.0, 10**6)])
def test_rate_limit_in_ranges(spark, limit, window, crowd):
    rows = hits(400, limit)
    df = spark.createDataFrame([(r["key"], r["at"], r["seq"]) for r in rows], "key string, at double, seq long").repartition(7)
    got = folds.rate_limit(df, ["key"], ["at", "seq"], limit, window, crowd)
    assert got.columns == ["key", "at", "seq", "accepted"]
    want = walked(rows, lambda r: r["key"], folds.rate_step(limit, window), ())
    assert sorted((r.seq, r.accepted) for r in got.collect()) == [(i, want[i][0]) for i in range(len(rows))]


@pytest.mark.parametrize("moves", [[-3, -1, 0, 1, 2, 4, 30], [1], [0], [3, -3]])
def test_throttle_in_ranges(spark, moves):
    """Steady moves never forget where they began, so each round settles one range."""
    rng, rows, now = random.Random(len(moves)), [], 10.0
    for i in range(300):
        now = (now + rng.choice(moves)) % 101
        rows.append({"key": "hot" if i % 9 else f"k{i % 2}", "seq": i, "progress": now})
    df = spark.createDataFrame([(r["key"], r["seq"], r["progress"]) for r in rows], "key string, seq long, progress double").repartition(5)
    want = walked(rows, lambda r: r["key"], folds.throttle_step(5, 75), None)
    got = folds.throttle(df, ["key"], ["seq"], crowd=40).collect()
    assert sorted((r.seq, r.emit) for r in got) == [(i, want[i][0]) for i in range(len(rows))]


def test_more_crowded_keys_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(folds, "MANY", 1)
    rows = hits(200, 3)
    df = spark.createDataFrame([(r["key"], r["at"], r["seq"]) for r in rows], "key string, at double, seq long")
    want = walked(rows, lambda r: r["key"], folds.rate_step(2, 9.0), ())
    got = folds.rate_limit(df, ["key"], ["at", "seq"], 2, 9.0, 5).collect()
    assert sorted((r.seq, r.accepted) for r in got) == [(i, want[i][0]) for i in range(len(rows))]


def test_no_rows(spark):
    assert folds.rate_limit(spark.createDataFrame([], "key string, at double"), ["key"], ["at"], 2, 9.0, 0).count() == 0
    assert folds.request_transitions(spark.createDataFrame([], "request_id string, seq long, at long, kind string, ttl_ms long")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_transitions_by_aggregates(spark, seed):
    """Requests of all lengths, a null one too; times go back and forth, events come before their creation and repeat."""
    rng = random.Random(seed)
    kinds = ["create", "approve", "decline", "redeem", "redeem", "other", None]
    rows = [{"request_id": rng.choice([None, *map(str, range(60))]), "seq": i, "at": rng.randrange(60), "kind": rng.choices(kinds, [4, 4, 1, 3, 3, 1, 1])[0], "ttl_ms": rng.choice([0, 20, 50])} for i in range(900)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "request_id string, seq long, at long, kind string, ttl_ms long").repartition(6)
    want = walked(rows, lambda r: r["request_id"], folds.transition_step, None)
    got = {r.seq: (r.accepted, r.status, r.reason) for r in folds.request_transitions(df).collect()}
    assert got == want
    assert {x[2] for x in want.values()} >= {None, "exists", "expired", "not pending", "not approved", "unknown event"}
