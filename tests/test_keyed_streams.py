"""Streams with typed state: what they give and what they keep."""

import json
import os
import random
import time

from pyspark.sql import functions as F

from kilnspark.operators import folds, usage
from kilnspark.streaming import keyed


def feed(spark, folder, batches, schema):
    """A stream whose micro-batches are the given lists of rows."""
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        add(folder, i, rows)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def add(folder, i, rows):
    file = folder / f"{i:03}.json"
    (folder / ".new").write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(folder / ".new", (1_700_000_000 + i, 1_700_000_000 + i))
    os.rename(folder / ".new", file)


def start(df, folder, name):
    return df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "state")).start()


def settled(query, until, seconds=90):
    """Whether the query's table comes to fulfil a condition."""
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        if until():
            return True
        time.sleep(0.3)
    return False


def rows_of(spark, name):
    return [tuple(r) for r in spark.sql(f"select * from {name}").collect()]


def kept(spark, folder, name):
    return {r.key[0] for r in spark.read.format("statestore").option("stateVarName", name).load(str(folder / "state")).collect()}


def stamp(seconds):
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(1_700_000_000 + seconds))


def test_an_idle_key_is_forgotten(spark, tmp_path):
    hits = [{"key": "idle", "at": 2**60 + t} for t in (1, 2, 3, 4, 11, 12, 13)]
    df = keyed.limited(feed(spark, tmp_path / "in", [hits], "key string, at long"), 2, 10, 1500)
    query = start(df, tmp_path, "limited")
    try:
        assert settled(query, lambda: len(rows_of(spark, "limited")) == 7)
        assert [at - 2**60 for _, at, ok in sorted(rows_of(spark, "limited")) if ok] == [1, 2, 11, 12]
        time.sleep(2)
        add(tmp_path / "in", 1, [{"key": "other", "at": 5}])
        assert settled(query, lambda: len(rows_of(spark, "limited")) == 8)
        assert settled(query, lambda: kept(spark, tmp_path, "held") <= {"other"})
    finally:
        query.stop()


def test_stalled_jobs_by_the_clock(spark, tmp_path):
    rows = [{"id": "a", "seq": 1, "status": "processing"}, {"id": "b", "seq": 1, "status": "processing"}, {"id": "b", "seq": 2, "status": "completed"}, {"id": "c", "seq": 1, "status": "queued"}]
    query = start(keyed.stalled(feed(spark, tmp_path / "in", [rows], "id string, seq long, status string"), 500), tmp_path, "stalled_by_clock")
    try:
        assert settled(query, lambda: rows_of(spark, "stalled_by_clock") == [("a", "processing")])
        assert settled(query, lambda: kept(spark, tmp_path, "status") == set())
    finally:
        query.stop()


def finished(spark, df, folder, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return rows_of(spark, name)


def test_last_path_and_last_tool(spark, tmp_path):
    rng = random.Random(2)
    views = [{"subject": rng.choice("ab"), "at": i, "path": rng.choice(["/x", "/y"]), "tool": rng.choice(["t", "u", None])} for i in range(60)]
    got = finished(spark, keyed.changes_of_view(feed(spark, tmp_path / "in", [views[:20], views[20:21], views[21:]], "subject string, at long, path string, tool string")), tmp_path, "two_values")
    table = spark.createDataFrame([tuple(v.values()) for v in views], "subject string, at long, path string, tool string")
    want = {(r.subject, r.at, "path", r.path) for r in usage.drop_repeats(table, "subject", "path", ["at"]).collect()} | {(r.subject, r.at, "tool", r.tool) for r in usage.drop_repeated_tools(table, "subject", "tool", ["at"]).collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_shuffled_changes_give_the_fold_in_order(spark, tmp_path):
    """Within the delay order does not matter; what comes later than that is dropped."""
    rng = random.Random(4)
    rows = [{"id": rng.choice("ab"), "ts": stamp(i * 10), "seq": i, "status": rng.choice(["queued", "processing", ""]), "progress": rng.choice([None, i]), "stage": ""} for i in range(50)]
    mixed = [r for k in range(0, 50, 10) for r in rng.sample(rows[k : k + 10], 10)]
    end = [{"id": "z", "ts": stamp(5000), "seq": 0, "status": "end", "progress": None, "stage": ""}]
    late = [rows[3] | {"status": "late"}, {"id": "z", "ts": stamp(9000), "seq": 0, "status": "end", "progress": None, "stage": ""}]
    df = feed(spark, tmp_path / "in", [mixed[:7], mixed[7:23], mixed[23:], end, late], "id string, ts timestamp, seq long, status string, progress int, stage string")
    got = [r for r in finished(spark, keyed.job_state_by_time(df, "5 minutes"), tmp_path, "by_time") if r[0] != "z"]
    now, want = {}, []
    for r in rows:
        status, progress = now.get(r["id"], (None, None))
        now[r["id"]] = (r["status"] or status, progress if r["progress"] is None else r["progress"])
        want.append((r["id"], r["seq"], *now[r["id"]]))
    assert sorted((i, seq, status, progress) for i, _, seq, status, progress, _ in got) == sorted(want)


def test_consent_of_two_streams(spark, tmp_path):
    """Consents that come late within the delay count, later ones don't rewrite; the state goes when a consent is over."""
    events = [[{"subject": "s", "ts": stamp(t), "seq": t} for t in (10, 30, 50)], [{"subject": "s", "ts": stamp(200), "seq": 200}], [{"subject": "z", "ts": stamp(t), "seq": t} for t in (2000,)], [{"subject": "z", "ts": stamp(9000), "seq": 9000}], [{"subject": "z", "ts": stamp(9900), "seq": 9900}]]
    one = lambda t, state, v="v1": {"subject": "s", "ts": stamp(t), "seq": t, "version": v, "state": state}
    consents = [[one(40, "denied")], [one(20, "granted"), one(60, "granted")], [{"subject": "z", "ts": stamp(1990), "seq": 1, "version": "v0", "state": "granted"}], [one(5, "granted"), {"subject": "z", "ts": stamp(8990), "seq": 2, "version": "v1", "state": "granted"}], [{"subject": "z", "ts": stamp(9900), "seq": 3, "version": "v1", "state": "denied"}]]
    given = feed(spark, tmp_path / "c", consents, "subject string, ts timestamp, seq long, version string, state string")
    asked = feed(spark, tmp_path / "e", events, "subject string, ts timestamp, seq long")
    got = finished(spark, keyed.consented(given, asked, "v1", 150, "5 minutes"), tmp_path, "consented")
    assert sorted((s, seq) for s, _, seq in got) == [("s", 30), ("s", 200), ("z", 9000)]
    assert "s" not in kept(spark, tmp_path, "held")


def test_a_batch_of_a_key_waits_as_one_element(spark, tmp_path):
    """Rows of a key cost one entry and one timer a micro-batch; of rows of equal time and seq the last one counts."""
    rows = [{"id": "a", "ts": stamp(i), "seq": i, "status": f"s{i}", "progress": None, "stage": ""} for i in range(100)]
    df = feed(spark, tmp_path / "in", [rows[50:], rows[:50], [rows[7] | {"status": "new"}]], "id string, ts timestamp, seq long, status string, progress int, stage string")
    assert not finished(spark, keyed.job_state_by_time(df, "5 minutes"), tmp_path, "waiting_rows")
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "state"))
    assert state.count() == 3
    add(tmp_path / "in", 3, [{"id": "z", "ts": stamp(5000), "seq": 0, "status": "", "progress": None, "stage": ""}])
    got = [r for r in finished(spark, keyed.job_state_by_time(df, "5 minutes"), tmp_path / "again", "waited_rows") if r[0] == "a"]
    assert sorted((seq, status) for _, _, seq, status, _, _ in got) == [(i, "new" if i == 7 else f"s{i}") for i in range(100)]
