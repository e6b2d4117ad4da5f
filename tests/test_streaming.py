"""Streams against their batch twins."""

import json
import os

from pyspark.sql import functions as F

from kilnspark.operators import folds
from kilnspark.streaming import states


def feed(spark, tmp_path, rows, schema):
    for i in range(0, len(rows), 3):
        file = tmp_path / f"{i:03}.json"
        file.write_text("\n".join(json.dumps(r) for r in rows[i : i + 3]))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # files arrive in this order
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_rate_limit(spark, tmp_path):
    rows = [{"key": "ab"[i % 2], "at": float(i)} for i in range(12)]
    got = {(r.key, r.at): r.accepted for r in run(states.stream_rate_limit(feed(spark, tmp_path, rows, "key string, at double"), 2, 6, None), "rate")}
    want = {(r.key, r.at): r.accepted for r in folds.rate_limit(spark.createDataFrame([(r["key"], r["at"]) for r in rows], "key string, at double"), ["key"], ["at"], 2, 6).collect()}
    assert got == want


def test_job_state_and_repeats(spark, tmp_path):
    rows = [{"id": "j", "seq": i, "status": s, "progress": p} for i, (s, p) in enumerate([("queued", 0), ("", 10), ("processing", None), ("", 50), ("completed", 100)])]
    got = run(states.stream_job_state(feed(spark, tmp_path, rows, "id string, seq long, status string, progress int, stage string")), "jobs", "update")
    assert [(r.status, r.progress) for r in got] == [("processing", 10), ("completed", 100)]


def test_progress_ends_with_the_result(spark, tmp_path):
    rows = [{"job_id": "j", "seq": i, "type": t, "progress": p} for i, (t, p) in enumerate([("progress", 5.0), ("progress", 3.0), ("progress", 60.0), ("result", None), ("progress", 1.0)])]
    got = run(states.stream_progress(feed(spark, tmp_path, rows, "job_id string, seq long, type string, progress double")), "progress")
    assert [r.shown for r in sorted(got, key=lambda r: r.seq)] == [5, 5, 60, 100, 1]


def test_repeats_and_consent(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "c").mkdir()
    views = [{"subject": "s", "at": float(i), "path": p} for i, p in enumerate("aabbab")]
    assert [r.path for r in sorted(run(states.stream_drop_repeats(feed(spark, tmp_path / "v", views, "subject string, at double, path string")), "views"), key=lambda r: r.at)] == list("abab")
    marks = [{"subject": "s", "at": float(i), "kind": k, "version": "v1", "state": st} for i, (k, st) in enumerate([("event", ""), ("consent", "granted"), ("event", ""), ("consent", "denied"), ("event", "")])]
    assert [r.at for r in run(states.stream_consent_gate(feed(spark, tmp_path / "c", marks, "subject string, at double, kind string, version string, state string"), "v1", 100), "consent")] == [2.0]


def test_expiry_stalls_and_counts(spark, tmp_path):
    (tmp_path / "e").mkdir()
    rows = [{"id": "a", "ts": "2024-01-01T00:00:00Z", "status": "declined"}, {"id": "b", "ts": "2024-01-01T00:00:00Z", "status": "processing"}, {"id": "c", "ts": "2024-01-01T00:01:00Z", "status": "approved"}]
    rows += [{"id": "d", "ts": f"2024-01-01T0{h}:00:00Z", "status": "x"} for h in (2, 3, 4)] * 2
    src = lambda: feed(spark, tmp_path / "e", rows, "id string, ts timestamp, status string").withWatermark("ts", "1 minute")
    assert {r.id for r in run(states.stream_expiry(src()), "expiry")} == {"a"}
    assert {r.id for r in run(states.stream_stalled_jobs(src(), 600_000), "stalled")} == {"b"}
    counts = run(states.stream_usage_counts(feed(spark, tmp_path / "e", rows, "id string, ts timestamp, status string").select("ts", F.col("status").alias("event"))), "counts")
    assert ("declined", 1) in {(r.event, r.n) for r in counts}


def test_deadlines_of_keys_that_share_groups(spark, tmp_path):
    """A key's later row replaces its deadline or ends it; eight groups hold all keys."""
    day = "2024-01-01T{:02}:00:00Z".format
    first = [{"id": str(i), "ts": day(0), "status": "pending"} for i in range(3000)]
    again = [{"id": str(i), "ts": day(1), "status": ("declined", "done", "pending")[i % 3]} for i in range(0, 3000, 2)]
    ends = [{"id": "end", "ts": t, "status": "x"} for t in ("2024-01-01T05:00:00Z", "2024-01-02T00:30:00Z", "2024-01-02T00:40:00Z")]
    for i, rows in enumerate([first, again, *([e] for e in ends)]):
        file = tmp_path / f"{i:03}.json"
        file.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    df = spark.readStream.schema("id string, ts timestamp, status string").option("maxFilesPerTrigger", 1).json(str(tmp_path)).withWatermark("ts", "1 minute")
    got = run(states.stream_expiry(df, groups=8), "many_deadlines")
    want = {(str(i), "pending") for i in range(1, 3000, 2)} | {(str(i), "declined") for i in range(0, 3000, 2) if i % 3 == 0}
    assert {(r.id, r.status) for r in got} == want and len(got) == len(want)
