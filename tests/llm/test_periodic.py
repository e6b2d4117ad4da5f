import hashlib
import random
import zlib

import numpy as np

from kilnspark.llm import periodic, queries

from .data import documents, prose


def brute_runs(words, least=12):
    """All runs (start, length, period): of a stretch that several periods fit, the smallest."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > start and i + p - start >= max(least, 2 * p):
                found.setdefault((start, i + p), p)
            i += i == start
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda x: (x[0], x[2]))


def brute_kept(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(brute_kept(words, runs))).hexdigest())


def test_runs_equal_brute_force():
    """Small alphabets, planted periods, powers, several documents in one grammar."""
    rng = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(0, 5)):
            n, k = rng.choice([0, 1, 5, 11, 12, 13, 40, 150]), rng.choice([1, 2, 3, 9])
            words = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 2))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            docs.append(words)
        least = rng.choice([2, 5, 12])
        got = periodic.runs([np.array(d, np.int64) for d in docs], least)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [brute_runs(d, least) for d in docs]


def test_lce_equals_plain_comparison():
    rng = random.Random(2)
    word, last = [0], [1]
    for _ in range(10):
        word, last = word + last, word  # a Fibonacci word: repeats of every size
    for letters in (word, [rng.randrange(2) for _ in range(300)], [7] * 300):
        s = np.array([*letters, 99], np.int64)
        levels = periodic.grammar(s)
        a, b = np.array([sorted(rng.sample(range(len(letters)), 2)) for _ in range(500)]).T
        want = [next(k for k in range(len(s)) if s[i + k] != s[j + k]) for i, j in zip(a, b)]
        assert periodic.alike(levels, a, b).tolist() == want


def test_query(spark, tmp_path):
    rng = random.Random(4)
    base = documents(spark)
    more = [(1000 + i, prose(rng, rng.randint(0, 120)), "en", "s", 0, "x", "y", "z", "w") for i in range(120)]
    docs = base.unionAll(documents(spark, more))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((brute_row(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert sum(r[1] > 0 for r in got) > 10


def test_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 9, 5, 6, None), (None, None, 5, 6, 7)], "doc_id long, text string, runs int, row int, `start` int")
    out = periodic.find_runs(docs)
    assert out.columns == ["doc_id", "row", "start", "runs", "collapsed"]
    rows = sorted(out.collect(), key=lambda r: r.doc_id is None)
    assert [tuple(map(tuple, r.runs)) for r in rows] == [((0, 18, 2),), ()] and [r.collapsed for r in rows] == ["a b", ""]
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(50)}" for _ in range(200_000)]
    words[1000:150_000] = words[1000:40_000] * 4
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    best = max(periodic.find_runs(docs).first().runs, key=lambda r: r.length)
    assert best.period == 39_000 and best.start <= 1000 and best.length >= 156_000
