import hashlib
import random
import zlib

import duckdb
import pytest

from kilnspark.llm import merkle, queries

from .data import documents

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(leaves):
    """The root, and for each leaf the siblings left and right, level by level."""
    now, below, paths = leaves, [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(now) > 1:
        up, under = [], []
        for k in range(0, len(now), 16):
            run = now[k : k + 16]
            for j in range(len(run)):
                for i in below[k + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(digest(*run))
            under.append(sum(below[k : k + 16], []))
        now, below = up, under
    return now[0], paths


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources]
    trees = [climb([leaf(r) for r in g]) for g in groups]
    root, above = climb([t[0] for t in trees]) if trees else (None, [])
    out = []
    for group, (subroot, paths), over in zip(groups, trees, above):
        for r, path in zip(group, paths):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            now = leaf([*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])]) if hit else leaf(r)
            for left, right in path + over:
                now = digest(left, now, right)
            out.append((r[0], leaf(r), subroot, root, digest(*[a + b for a, b in path + over]), now, now == root))
    return sorted(out, key=str)


def table(n, sources, seed=3):
    rng = random.Random(seed)
    return [(i * 2, rng.choice(sources), rng.choice(["en", None]), rng.choice([7, None]), rng.choice(["Über Text", "plain", "", None, "x" * 5000]), "x", "y", "z", "w") for i in range(n)]


@pytest.mark.parametrize("n, sources", [(1, ["a"]), (16, ["a"]), (17, ["a"]), (300, ["a", "b", None, ""]), (40, [f"s{i}" for i in range(40)])])
def test_query(spark, tmp_path, n, sources):
    rows = [(r[0], r[1], r[3], r[4], r[2]) for r in table(n, sources)]
    docs = spark.createDataFrame([(i, s, t, c, lang, 1) for i, s, c, t, lang in rows], "doc_id long, source string, text string, n_chars long, lang string, leaf int").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute([(i, s, lang, c, t) for i, s, c, t, lang in rows])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(merkle.oracle()).fetchall(), key=str) == sorted(got, key=str)


def test_null_and_shared_ids_and_repeated_rows(spark):
    docs = documents(spark)
    docs = docs.unionAll(docs.where("doc_id < 16"))
    got = sorted((tuple(r) for r in merkle.manifest(docs, FIELDS).collect()), key=str)
    rows = [tuple(r[c] for c in FIELDS) for r in docs.collect()]
    want = brute(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want] and all(r[6] for r in got)
    assert merkle.manifest(documents(spark, []), FIELDS).count() == 0


def test_rows_of_one_source_and_id_span_ranges(spark):
    docs = spark.createDataFrame([(5, "s", "en", 1, "same")] * 700, "doc_id long, source string, lang string, n_chars long, text string")
    got = [tuple(r) for r in merkle.manifest(docs, FIELDS).collect()]
    assert sorted(r[:5] for r in got) == sorted(r[:5] for r in brute([(5, "s", "en", 1, "same")] * 700))
