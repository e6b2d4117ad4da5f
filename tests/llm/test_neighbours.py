import numpy as np

from kilnspark.llm import multi_index

FIELDS = "vec_id long, embedding array<float>, label int, cell string"


def vectors(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, 16))
    rows = (centres[rng.integers(0, 10, n)] + 0.6 * rng.normal(size=(n, 16))).astype(np.float32)
    rows[200:500] = rows[200]
    return rows


def brute(ids, rows, every, top):
    out = {}
    for i, q in zip(ids, rows.astype(float)):
        if i % every == 0:
            far = np.sqrt(((rows.astype(float) - q) ** 2).sum(1))
            out[i] = sorted((d, j) for d, j in zip(far.tolist(), ids) if j != i)[:top]
    return out


def test_recall_and_order(spark):
    rows = vectors()
    bad = [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [1.0, None] * 8), (9400, [float("inf")] * 16), (9500, [1.0] * 3), (None, [1.0] * 16)]
    data = [(i, r.tolist(), 0, "x") for i, r in enumerate(rows)] + [(i, v, 0, "x") for i, v in bad] + [(7, rows[7].tolist(), 0, "x")]
    got = {}
    for r in multi_index.search(spark.createDataFrame(data, FIELDS), every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute(list(range(len(rows))), rows, 20, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert all(v == sorted(v) for v in got.values())
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    for q in (200, 220, 480):  # members of a large group of equal vectors
        assert got[q] == want[q]
    for q, found in got.items():
        assert np.allclose([s for s, _ in found], [np.sqrt(((rows[j].astype(float) - rows[q].astype(float)) ** 2).sum()) for _, j in found], rtol=1e-12)


def test_all_cells_is_exact(spark):
    rows = vectors(300, 5)
    df = spark.createDataFrame([(i, r.tolist(), 0, "x") for i, r in enumerate(rows)], FIELDS)
    got = {}
    for r in multi_index.search(df, every=10, share=1.0, centroids=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [j for _, j in v] for q, v in brute(list(range(300)), rows, 10, 10).items()}


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0, "x"), (1, [1.0, 3.0], 0, "x")], FIELDS)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in multi_index.search(df).collect()] == [(0, 1, 1, 1.0)]
    assert multi_index.search(spark.createDataFrame([], FIELDS)).count() == 0


def test_cells_come_by_ascending_distance():
    rng = np.random.default_rng(1)
    a, b, counts = rng.random(6), rng.random(7), rng.integers(0, 3, 42)
    cells = multi_index.visit(a, b, counts, 10**9)
    assert cells == [c for c in sorted(range(42), key=lambda c: a[c // 7] + b[c % 7]) if counts[c]]
