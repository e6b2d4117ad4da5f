import hashlib

from pyspark.sql import functions as F

from kilnspark.llm import order_minhash as omh

from .data import documents


def test_compare_edits(spark):
    docs = documents(spark).where("doc_id is null or doc_id <> 4")
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    got = {r.doc_id: r for r in omh.compare_edits(docs).collect()}
    assert len(got) == len(rows)
    same = {}
    for row, after in zip(rows, rows[1:] + rows[:1]):
        text, other, r = row.text or "", after.text or "", got[row.doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert same.setdefault(text, r.fingerprint) == r.fingerprint
        assert (r.near_next == 1.0) == (r.fingerprint == got[after.doc_id].fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert omh.compare_edits(documents(spark, [])).count() == 0




def test_signature_is_sensitive_to_order_and_repeats(spark):
    words = [f"w{i}" for i in range(400)]
    swapped = words[200:] + words[:200]
    texts = [" ".join(words), " ".join(words[:390] + ["x"] * 10), " ".join(swapped), "a b " * 50, "a b " * 200, " ".join(reversed(words))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", omh.signature(F.col("t")).alias("s"))
    both = df.alias("a").crossJoin(df.alias("b")).select(F.col("a.i").alias("x"), F.col("b.i").alias("y"), omh.likeness(F.col("a.s"), F.col("b.s")).alias("n"))
    near = {(r.x, r.y): r.n for r in both.collect()}
    assert all(near[i, i] == 1 for i in range(6))
    assert near[0, 1] > 0.8 and near[0, 5] == 0 and near[3, 4] < 0.6
    assert 0.3 < near[0, 2] < 0.8  # the same k-mers, half of their pairs in another order


def test_likeness_falls_with_edits(spark):
    import random

    rng = random.Random(1)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(600)]
    texts = [" ".join(words)]
    for n in (6, 60, 300):
        edited = list(words)
        for i in rng.sample(range(600), n):
            edited[i] = f"e{i}"
        texts.append(" ".join(edited))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", omh.signature(F.col("t")).alias("s")).orderBy("i").collect()
    near = [len(set(rows[0].s) & set(r.s)) / 64 for r in rows]
    assert near[0] == 1 > near[1] > near[2] > near[3] and near[1] > 0.8
