import hashlib
import random
import re

import pytest

from kilnspark.llm import anchors, lz_dedup, suffix_dedup

from .data import documents


def brute_bytes(texts, length):
    seen = {}
    for d, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            seen.setdefault(t[s : s + length], []).append((d, s))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                gone[d].update(range(s, s + length))
    return gone


def n_runs(gone):
    return sum(i - 1 not in gone for i in gone)


def test_repeated_starts_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 5))]
        length = rng.randint(2, 9)
        seen = {}
        for d, t in enumerate(segments):
            for s in range(len(t) - length + 1):
                seen.setdefault(t[s : s + length], []).append((d, s))
        want = [sorted(s for p in seen.values() if len(p) > 1 for e, s in p if e == d) for d in range(len(segments))]
        assert [x.tolist() for x in suffix_dedup.repeated_starts(segments, length)] == want


def test_anchor_lies_in_each_window():
    import numpy as np

    units = np.random.default_rng(1).integers(0, 3, 500)
    hashes = anchors.gram_hashes(units, 5)
    for i in range(0, 480):
        for j in range(i):
            assert (hashes[i] == hashes[j]) == (units[i : i + 5] == units[j : j + 5]).all()
    places = set(anchors.anchor_places(units, 13, 5)[0].tolist())
    assert all(any(s <= p <= s + 8 for p in places) for s in range(500 - 12))


@pytest.mark.parametrize("crowd,batch", [(1000, 1 << 20), (1, 1 << 20), (1000, 500)])
@pytest.mark.parametrize("length,gram", [(400, 64), (20, 5)])
def test_byte_dedup(spark, monkeypatch, crowd, batch, length, gram):
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    docs = documents(spark)
    rows = docs.collect()
    gone = brute_bytes([(r.text or "").encode() for r in rows], length)
    want = []
    for r, g in zip(rows, gone):
        data = (r.text or "").encode()
        want.append((r.doc_id, len(data), len(g), n_runs(g), hashlib.sha256(bytes(b for i, b in enumerate(data) if i not in g)).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.deduplicate(docs, length, gram, crowd).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_byte_dedup_of_nothing(spark):
    assert suffix_dedup.deduplicate(documents(spark, [])).count() == 0


def brute_words(rows, length):
    words = [[w for w in re.split(r"[ \t-\r]+", r.text or "") if w] for r in rows]
    order = [r.doc_id if r.doc_id is not None else 2**63 for r in rows]
    first = {}
    for o, ws in zip(order, words):
        for s in range(len(ws) - length + 1):
            gram = tuple(ws[s : s + length])
            first[gram] = min(first.get(gram, o), o)
    out = []
    for o, ws in zip(order, words):
        gone = {i for s in range(len(ws) - length + 1) if first[tuple(ws[s : s + length])] < o for i in range(s, s + length)}
        out.append((len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


@pytest.mark.parametrize("crowd", [64, 1])
@pytest.mark.parametrize("length,gram", [(13, 4), (4, 2)])
def test_word_dedup(spark, crowd, length, gram):
    docs = documents(spark)
    rows = docs.collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, brute_words(rows, length))]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in lz_dedup.deduplicate(docs, length, gram, crowd).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_word_dedup_of_random_repeats(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 80))), "en", "s", 0, "", "", "", "") for i in range(60)]
    docs = documents(spark, rows)
    rows = docs.collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, brute_words(rows, 6))]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in lz_dedup.deduplicate(docs, 6, 2, 8).collect()]
    assert sorted(got) == sorted(want)


def test_word_dedup_keeps_rows_and_columns(spark):
    docs = documents(spark)
    got = lz_dedup.deduplicated(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert lz_dedup.deduplicate(documents(spark, [])).count() == 0


def test_rows_without_ids_stay_apart(spark):
    """Two texts that agree in 31 bits of their usual hash, both without an id."""
    one, other = (" ".join(f"{c}{i}" for c in "abcdefghijklmnop") for i in (89634, 193672))
    docs = spark.createDataFrame([(None, one), (None, other), (5, "x " + other), (2**63 - 1, one), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept) for r in lz_dedup.deduplicate(docs).collect()}
    assert got == {(None, 16, 0, one), (None, 16, 16, ""), (5, 17, 0, "x " + other), (2**63 - 1, 16, 0, one), (None, 0, 0, "")}
    rows = {(r.doc_id, r.text) for r in lz_dedup.deduplicated(docs).collect()}
    assert rows == {(None, one), (None, ""), (5, "x " + other), (2**63 - 1, one), (None, None)}
    kept = {(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept).decode()) for r in suffix_dedup.deduplicate(docs, 20, 5).collect()}
    assert kept == {(None, len(one), len(one), ""), (None, len(other), len(other), ""), (5, len(other) + 2, len(other), "x "), (2**63 - 1, len(one), len(one), ""), (None, 0, 0, "")}


def test_many_copies_of_one_row(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h i j k l m n o p")] * 300 + [(7, "z a b c d e f g h i j k l m n")], "doc_id long, text string")
    got = lz_dedup.deduplicate(docs).collect()
    assert sorted({(r.doc_id, r.n_removed, r.kept) for r in got}, key=str) == [(7, 0, "z a b c d e f g h i j k l m n"), (None, 14, "o p")] and len(got) == 301


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h i j k l m n " * 2 + str(i), i, i, "k", i, i, i) for i in range(4)], "doc_id long, text string, ord int, h1 long, kept string, row int, spans int, key int")
    got = sorted(lz_dedup.deduplicated(docs).collect())
    assert [(r.doc_id, r.ord, r.h1, r.kept, r.row, r.spans, r.key) for r in got] == [(i, i, i, "k", i, i, i) for i in range(4)]
    assert [r.text for r in got[1:]] == ["1", "2", "3"]


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(lz_dedup, "STEP", 64)
    monkeypatch.setattr(lz_dedup, "LONG", 60)
    rng, seen = random.Random(1), {}
    for _ in range(1000):
        text = "".join(rng.choices(["a", "b", " ", "\t", "\n ", "ü", "漢", "word", "x" * rng.randint(1, 200)], k=rng.randint(0, 30))).encode()
        hashes = lz_dedup.word_hashes(text).tolist()
        assert len(hashes) == len(text.split())
        assert all(seen.setdefault(w, h) == h for w, h in zip(text.split(), hashes))
    assert len(set(seen.values())) == len(seen)
