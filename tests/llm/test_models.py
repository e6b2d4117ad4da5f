import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnspark.llm import maxent_lm, quality
from kilnspark.llm.common import crc_class

from .data import documents, prose


def test_quality_features_are_those_of_each_word(monkeypatch):
    s = quality.Settings()
    words = ["", "a", "straße", "日本語の文章", "x" * 40, "a"]
    whole = [(own.tolist(), at.tolist()) for own, at in quality.features(words, s)]
    counts = np.zeros(len(words), int)
    for own, _ in whole:
        np.add.at(counts, own, 1)
    assert counts.tolist() == [1 + sum(max(0, len(w) + 3 - k) for k in (2, 3, 4)) for w in words]
    weights = np.random.default_rng(1).random(s.buckets)
    total, n = quality.word_sums(words, weights, s)
    monkeypatch.setattr(quality, "STEP", 7)
    again, m = quality.word_sums(words, weights, s)
    assert np.allclose(total, again) and (n == m).all() and (n == counts).all()
    alone = [quality.word_sums([w], weights, s)[0][0] for w in words]
    assert np.allclose(total, alone) and total[1] == total[5]


def plain_features(text, s):
    """Features counted word by word and n-gram by n-gram."""
    found, words = Counter(), text.split()
    for k, w in enumerate(words):
        found[zlib.crc32(w.encode()) % s.buckets] += 1
        found[quality.AGAIN % s.buckets] += k > 0 and words[k - 1] == w
        marked = f"<{w}>"
        for size in range(s.shortest, s.longest + 1):
            for at in range(len(marked) - size + 1):
                mixed = 0
                for c in marked[at : at + size]:
                    mixed = (mixed * int(quality.ODD) + ord(c)) % 2**64
                found[((mixed + size) * int(quality.MIX) % 2**64 >> 32) % s.buckets] += 1
    return {k: n for k, n in found.items() if n}


def plain_training(docs, s):
    """The same steps with lists of numbers."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.width, 1 / s.width, (s.buckets, s.width)).tolist()
    layer, bias, steps, done = [[0.0, 0.0] for _ in range(s.width)], [0.0, 0.0], s.epochs * len(docs), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(docs)):
            found, label = docs[i]
            total = sum(found.values())
            rate = s.rate * (1 - done / steps)
            done += 1
            mean = [sum(vectors[f][d] * n / total for f, n in found.items()) for d in range(s.width)]
            logits = [bias[c] + sum(mean[d] * layer[d][c] for d in range(s.width)) for c in (0, 1)]
            odds = [math.exp(x - max(logits)) for x in logits]
            wrong = [o / sum(odds) - (c == label) for c, o in enumerate(odds)]
            back = [sum(layer[d][c] * wrong[c] for c in (0, 1)) for d in range(s.width)]
            for d in range(s.width):
                for c in (0, 1):
                    layer[d][c] -= rate * mean[d] * wrong[c]
                for f, n in found.items():
                    vectors[f][d] -= s.vector_rate * rate * back[d] * n / total
            for c in (0, 1):
                bias[c] -= 0.1 * rate * wrong[c]
    return [sum(v[d] * (layer[d][1] - layer[d][0]) for d in range(s.width)) for v in vectors], bias[1] - bias[0]


def test_quality_equals_plain_training_and_scoring(spark):
    """Features, every step of training and the scores against loops over words and numbers."""
    s = quality.Settings(buckets=512, width=3, epochs=3)
    rng = random.Random(8)
    texts = {i: prose(rng, 25) + (" zz zz $$" * 3 if i % 2 else "") for i in range(16)} | {16: "", 17: "straße straße 日本語"}
    docs = documents(spark, [(i, t, "en", "s", 0, "", "", "", "") for i, t in texts.items()])
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(16)], "doc_id long, quality int, toxic int")
    rows = quality.training_rows(docs, labels, F.col("doc_id") < 12, s)
    plain = [(plain_features(texts[i], s), 1 - i % 2) for i in range(12)]
    assert [(dict(zip(at.tolist(), n.tolist())), label) for at, n, label in rows] == plain
    weights, bias = plain_training(plain, s)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels, F.col("doc_id") >= 12, settings=s).collect()}
    for i, text in texts.items():
        found = plain_features(text, s)
        logit = bias + sum(weights[f] * n for f, n in found.items()) / max(1, sum(found.values()))
        assert abs(got[i] - 1 / (1 + math.exp(-logit))) < 1e-4, i
    few = quality.training_rows(docs, labels, F.col("doc_id") < 12, quality.Settings(buckets=512, pairs=1))
    assert len(few) == 1


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = " ".join(w + ("$$$" if bad else "") for w in prose(rng, 60).split())
        rows.append((i, text, "en", "s", 0, "", "", "", ""))
        labels.append((i, 0 if bad else 1, 0))
    labels += [(0, 0, 0), (9999, 1, 0), (None, 1, 0), (5, None, 0)]
    docs = documents(spark, rows + [(None, None, None, None, 0, "", "", "", ""), (1000, "", "en", "s", 0, "", "", "", "")])
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), crc_class(4) == 2).collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert len(held) > 40 and sum(r.predicted == (r.doc_id % 3 != 0) for r in held) >= 0.95 * len(held)
    empty = quality.classify(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"), crc_class(4) == 2)
    assert empty.count() == 0
    unlabelled = quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), crc_class(4) == 2)
    assert {r.score for r in unlabelled.collect()} == {0.5}


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[ \t-\r]+", low) if w] + ["\n"]


@pytest.mark.parametrize("head", [1 << 17, 5])
def test_base_scores_equal_brute_force(spark, head):
    docs = documents(spark)
    rows = docs.withColumn("k", crc_class(7)).collect()
    counts = Counter(w for r in rows if r.k is not None and r.k != 2 for w in words(r.text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        own = words(r.text)
        want.append((str(r.doc_id), r.k == 2, len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 6)))
    got = maxent_lm.scores(docs, crc_class(7) != 2, crc_class(7) == 2, maxent_lm.Settings(head=head)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score <= 0 for r in got)
    assert maxent_lm.scores(documents(spark, []), F.lit(True), F.lit(False)).count() == 0


def test_model_adds_up_to_one_and_beats_the_base(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["red fox", "blue whale", "old oak"]) for _ in range(40)), "en", "s", 0, "", "", "", "") for i in range(200)]
    docs = documents(spark, rows)
    got = maxent_lm.scores(docs, crc_class(7) != 2, crc_class(7) == 2, maxent_lm.Settings(rounds=4)).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    texts = docs.select(F.encode("text", "utf-8").alias("text"))
    s = maxent_lm.Settings(rounds=2)
    counts = maxent_lm.count_words(texts, s)
    model = maxent_lm.fit(texts, counts, s)
    hashes, _, ends = maxent_lm.batch_ids(model, [b"red fox blue"])
    p = maxent_lm.probabilities(model, maxent_lm.contexts(hashes, ends, s.buckets))[1].astype(float)
    known = {r.word: r.c for r in counts.collect()}
    own = {w: model.classes[maxent_lm.batch_ids(model, [bytes(w)])[1][0]] for w in known}
    total = sum(p[own[w]] * (c + 1) / model.mass[own[w]] for w, c in known.items())
    total += p[-1] / model.mass[-1] if model.mass[-1] > 0 else 0  # the one unknown word
    assert abs(total - 1) < 1e-3


@pytest.mark.parametrize("head", [1 << 17, 5])
def test_scores_equal_those_of_single_tokens(spark, head):
    docs = documents(spark)
    s = maxent_lm.Settings(head=head)
    training = docs.where(crc_class(7) != 2).select(F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"))
    counts = maxent_lm.count_words(training, s)
    model, known = maxent_lm.fit(training, counts, s), {bytes(r.word): r.c for r in counts.collect()}
    assert maxent_lm.head_words(counts, head)[0][1] == max(known.values()) or head < len(known)
    want = []
    for row in docs.collect():
        own, total = [w.encode() for w in words(row.text)], 0.0
        hashes, ids, ends = maxent_lm.batch_ids(model, [(row.text or "").encode()])
        for i, word in enumerate(own):
            logits = model.bias.astype(float)
            for at in maxent_lm.contexts(hashes[: i + 1], np.array([i + 1]), s.buckets)[:, i]:
                logits = logits + model.weights[at]
            c = model.classes[ids[i]]
            p = np.exp(logits[c] - logits.max()) / np.exp(logits - logits.max()).sum()
            total += math.log10(p) + math.log10((known.get(word, 0) + 1) / model.mass[c])
        want.append((str(row.doc_id), len(own), total))
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in maxent_lm.scores(docs, crc_class(7) != 2, crc_class(7) == 2, s).collect())
    for a, b in zip(got, sorted(want)):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) <= 1e-3 * abs(b[2]) + 1e-3


def plain_gradient(texts, model, s):
    """Token by token: how often each row of weights met each class, and expected to."""
    met, wanted = np.zeros((s.buckets, s.classes)), np.zeros((s.buckets, s.classes))

    def row(x, salt):
        odd = 0x9E3779B97F4A7C15
        h = (x + salt) * odd % 2**64
        h ^= h >> 29
        return (h * odd % 2**64 >> 40) % s.buckets

    place = {int(h): k for k, h in enumerate(model.hashes)}
    for text in texts:
        own = [int(maxent_lm._END[0]) if w == maxent_lm.END else int(maxent_lm.word_hashes(w)[0]) for w in maxent_lm.tokens(text)]
        for i, h in enumerate(own):
            before, second = own[i - 1] if i else 0, own[i - 2] if i > 1 else 0
            rows = [row(before, 11), row((before * 1_000_003 + second) % 2**64, 5077), row(second, 90_001)]
            logits = [float(model.bias[c]) + sum(float(model.weights[r, c]) for r in rows) for c in range(s.classes)]
            odds = [math.exp(x - max(logits)) for x in logits]
            for r in rows:
                met[r, model.classes[place.get(h, -1)]] += 1
                for c in range(s.classes):
                    wanted[r, c] += odds[c] / sum(odds)
    return met, wanted


def test_gradient_equals_a_plain_one(spark):
    """Before and after a step; with words beyond the head, short and empty texts."""
    rng = random.Random(6)
    s = maxent_lm.Settings(head=12, buckets=97, rounds=0)
    texts = [prose(rng, rng.choice([0, 1, 2, 40])).encode() for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "text binary").repartition(3)
    counts = maxent_lm.count_words(df, s)
    for rounds in (0, 1):
        model = maxent_lm.fit(df, counts, maxent_lm.Settings(head=12, buckets=97, rounds=rounds))
        assert bool(np.abs(model.weights).max() > 0) == (rounds > 0)
        sums = maxent_lm.gradient(df, spark.sparkContext.broadcast(model), s)
        met, wanted = plain_gradient(texts, model, s)
        assert np.array_equal(sums[:, : s.classes], met) and np.allclose(sums[:, s.classes :], wanted, rtol=1e-4, atol=1e-4)
