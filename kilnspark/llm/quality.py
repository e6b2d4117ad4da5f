"""Quality scores from supervised subword embeddings.

Each word and each of its character n-grams hashes to a learned vector; a
document is the average of its features' vectors, a softmax layer gives the
class. Training is stochastic gradient descent in numpy on a bounded sample
of labelled rows. For scoring, vectors and layer fold into one number a
feature, so that a document's score is an average over all its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import discard, mapped, slices, stored, text_of

#: N-gram starts hashed at a time; multipliers of the n-gram hash; the word pairs of a word with itself, which all share one feature.
STEP, ODD, MIX, AGAIN = 1 << 20, np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15), zlib.crc32(b"\0again")


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows that training uses at most (those whose ids hash lowest), whole; pairs: features of all of them together that it uses at most.

    rate: steps of the layer; a feature's vector has vector_rate times that,
    as its share of a document, and so its gradient, is small.
    """

    buckets: int = 1 << 18
    width: int = 8
    shortest: int = 2
    longest: int = 4
    epochs: int = 6
    rate: float = 0.5
    vector_rate: float = 100.0
    sample: int = 1500
    pairs: int = 1 << 23
    seed: int = 11


def features(words: list[str], s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in words, bucket) of the words and of their character n-grams, word ends marked; STEP n-gram starts at a time."""
    n = len(words)
    yield np.arange(n), np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, n) % s.buckets
    lengths = np.fromiter(map(len, words), np.int64, n) + 2
    codes = np.frombuffer(("".join(f"<{w}>" for w in words) + "\0" * s.longest).encode("utf-32-le"), "<u4")
    owner, ends = np.repeat(np.arange(n, dtype=np.int32), lengths), lengths.cumsum()
    for at in range(0, len(owner), STEP):
        own = owner[at : at + STEP]
        room = ends[own] - np.arange(at, at + len(own))
        mixed = np.zeros(len(own), np.uint64)
        for size in range(1, s.longest + 1):
            mixed = mixed * ODD + codes[at + size - 1 : at + size - 1 + len(own)]
            if size >= s.shortest:
                fits = room >= size
                high = (mixed[fits] + np.uint64(size)) * MIX >> np.uint64(32)
                yield own[fits], (high % np.uint64(s.buckets)).astype(np.int64)


def counted(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and how often each occurs; a word after itself is a feature too."""
    words = text.split()
    again = [AGAIN % s.buckets] * sum(map(str.__eq__, words, words[1:]))
    found = [np.array(again, np.int64), *(at for _, at in features(words, s))]
    return np.unique(np.concatenate(found), return_counts=True)


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> tuple[np.ndarray, float]:
    """What each bucket adds to the logit of label 1, and the bias, from (features, their counts, label) of each document."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.width, 1 / s.width, (s.buckets, s.width))
    layer, bias = np.zeros((s.width, 2)), np.zeros(2)
    steps, done = max(1, s.epochs * len(docs)), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(docs)):
            at, n, label = docs[i]
            rate = s.rate * (1 - done / steps)
            done += 1
            share = (n / n.sum())[:, None] if len(at) else np.zeros((0, 1))
            mean = (vectors[at] * share).sum(axis=0)
            logits = mean @ layer + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            back = layer @ wrong
            layer -= rate * np.outer(mean, wrong)
            bias -= 0.1 * rate * wrong
            vectors[at] -= s.vector_rate * rate * back * share
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, teaches: Column, s: Settings) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(features, their counts, label) of at most s.sample labelled documents that teach, in a fixed order.

    Features are counted in the tasks, over whole texts, and come back as
    numbers of 32 bits. Rows are taken in the order of their ids' hashes as long
    as they have at most s.pairs features together, the first in any case. Of
    several texts of one id the one that hashes lowest teaches.
    """
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = known.where(teaches).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)  # s.sample rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = [counted(t.as_py(), s) for t in batch.column(2)]
            sizes = pa.array([len(at) for at, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], sizes, pa.array([np.stack(x).astype("<i4").tobytes() for x in found], pa.binary())], ["doc_id", "label", "size", "pairs"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    some = own.join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "label")), "doc_id")
    one = some.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "label", "t.text")
    held = stored(mapped(one, run, "doc_id long, label int, size long, pairs binary"), "labelled")
    left, taken = s.pairs, []
    for r in held.select("doc_id", "size").orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # s.sample rows
        left -= r.size
        if taken and left < 0:
            break
        taken.append(r.doc_id)
    rows = [(r.doc_id, np.frombuffer(r.pairs, "<i4").reshape(2, -1), r.label) for r in held.where(F.col("doc_id").isin(taken)).collect()]
    discard(held)
    return [(*pairs, label) for _, pairs, label in sorted(rows, key=lambda r: r[0])]


def word_sums(words: list[str], weights: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each word the sum of its features' weights and the number of its features."""
    total, n = np.zeros(len(words)), np.zeros(len(words), np.int64)
    for own, at in features(words, s):
        total += np.bincount(own, weights[at], minlength=len(words))
        n += np.bincount(own, minlength=len(words))
    return total, n


def scored(docs: DataFrame, weights: np.ndarray, bias: float, s: Settings) -> DataFrame:
    """(doc_id, score) for each row of docs; a text without words gets the bias alone."""
    model = docs.sparkSession.sparkContext.broadcast(weights)  # s.buckets numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        again = float(weights[AGAIN % s.buckets])
        for batch in slices(batches):
            place: dict[str, int] = {}
            docs, twice = [], []
            for text in batch.column(1):
                words = text.as_py().split()
                docs.append(np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32, len(words)))
                twice.append(int((docs[-1][1:] == docs[-1][:-1]).sum()))
            total, n = word_sums(list(place), weights, s)
            scores = []
            for at, doubled in zip(docs, twice):
                logit = bias + (total[at].sum() + doubled * again) / max(1, n[at].sum() + doubled)
                scores.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", text_of().alias("text")), run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, settings: Settings | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text).

    held_out is a condition on doc_id; such rows never teach (nor do rows
    without an id or with another label than 0 and 1; of contradicting labels
    the lower holds). Only the text, whole, makes the score. Null texts count as
    empty; rows may repeat; an empty table gives no rows; other columns are left
    out. Without labelled rows every score is one half.
    """
    s = settings or Settings()
    rows = training_rows(docs, labels, F.col("doc_id").isNotNull() & ~held_out, s)
    weights, bias = train(rows, s) if rows else (np.zeros(s.buckets, np.float32), 0.0)
    return scored(docs, weights, bias, s).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, settings: Settings | None = None) -> DataFrame:
    """The rows of docs whose own text scores threshold or more; all rows if nothing teaches.

    A score comes from the text alone, so rows are judged by 128 bits of the
    text's hashes and ids may be null or shared; a null text counts as empty;
    all columns stay, whatever their names.
    """
    s = settings or Settings()
    rows = training_rows(docs, labels, F.col("doc_id").isNotNull() & ~held_out, s)
    if not rows:
        return docs
    name = F.struct(F.xxhash64(text_of()).alias("h1"), F.xxhash64(F.lit(1), text_of()).alias("h2"))
    own = docs.select(name.alias("doc_id"), "text")
    bad = scored(own, *train(rows, s), s).where(F.col("score") < threshold).select("doc_id").distinct()
    whole = docs.select(name.alias("doc_id"), F.struct("*").alias("row"))
    return whole.join(bad.hint("merge"), "doc_id", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
