"""Scores of a hashed maximum-entropy language model.

The model gives each word, and the end of a text, a probability in two steps:
a softmax over word classes whose features are hashed from the two words
before (the one before, both, and the one skipped to; all words have features
of their own, rare and unknown ones too), then the word's share of its class by
training counts plus one. Words rarer than the `head` most frequent and unknown
words make up the last class; the others are classed by frequency and spelling. The probabilities of all known words and of one unknown word add
up to one in each context.

Counts come from all training texts. Weights are trained by distributed
gradient updates: in each round every task sums the gradient of its texts,
Spark adds the sums, and the driver takes a scaled step on the table, whose
size is fixed. Scoring is a numpy pass over batches of texts; the counts of the
words beyond the head are joined.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.anchors import ROW, doc_id, identity
from kilnspark.llm.common import slices, stored, text_of
from kilnspark.llm.lz_dedup import placed_hashes, word_hashes
from kilnspark.llm.multi_index import kmeans, nearest

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The end of a text; white space, so no word.
END = b"\n"
_END = np.array([xxhash.xxh64_intdigest(END)], np.uint64)


@dataclass(frozen=True)
class Settings:
    """head: words that tasks know by heart, at most; buckets: 65,536 at most; fitted: those of them whose spelling forms the clusters.

    spellings x tiers + 1 classes; buckets rows of weights; tasks: at most so
    many sum a gradient, each sends one row a bucket.
    """

    head: int = 1 << 17
    fitted: int = 20_000
    tasks: int = 4096
    spellings: int = 5
    tiers: int = 3
    buckets: int = 1 << 14
    rounds: int = 2
    rate: float = 0.5
    most: float = 2.0
    smooth: float = 2.0
    pending: int = 200_000

    @property
    def classes(self) -> int:
        return self.spellings * self.tiers + 1


def tokens(text: bytes) -> list[bytes]:
    """The words, A-Z lower-cased, then the end."""
    out = text.translate(UPPER).split()
    out.append(END)
    return out


def count_words(texts: DataFrame, s: Settings) -> DataFrame:
    """(word binary, c) over texts(text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
            if len(held) > s.pending:
                yield out()
                held.clear()
        if held:
            yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def classes_of(words: list[bytes], counts: np.ndarray, s: Settings) -> np.ndarray:
    """A class for each head word: its spelling's cluster and its frequency tier."""
    if not words:
        return np.zeros(0, np.int64)
    spelled = np.zeros((len(words), 128), np.float32)
    for i, word in enumerate(words):
        for j in range(max(1, len(word) - 1)):
            spelled[i, zlib.crc32(word[j : j + 2]) % 128] += 1
    spelled /= np.maximum(np.linalg.norm(spelled, axis=1, keepdims=True), 1e-9)
    centres = kmeans(spelled[: s.fitted], s.spellings, 3, 8)
    order = np.argsort(-counts, kind="stable")
    share = np.empty(len(words))
    share[order] = np.cumsum(counts[order]) / max(1, counts.sum())
    return nearest(spelled, centres) * s.tiers + np.minimum((share * s.tiers).astype(int), s.tiers - 1)


@dataclass
class Model:
    """What tasks need: the head's words, classes and counts, and the class weights."""

    hashes: np.ndarray  # ascending; the other arrays follow this order
    classes: np.ndarray
    counts: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    mass: np.ndarray
    total: float
    n_tokens: int

    def __post_init__(self):
        #: Where the hashes of each leading 18 bits begin, and how many share them at most.
        self.first = np.searchsorted(self.hashes, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int32)
        self.steps = int(np.diff(np.append(self.first, len(self.hashes))).max())

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash in the head, -1 beyond it."""
        at, end = self.first[(hashes >> np.uint64(46)).astype(np.int64)].astype(np.int64), len(self.hashes) - 1
        out = np.where(self.hashes[np.minimum(at, end)] == hashes, at, -1)
        open_ = np.flatnonzero(out < 0)
        for step in range(1, self.steps):
            there = np.minimum(at[open_] + step, end)
            own = self.hashes[there]
            hit = own == hashes[open_]
            out[open_[hit]] = there[hit]
            open_ = open_[own < hashes[open_]]  # the head is ascending
        return out


def batch_ids(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, their places in the head (-1 beyond it), the texts' ends."""
    hashes, places = placed_hashes(b"\n".join(texts).translate(UPPER))
    after = np.cumsum([len(t) + 1 for t in texts])
    words = np.searchsorted(places, after)  # words up to each text's end
    flat = np.insert(hashes, words, _END[0])
    return flat, model.places(flat), words + np.arange(1, len(texts) + 1)


def contexts(hashes: np.ndarray, ends: np.ndarray, buckets: int) -> np.ndarray:
    """Rows of weights for each token: word before, both words before, word before that."""
    n = len(hashes)
    before, second = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    before[1:], second[2:] = hashes[:-1], hashes[:-2]
    starts = np.concatenate([[0], ends[:-1]])
    before[starts] = second[starts] = 0
    second[starts[starts + 1 < np.append(starts[1:], n)] + 1] = 0
    odd = np.uint64(0x9E3779B97F4A7C15)

    def row(x: np.ndarray, salt: int) -> np.ndarray:
        h = (x + np.uint64(salt)) * odd
        h ^= h >> np.uint64(29)
        return (((h * odd) >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint16)

    return np.stack([row(before, 11), row(before * np.uint64(1_000_003) + second, 5077), row(second, 90_001)])


def probabilities(model: Model, rows: np.ndarray) -> np.ndarray:
    """Class probabilities of each token."""
    logits = np.take(model.weights, rows[0], axis=0)
    logits += np.take(model.weights, rows[1], axis=0)
    logits += np.take(model.weights, rows[2], axis=0)
    logits += model.bias
    logits -= np.maximum.reduce(np.ascontiguousarray(logits.T), axis=0)[:, None]
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(logits.shape[1], np.float32))[:, None]
    return logits


def gradient(texts: DataFrame, shared, s: Settings) -> np.ndarray:
    """(buckets, 2 x classes): for each row of weights how often it met each class, and how often it expected to."""
    n = s.classes
    columns = [f"x{i}" for i in range(2 * n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, met, wanted = shared.value, np.zeros(s.buckets * n), np.zeros((n, s.buckets))
        for batch in slices(batches, 128):
            hashes, ids, ends = batch_ids(model, batch.column(0).to_pylist())
            rows = contexts(hashes, ends, s.buckets)
            own = model.classes[ids]
            expected = probabilities(model, rows)
            by_class = expected.T.astype(float)
            for row in rows:
                met += np.bincount(row.astype(np.int64) * n + own, minlength=s.buckets * n)
                for c in range(n):
                    wanted[c] += np.bincount(row, by_class[c], minlength=s.buckets)
        both = np.concatenate([met.reshape(-1, n), wanted.T], axis=1).astype(np.float32)
        at = np.flatnonzero(both.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(both[at, i]) for i in range(2 * n)]], ["bucket", *columns])

    summed = texts.coalesce(s.tasks).mapInArrow(run, "bucket int, " + ", ".join(f"{c} float" for c in columns)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns])
    out = np.zeros((s.buckets, 2 * n))
    for row in summed.collect():  # s.buckets rows at most
        out[row[0]] = row[1:]
    return out


def head_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """(word, count) of the end and of the `most` most frequent words at most, all of one count or none, most frequent first."""
    steps = counts.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step"))  # 8 rows a doubling
    low, held = 1 << 62, 0
    for row in steps.collect():
        held += row["n"]
        if held > most:
            break
        low = row["c"]
    found = {bytes(r["word"]): r["c"] for r in counts.where((F.col("c") >= low) | (F.col("word") == F.lit(END))).collect()}
    return sorted(({END: 0} | found).items(), key=lambda x: (-x[1], x[0]))


def fit(texts: DataFrame, counts: DataFrame, s: Settings) -> Model:
    """The model of texts(text binary) with their word counts(word, c)."""
    n_tokens, n_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    rows = head_words(counts, s.head)
    words, held = [w for w, _ in rows], np.array([c for _, c in rows], float)
    own = classes_of(words, held, s)
    mass = np.bincount(own, held + 1, minlength=s.classes).astype(float)
    mass[-1] += (n_tokens - held.sum()) + (n_words - len(words)) + 1
    total = float(n_tokens + n_words + 1)
    bias = np.log(np.maximum(mass, 1e-9) / total).astype(np.float32)
    hashes = np.array([_END[0] if w == END else word_hashes(w)[0] for w in words], np.uint64)
    turn = np.argsort(hashes)
    model = Model(hashes[turn], np.append(own[turn], s.classes - 1), np.append(held[turn], 0), np.zeros((s.buckets, s.classes), np.float32), bias, mass, total, n_tokens)
    for _ in range(s.rounds if n_tokens else 0):
        shared = texts.sparkSession.sparkContext.broadcast(model)  # bounded by s.head and s.buckets
        sums = gradient(texts, shared, s)
        met, wanted = sums[:, : s.classes], sums[:, s.classes :]
        step = s.rate * (met - wanted) / (wanted + s.smooth)
        model.weights = np.where(mass > 0, model.weights + np.clip(step, -s.most, s.most), 0).astype(np.float32)
        shared.unpersist()
    return model


def scores(docs: DataFrame, teaches: Column, held_out: Column, settings: Settings | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs(doc_id, text).

    teaches and held_out are conditions on doc_id; null ones are false. A null
    text counts as empty and has its end alone. base_score is the add-one
    unigram log10 probability, score the model's. Without a training text, as
    in an empty table, each token is unknown. Rows may repeat and share an id,
    null or not; a text of any length is scored by one task; other columns are
    left out.
    """
    s = settings or Settings()
    text = F.encode(text_of(), "utf-8").alias("text")
    training = docs.where(F.coalesce(teaches, F.lit(False))).select(text)
    counts = stored(count_words(training, s), "counts")
    model = fit(training, counts, s)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        mass = np.where(m.mass > 0, m.mass, 1.0)
        for batch in slices(batches, 128):
            texts = batch.column(3).to_pylist()
            hashes, ids, ends = batch_ids(m, texts)
            own = m.classes[ids]
            chosen = np.log10(np.maximum(probabilities(m, contexts(hashes, ends, m.weights.shape[0]))[np.arange(len(ids)), own].astype(float), 1e-30))
            inside = np.log10(m.counts[ids] + 1)  # 0 beyond the head; joined later
            starts = np.concatenate([[0], ends[:-1]])
            n = ends - starts
            known = np.add.reduceat((m.counts[ids] > 0).astype(np.int64), starts)
            base = np.add.reduceat(inside, starts) - n * math.log10(m.total)
            model_part = np.add.reduceat(chosen + inside - np.log10(mass)[own], starts)
            rare = []
            for text, a, b in zip(texts, starts.tolist(), ends.tolist()):
                words = tokens(text)
                rare.append(list(Counter([words[i] for i in np.flatnonzero(ids[a:b] < 0).tolist()]).items()))
            rare = pa.array(rare, pa.map_(pa.binary(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(known), pa.array(base), pa.array(model_part), rare], [*ROW, "n_tokens", "known", "base", "part", "rare"])

    scored = stored(docs.select(*identity(), text).mapInArrow(head, "ord long, h1 long, h2 long, n_tokens long, known long, base double, part double, rare map<binary,int>"), "scored")
    words = scored.select(*ROW, F.explode("rare").alias("word", "n"))
    joined = words.join(counts.hint("merge"), "word").groupBy(*ROW).agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("add"))
    rows = scored.groupBy(*ROW).agg(F.count("*").alias("r"), *[F.first(c).alias(c) for c in ("n_tokens", "known", "base", "part")])
    every = rows.join(joined.hint("merge"), ROW, "left")
    share = lambda c: F.coalesce(F.col(c) / F.col("r"), F.lit(0.0))  # noqa: E731  equal rows were added up
    flat = every.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("r").cast("int")))).withColumn("doc_id", doc_id(F.col("ord"), F.col("h2")))
    return flat.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + share("more").cast("long")).alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + share("add")).alias("base_score"),
        (F.col("part") + share("add")).alias("score"),
    )
