"""Removal of word sequences that an earlier document holds, by relative Lempel-Ziv parsing.

Anchors (see anchors.py) bring the places that may share a window of words
together; the regions of a key, in order of doc_id, make up a reference block.
Each region is factored greedily against the block of the smaller documents:
a factor is the longest run of words that the block holds too. A factor of at
least a window is a duplicate span; windows that lie over a factor's end, which
greedy parsing tears apart, are looked up in the block's windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm import anchors
from kilnspark.llm.common import mapped, slices, text_of
from kilnspark.llm.suffix_dedup import runs

#: Words of a window; words of an anchor's run; regions of a key beyond which it is split.
LENGTH, GRAM, CROWD = 13, 4, 64
#: Bytes of a text that are hashed together; bytes of a word beyond which it is hashed on its own.
STEP, LONG = 1 << 20, 128
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_UP = _powers(_ODD, STEP + 1)
_DOWN = _powers(pow(_ODD, -1, 1 << 64), STEP + 1)
_LETTERS = anchors.mixed_bits(np.arange(1, 257, dtype=np.uint64))


def placed_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, its letters' numbers as a polynomial, from running sums over the text; and where each begins."""
    out, places, at = [], [], 0
    while at < len(text):
        part, base = text[at : at + STEP], at
        if at + STEP < len(text):  # up to the last white space; a longer word makes a part of its own
            blank = np.flatnonzero(_BLANK[np.frombuffer(part, np.uint8)])
            if len(blank):
                part = part[: blank[-1] + 1]
            else:
                rest = np.flatnonzero(_BLANK[np.frombuffer(text, np.uint8, offset=at)])
                part = text[at : at + int(rest[0])] if len(rest) else text[at:]
        at += len(part)
        codes = np.frombuffer(part, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[codes], [True]])))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            continue
        places.append(starts + base)
        if len(part) > STEP:
            out.append(np.array([xxhash.xxh64_intdigest(part[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64))
            continue
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[codes] * _UP[: len(codes)])])
        hashes = anchors.mixed_bits((sums[ends] - sums[starts]) * _DOWN[starts])
        for i in np.flatnonzero(ends - starts > LONG).tolist():
            hashes[i] = xxhash.xxh64_intdigest(part[starts[i] : ends[i]])
        out.append(hashes)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(places)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    return placed_hashes(text)[0]


def cut(text: bytes):
    """The words' hashes, and their bytes for a range of words."""
    units = word_hashes(text)
    raw = units.tobytes()
    return units, lambda a, b: raw[8 * a : 8 * b]


class Block:
    """A reference block: the regions of smaller documents, with an index of their words and windows."""

    def __init__(self, length: int):
        self.length, self.words, self.at, self.windows = length, [], {}, set()

    def add(self, words: tuple[int, ...]) -> None:
        for i, word in enumerate(words):
            self.at.setdefault(word, []).append(len(self.words) + i)
        self.words += [*words, None]
        self.windows.update(words[i : i + self.length] for i in range(len(words) - self.length + 1))

    def longest(self, words: tuple[int, ...], i: int) -> int:
        """Words from i on that follow each other somewhere in the block."""
        best, n, own = 0, len(words), self.words
        for p in self.at.get(words[i], ()):
            if best and (i + best >= n or p + best >= len(own) or own[p + best] != words[i + best]):
                continue
            k = 1
            while i + k < n and own[p + k] == words[i + k]:
                k += 1
            best = max(best, k)
        return best

    def starts(self, words: tuple[int, ...]) -> list[int]:
        """Starts of the windows of words that the block holds."""
        n, length, out, i = len(words), self.length, set(), 0
        while i < n:
            size = max(1, self.longest(words, i))
            out.update(range(i, i + size - length + 1))
            end = i + size
            over = range(max(0, end - length + 1), min(end, n - length + 1))
            out.update(s for s in over if words[s : s + length] in self.windows)
            i = end
        return sorted(out)


def _parse(length: int):
    """(key, region, runs) for parts that arrive sorted by key and ord."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, waiting, order = None, None, [], None
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in slices(batches, 2048):
            out = []
            for k, region, o, units in zip(*(batch.column(c).to_pylist() for c in ("key", "region", "ord", "units"))):
                if k != key:
                    key, block, waiting, order = k, Block(length), [], o
                elif o != order:
                    for words in waiting:
                        block.add(words)
                    waiting, order = [], o
                words = tuple(np.frombuffer(units, "<u8").tolist())
                if found := block.starts(words):
                    out.append((k, region, [{"lo": a, "hi": b} for a, b in runs(np.array(found), length)]))
                waiting.append(words)
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int64(), kind))], ["key", "region", "runs"])

    return run


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(ord, h1, h2, spans): the word intervals of each text that together cover the windows that a smaller document holds."""

    def method(parts: DataFrame) -> DataFrame:
        dealt = parts.select("key", "region", "ord", "units").repartition("key").sortWithinPartitions("key", "ord")
        return mapped(dealt, _parse(length), f"key long, region long, runs {anchors.RUNS}")

    return anchors.spans(docs, cut, method, length, gram, 8, crowd, earlier=True)


def _kept(z: bytes, spans: list[int] | None) -> tuple[int, int, str]:
    """Words, words removed, and the others joined by one space."""
    words = anchors.unpacked(z).split()
    gone = anchors.merged(spans, len(words))
    if not gone:
        return len(words), 0, b" ".join(words).decode()
    ends = [0, *(x for span in gone for x in span), len(words)]
    kept = [w for a, b in zip(ends[::2], ends[1::2]) for w in words[a:b]]
    return len(words), len(words) - len(kept), b" ".join(kept).decode()


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept string) for each row of docs(doc_id, text).

    Every word that a window of `length` words covers which a document with a
    smaller doc_id holds too goes; kept words are joined by one space. A null
    id counts as 2^63 - 1, the largest; rows of one id do not judge each other;
    rows may repeat; a null text has no words; an empty table gives no rows;
    other columns are left out. A text of any length is read by one task, its
    regions by others.
    """
    found = spans(docs, length, gram, crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = [(None if row["h2"] & 1 else row["ord"], *_kept(row["z"], row["spans"])) for row in batch.to_pylist()]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()])], ["doc_id", "n_words", "n_removed", "kept"])

    joined = anchors.packed(docs).join(found.hint("merge"), anchors.ROW, "left")
    return mapped(joined, run, "doc_id long, n_words long, n_removed long, kept string")


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """The rows of docs, their text replaced by the kept words where any went (n_chars follows).

    Rows as in deduplicate(); all columns of docs stay, whatever their names.
    """
    found = spans(docs, length, gram, crowd)
    texts = docs.select(*anchors.identity(), text_of().alias("text")).join(found.hint("merge"), anchors.ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            kept = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = text.encode().split()
                ends = [0, *(x for span in anchors.merged(spans, len(words)) for x in span), len(words)]
                kept.append(b" ".join([w for a, b in zip(ends[::2], ends[1::2]) for w in words[a:b]]).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept, pa.string())], [*anchors.ROW, "kept"])

    new = mapped(texts, run, "ord long, h1 long, h2 long, kept string").dropDuplicates(anchors.ROW)
    whole = docs.select(*anchors.identity(), F.struct("*").alias("row"))
    both = whole.join(new.hint("merge"), anchors.ROW, "left")
    fields = {"text": F.coalesce("kept", "row.text").alias("text")}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return both.select(*[fields.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns])
