"""Runs of periodic words, found with a grammar made by recompression.

Block compression makes every maximal block of one letter a letter; pair
compression deals the letters to two sides and makes each left letter and the
right one behind it a letter. Both cut by looking at two neighbours only, so
equal stretches are cut alike but for their ends. Rounds of both give the
levels of a run-length grammar. How far two places read alike (LCE) is asked
by climbing the levels while the letters agree and descending where they do
not. A run of period p holds two places, p apart, whose first lies on a grid
of step max(p, least - p), so candidates are n log n, and their extensions to
both sides are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import slices, text_of

#: Words of short documents that share a grammar; candidates that are looked at together.
WORDS, CANDIDATES = 1 << 17, 1 << 20
OUT = "runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Level:
    """A level's letters; owner: each one's number on the next level; first: where each letter of the next level begins, and the end."""

    def __init__(self, letters: np.ndarray):
        self.letters, self.owner, self.first = letters, None, None

    def above(self, begins: np.ndarray, names: np.ndarray) -> Level:
        """The next level: its letters begin at `begins` and are equal where `names` are."""
        self.first = np.append(begins, len(self.letters))
        mark = np.zeros(len(self.letters), np.int64)
        mark[begins] = 1
        self.owner = np.cumsum(mark) - 1
        return Level(np.unique(names, return_inverse=True)[1].reshape(-1))

    def mirrored(self, above: Level | None) -> Level:
        """This level read from its end."""
        out = Level(self.letters[::-1])
        if above is not None:
            out.owner, out.first = len(above.letters) - 1 - self.owner[::-1], len(self.letters) - self.first[::-1]
        return out


def grammar(letters: np.ndarray) -> list[Level]:
    """Levels from the letters up, until no letter stands twice: above, nothing is alike."""
    levels, rng = [Level(letters)], np.random.default_rng(1)
    while True:
        at = levels[-1]
        size = int(at.letters.max()) + 1
        if np.bincount(at.letters, minlength=size).max() < 2:
            return levels
        fresh = np.append(True, at.letters[1:] != at.letters[:-1])
        if not fresh.all():
            begins = np.flatnonzero(fresh)
            levels.append(at.above(begins, at.letters[begins] + size * np.diff(np.append(begins, len(fresh)))))
            at = levels[-1]
            size = int(at.letters.max()) + 1
        right = rng.integers(0, 2, size).astype(bool)[at.letters]
        tied = np.append(~right[:-1] & right[1:], False)  # a left letter and a right one behind it
        begins = np.flatnonzero(~np.append(False, tied[:-1]))
        behind = np.where(tied, np.append(at.letters[1:], 0) + 1, 0)[begins]
        levels.append(at.above(begins, at.letters[begins] * (size + 1) + behind))


def mirrored(levels: list[Level]) -> list[Level]:
    return [x.mirrored(above) for x, above in zip(levels, [*levels[1:], None])]


def _left_in_block(level: Level, at: np.ndarray) -> np.ndarray:
    """Letters from each place to the end of its letter on the next level, if they are one block."""
    return level.first[level.owner[at] + 1] - at


def alike(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters from the places a and b on are equal, each a < b; the last letter of all stands once."""
    began, left = a.copy(), []
    who, turned = np.arange(len(a)), []
    for level in levels:
        if level.owner is None or not len(who):
            turned.append((who, a, b))
            break
        inside = (level.first[level.owner[a]] != a) | (level.first[level.owner[b]] != b)
        same = level.letters[a] == level.letters[b]
        step = np.where(inside & same, _steps(level, a, b), 0)
        a, b = a + step, b + step
        up_a, up_b = level.owner[a], level.owner[b]
        above = levels[len(turned) + 1].letters
        climbs = (level.first[up_a] == a) & (level.first[up_b] == b) & (above[up_a] == above[up_b])
        turned.append((who[~climbs], a[~climbs], b[~climbs]))
        who, a, b = who[climbs], up_a[climbs], up_b[climbs]
    held = (np.array([], np.int64),) * 3
    for level, here in zip(reversed(levels[: len(turned)]), reversed(turned)):
        who, a, b = (np.concatenate(x) for x in zip(held, here))
        going = np.flatnonzero(level.letters[a] == level.letters[b])
        while len(going):
            step = _steps(level, a[going], b[going])
            a[going] += step
            b[going] += step
            going = going[level.letters[a[going]] == level.letters[b[going]]]
        below = levels.index(level) - 1
        held = (who, a, b) if below < 0 else (who, levels[below].first[a], levels[below].first[b])
    left = np.empty(len(began), np.int64)
    left[held[0]] = held[1]
    return left - began


def _steps(level: Level, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far to go where the letters agree: over what both have left of a block, else one letter."""
    if level.owner is None:
        return np.ones(len(a), np.int64)
    step = np.minimum(_left_in_block(level, a), _left_in_block(level, b))
    return np.where((step > 1) & (level.letters[a] == level.letters[a + step - 1]) & (level.letters[b] == level.letters[b + step - 1]), step, 1)


def _candidates(begins: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) on the harmonic grids of documents that begin at `begins`, about CANDIDATES at a time."""
    most = sizes // 2
    doc = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(period, least - period)
    counts = (sizes[doc] - period + step - 1) // step
    ends = np.cumsum(counts)
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES)))
        n = counts[at:to]
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(begins[doc[at:to]], n) + turn * np.repeat(step[at:to], n), np.repeat(period[at:to], n)
        at = to


def runs(documents: list[np.ndarray], least: int) -> list[np.ndarray]:
    """For each document, words as numbers, its runs (start, length, period), ascending.

    A run is a maximal stretch of smallest period p and length max(least, 2 p)
    or more.
    """
    sizes = np.array([len(d) for d in documents], np.int64)
    names = int(max((d.max() for d in documents if len(d)), default=0)) + 1
    parts = [x for k, d in enumerate(documents) for x in (np.array([names + k]), d)]  # a letter of its own between two documents
    letters = np.concatenate([*parts, [names + len(documents)]]).astype(np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    levels = grammar(letters)
    back = mirrored(levels)
    found = []
    for i, p in _candidates(begins, np.where(sizes < least, 0, sizes), least):
        near = letters[i] == letters[i + p]
        i, p = i[near], p[near]
        start, end = i - alike(back, len(letters) - i - p, len(letters) - i), i + p + alike(levels, i, i + p)
        long = end - start >= np.maximum(least, 2 * p)
        found.append(np.unique(np.stack([start, end, p], 1)[long], axis=0))
    every = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found]), axis=0)
    every = every[np.append(True, (every[1:, :2] != every[:-1, :2]).any(1))[: len(every)]]  # of equal stretches the smallest period
    of = np.searchsorted(begins, every[:, 0], side="right") - 1
    every = np.stack([every[:, 0] - begins[of], every[:, 1] - every[:, 0], every[:, 2]], 1)
    cuts = np.searchsorted(of, np.arange(len(sizes) + 1))
    out = [every[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return [x[np.lexsort((x[:, 2], x[:, 0]))] for x in out]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run covers behind its first period, joined by one space."""
    if not len(found):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def find_runs(docs: DataFrame, least: int = 12, text: str = "text") -> DataFrame:
    """docs with `runs`, an array of (start, length, period) in words by start and period, and `collapsed`, what stays without repeats.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Runs never cross documents. A
    null or empty text has no runs and an empty `collapsed`. Rows stand for
    themselves, so repeated rows, null and shared ids need no care; columns
    named `runs` or `collapsed` give way. A text of any length is read by one
    task, in memory that grows with its words; its candidates come in blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def out(rows: list, texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            numbers: dict[bytes, int] = {}
            found = runs([np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in texts], least)
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
            spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type)))
            kept = pa.array([collapsed(words, f).decode() for words, f in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(rows), spans, kept], ["row", "runs", "collapsed"])

        rows, texts, size = [], [], 0
        for batch in slices(batches):
            for k in range(batch.num_rows):
                rows.append(batch.column(0).slice(k, 1))
                texts.append(batch.column(1)[k].as_py().split())
                size += len(texts[-1])
                if size >= WORDS:
                    yield from out(rows, texts)
                    rows, texts, size = [], [], 0
        if rows:
            yield from out(rows, texts)

    keep = [c for c in docs.columns if c not in (text, "runs", "collapsed")]
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    sent = docs.select(row.alias("row"), F.encode(text_of(text), "utf-8").alias("text"))
    found = sent.mapInArrow(run, f"row {sent.schema['row'].dataType.simpleString()}, {OUT}")
    return found.select(*[F.col("row").getField(c).alias(c) for c in keep], "runs", "collapsed")
