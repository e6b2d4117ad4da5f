"""Removal of repeated byte strings, by interval expansion on a Burrows-Wheeler transform.

Anchors (see anchors.py) bring together texts that may share a string of
`length` bytes. Equal regions are one entry. The different regions of a key
are laid end to end, with those of neighbouring keys, and sorted as suffixes; on the transform, a breadth-first backward extension of
intervals finds the common prefix of neighbouring suffixes by increasing
value. It stops at `length`: boundaries not reached by then separate suffixes
that share at least `length` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kilnspark.llm import anchors
from kilnspark.llm.common import slices

#: Bytes of a string; bytes of an anchor's run; regions of a key beyond which it is split; bytes of a transform.
LENGTH, GRAM, CROWD, BATCH = 400, 64, 1000, 1 << 20


def cut(text: bytes):
    return np.frombuffer(text, np.uint8), lambda a, b: text[a:b]


def suffix_array(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes sorted by their first `length` symbols at least, by prefix doubling."""
    n, step = len(text), 7
    rank = np.zeros(n, np.int64)
    for i in range(step):  # the first seven symbols, nine bits each, zero beyond the end
        rank <<= 9
        rank[: max(0, n - i)] |= text[i:].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    held = rank[order]
    rank[order] = np.concatenate([[0], (held[1:] != held[:-1]).cumsum()])
    while True:
        later = np.zeros(n, np.int64)
        later[: max(0, n - step)] = rank[step:] + 1
        key = rank * (int(later.max(initial=0)) + 1) + later
        order = np.argsort(key, kind="stable")
        held = key[order]
        fresh = np.concatenate([[0], (held[1:] != held[:-1]).cumsum()])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if step >= length or fresh[-1] == n - 1:
            return order


def open_boundaries(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each i > 0, whether suffixes order[i - 1] and order[i] share `length` symbols.

    The last symbol of text must be unique and the least.
    """
    n = len(text)
    bwt = text[order - 1]  # the symbol before each suffix; before the first stands the last
    by_symbol = np.argsort(bwt, kind="stable")
    step_back = np.empty(n, np.int64)
    step_back[by_symbol] = np.arange(n)  # where the suffix that begins one symbol earlier stands
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lo, hi = np.array([0]), np.array([n - 1])
    for _ in range(length):
        if not len(lo):
            break
        width = hi - lo + 1
        owner = np.repeat(np.arange(len(lo)), width)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo, width)
        group = owner * 512 + bwt[at]
        turn = np.argsort(group, kind="stable")
        group, at = group[turn], at[turn]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        last = np.concatenate([first[1:], [True]])
        new_lo, new_hi = step_back[at[first]], step_back[at[last]]
        ends = new_hi + 1
        keep = unset[ends]
        ends, spot = np.unique(ends[keep], return_index=True)
        unset[ends] = False
        lo, hi = new_lo[keep][spot], new_hi[keep][spot]
    return unset[:n]


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, the starts of strings of `length` bytes that also start elsewhere in the segments."""
    gap = np.array([1], np.int64)
    text = np.concatenate([x for s in segments for x in (np.frombuffer(s, np.uint8).astype(np.int64) + 2, gap)] + [np.array([0])])
    order = suffix_array(text, length)
    near = open_boundaries(text, order, length)
    hit = np.zeros(len(text), bool)
    hit[order] = near | np.concatenate([near[1:], [False]])
    out, at = [], 0
    for s in segments:
        out.append(np.flatnonzero(hit[at : at + max(0, len(s) - length + 1)]))
        at += len(s) + 1
    return out


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The intervals that strings at these ascending starts cover, joined where they touch."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], breaks + 1])].tolist(), (starts[np.concatenate([breaks, [len(starts) - 1]])] + length).tolist()))


def _expand(length: int, batch_bytes: int):
    """(key, region, runs) of repeated strings among parts that arrive sorted by key."""

    def settle(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        found = repeated_starts([units for _, _, units in held], length)
        out = [(k, r, [{"lo": a, "hi": b} for a, b in runs(starts, length)]) for (k, r, _), starts in zip(held, found) if len(starts)]
        cols = list(zip(*out)) or [[]] * 3
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), kind))], ["key", "region", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in slices(batches, 2048):
            for key, region, units in zip(*(batch.column(c).to_pylist() for c in ("key", "region", "units"))):
                if key != last and size >= batch_bytes:
                    yield settle(held)
                    held, size = [], 0
                held.append((key, region, units))
                size, last = size + len(units), key
        if held:
            yield settle(held)

    return run


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(ord, h1, h2, spans): the byte intervals of each text that together cover its repeated strings."""

    def method(parts: DataFrame) -> DataFrame:
        dealt = parts.select("key", "region", "units").repartition("key").sortWithinPartitions("key")
        return dealt.mapInArrow(_expand(length, BATCH), f"key long, region long, runs {anchors.RUNS}")

    return anchors.spans(docs, cut, method, length, gram, 1, crowd, earlier=False)


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for each row of docs(doc_id, text).

    Every byte that a string of `length` bytes covers which also starts
    elsewhere, in any row, goes. A null text counts as empty; rows may repeat or
    share an id, null or not; texts shorter than `length` stay whole; an empty
    table gives no rows; other columns are left out. A text of any length is
    read by one task, its regions by others.
    """
    found = spans(docs, length, gram, crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            for row in batch.to_pylist():
                text = anchors.unpacked(row["z"])
                gone = anchors.merged(row["spans"], len(text))
                ends = [0, *(x for span in gone for x in span), len(text)]
                kept = b"".join([text[a:b] for a, b in zip(ends[::2], ends[1::2])]) if gone else text
                out.append((None if row["h2"] & 1 else row["ord"], len(text), len(text) - len(kept), len(gone), kept))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.binary()])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = anchors.packed(docs).join(found.hint("merge"), anchors.ROW, "left")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
