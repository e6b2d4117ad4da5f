"""Secrets in texts: patterns, and strings that look drawn at random.

Two Markov models of characters tell random strings from ordinary
identifiers: a chain of transitions between the characters of ALPHABET each,
counted over labelled samples. A candidate is a stretch of such characters; it
is taken as random if the logarithm of the models' ratio, summed over its
transitions, is high enough a character.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import slices, text_of

#: The kinds, their patterns (letters of the first word in either case), the group that is measured and its least length.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
MODEL = "random"
ORDER = {kind: k for k, kind in enumerate([*KINDS, MODEL])}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: How identifiers are made of words.
STYLES = [lambda t: t.title().replace(" ", ""), lambda t: t.replace(" ", "_"), lambda t: t.upper().replace(" ", "_"), lambda t: t.replace(" ", "-"), lambda t: t.replace(" ", "/")]
_PATTERNS = {kind: (re.compile(p, re.ASCII), group, least) for kind, (p, group, least) in KINDS.items()}
_STATE = np.zeros(256, np.int64)
_STATE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, STATES)


@dataclass(frozen=True)
class Settings:
    """Least length of a candidate, least log ratio in bits a character, and what is added to each count."""

    length: int = 16
    bits: float = 1.5
    smooth: float = 0.5


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of each kind's matches, leftmost first and apart, that are long enough; in code points, by start, then kind as listed."""
    found = [(m.start(), kind, m.end()) for kind, (pattern, group, least) in _PATTERNS.items() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda x: (x[0], ORDER[x[1]]))


def transitions(text: bytes) -> np.ndarray:
    """How often each state follows each; state 0 is whatever is not in ALPHABET, and stands at both ends."""
    states = np.concatenate([[0], _STATE[np.frombuffer(text, np.uint8)], [0]])
    return np.bincount(states[:-1] * STATES + states[1:], minlength=STATES * STATES)


def _blanked(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with a space for each span."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts.append(text[at:start])
        at = max(at, end)
    return " ".join([*parts, text[at:]])


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """Samples (sample, random) from the corpus itself.

    Ordinary is what stands outside of base spans, as it is and as identifiers
    of one of STYLES, by the text's length. Random is what base spans hold but
    for hex, and of each row a digest in hex and one in base 64.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            samples, kinds = [], []
            for value in batch.column(0).to_pylist():
                spans = base_spans(value)
                plain = _blanked(value, spans)
                samples += [plain, STYLES[len(plain) % len(STYLES)](plain)]
                kinds += [False, False]
                samples += [value[m.start(group) : m.end(group)] for kind, (pattern, group, least) in _PATTERNS.items() if kind != "hex" for m in pattern.finditer(value) if m.end(group) - m.start(group) >= least]
                kinds += [True] * (len(samples) - len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(samples, pa.string()), pa.array(kinds, pa.bool_())], ["sample", "random"])

    own = docs.select(text_of(text).alias("t")).mapInArrow(run, "sample string, random boolean")
    key = F.sha2(text_of(text), 256)
    drawn = docs.select(F.explode(F.array(F.substring(key, 1, 40), F.regexp_replace(F.base64(F.unhex(key)), "=+$", ""))).alias("sample"), F.lit(True).alias("random"))
    return own.unionAll(drawn)


def log_ratios(samples: DataFrame, smooth: float = Settings.smooth) -> np.ndarray:
    """The matrix of log2 P(next | now, random) / P(next | now, ordinary) from samples(sample, random).

    Tasks count; the driver gets two matrices of STATES by STATES, whatever the
    samples' size. Null samples and labels count for nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, STATES * STATES), np.int64)
        for batch in slices(batches):
            for sample, random in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[int(random)] += transitions(sample.as_py())
        kind, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[kind, at])], ["kind", "at", "n"])

    known = samples.where("sample is not null and random is not null").select(F.encode("sample", "utf-8").alias("sample"), "random")
    counts = np.zeros((2, STATES * STATES))
    for r in known.mapInArrow(run, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():  # 2 STATES^2 rows
        counts[r.kind, r.at] = r.n
    return ratios_of(counts, smooth)


def ratios_of(counts: np.ndarray, smooth: float) -> np.ndarray:
    chance = counts.reshape(2, STATES, STATES)[:, :, 1:] + smooth  # a candidate never leaves ALPHABET
    chance = np.log2(chance / chance.sum(2, keepdims=True))
    return chance[1] - chance[0]


def score(candidate: str, ratios: np.ndarray) -> float:
    """The log ratio of a string over ALPHABET, in bits."""
    states = _STATE[np.frombuffer(candidate.encode(), np.uint8)]
    return float(ratios[np.concatenate([[0], states[:-1]]), states - 1].sum())


def found_random(text: str, taken: list[tuple[int, str, int]], ratios: np.ndarray, settings: Settings) -> list[tuple[int, str, int]]:
    """Candidates apart from the spans `taken`, ascending, that the models call random."""
    out, k = [], 0
    for m in _candidate(settings.length).finditer(text):
        start, end = m.span()
        while k < len(taken) and taken[k][0] <= start and taken[k][2] <= start:
            k += 1
        if any(s < end and e > start for s, _, e in taken[k:] if s < end):
            continue
        if score(m.group(), ratios) >= settings.bits * (end - start):
            out.append((start, MODEL, end))
    return out


_COMPILED: dict[int, re.Pattern] = {}


def _candidate(length: int) -> re.Pattern:
    if length not in _COMPILED:
        _COMPILED[length] = re.compile(f"[{re.escape(ALPHABET)}]{{{length},}}")
    return _COMPILED[length]


def scan(docs: DataFrame, samples: DataFrame | None = None, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """docs with `spans`, an array of (start, end, kind): the matches of KINDS and what the models add, by start, then kind.

    Positions are code points, ends exclusive. Models learn from samples
    (sample, random), or those of labelled(docs). A null or empty text has no
    spans; rows stand for themselves, whatever their ids; other columns stay,
    the text goes, a column named `spans` gives way. A text of any length is
    read by one task.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(labelled(docs, text) if samples is None else samples, settings.smooth))  # STATES^2 numbers
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = []
            for value in batch.column(1).to_pylist():
                base = base_spans(value)
                every = sorted(base + found_random(value, base, ratios.value, settings), key=lambda x: (x[0], ORDER[x[1]]))
                spans.append([{"start": s, "end": e, "kind": k} for s, k, e in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["row", "spans"])

    keep = [c for c in docs.columns if c not in (text, "spans")]
    sent = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text_of(text).alias("text"))
    found = sent.mapInArrow(run, f"row {sent.schema['row'].dataType.simpleString()}, spans array<struct<start: long, end: long, kind: string>>")
    return found.select(*[F.col("row").getField(c).alias(c) for c in keep], "spans")


def shown(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
