"""Repeated windows found through content-defined anchors.

A text is a sequence of units (bytes or words). Each window of `length` units
has one anchor: the position in it whose run of `gram` units hashes lowest,
leftmost on ties. Equal windows have their anchor at the same place, so two of
them meet under the anchor's key. The windows of an anchor start side by side;
what they cover is its region. Only anchors whose key stands more than once are
kept. Equal regions are one entry that stands for all its places; keys with
different regions are settled by the operator's own method.

A key with many different regions is split: a window has at least half of the
units around the key's own on the left or the right of it, so the windows of a
region go to two keys of longer runs, and only those that repeat stay. Split
keys are treated like others, until a key is a whole window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import discard, mapped, partitions, slices, stored, text_of

LAST = 2**63 - 1
#: The columns that name a row.
ROW = ["ord", "h1", "h2"]
#: Windows of a text that are looked at together; anchors that a task holds.
_STEP, HELD = 1 << 23, 1 << 20
_WHERE = "ord long, h1 long, h2 long, place long"
RUNS = "array<struct<lo:int,hi:int>>"


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well spread, one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of `gram` units, by doubling."""
    power, out, width = np.array([0x9E3779B97F4A7C15], np.uint64), None, 0
    part, size, bits = mixed_bits(units.astype(np.uint64) + np.uint64(1)), 1, gram
    n = len(units) - gram + 1
    while bits:
        if bits & 1:
            piece = part[width:]
            out = piece.copy() if out is None else out[: len(piece)] * power + piece[: len(out)]
            width += size
        bits >>= 1
        if bits:
            part = part[:-size] * power + part[size:]
            power, size = power * power, size * 2
    return mixed_bits(out[:n])


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring keys, from running minima of blocks."""
    n = len(keys)
    pad = -n % width
    wide = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(wide, axis=1).ravel()
    back = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchor_places(units: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors' positions, ascending, their keys, and the starts of the first and last window of each."""
    if len(units) < length:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    hashes = gram_hashes(units, gram)
    width, found, starts = length - gram + 1, [], []
    for at in range(0, len(hashes) - width + 1, _STEP):  # positions fit in 24 bits
        part = hashes[at : at + _STEP + width - 1]
        low = window_minima((part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64), width)
        turns = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        found.append((low[turns] & np.uint64((1 << 24) - 1)).astype(np.int64) + at)
        starts.append(turns + at)
    places, where = np.unique(np.concatenate(found), return_index=True)
    first = np.concatenate(starts)[where]
    return places, hashes[places], first, np.concatenate([first[1:], [len(hashes) - width + 1]]) - 1


def identity() -> list[Column]:
    """ord, h1, h2 of a row: doc_id, a null one last, and 127 bits of hashes of the text with a flag for a null id.

    Rows of equal identity have equal ids and texts, so they may stand for each other.
    """
    text, flag = text_of(), F.col("doc_id").isNull().cast("long")
    second = F.xxhash64(F.lit(7), text).bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(flag)
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(text).alias("h1"), second.alias("h2")]


def doc_id(ord_: Column, h2: Column) -> Column:
    """The id that identity() was made from."""
    return F.when(h2.bitwiseAND(F.lit(1).cast("long")) == 0, ord_)


def _placed(keys: np.ndarray, regions: np.ndarray, places: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    cols = [keys, regions, *rows.T, places]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in cols], ["key", "region", *ROW, "place"])


def _packed_chunk(keys: np.ndarray, regions: np.ndarray, places: np.ndarray, who: np.ndarray, many: np.ndarray, rows: np.ndarray) -> tuple[int, int, bytes]:
    used, own = np.unique(who, return_inverse=True)
    parts = [keys, regions, places, rows[used].T, own.astype("<u4"), many]
    return len(keys), len(used), zstandard.ZstdCompressor(level=1).compress(b"".join([np.ascontiguousarray(p).tobytes() for p in parts]))


def _opened_chunk(n: int, d: int, payload: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    take = lambda a, size, kind: np.frombuffer(raw, kind, size, a)
    rows = take(24 * n, 3 * d, "<i8").reshape(3, d).T
    own = take(24 * n + 24 * d, n, "<u4")
    return take(0, n, "<u8"), take(8 * n, n, "<u8"), take(16 * n, n, "<i8"), rows[own], take(28 * n + 24 * d, n, "?")


def find(docs: DataFrame, cut: Callable[[bytes], tuple[np.ndarray, Callable[[int, int], bytes]]], length: int, gram: int) -> DataFrame:
    """(key, region, ord, h1, h2, place) for each anchor of docs(doc_id, text) whose key stands more than once.

    cut gives a text's units as integers and a function for the bytes of a
    range of them. region: 64 bits of a hash of the region's units and of where
    the anchor lies in it; place: where the region begins << 32 | its units
    before the anchor << 16 | its units.

    A task sorts the anchors it holds and sends each key once, marked if it
    stood there more than once; others of such a key are known to repeat and
    need not move. So a key that stands everywhere moves once for each task.
    What moves are chunks, arrays of anchors by range of keys; a range must fit
    a task, so spark.sql.shuffle.partitions has to follow the input.
    """
    if 2 * length - gram >= 1 << 16:
        raise ValueError("a region must have less than 65,536 units")
    n_ranges = partitions(docs.sparkSession)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], [], 0
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches):
            for *row, text in zip(*(c.to_pylist() for c in batch.columns)):
                units, bytes_of = cut(text)
                at, keys, first, last = anchor_places(units, length, gram)
                if not len(at):
                    continue
                lo, hi, back = first.tolist(), (last + length).tolist(), (at - first).tolist()
                regions = np.array([digest(bytes_of(a, b), c) for a, b, c in zip(lo, hi, back)], np.uint64)
                keys = keys << np.uint64(40) | keys >> np.uint64(24)  # anchors hash low: the low bits are spread evenly
                held.append((keys, regions, first << 32 | (at - first) << 16 | (last + length - first), np.full(len(at), len(rows))))
                rows.append(row)
                size += len(at)
                if size >= HELD:
                    yield chunk_rows(*(np.concatenate(x) for x in zip(*held)), np.array(rows, np.int64), n_ranges)
                    held, rows, size = [], [], 0
        if held:
            yield chunk_rows(*(np.concatenate(x) for x in zip(*held)), np.array(rows, np.int64), n_ranges)

    own = docs.select(*identity(), F.encode(text_of(), "utf-8").alias("text"))
    chunks = stored(mapped(own, collect, CHUNK), "anchor-chunks")
    work = stored(met(chunks, n_ranges), "anchors")
    discard(chunks)
    return work


CHUNK = "range int, n int, d int, payload binary"
_CHUNK = {"range": pa.int32(), "n": pa.int32(), "d": pa.int32(), "payload": pa.binary()}


def chunk_rows(keys: np.ndarray, regions: np.ndarray, places: np.ndarray, who: np.ndarray, rows: np.ndarray, n_ranges: int) -> pa.RecordBatch:
    """CHUNK rows of what a task holds: each key's first entry by range of keys, its others, which need not move, in range -1. who: the entry's row of `rows`."""
    turn = np.argsort(keys, kind="stable")
    keys, regions, places, who = keys[turn], regions[turn], places[turn], who[turn]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    many = np.append(~first[1:], [False])[: len(keys)]
    got = []
    if not first.all():
        got.append((-1, *_packed_chunk(*(x[~first] for x in (keys, regions, places, who, many)), rows)))
    keys, regions, places, who, many = (x[first] for x in (keys, regions, places, who, many))
    ranges = ((keys >> np.uint64(40)) * np.uint64(n_ranges) >> np.uint64(24)).astype(np.int64)
    for r in np.unique(ranges).tolist():
        a, b = np.searchsorted(ranges, [r, r + 1])
        got.append((r, *_packed_chunk(*(x[a:b] for x in (keys, regions, places, who, many)), rows)))
    return _batch(got, _CHUNK)


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, d, payload in zip(*(batch.column(c).to_pylist() for c in ("n", "d", "payload"))):
            yield _placed(*_opened_chunk(n, d, payload)[:4])


def _repeated(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    keys, regions, places, rows, many = (np.concatenate(x) for x in zip(*(_opened_chunk(*h) for h in held)))
    turn = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(keys[turn]) != 0]))
    sizes = np.diff(np.append(starts, len(keys)))
    turn = turn[np.repeat((sizes > 1) | np.logical_or.reduceat(many[turn], starts), sizes)]
    return _placed(keys[turn], regions[turn], places[turn], rows[turn])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, own = [], None
    for batch in batches:
        for r, *chunk in zip(*(batch.column(c).to_pylist() for c in ("range", "n", "d", "payload"))):
            if r != own and held:
                yield _repeated(held)
                held = []
            own = r
            held.append(chunk)
    if held:
        yield _repeated(held)


def met(chunks: DataFrame, n_ranges: int) -> DataFrame:
    """(key, region, ord, h1, h2, place) of the entries in CHUNK rows whose key stands more than once."""
    placed = f"key long, region long, {_WHERE}"
    moved = chunks.where("range >= 0").repartition(n_ranges, "range").sortWithinPartitions("range")
    return mapped(chunks.where("range = -1"), _known, placed).unionAll(mapped(moved, _meet, placed))


def heads(work: DataFrame) -> DataFrame:
    """(key, region, n, ord, last, h1, h2, place): how often a region stands, its least and greatest ord, its first place. Sums are made before rows move."""
    first = F.min(F.struct(*ROW, "place")).alias("first")
    return work.groupBy("key", "region").agg(F.count("*").alias("n"), F.max("ord").alias("last"), first).select("key", "region", "n", "first.ord", "last", "first.h1", "first.h2", "first.place")


def mixed(regions: DataFrame, crowd: int, earlier: bool) -> DataFrame:
    """(key, crowded): keys of different regions that need a look: for earlier, their least ords differ, else some region stands once."""
    about = regions.groupBy("key").agg(F.count("*").alias("kinds"), F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.min("n").alias("least"))
    return about.where("lo < hi" if earlier else "kinds > 1 and least = 1").select("key", (F.col("kinds") > crowd).alias("crowded"))


def packed(docs: DataFrame) -> DataFrame:
    """(ord, h1, h2, z): the texts compressed, for joins that must move them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([press(t.as_py()) for t in batch.column(3)], pa.binary())], [*ROW, "z"])

    return mapped(docs.select(*identity(), F.encode(text_of(), "utf-8").alias("text")), run, "ord long, h1 long, h2 long, z binary")


def unpacked(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


_PART = {"key": pa.int64(), "region": pa.int64(), "n": pa.int64(), "ord": pa.int64(), "c0": pa.int32(), "c1": pa.int32(), "crowded": pa.bool_(), "units": pa.binary()}
PART = "key long, region long, n long, ord long, c0 int, c1 int, crowded boolean, units binary"


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values())], list(kinds))


def regions(docs: DataFrame, asked: DataFrame, cut: Callable, gram: int) -> DataFrame:
    """PART rows for asked(heads' columns, crowded): the region's units; c0 to c1: the key's own units in it."""
    wanted = asked.groupBy(*ROW).agg(F.collect_list(F.struct("key", "region", "n", "place", "crowded")).alias("asked"))  # the anchors of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            for row in batch.to_pylist():
                bytes_of = cut(unpacked(row["z"]))[1]
                for a in row["asked"]:
                    lo, back, size = a["place"] >> 32, a["place"] >> 16 & 0xFFFF, a["place"] & 0xFFFF
                    out.append((a["key"], a["region"], a["n"], row["ord"], back, back + gram, a["crowded"], bytes_of(lo, lo + size)))
            yield _batch(out, _PART)

    found = mapped(packed(docs).join(wanted.hint("merge"), ROW), run, PART)
    return found.dropDuplicates(["key", "region"])  # rows of equal identity give equal parts


_ENTRY = {"key": pa.int64(), "region": pa.int64(), "of_key": pa.int64(), "of_region": pa.int64(), "at": pa.int32(), "size": pa.int32(), "n": pa.int64(), "ord": pa.int64(), "c0": pa.int32(), "c1": pa.int32(), "units": pa.binary()}
ENTRY = "key long, region long, of_key long, of_region long, at int, size int, n long, ord long, c0 int, c1 int, units binary"


def _split(length: int, width: int) -> Callable:
    """ENTRY rows: the windows of a region with at least half of their other units left of the key's own, and those with less; width: bytes of a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, 1024):
            out = []
            for key, region, n, order, c0, c1, _, units in zip(*(batch.column(c).to_pylist() for c in _PART)):
                size, slack = len(units) // width, length - (c1 - c0)
                half = (slack + 1) // 2
                more = slack - half + 1
                for side, d0, d1, first, last in ((1, c0 - half, c1, c1 - length, c0 - half), (2, c0, c1 + more, c1 + more - length, c0)):
                    lo, hi = max(0, first), min(size, last + length)
                    if d0 < 0 or d1 > size or hi - lo < length:
                        continue
                    part = units[width * lo : width * hi]
                    new = digest(part[width * (d0 - lo) : width * (d1 - lo)], side) ^ key & (1 << 64) - 1
                    out.append((new, digest(part, d0 - lo), key, region, lo, hi - lo, n, order, d0 - lo, d1 - lo, part))
            signed = [(*(x - (1 << 64) if x >> 63 else x for x in row[:2]), *row[2:]) for row in out]
            yield _batch(signed, _ENTRY)

    return run


def hits(parts: DataFrame, method: Callable[[DataFrame], DataFrame], length: int, width: int, crowd: int, earlier: bool, used: list[DataFrame]) -> DataFrame:
    """(key, region, runs): the units of each region in parts, a PART table, that windows to be removed cover.

    method gives that for the parts of keys that aren't crowded. Crowded keys
    are split and their parts settled like keys of their own. used gets the
    tables that the result reads.
    """
    few = method(parts.where("not crowded"))
    many = parts.where("crowded")
    if many.isEmpty():
        return few
    entries = stored(mapped(many, _split(length, width), ENTRY), "entries")
    again = entries.groupBy("key").agg(F.sum("n").alias("all")).where("all > 1").select("key")
    work = stored(entries.join(again.hint("merge"), "key", "left_semi"), "split-entries")
    discard(entries)
    own = work.groupBy("key", "region").agg(F.sum("n").alias("n"), F.min("ord").alias("ord"), F.max("ord").alias("last"), *[F.first(c).alias(c) for c in ("c0", "c1", "units")])
    own = stored(own, "split-heads")
    asked = stored(own.join(mixed(own, crowd, earlier).hint("merge"), "key").select(*_PART), "split-parts")
    used += [work, own, asked]
    found = verdicts(work.drop("units", "c0", "c1"), own.drop("units", "c0", "c1"), hits(asked, method, length, width, crowd, earlier, used), earlier, used)
    up = found.withColumn("runs", F.when(F.col("whole"), F.array(F.struct(F.lit(0).alias("lo"), F.col("size").alias("hi")))).otherwise(F.col("runs")))
    up = up.select("of_key", "of_region", F.transform("runs", lambda r: F.struct((r["lo"] + F.col("at")).alias("lo"), (r["hi"] + F.col("at")).alias("hi"))).cast(RUNS).alias("runs"))
    up = up.groupBy(F.col("of_key").alias("key"), F.col("of_region").alias("region")).agg(F.flatten(F.collect_list("runs")).alias("runs"))  # two rows at most
    return few.unionAll(up)


def verdicts(work: DataFrame, own: DataFrame, found: DataFrame, earlier: bool, used: list[DataFrame]) -> DataFrame:
    """work's rows that lose something: whole (all of the region) or runs of it. own: work's heads; found: hits() of those that need a look.

    The heads' verdicts are written first, so that Spark can split a region that stands in very many places.
    """
    judged = own.join(found.groupBy("key", "region").agg(F.flatten(F.collect_list("runs")).alias("runs")).hint("merge"), ["key", "region"], "left")  # a row each
    judged = judged.where(("last > ord" if earlier else "n > 1") + " or runs is not null").select("key", "region", F.col("ord").alias("least"), F.col("n").alias("times"), "runs")
    judged = stored(judged, "verdicts")
    used.append(judged)
    whole = F.col("ord") > F.col("least") if earlier else F.col("times") > 1
    return work.join(judged.hint("merge"), ["key", "region"]).withColumn("whole", whole).where("whole or runs is not null")


def spans(docs: DataFrame, cut: Callable, method: Callable[[DataFrame], DataFrame], length: int, gram: int, width: int, crowd: int, earlier: bool) -> DataFrame:
    """(ord, h1, h2, spans): for each text that loses something, intervals of units that together cover what goes.

    earlier: windows go that a smaller ord holds; else windows that stand
    elsewhere. An interval is lo << 32 | hi.
    """
    work = find(docs, cut, length, gram)
    own = stored(heads(work), "heads")
    asked = stored(own.join(stored(mixed(own, crowd, earlier), "keys").hint("merge"), "key"), "asked")
    parts = stored(regions(docs, asked, cut, gram), "regions")
    used = [work, own, asked, parts]
    found = verdicts(work, own.select("key", "region", "n", "ord", "last"), hits(parts, method, length, width, crowd, earlier, used), earlier, used)
    lo = F.shiftright("place", 32)
    span = lambda a, b: F.shiftleft(lo + a, 32).bitwiseOR(lo + b)
    size = F.col("place").bitwiseAND(F.lit(0xFFFF).cast("long"))
    each = F.when(F.col("whole"), F.array(span(F.lit(0), size))).otherwise(F.transform("runs", lambda r: span(r["lo"], r["hi"])))
    out = stored(found.select(*ROW, F.explode(each).alias("span")).groupBy(*ROW).agg(F.collect_set("span").alias("spans")), "spans")  # those of one text
    discard(*used)
    return out


def merged(intervals: list[int], n: int) -> list[tuple[int, int]]:
    """Intervals lo << 32 | hi within [0, n), joined where they touch."""
    if not intervals:
        return []
    at = np.sort(np.array(intervals, np.int64))
    lo, hi = at >> 32, np.minimum(np.maximum.accumulate(at & 0xFFFFFFFF), n)
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return list(zip(lo[first].tolist(), hi[np.append(first[1:], [len(lo)]) - 1].tolist()))
