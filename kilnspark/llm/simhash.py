"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are cut into RING segments. For two fingerprints that differ in
at most tau bits, some segment starts a chain, around the ring, whose every
prefix of l segments differs in at most floor(l * tau / RING) bits. The first
segments of such a chain have a budget of zero, so they are an equality key;
the rest of the chain is checked before the full Hamming distance is. A bucket
of more than CROWD fingerprints is not paired: its members are tied through
the values within one bit of them, which reaches each pair at distance two.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import slices, stored, text_of
from kilnspark.llm.components import components

TAU, RING, CROWD, SEED = 2, 5, 64, 42
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    words = text.translate(UPPER).split()
    if not words:
        return 0
    line, n = b" ".join(words), len(words) - width + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: n - 1]).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], dtype="<u8")
    return folded(hashes)


def folded(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    """A 64-bit number as Spark's long."""
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row of docs; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, "u8").view("i8"))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_of(), "utf-8").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _cuts(ring: int) -> list[int]:
    return [64 * i // ring for i in range(ring + 1)]


def _mask(i: int, ring: int) -> int:
    """The bits of segment i as a signed 64-bit integer."""
    cuts = _cuts(ring)
    return signed((1 << cuts[i + 1]) - (1 << cuts[i]))


def _ball(radius: int) -> Column:
    """The differences of at most radius bits."""
    spots = [sum(1 << i for i in some) for r in range(radius + 1) for some in combinations(range(64), r)]
    return F.array(*[F.lit(signed(x)).cast("long") for x in spots])


def _chain(x: Column, start: int, tau: int, ring: int) -> Column:
    """Whether the differing bits x keep each chain budget from segment start on."""
    total, ok = F.lit(0), F.lit(True)
    for length in range(1, ring + 1):
        total = total + F.bit_count(x.bitwiseAND(F.lit(_mask((start + length - 1) % ring, ring)).cast("long")))
        ok = ok & (total <= length * tau // ring)
    return ok


def links(fps: DataFrame, tau: int = TAU, ring: int = RING, crowd: int = CROWD) -> DataFrame:
    """(a, b) that connect exactly the distinct values fp at most tau bits apart, tau up to 4; a null fp links to none.

    Within a crowded bucket the links are stars: two members are at most tau
    bits apart just if some value is within half of tau of the one and the
    rest of it of the other, so each value ties what is near it to one member.
    What is reachable stays, not each pair. Columns but fp are left out.
    """
    if not 0 < tau <= 4:
        raise ValueError("the values around a member of a crowded bucket are too many for this tau")
    zeros = next(n for n in range(1, ring + 1) if n * tau // ring) - 1
    masks = [sum(_mask((i + k) % ring, ring) for k in range(zeros)) for i in range(ring)]
    keys = F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("part")) for i, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.start", "k.part")
    sizes = keyed.groupBy("start", "part").agg(F.count("*").alias("n")).where("n > 1")
    held = stored(keyed.join(sizes.hint("merge"), ["start", "part"]), "buckets")
    few = held.where(F.col("n") <= crowd)
    pairs = few.select("start", "part", F.col("fp").alias("a")).join(few.select("start", "part", F.col("fp").alias("b")).hint("merge"), ["start", "part"]).where("a < b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    chained = F.lit(False)
    for i in range(ring):
        chained = chained | ((F.col("start") == i) & _chain(x, i, tau, ring))
    near = pairs.where(chained & (F.bit_count(x) <= tau)).select("a", "b")
    crowded = held.where(F.col("n") > crowd).select("fp").distinct()
    around = lambda radius: crowded.select("fp", F.explode(_ball(radius)).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("z"))
    centre = around(tau // 2).groupBy("z").agg(F.min("fp").alias("a"))
    far = around(tau - tau // 2) if tau % 2 else around(tau // 2)
    hubs = far.withColumnRenamed("fp", "b").join(centre.hint("merge"), "z").select("a", "b").where("a <> b")
    return near.unionAll(hubs).distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs(doc_id, text).

    component_id is the least doc_id reachable over links of at most two
    differing bits (a null doc_id counts as larger than all). Texts without
    words, empty and null ones have fingerprint zero and link like any other;
    equal texts always share a component. Copies meet as one fingerprint, so a
    large group costs one row. Other columns are left out.
    """
    fps = stored(fingerprints(docs, width), "fingerprints")
    least = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(least.select("fp")))
    classes = least.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.select("fp", "root").join(ids.hint("merge"), "root").select("fp", "component_id")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(named.hint("merge"), "fp").select("doc_id", shown, "component_id")
