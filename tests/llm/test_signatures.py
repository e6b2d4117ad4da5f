"""Order MinHash signatures against a plain twin, and the order of documents against a sort."""

import re

import pytest
import xxhash
from pyspark.sql import functions as F

from kilnspark.llm import order_minhash as om

from .data import documents

ALL = (1 << 64) - 1


def hashed(parts, seed=42):
    """Spark's xxhash64 of a row of byte strings."""
    for part in parts:
        seed = xxhash.xxh64_intdigest(part, seed)
    return seed


def number(x, size=8):
    return (x & ((1 << 8 * size) - 1)).to_bytes(size, "little")


def twin(text, k, bins, least):
    """The least numbered k-mers of each bin, in text order, hashed."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return []
    grams = [words[i : i + k] for i in range(max(1, len(words) - k + 1))]
    seen, held = {}, {}
    for i, gram in enumerate(grams):
        h = hashed([w.encode() for w in gram]) & ((1 << 36) - 1)
        g = hashed([number(h), number(seen.get(h, 0), 4)])
        seen[h] = seen.get(h, 0) + 1
        signed = g - (1 << 64) if g >> 63 else g
        held.setdefault(signed % bins, []).append(((g >> 20) & ((1 << 30) - 1), i))
    out = []
    for b, entries in sorted(held.items()):
        placed = sorted((i, rank) for rank, i in sorted(entries)[:least])
        out.append((b << 32) + (hashed([number(b << 30 | rank) for _, rank in placed]) & 0xFFFFFFFF))
    return out


@pytest.mark.parametrize("k,bins,least", [(2, 64, 2), (1, 7, 3), (3, 64, 1)])
def test_signature_equals_its_twin(spark, k, bins, least):
    docs = documents(spark).where("length(text) < 3000 or text is null")
    got = docs.select("text", om.signature(F.coalesce("text", F.lit("")), k, bins, least).alias("sig")).collect()
    assert len(got) > 20
    for row in got:
        assert row.sig == twin(row.text or "", k, bins, least)


def test_next_row_with_an_id_that_most_rows_share(spark):
    rows = [(i, i * 7919 % 1009 - 500 << 50) for i in range(20)] + [(5, (j * 7919 % 1009 - 500) << 54) for j in range(300)] + [(2**63 - 1, j << 60) for j in range(-7, 7)]
    docs = spark.createDataFrame(rows, "ord long, th long").repartition(3)
    numbers = om.ranged(docs, "ord", "th").groupBy("_range").count().collect()
    assert max(r["count"] for r in numbers) < 100
    want = sorted(rows)
    got = {(r.ord, r.th): (r.next_ord, r.next_th) for r in om.with_next(docs, ["ord", "th"]).collect()}
    assert got == dict(zip(want, want[1:] + want[:1]))
