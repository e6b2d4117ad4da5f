import random
import re
import sys

import pytest
import xxhash

from kilnspark.llm import simhash
from kilnspark.llm.components import components

from .data import documents


def brute_fingerprint(text):
    words = [w for w in re.split(r"[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, tau=2):
    """The least index of each index's component under a Hamming distance of tau."""
    root = list(range(len(values)))
    for _ in values:
        for i, a in enumerate(values):
            for j, b in enumerate(values[:i]):
                if ((a ^ b) & (2**64 - 1)).bit_count() <= tau:
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_near_duplicates(spark):
    docs = documents(spark)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    fps = [brute_fingerprint(r.text) for r in rows]
    want = sorted((str(r.doc_id), f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, fps, classes(fps)))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_links_reach_what_is_near(spark):
    """Random and crowded fingerprints, with buckets below and above the crowd bound."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base}
    for _ in range(150):
        values.add(rng.choice(sorted(values)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values |= {rng.getrandbits(64) for _ in range(50)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    near = classes(values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for crowd in (2, 1000):
        edges = [(r.a, r.b) for r in simhash.links(df, crowd=crowd).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in edges)
        roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert [roots.get(v, v) for v in values] == [values[c] for c in near]


@pytest.mark.parametrize("tau", [1, 3])
def test_links_of_other_distances(spark, tau):
    rng = random.Random(tau)
    values = {rng.getrandbits(64) for _ in range(4)}
    for _ in range(90):
        near = rng.choice(sorted(values))
        for bit in rng.sample(range(64), rng.choice([1, 2, 3, 5])):
            near ^= 1 << bit
        values.add(near)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for crowd in (2, 1000):
        edges = [(r.a, r.b) for r in simhash.links(df, tau, crowd=crowd).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= tau for a, b in edges)
        roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert [roots.get(v, v) for v in values] == [values[c] for c in classes(values, tau)]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(1, 300)) and 5000 not in got


def test_stars_take_no_round(spark, monkeypatch):
    """Each round is several jobs, whose plans the driver makes and keeps."""
    module, written = sys.modules["kilnspark.llm.components"], []
    keep = module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: written.append(name) or keep(df, name))
    got = {(r.node, r.root) for r in components(spark.createDataFrame([(1, 2), (3, 1), (9, 8), (2, 1)], "a long, b long")).collect()}
    assert got == {(2, 1), (3, 1), (9, 8)} and written == ["edges"]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
