"""Token-id files: fixed-size id blocks, transposed into planes and compressed.

The file format is a table that Spark's own writer commits, one row for each
chunk: a block of at most BLOCK ids of one shard, in ascending document order.
Its ids (32 bits, little endian) are transposed into byte or bit planes, each
plane is compressed with zstandard, and plane_ends says where each ends in the
payload. The row is also the chunk's index: shard, chunk, the shard's ids
before it, and for each document part in it the document's place, id and ids.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnspark.llm.common import slices, text_of

#: Ids of a block, chunks of text kept in a worker's memo, and characters of the texts encoded at once (a longer text stands alone).
BLOCK, MEMO, AT_ONCE = 65_536, 1_000_000, 2_000_000
CHUNKS = "shard int, chunk int, first long, n_ids int, planes int, plane_ends array<int>, payload binary, doc_nos array<int>, doc_ids array<long>, parts array<int>"


def pack(ids: np.ndarray, planes: int) -> tuple[list[int], bytes]:
    """Where each compressed plane ends, and the planes. planes: 4 (bytes) or 32 (bits)."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == 32:
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        flat = [np.packbits(p, bitorder="little").tobytes() for p in rows.T]
    else:
        flat = [p.tobytes() for p in rows.T]
    done = [zstandard.ZstdCompressor(level=3).compress(p) for p in flat]
    return np.cumsum([len(p) for p in done]).tolist(), b"".join(done)


def unpack(n: int, planes: int, ends: list[int], payload: bytes) -> np.ndarray:
    """The ids of a chunk."""
    raw = [zstandard.ZstdDecompressor().decompress(payload[a:b]) for a, b in zip([0, *ends], ends)]
    flat = [np.frombuffer(p, np.uint8) for p in raw]
    if planes == 32:
        bits = np.stack([np.unpackbits(p, count=n, bitorder="little") for p in flat], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    return np.ascontiguousarray(np.stack(flat, axis=1)).view("<u4").ravel()


#: A space between two other characters that are no white space: no match of the byte-level pre-tokenizer's pattern reaches across its left side.
SEAM = re.compile(r"(?<=\S) (?=\S)")


#: White space but spaces and line feeds.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
ASCII_SPACE = [c for c in OTHER_SPACE if c.isascii()]
#: The pattern matches Latin letters apart from the punctuation after them.
LATIN, MARKS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"), string.punctuation
#: Byte-level models write a byte that is no printable Latin-1 character as one of the characters from 256 on.
BYTES = {b: 256 + i for i, b in enumerate(x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174))}


class ChunkEncoder:
    """Encodes with the tokenizers library, each distinct chunk once while it is remembered; the earlier half of a full memo stays.

    Texts are cut before single spaces and line feeds, where the byte-level
    pre-tokenizer always cuts too, so a text's ids are those of its chunks.
    A chunk of letters and punctuation after them is made of both; letters
    alone are one match of its pattern, which goes to the library's model at
    once. Under any other pre-tokenizer, a normalizer, or an added token with
    white space or such neighbours, texts stay whole.
    """

    def __init__(self, raw: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.ids = Tokenizer.from_str(raw), {"": b""}
        about = json.loads(raw)
        split = {k: (about["pre_tokenizer"] or {}).get(k) for k in ("type", "add_prefix_space", "use_regex")}
        plain = split == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and not about["normalizer"] and not about["truncation"]
        self.added = [t["content"] for t in about["added_tokens"]]
        self.cuts = plain and not any(t["content"].split() != [t["content"]] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in about["added_tokens"])
        self.feed = np.frombuffer(self._each(["\n"])[0], "<u4")

    def _each(self, texts: list[str]) -> list[bytes]:
        return _parts([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _with_added(self, chunks: list[str]) -> set[str]:
        """The chunks in which an added token stands."""
        joined = " ".join(chunks)
        found = [t for t in self.added if t in joined]
        return {c for c in chunks if any(t in c for t in found)} if found else set()

    def _letters(self, words: list[str]) -> list[bytes]:
        """As _each, for Latin letters after a space or a line feed, without an added token."""
        tokenize, feed = self.tokenizer.model.tokenize, self.feed.tolist()
        level = [w[1:] if w.isascii() else w[1:].encode().decode("latin-1").translate(BYTES) for w in words]
        return _parts([[t.id for t in tokenize("\u0120" + x)] if w[0] == " " else [*feed, *(t.id for t in tokenize(x))] for w, x in zip(words, level)])

    def _listed(self, texts: list[str]) -> list[bytes]:
        """As _each, for texts that begin with a space or a line feed and have no other white space at their ends.

        Between those that are not just letters stands a line feed, whose token
        has no other source.
        """
        held = self._with_added(texts)
        done = dict(zip(held, self._each(list(held))))
        done.update(zip(words := [t for t in texts if t not in held and _latin(t[1:])], self._letters(words)))
        rest = [t for t in texts if t not in done]
        if len(self.feed) == 1 and rest and not any("\n" in t for t in rest):
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(["", *rest])], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.feed[0])
            raw, starts, ends = ids.tobytes(), (4 * (cuts + 1)).tolist(), (4 * np.append(cuts[1:], len(ids))).tolist()
            done.update(zip(rest, [raw[a:b] for a, b in zip(starts, ends)]))
        else:
            done.update(zip(rest, self._each(rest)))
        return [done[t] for t in texts]

    def _plain(self, text: str) -> bool:
        """Whether all white space is single spaces and line feeds between words."""
        feeds = "\n" in text
        return not (not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or feeds and ("\n\n" in text or " \n" in text or "\n " in text) or any(c in text for c in (ASCII_SPACE if text.isascii() else OTHER_SPACE)))

    def _cut(self, text: str) -> list[str]:
        """The text's chunks: each but the first stands for itself after a space, or for itself if it begins with a line feed."""
        return text.replace("\n", " \n").split(" ") if self._plain(text) else SEAM.split(text)

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks that the memo lacks, which keeps them."""
        held, made, fresh = self._with_added(chunks), [], {}
        for c in chunks:
            word = c.rstrip(MARKS)
            if len(word) < len(c) and c not in held and _latin(word[1:] if word[:1] == "\n" else word):
                made.append((c, word, marks := "\n" + c[len(word) :]))  # the punctuation has its ids after a line feed's
                fresh[word] = fresh[marks] = None
            else:
                fresh[c] = None
        fresh = [c for c in fresh if c not in self.ids]
        for at in range(0, len(fresh), 4096):
            some = fresh[at : at + 4096]
            for part in ([c for c in some if "\n" not in c], [c for c in some if "\n" in c]):
                self.ids.update(zip(part, self._listed([c if c[0] == "\n" else f" {c}" for c in part])))
        ids, skip = self.ids, 4 * len(self.feed)
        for c, word, marks in made:
            ids[c] = ids[word] + ids[marks][skip:]
        return [ids[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.cuts:
            return self._each(texts)
        plain = [self._plain(t) for t in texts]
        odd = [SEAM.split(t) for t, p in zip(texts, plain) if not p]
        firsts = self._each([c[0] for c in odd])
        # Plain texts are cut at once, each after a line feed, whose ids go again; the empty string before them has no ids.
        spaced = "".join([f"\n{t}" for t, p in zip(texts, plain) if p]).replace("\n", " \n")
        chunks = pa.concat_arrays([pc.split_pattern(pa.array([spaced], pa.large_string()), " ").flatten(), pa.array([c for x in odd for c in x[1:]], pa.large_string())]).dictionary_encode()
        known = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.ids.get, known))
        gaps = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(gaps, self._learn([known[i] for i in gaps])):
            ids[i] = x
        if len(self.ids) > MEMO:  # chunks met early are those met often
            self.ids = dict(islice(self.ids.items(), MEMO // 2))
        sizes, at = np.fromiter(map(len, ids), np.int64, len(ids)) // 4, chunks.indices.to_numpy()
        starts, took = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.cumsum(took)
        raw = np.frombuffer(b"".join(ids), "<u4")[np.arange(ends[-1]) + np.repeat(starts - (ends - took), took)].tobytes()
        counts = [t.count(" ") + t.count("\n") + 1 for t, p in zip(texts, plain) if p] + [len(c) - 1 for c in odd]
        cuts = (4 * ends[np.cumsum([0, *counts])]).tolist()
        own = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        first, rest, skip = iter(own), zip(firsts, own[len(texts) - len(odd) :]), 4 * len(self.feed)
        return [next(first)[skip:] if p else b"".join(next(rest)) for p in plain]


def _latin(word: str) -> bool:
    """Whether word is Latin letters alone."""
    return word.isalpha() and (word.isascii() or LATIN.fullmatch(word) is not None)


def _parts(found: list[list[int]]) -> list[bytes]:
    """Each list of ids as little-endian unsigned 32-bit integers."""
    raw = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
    ends = list(accumulate([4 * len(f) for f in found]))
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


_encoders: dict[int, ChunkEncoder] = {}


def _encoder(raw: str) -> ChunkEncoder:
    key = hash(raw)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(raw)
    return _encoders[key]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """The ids and texts of rows in order, as many at once as have AT_ONCE characters."""
    docs, texts, size = [], [], 0
    for batch in slices(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if size and size + len(text) > AT_ONCE:
                yield docs, texts
                docs, texts, size = [], [], 0
            docs.append(doc)
            texts.append(text)
            size += len(text)
    if docs:
        yield docs, texts


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, block: int = BLOCK, planes: int = 4) -> None:
    """Encode every text of docs(doc_id, text), append end_id, write the chunks.

    Ids are those of the library's encode with add_special_tokens=False: the
    string of an added token in a text gives that token. A null text counts as
    empty; rows of equal doc_id stay apart, in the order of their texts'
    hashes; a null doc_id comes first; an empty table gives an empty file; a
    very long text spreads over chunks. Other columns are left out. A shard is
    one range of (doc_id, hash of the text), so that an id of many rows is cut
    between shards.
    """
    if planes not in (4, 32):
        raise ValueError("planes: 4 (bytes) or 32 (bits)")
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        raw = spark.sparkContext.broadcast(f.read())  # a vocabulary file: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(raw.value), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        chunk, first, no, held, parts = 0, 0, 0, bytearray(), []

        def cut(size: int) -> pa.RecordBatch:
            nonlocal chunk, first, held, parts
            ids = np.frombuffer(bytes(held[: 4 * size]), "<u4")
            ends, payload = pack(ids, planes)
            row = [[shard], [chunk], [first], [size], [planes], [ends], [payload], [[p[0] for p in parts]], [[p[1] for p in parts]], [[p[2] for p in parts]]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            del held[: 4 * size]
            chunk, first, parts = chunk + 1, first + size, []
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

        names = [x.split()[0] for x in CHUNKS.split(", ")]
        for docs, texts in _groups(batches):
            for doc, ids in zip(docs, encoder.encode(texts)):
                left, ids = len(ids) // 4 + 1, ids + end
                while left:
                    room = block - len(held) // 4
                    take = min(left, room)
                    at = len(ids) - 4 * left
                    held += ids[at : at + 4 * take]
                    parts.append((no, doc, take))
                    left -= take
                    if take == room:
                        yield cut(block)
                no += 1
        if held:
            yield cut(len(held) // 4)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("th", F.xxhash64("text"))
    dealt = own.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").drop("th")
    dealt.mapInArrow(run, CHUNKS).write.option("compression", "uncompressed").parquet(path)


def _shifted(crc: int, n: int) -> int:
    """crc moved past n zero bytes: the product with x^(8n) modulo the CRC-32 polynomial."""
    square, product, n = 1 << 30, 1 << 31, 8 * n  # bit 31 stands for x^0

    def times(a: int, b: int) -> int:
        out = 0
        for i in range(31, -1, -1):
            if a >> i & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    while n:
        if n & 1:
            product = times(square, product)
        square, n = times(square, square), n >> 1
    return times(product, crc)


def joined_crc(crcs: list[int], sizes: list[int]) -> int:
    """The crc32 of parts laid end to end, from each part's crc32 and bytes."""
    out = 0
    for crc, n in zip(crcs, sizes):
        out = _shifted(out, n) ^ crc
    return out


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_no, doc_id, at, ids binary) for each document part; at: the shard's ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            for row in batch.to_pylist():
                ids = unpack(row["n_ids"], row["planes"], row["plane_ends"], row["payload"])
                cuts = np.cumsum([0, *row["parts"]])
                n = len(cuts) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_nos"], pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + cuts[:-1], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    ["shard", "doc_no", "doc_id", "at", "ids"],
                )

    return spark.read.schema(CHUNKS).parquet(path).mapInArrow(run, "shard int, doc_no int, doc_id long, at long, ids binary")


def documents_read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back: doc_id, start, n_tokens, ids_crc32."""

    @F.pandas_udf("long")
    def joined(crcs: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([joined_crc([int(x) for x in a], [int(x) for x in b]) for a, b in zip(crcs, sizes)], dtype="int64")

    parts = read_ids(spark, path).select("shard", "doc_no", "doc_id", "at", F.crc32("ids").alias("crc"), F.octet_length("ids").alias("n"))
    docs = parts.groupBy("shard", "doc_no", "doc_id").agg(F.min("at").alias("at"), F.sum("n").alias("bytes"), F.array_sort(F.collect_list(F.struct("at", "crc", "n"))).alias("p"))
    whole = docs.where(F.size("p") == 1).select("shard", "doc_id", "at", "bytes", F.col("p")[0]["crc"].alias("ids_crc32"))
    torn = docs.where(F.size("p") > 1).select("shard", "doc_id", "at", "bytes", joined("p.crc", "p.n").alias("ids_crc32"))
    sizes = spark.read.schema(CHUNKS).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = sizes.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))  # a row for each partition written
    return whole.unionAll(torn).join(F.broadcast(before), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), (F.col("bytes") / 4).cast("long").alias("n_tokens"), "ids_crc32")
