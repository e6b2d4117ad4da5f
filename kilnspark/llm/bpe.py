"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved recursively. The elements that are joined up the tree are
piece lists (matches of the split pattern), and inside a long piece, token
lists. Both joins re-encode a window around the seam that grows until what
lies outside is proven stable:

* Pieces: the pattern has no lookbehind, so a scan that reaches a position at
  which the right half's own scan also stood continues as that scan did; a
  left piece is final if the pattern needed no character past the seam.
* Tokens: merging by rank treats two neighbouring spans alike whatever stands
  around them, until a merge crosses their outer edges. A token sequence is
  therefore the encoding of its bytes exactly if each neighbouring pair is the
  encoding of its own bytes. If a re-encoded window begins and ends with the
  same tokens as before, every pair across its edges was valid already.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import mapped, slices, text_of

#: Characters of a text leaf, bytes of a piece leaf, entries kept in each of a worker's memos.
TEXT_LEAF, PIECE_LEAF, MEMO = 4096, 16, 300_000
#: Characters past its end that the split pattern can look at to end a piece.
LOOKAHEAD = 2


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the text of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


class Memo(dict):
    """Remembers the short pieces, leaves or windows met so far; starts anew when full."""

    def __init__(self, of, most: int = MEMO):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, piece: str):
        got = self.of(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = got
        return got


class Codec:
    """Encoder and decoder for one rank table and split pattern."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = read_ranks(raw)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.pattern = regex.compile(pattern)
        self.memo, self.leaves, self.windows = Memo(self.encode_piece, 2 * MEMO), Memo(self._leaf), Memo(self._window)

    # tokens of one piece

    def merge(self, data: bytes) -> list[int]:
        """Merge by rank, leftmost first, without the tree: for leaves and windows."""
        return self._merge_short(data) if len(data) <= 48 else self._merge_long(data)

    def _merge_short(self, data: bytes) -> list[int]:
        rank, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) != none:
            i = pairs.index(least)
            joined = parts[i] = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + joined, none)
            if i < len(pairs):
                pairs[i] = rank(joined + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        n, rank = len(data), self.ranks.get
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, to = heapq.heappop(heap)
            if end[i] != mid or mid >= n or end[mid] != to:
                continue
            end[i], end[mid] = to, -1
            if to < n:
                back[to] = i
                if (r := rank(data[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, to, end[to]))
            if (j := back[i]) >= 0 and (r := rank(data[j:to])) is not None:
                heapq.heappush(heap, (r, j, i, to))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def join_tokens(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of left followed by those of right."""
        if not left or not right:
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self.windows[left[i:] + right[:j]]
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            k *= 2

    def _window(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(self.merge(b"".join([self.tokens[t] for t in tokens])))

    def _leaf(self, data: bytes) -> tuple[int, ...]:
        return tuple(self.merge(data))

    def _tree(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= PIECE_LEAF:
            return self.leaves[data]
        mid = len(data) // 2
        return self.join_tokens(self._tree(data[:mid]), self._tree(data[mid:]))

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self._tree(data)

    # pieces of a text

    def pieces(self, text: str, lo: int, hi: int) -> list[str]:
        if hi - lo <= TEXT_LEAF:
            return self.pattern.findall(text, lo, hi)
        mid = (lo + hi) // 2
        return self.join_pieces(text, mid, hi, self.pieces(text, lo, mid), self.pieces(text, mid, hi))

    def join_pieces(self, text: str, mid: int, hi: int, left: list[str], right: list[str]) -> list[str]:
        """The pieces of two neighbouring halves that meet at mid, as one scan would find them."""
        at = mid
        while left and at + LOOKAHEAD > mid:
            at -= len(left.pop())
        seen, k = mid, 0
        while at != seen or at < mid:
            match = self.pattern.match(text, at, hi)
            left.append(match.group())
            at = match.end()
            while seen < at:
                seen += len(right[k])
                k += 1
        return left + right[k:]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pieces(text, 0, len(text)))))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, concatenated up a tree of halves."""
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_codecs: dict[tuple[int, str], Codec] = {}


def codec_of(raw: bytes, pattern: str) -> Codec:
    """One codec for each rank file in a process."""
    key = (hash(raw), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def _shared(df: DataFrame, rank_file: str):
    with open(rank_file, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: fixed size


def _over(docs: DataFrame, rank_file: str, pattern: str, key: str, text: str, columns: list[tuple[str, str]], of) -> DataFrame:
    """of(codec, texts), a list of Arrow arrays for `columns`, over each row's text, beside its key: one pass of Python."""
    raw = _shared(docs, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(raw.value, pattern)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *of(codec, batch.column(1).to_pylist())], [key, *(c for c, _ in columns)])

    kind = docs.schema[key].dataType.simpleString()
    return mapped(docs.select(key, text_of(text).alias("text")), run, ", ".join([f"`{key}` {kind}", *map(" ".join, columns)]))


def _listed(ids: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))))


def encode(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for each row of docs.

    A null text counts as empty and gives no ids; repeated rows and rows of one
    key, null or not, are encoded each; an empty table gives no rows; other
    columns of docs are left out. A very long text stays within one task, but
    its tree keeps windows small.
    """
    return _over(docs, rank_file, pattern, key, text, [("ids", "array<int>")], lambda codec, texts: [_listed([codec.encode(t) for t in texts])])


def decode(encoded: DataFrame, rank_file: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded binary) for rows of (key, ids); null ids count as none."""
    raw = _shared(encoded, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(raw.value, pattern)
        for batch in slices(batches):
            ends, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            texts = [codec.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], [key, "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids")
    return mapped(encoded.select(key, ids), run, f"`{key}` {kind}, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded binary): each text encoded and its ids decoded again, rows as in encode()."""

    def of(codec: Codec, texts: list[str]) -> list[pa.Array]:
        ids = [codec.encode(t) for t in texts]
        return [_listed(ids), pa.array(map(codec.decode, ids), pa.binary())]

    return _over(docs, rank_file, pattern, key, text, [("ids", "array<int>"), ("decoded", "binary")], of)


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs, rows as in encode().

    The hashes are of the decimal ids joined by commas and of the bytes decoded
    from the ids, so that no ids leave the task.
    """

    def of(codec: Codec, texts: list[str]) -> list[pa.Array]:
        sizes, listed, decoded = [], [], []
        for text in texts:
            ids = codec.encode(text)
            sizes.append(len(ids))
            listed.append(hashlib.sha256(",".join(map(codec.names.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return [pa.array(sizes, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]

    return _over(docs, rank_file, pattern, "doc_id", "text", [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], of)
