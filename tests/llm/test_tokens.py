import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kilnspark.llm import bpe, queries, token_planes
from kilnspark.llm.common import scratch

from .data import documents

RANKS, JSON = P.path(queries.BYTE_RANKS), P.path(queries.BYTE_JSON)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_equals_one_scan(reference, monkeypatch):
    import random

    monkeypatch.setattr(bpe, "TEXT_LEAF", 5)
    monkeypatch.setattr(bpe, "PIECE_LEAF", 2)
    codec = bpe.Codec(open(RANKS, "rb").read(), P.PATTERN)
    rng = random.Random(3)
    parts = ["a", "e", "'s", "'re", "'ll", " ", "  ", "\n", " \n", "é", "ß", "漢", "1", "!", "$$", "the", " the", "'", "\t", "aaaa", "𝒳"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    for text in ("a" * 3000, "ab" * 1500, " " * 2000, "x" + " " * 999 + "y"):
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_digests(spark, reference):
    docs = documents(spark)
    want = []
    for row in docs.collect():
        ids = reference.encode_ordinary(row.text or "")
        want.append((row.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(docs, RANKS, P.PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.digests(documents(spark, []), RANKS, P.PATTERN).count() == 0


def test_round_trip(spark, reference):
    docs = documents(spark)
    for row in bpe.round_trip(docs, RANKS, P.PATTERN).collect() + bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect():
        assert row.ids == reference.encode_ordinary(bytes(row.decoded).decode())
    assert sorted(bytes(r.decoded).decode() for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect()) == sorted(r.text or "" for r in docs.collect())


@pytest.mark.parametrize("planes,block", [(4, 65_536), (32, 100)])
def test_token_files(spark, planes, block):
    tokenizer = Tokenizer.from_file(JSON)
    special = spark.createDataFrame([(500, "hello <|endoftext|> world"), (501, "<|endoftext|>"), (502, " a<|endoftext|>  b ")], "doc_id long, text string")
    docs = documents(spark).where("doc_id is null or doc_id <> 4").select("doc_id", "text", F.col("text").alias("th")).unionByName(special, allowMissingColumns=True)
    path = scratch(spark, "ids")
    token_planes.write_ids(docs, path, JSON, 2, block, planes)
    want, start = [], 0
    for row in sorted(docs.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id):
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [2]
        want.append((row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_planes.documents_read(spark, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_chunks_have_the_ids_of_whole_texts(monkeypatch):
    import random

    monkeypatch.setattr(token_planes, "MEMO", 500)
    tokenizer, encoder = Tokenizer.from_file(JSON), token_planes.ChunkEncoder(open(JSON).read())
    rng = random.Random(5)
    parts = ["a", "é", "'s", " 's", "'ll", " ", " ", "  ", "\n", " \n", "\u00a0", "\u2028", "\x1c", "\x85", "漢", "1", "!", "$$", "the", " the", "<|endoftext|>", " <|endoftext|> ", "<|endof", "\t", "𝒳" * 40]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(4000)] + ["x" * 5000, "", " "]
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        assert encoder.encode(some) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]


def test_common_chunks_are_encoded_once(monkeypatch):
    monkeypatch.setattr(token_planes, "MEMO", 40)
    tokenizer, encoder, asked = Tokenizer.from_file(JSON), token_planes.ChunkEncoder(open(JSON).read()), []
    listed = encoder._listed
    monkeypatch.setattr(encoder, "_listed", lambda texts: asked.extend(texts) or listed(texts))
    for at in range(0, 600, 30):
        text = "so the " + " the ".join(f"w{i}\nx" for i in range(at, at + 30))
        assert encoder.encode([text]) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert asked.count(" the") == 1 and asked.count(" w599") == 1


def test_texts_are_cut_between_words_only():
    encoder = token_planes.ChunkEncoder(open(JSON).read())
    for text in ("", "a", "a b", "a\nb c", "a  b", " a", "a ", "a\n\nb", "a \nb", "a\n b", "\na", "a\n", *(f"a{c}b d" for c in token_planes.OTHER_SPACE)):
        words = text.split()
        plain = words and len(words) - 1 == text.count(" ") + text.count("\n") and len(words) - 1 + len("".join(words)) == len(text)
        assert encoder._cut(text) == (text.replace("\n", " \n").split(" ") if plain else token_planes.SEAM.split(text))


def test_words_are_encoded_without_their_punctuation(monkeypatch):
    tokenizer, encoder, asked = Tokenizer.from_file(JSON), token_planes.ChunkEncoder(open(JSON).read()), []
    listed = encoder._listed
    monkeypatch.setattr(encoder, "_listed", lambda texts: asked.extend(texts) or listed(texts))
    texts = ["so beta, beta. beta;\nbeta!", "beta beta?", "größe größe, (größe)"]
    for text in texts:
        assert encoder.encode([text]) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert asked.count(" beta") == asked.count("\nbeta") == asked.count(" größe") == 1
    assert not {" beta,", " beta.", " beta;", " beta?", " größe,"} & set(asked)


@pytest.mark.parametrize("added", [None, "bet", "a,", "%", "\u00e9"])
def test_words_and_punctuation_have_the_ids_of_whole_texts(added):
    import json
    import random

    about = json.loads(open(JSON).read())
    if added:
        about["added_tokens"].append(about["added_tokens"][0] | {"id": 50257, "content": added})
    raw = json.dumps(about)
    tokenizer, encoder = Tokenizer.from_str(raw), token_planes.ChunkEncoder(raw)
    assert encoder.cuts
    rng = random.Random(7)
    parts = ["beta", "Alpha", "größe", "é", "Éa", "ª", "ǅ", "ɐ", "×", "漢", "x1", "don't", "o'", "'s", "s'", "x's", "_", "a_b", ",", ".", "***", "%%%", "<|", "|>", "<|endoftext|>", "²", "e\u0301", "…"]
    texts = ["".join(rng.choice(["", " ", " ", " ", "\n", "  "][: 5 if i % 9 else 6]) + rng.choice(parts) for _ in range(rng.randint(1, 20))) for i in range(4000)]
    for at in range(0, len(texts), 400):
        some = texts[at : at + 400]
        assert encoder.encode(some) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]


def test_texts_are_gathered_in_order(monkeypatch):
    monkeypatch.setattr(token_planes, "AT_ONCE", 10)
    texts = ["", "abc", "x" * 50, "", "abcd", "abcdef", "a", "", "abcdefghi"]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(a, b)), "text": texts[a:b]}) for a, b in ((0, 4), (4, 9))]
    groups = list(token_planes._groups(iter(batches)))
    assert [t for _, g in groups for t in g] == texts and [d for g, _ in groups for d in g] == list(range(9))
    assert all(sum(map(len, g)) <= 10 or max(map(len, g)) > 10 and sum(map(len, g)) == 50 for _, g in groups) and not list(token_planes._groups(iter([])))


def test_token_files_of_nothing(spark):
    path = scratch(spark, "ids")
    token_planes.write_ids(documents(spark, []), path, JSON, 2)
    assert token_planes.documents_read(spark, path).count() == 0


def test_planes_round_trip():
    ids = np.random.default_rng(1).integers(0, 2**32, 1001, dtype=np.uint64).astype("<u4")
    for planes in (4, 32):
        ends, payload = token_planes.pack(ids, planes)
        assert (token_planes.unpack(len(ids), planes, ends, payload) == ids).all()


def test_crc_of_parts():
    data = bytes(range(256)) * 40
    cuts = [0, 1, 1, 500, 7000, len(data)]
    parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
    assert token_planes.joined_crc([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(data)
