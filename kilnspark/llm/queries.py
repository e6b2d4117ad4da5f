"""The registered corpus queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnspark.llm import bpe, lz_dedup, maxent_lm, merkle, mixing, multi_index, order_minhash, periodic, quality, secrets, simhash, suffix_dedup, token_planes
from kilnspark.llm.common import WORD, crc_class, scratch, table

BYTE_RANKS, BYTE_JSON, END_ID = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", 2
SOURCE_WEIGHTS, MIX_SHARE, MIX_MOST = [3, 1, 2], 1.5, 2


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded by byte-level BPE."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    return order_minhash.compare_edits(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix to source weights takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, MIX_SHARE, MIX_MOST)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every text; one id class in four never teaches."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_class(4) == 2)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without its repeated 400-byte strings."""
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without the 13-word windows of smaller documents."""
    return lz_dedup.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, written to plane files and read back."""
    path = scratch(spark, "token-ids")
    token_planes.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_JSON), END_ID)
    return token_planes.documents_read(spark, path)


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for each hundredth vector."""
    return multi_index.search(table(spark, sf_dir, "embeddings"), every=100, top=10)


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every text; one id class in seven is held out."""
    return maxent_lm.scores(table(spark, sf_dir, "documents"), crc_class(7) != 2, crc_class(7) == 2)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and their components."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents of which one id class in ten repeats its words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, words = F.floor(h / 10), F.col("_w")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    again = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % p))
    split = docs.withColumn("_w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    return split.withColumn("text", F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), again), " ")).otherwise(F.col("text"))).drop("_w")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of periodic words of every text, and what stays without repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = F.col("runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("shorter"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = periodic.find_runs(with_repeats(docs), least=12).withColumn("best", best)
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.shorter")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.shorter")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every row; one id class in five is tampered with."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], {"text": lowered}, crc_class(5) == 0)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text, by patterns and by models of random strings."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != secrets.MODEL)
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS], F.sha2(secrets.shown(base), 256).alias("base_sha256"), secrets.shown(F.col("spans")).alias("spans"), count(secrets.MODEL).alias("n_random"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_order_minhash, op3_source_mixing, op4_quality, op5_suffix_dedup, op6_substring_dedup, op7_token_planes, op8_multi_index, op9_maxent_lm, op10_simhash, op11_periodic_runs,
              op12_merkle_manifest, op13_secret_scan)
}

ORACLE: dict[str, str] = {
    "op12_merkle_manifest": merkle.oracle(),
    "op3_source_mixing": mixing.oracle(SOURCE_WEIGHTS, MIX_SHARE, MIX_MOST),
}
