"""Document fingerprints by order MinHash, with built-in functions only.

The k-mers of a text are its runs of `k` words, numbered by occurrence: the
second time a k-mer stands in a text it counts as another one. Each numbered
k-mer hashes into one of `bins`; a bin keeps the `least` of them that hash
lowest, puts them in text order and hashes that tuple. Two texts agree in a
bin if the same k-mers win it in the same order, which moves and swaps break.

Within the arrays an element is one 63-bit number, so that sorting compares
numbers: a hash above, the position (27 bits) below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.llm.common import WORD, partitions, text_of

K, BINS, LEAST = 2, 64, 2
_AT, _VALUE = 27, 36


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mask(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _numbered(packed: Column, bins: int) -> Column:
    """Sorted (hash, position) to bin (6 bits), rank (30 bits), position, by occurrence-numbered k-mer."""

    def runs(a: Column, starts: Column) -> Column:
        def occurrences(start: Column, j: Column) -> Column:
            stop = F.coalesce(F.get(starts, j + 1), F.size(a)) - 1

            def one(i: Column) -> Column:
                g = F.xxhash64(F.shiftright(F.get(a, i), _AT), i - start)
                lead = F.shiftleft(F.pmod(g, F.lit(bins)), 57)
                return lead + F.shiftleft(_mask(F.shiftrightunsigned(g, 20), 30), _AT) + _mask(F.get(a, i), _AT)

            return F.transform(F.sequence(start, stop), one)

        return F.flatten(F.transform(starts, occurrences))

    def of(a: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.shiftright(F.get(a, i), _AT) != F.shiftright(F.get(a, i - 1), _AT)))
        return _let(first, lambda starts: runs(a, starts))

    return _let(packed, of)


def signature(text: Column, k: int = K, bins: int = BINS, least: int = LEAST) -> Column:
    """array<bigint>: for each bin that has k-mers, bin << 32 | 32 bits of its tuple's hash.

    A text of fewer than k words is one k-mer; one without words has no entry.
    """
    if not 1 <= bins <= 64:
        raise ValueError("bins: 1 to 64")

    def packed(words: Column) -> Column:
        n = F.greatest(F.size(words) - (k - 1), F.lit(1))
        return F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.shiftleft(_mask(F.xxhash64(*[F.get(words, i + j) for j in range(k)]), _VALUE), _AT) + i))

    def winners(a: Column) -> Column:
        return F.filter(a, lambda e, i: F.coalesce(F.shiftright(F.get(a, i - least), 57) != F.shiftright(e, 57), F.lit(True)))

    def tuples(won: Column) -> Column:
        def entry(e: Column, i: Column) -> Column:
            own = F.filter(F.slice(won, i + 1, least), lambda x: F.shiftright(x, 57) == F.shiftright(e, 57))
            placed = F.sort_array(F.transform(own, lambda x: F.shiftleft(_mask(x, _AT), _VALUE) + _mask(F.shiftright(x, _AT), _VALUE)))
            hashed = F.xxhash64(F.transform(placed, lambda y: _mask(y, _VALUE)))
            leads = F.coalesce(F.shiftright(F.get(won, i - 1), 57) != F.shiftright(e, 57), F.lit(True))
            return F.when(leads, F.shiftleft(F.shiftright(e, 57), 32) + _mask(hashed, 32))

        return F.filter(F.transform(won, entry), lambda x: x.isNotNull())

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    made = _let(words, lambda w: F.when(F.size(w) > 0, _let(F.sort_array(_numbered(packed(w), bins)), lambda a: _let(winners(a), tuples))))
    return F.coalesce(made, F.array().cast("array<bigint>"))


def shown(signature: Column) -> Column:
    """A signature as text: ten hex digits an entry."""
    return F.array_join(F.transform(signature, lambda e: F.lower(F.lpad(F.hex(e), 10, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of bins, among those that either text fills, in which both agree; 1 if neither fills any."""
    bins = F.size(F.array_distinct(F.transform(F.concat(a, b), lambda e: F.shiftright(e, 32))))
    return F.when(bins == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / bins)


def ranged(docs: DataFrame, order: str, tie: str) -> DataFrame:
    """docs with _range: numbers of ranges of (order, tie) of about equal rows, ascending.

    A value of `order` that holds more than a range's share is a range end and
    is cut by `tie`, a hash, into as many equal parts as it needs.
    """
    n = 2 * partitions(docs.sparkSession)
    total, cuts = docs.agg(F.count("*"), F.percentile_approx(order, [i / n for i in range(1, n)], F.lit(100 * n))).first()
    counts = docs.groupBy(order).agg(F.count("*").alias("c")).where(F.col("c") > max(1, total // n))
    hot = {r[0]: -(-r["c"] * n // total) for r in counts.collect()}  # fewer than n rows
    bounds = sorted({*(cuts or []), *hot})
    ends = F.array(*[F.lit(x).cast("long") for x in bounds]) if bounds else F.array().cast("array<bigint>")
    most = max(hot.values(), default=0) + 1
    below = F.size(F.filter(ends, lambda b: b < F.col(order)))
    if not hot:
        return docs.withColumn("_range", below)
    parts = F.try_element_at(F.create_map(*[F.lit(x) for o, k in hot.items() for x in (o, k)]), F.col(order))
    part = 1 + F.least(parts - 1, F.floor((F.col(tie) / F.lit(2.0**64) + 0.5) * parts))
    return docs.withColumn("_range", (below * most + F.coalesce(part, F.lit(0))).cast("int"))


def with_next(docs: DataFrame, carried: list[str], made: dict[str, Column] | None = None, order: str = "ord", tie: str = "th") -> DataFrame:
    """docs with the columns `made`, and next_<c> for each carried column: the next row's by (order, tie), the first's after the last.

    Rows are dealt into ranges; each range also gets the row that follows its
    last, so no window spans more than a range. Columns are made after the rows
    are dealt out, once for each row.
    """
    spark, own = docs.sparkSession, ranged(docs, order, tie)
    firsts = own.groupBy("_range").agg(F.min(F.struct(order, tie)).alias("f")).orderBy("_range").collect()  # some rows a range
    after = [(first["f"][0], first["f"][1], firsts[i - 1]["_range"]) for i, first in enumerate(firsts)]
    ghosts = F.broadcast(spark.createDataFrame(after, "_first long, _tie long, _to int"))  # some rows a range
    heads = docs.join(ghosts, (F.col(order) == F.col("_first")) & (F.col(tie) == F.col("_tie"))).withColumn("_range", F.col("_to")).withColumn("_ghost", F.lit(1)).drop("_first", "_tie", "_to")
    every = own.withColumn("_ghost", F.lit(0)).withColumns(made or {}).unionByName(heads.withColumns(made or {}))
    window = Window.partitionBy("_range").orderBy("_ghost", order, tie)
    led = every.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in carried])
    return led.where("_ghost = 0").drop("_range", "_ghost")


def compare_edits(docs: DataFrame, k: int = K, bins: int = BINS, least: int = LEAST) -> DataFrame:
    """Fingerprints of each row of docs(doc_id, text), of its edited text, and their likeness.

    The edited text has the text's last half replaced by as much of the next
    document's start. Documents follow each other by doc_id (null last), rows
    of one id, null or not, by their texts' hashes. A null text counts as empty;
    an empty table gives no rows; a text of any length is signed by one task;
    other columns are left out.
    """
    last = 2**63 - 1
    own = docs.select("doc_id", text_of().alias("text")).select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("ord"), F.xxhash64("text").alias("th"))
    signed = {"sig": signature(F.col("text"), k, bins, least)}
    half = F.floor(F.col("n_chars") / 2).cast("int")
    pairs = with_next(own, ["text", "sig"], signed).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = pairs.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("next_text").substr(F.lit(1), half)))
    both = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sig", "next_sig", signature(F.col("edited"), k, bins, least).alias("edited_sig"))
    return both.select("doc_id", "n_chars", "edited_sha256", shown(F.col("sig")).alias("fingerprint"), shown(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
