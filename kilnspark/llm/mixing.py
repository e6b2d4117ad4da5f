"""Mixing sources to target weights by a low-discrepancy slot schedule.

Built-in functions only. Sources are shuffled and cut into equal-token blocks;
slot i of the schedule lies at the golden-ratio point frac(i * phi), which the
cumulative weights map to a source; the k-th slot of a source takes its k-th
block, beginning again after its last. All ranks and running sums are made in
two steps, over small ranges and over the ranges' totals, so that a source
that holds most rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.llm.common import WORD, discard, stored

#: 2^31 and the odd integer next to 2^31 / golden ratio: the schedule's points are multiples modulo 2^31.
UNITS, GOLDEN = 2**31, 1_327_217_885
#: A prime and a multiplier below it that shuffle doc_id.
PRIME, STEP = 2_147_483_647, 1_588_635_695
#: Tokens of a block, ranges of shuffled documents, slots of a range, bins of the weights' line.
BLOCK, RANGES, SLOTS, BINS = 16, 4096, 16_384, 1024
#: Sources up to which their bins are broadcast; beyond, the join shuffles.
FEW_SOURCES = 50_000


def shuffled(doc_id: Column) -> Column:
    """A place in [0, PRIME) that scatters ids; a null id counts as 0."""
    return F.pmod(F.pmod(F.coalesce(doc_id, F.lit(0)).cast("long"), F.lit(PRIME)) * STEP + 12_345, F.lit(PRIME))


def targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """(source, source_size, s, target) from rows (source, size).

    Weights repeat over the sources by code point, null last. The target total
    is share times all sizes; a target stops at most times its source's size
    and the rest is shared again by weight: a source is capped if its cap, per
    weight, is within what is left per weight after the smaller caps.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))  # a row for each source from here on
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    own = totals.withColumn("s", (F.row_number().over(order) - 1).cast("int")).withColumn("w", F.element_at(cycle, (F.col("s") % len(weights) + 1).cast("int")).cast("long"))
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), "s").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    cap = F.col("source_size") * most
    rest = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(by_cap), F.lit(0))
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_cap), F.lit(0))
    met = own.withColumn("rest", rest).withColumn("left", left).withColumn("capped", cap * F.col("left") <= F.col("rest") * F.col("w"))
    free = met.withColumn("rest0", F.max(F.when(~F.col("capped"), F.struct("left", "rest"))).over(every))
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("rest0.rest") * F.col("w") / F.col("rest0.left"))
    return free.select("source", "source_size", "s", target.alias("target"))


def schedule(goals: DataFrame, block: int = BLOCK, most: int = 2) -> DataFrame:
    """(s, block, times): how often the slots take each block, from rows of targets()."""
    spark = goals.sparkSession
    total, n_sources = goals.agg(F.sum("target"), F.count("*")).first()
    n_slots = -int(-(total or 0.0) // block)
    every, order = Window.partitionBy(F.lit(0)), Window.orderBy("s")
    width = F.floor(F.col("target") * UNITS / F.sum("target").over(every)).cast("long")
    lines = goals.where("target > 0").withColumn("width", width).withColumn("hi", F.sum("width").over(order)).withColumn("lo", F.col("hi") - F.col("width"))
    bins = lines.where("width > 0").select("s", "lo", "hi", F.expr(f"ceil(source_size / {block})").cast("long").alias("n_blocks"), F.explode(F.expr(f"sequence(lo div {UNITS // BINS}, (hi - 1) div {UNITS // BINS})")).alias("bin"))
    bins = bins.hint("broadcast" if n_sources <= FEW_SOURCES else "merge")  # BINS rows and one for each source at most
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.expr(f"(id % {UNITS}) * {GOLDEN} % {UNITS}").alias("u"))
    dealt = slots.withColumn("bin", F.expr(f"u div {UNITS // BINS}")).join(bins, "bin").where("u >= lo and u < hi").select("slot", F.expr(f"slot div {SLOTS}").alias("range"), "s", "n_blocks")
    counts = dealt.groupBy("s", "range").agg(F.count("*").alias("n"))
    before = counts.select("s", "range", (F.sum("n").over(Window.partitionBy("s").orderBy("range")) - F.col("n")).alias("before"))
    inside = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("s", "range").orderBy("slot")))
    ranked = inside.join(before.hint("merge"), ["s", "range"]).withColumn("k", F.col("before") + F.col("rank") - 1)
    return ranked.where(F.col("k") < F.col("n_blocks") * most).groupBy("s", (F.col("k") % F.col("n_blocks")).alias("block")).agg(F.count("*").alias("times"))


def mix(docs: DataFrame, weights: list[int] | None = None, share: float = 1.5, most: int = 2, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for each row of docs(doc_id, text, source).

    size counts words (0 for a null text); taken is the words the schedule
    takes from the document, repeats counted, at most `most` times its size. A
    null source is a source, last in order; a null doc_id is shuffled as 0;
    rows of equal id, source and size are interchangeable. Other columns are
    left out; an empty table gives no rows.
    """
    sized = stored(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    goals = stored(targets(sized, weights or [3, 1, 2], share, most), "targets")
    key = sized.join(goals.select(F.col("source").alias("of"), "source_size", "s", "target").hint("broadcast" if goals.count() <= FEW_SOURCES else "merge"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    key = key.withColumn("place", shuffled(F.col("doc_id"))).withColumn("range", F.expr(f"place * {RANGES} div {PRIME}"))
    sums = key.groupBy("s", "range").agg(F.sum("size").alias("n"))
    before = sums.select("s", "range", (F.sum("n").over(Window.partitionBy("s").orderBy("range")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("s", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = stored(key.withColumn("run", F.sum("size").over(inside)).join(before.hint("merge"), ["s", "range"]).withColumn("first", F.col("before") + F.col("run") - F.col("size")), "placed")
    parts = placed.where("size > 0").select("s", "first", "size", F.explode(F.expr(f"sequence(first div {block}, (first + size - 1) div {block})")).alias("block"))
    words = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("first", F.col("block") * block)
    turns = stored(schedule(goals, block, most), "schedule")  # a plan of its own: the driver plans the rest again after each of its stages
    taken = parts.join(turns.hint("merge"), ["s", "block"]).groupBy("s", "first").agg(F.sum(words * F.col("times")).alias("words"))
    some = placed.where("size > 0").join(taken.hint("merge"), ["s", "first"], "left")
    columns = ["doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "source"]
    out = some.select(*columns).unionByName(placed.where("size = 0").withColumn("words", F.lit(0)).select(*columns))
    out.reads = [sized, goals, placed, turns]
    return out


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, whole, as many times as the mix takes their words (rounded half up).

    Every copy keeps the columns of docs, whatever their names; documents of
    which the mix takes less than half and documents without words do not
    appear. Rows of equal id, source and size share what is taken of them.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    dealt = mix(docs, **how)
    key = stored(dealt.where("taken > 0").groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("n_rows")), "takings")
    discard(*dealt.reads)
    whole = docs.select(F.col("doc_id").alias("own"), F.col("source").alias("from"), size.alias("words"), F.struct("*").alias("row"))
    both = whole.join(key.hint("merge"), F.col("own").eqNullSafe(F.col("doc_id")) & F.col("from").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size")))
    copies = F.floor(F.col("taken") / (F.col("size") * F.col("n_rows")) + 0.5).cast("int")
    return both.select(F.explode(F.array_repeat("row", copies)).alias("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def oracle(weights: list[int], share: float, most: int, block: int = BLOCK) -> str:
    """DuckDB SQL for mix() over documents."""
    cycle = ", ".join(map(str, weights))
    return rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
own AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS s FROM totals),
weighed AS (SELECT *, [{cycle}][(s % {len(weights)} + 1)::INT]::BIGINT AS w FROM own),
met AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * {float(share)} - coalesce(sum(source_size * {most}) OVER c, 0)::DOUBLE AS rest,
  (sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER c, 0)::BIGINT AS left_w FROM weighed
  WINDOW c AS (ORDER BY source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, (source_size * {most} * left_w)::DOUBLE <= rest * w AS capped FROM met),
best AS (SELECT max(left_w) AS l FROM judged WHERE NOT capped),
free AS (SELECT rest AS r, left_w AS l FROM judged WHERE NOT capped AND left_w = (SELECT l FROM best) LIMIT 1),
goals AS (SELECT source, source_size, s, CASE WHEN capped THEN (source_size * {most})::DOUBLE ELSE (SELECT r FROM free) * w / (SELECT l FROM free) END AS target FROM judged),
total AS (SELECT sum(target) AS t FROM goals),
wide AS (SELECT *, floor(target * {UNITS} / (SELECT t FROM total))::BIGINT AS width FROM goals),
lines AS (SELECT *, (sum(width) OVER (ORDER BY s))::BIGINT AS hi, ceil(source_size / {block})::BIGINT AS n_blocks FROM wide),
slots AS (SELECT i AS slot, (i % {UNITS}) * {GOLDEN} % {UNITS} AS u FROM range((SELECT ceil(t / {block})::BIGINT FROM total)) r(i)),
dealt AS (SELECT s, n_blocks, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS k FROM slots JOIN lines ON u >= hi - width AND u < hi),
counts AS (SELECT s, count(*) AS n FROM dealt WHERE k < n_blocks * {most} GROUP BY s),
placed AS (SELECT z.doc_id, z.size, z.source, g.source_size, g.target, g.s, coalesce((sum(z.size) OVER (PARTITION BY g.s ORDER BY ((coalesce(z.doc_id, 0) % {PRIME} + {PRIME}) % {PRIME} * {STEP} + 12345) % {PRIME}, z.doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0)::BIGINT AS a
  FROM sized z JOIN goals g ON z.source IS NOT DISTINCT FROM g.source),
most AS (SELECT p.*, l.n_blocks, coalesce(c.n, 0) AS n FROM placed p JOIN lines l USING (s) LEFT JOIN counts c USING (s))
SELECT doc_id, size, source_size, target, source,
 (greatest(0, least(size, CASE WHEN n >= n_blocks THEN source_size ELSE n * {block} END - a))
  + greatest(0, least(size, CASE WHEN n >= 2 * n_blocks THEN source_size ELSE (n - n_blocks) * {block} END - a)))::BIGINT AS taken
FROM most"""
