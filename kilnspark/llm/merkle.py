"""A Merkle manifest of a dataset by slot pivots.

Nodes are (tree, i, n, h): the i-th of n digests on one level of a tree. A
level's pivot spreads each parent's FANOUT children into as many columns by
conditional aggregates. The columns joined and hashed are the parent; joined
without the own slot they are a child's siblings. Trees of one source each
end in a subroot; the subroots are the leaves of one tree more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import discard, partitions, stored

FANOUT = 16
STEP, SLOTS = "struct<l: string, r: string>", [f"c{k}" for k in range(FANOUT)]


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df, written, with `out`: each row's number from 0 in the order, and `pid`, the range of the order it lies in.

    Equal rows are dealt by where they were read, so that they may span ranges.
    One count a range comes to the driver and goes out again.
    """
    spark = df.sparkSession
    salted = df.withColumn("_at", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(partitions(spark), *order, F.col("_at")).sortWithinPartitions(*order, "_at").drop("_at")
    held = stored(ranged.select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("_m")), "numbered")
    begin, total = [], 0
    for pid, n in sorted(tuple(r) for r in held.groupBy("pid").count().collect()):  # a row a range
        begin.append((pid, total))
        total += n
    starts = spark.createDataFrame(begin, "pid int, _b long")
    named = held.join(F.broadcast(starts), "pid").withColumn(out, F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_b")
    named.stored_at = held.stored_at
    return named


def pivot(nodes: DataFrame, *more: Column) -> DataFrame:
    """(tree, j, n, c0.., more): the children of each parent in columns."""
    slot = F.col("i") % FANOUT
    own = [F.max(F.when(slot == k, F.col("h"))).alias(f"c{k}") for k in range(FANOUT)]
    return nodes.groupBy("tree", F.floor(F.col("i") / FANOUT).alias("j")).agg(F.max("n").alias("n"), *own, *more)


def parents(groups: DataFrame) -> DataFrame:
    """The nodes one level up; a node alone on its level stays what it is."""
    return groups.select("tree", F.col("j").alias("i"), F.ceil(F.col("n") / FANOUT).alias("n"), F.when(F.col("n") > 1, F.sha2(F.concat_ws("", *SLOTS), 256)).otherwise(F.col("c0")).alias("h"))


def _siblings(slot: int) -> Column:
    """What stands left and right of a slot, as a path of one step; none on a level of one node."""
    left, right = (F.concat_ws("", *[F.col(f"c{k}") for k in span]) for span in (range(slot), range(slot + 1, FANOUT)))
    return F.when(F.col("n") > 1, F.array(F.struct(left.alias("l"), right.alias("r")))).otherwise(F.array().cast(f"array<{STEP}>"))


def _above(groups: DataFrame, paths: DataFrame) -> DataFrame:
    """groups with what paths(tree, i, path, subroot) has of their parents."""
    return groups.join(paths.withColumnsRenamed({"i": "j"}).hint("merge"), ["tree", "j"])


def _spread(groups: DataFrame) -> DataFrame:
    """(tree, i, path, subroot) of the children of groups that know their own path."""
    children = [F.struct(F.lit(k).alias("slot"), F.col(f"c{k}").alias("h"), _siblings(k).alias("own")) for k in range(FANOUT)]
    each = groups.select("tree", "j", "path", "subroot", F.explode(F.array(*children)).alias("c")).where("c.h is not null")
    return each.select("tree", (F.col("j") * FANOUT + F.col("c.slot")).alias("i"), F.concat("c.own", "path").alias("path"), "subroot")


def climb(nodes: DataFrame, *more: Column) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of all levels, written, leaves first (`more` with these alone), and the nodes left, one a tree."""
    levels = [stored(pivot(nodes, *more), "pivot")]
    while True:
        top = parents(levels[-1])
        if (top.agg(F.max("n")).first()[0] or 1) == 1:
            return levels, top
        levels.append(stored(pivot(top), "pivot"))


def manifest(docs: DataFrame, fields: list[str], changed: dict[str, Column] | None = None, where: Column | None = None, source: str = "source", order: str = "doc_id") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of docs.

    A leaf is the digest of `fields`. `changed` says what tampering makes of
    some of them in the rows `where` it happens; folded_root is recomputed from
    the leaf so changed and the original siblings. Within a source leaves
    ascend by `order`, null first, then by the leaf, so rows that share an id
    have a place and equal rows take neighbouring ones. A null source is one of
    its own, before all others and apart from the empty one. Columns with other
    names are left out; an empty table gives no rows. Texts are read once and
    don't move; a source of any size is spread over ranges.
    """
    changed = changed or {}
    leaf, other = digest(*[field(F.col(f"`{c}`")) for c in fields]), digest(*[field(changed.get(c, F.col(f"`{c}`"))) for c in fields])
    leaves = stored(docs.select(F.col(order).cast("long").alias("id"), F.col(source).alias("src"), leaf.alias("h"), F.when(F.lit(False) if where is None else where, other).alias("other")), "leaves")
    ranked = numbered(leaves, [F.col("src"), F.col("id"), F.col("h")], "at")
    spans = stored(ranked.groupBy("pid", "src").agg(F.min("at").alias("begin"), F.count("*").alias("n")), "spans")  # a row a range and source
    trees = numbered(spans.groupBy("src").agg(F.min("begin").alias("begin"), F.sum("n").alias("n")), [F.col("src")], "tree")
    named = spans.select(F.col("pid").alias("p"), F.col("src").alias("s")).join(trees.hint("merge"), F.col("s").eqNullSafe(F.col("src"))).drop("src", "pid")
    placed = ranked.join(named.hint("merge"), (F.col("pid") == F.col("p")) & F.col("src").eqNullSafe(F.col("s"))).withColumn("i", F.col("at") - F.col("begin"))
    levels, subroots = climb(placed, F.collect_list(F.struct((F.col("i") % FANOUT).alias("slot"), "id", "other")).alias("children"))  # FANOUT at most
    tops = stored(subroots.select("tree", F.col("h").alias("subroot")), "subroots")
    above, last = climb(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(tops.count()).alias("n"), F.col("subroot").alias("h")))
    root = (last.first() or {"h": None})["h"]
    paths = last.select("tree", "i", F.array().cast(f"array<{STEP}>").alias("path"), F.lit(None).cast("string").alias("subroot"))
    for groups in reversed(above):
        paths = _spread(_above(groups, paths))
    paths = tops.join(paths.select(F.col("i").alias("tree"), "path").hint("merge"), "tree").select("tree", F.lit(0).cast("long").alias("i"), "path", "subroot")
    for groups in reversed(levels[1:]):
        paths = _spread(_above(groups, paths))
    paths = stored(paths, "paths")
    discard(leaves, ranked, spans, trees, tops, *above, *levels[1:])
    each = _above(levels[0], paths).select("n", *SLOTS, "path", "subroot", F.explode("children").alias("c"))
    at = (F.col("c.slot") + 1).cast("int")
    whole = each.select("c.*", "subroot", F.element_at(F.array(*SLOTS), at).alias("leaf"), F.concat(F.element_at(F.array(*[_siblings(k) for k in range(FANOUT)]), at), "path").alias("path"))
    folded = F.aggregate("path", F.coalesce("other", "leaf"), lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), ""), 256)
    out = whole.select(F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(upper: int = 8) -> str:
    """DuckDB SQL for manifest() of the registered query: trees of up to FANOUT ** upper leaves, each level unrolled."""
    ctes = [_SQL_LEAVES]
    siblings = "coalesce(string_agg(h, '' ORDER BY i) OVER (PARTITION BY tree, i // {f} ORDER BY i ROWS BETWEEN {span}), '')"
    before, after = "UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"

    def tree(name: str, first: str) -> None:
        ctes.append(f"{name}_0 AS ({first})")
        for k in range(upper):
            sides = ", ".join(f"{siblings.format(f=FANOUT, span=span)} AS {side}".replace(" ORDER BY i) OVER", ") OVER") for span, side in ((before, "l"), (after, "r")))
            ctes.append(f"{name}_side_{k} AS (SELECT tree, i, n, {sides} FROM {name}_{k})")
            ctes.append(f"{name}_{k + 1} AS (SELECT tree, i // {FANOUT} AS i, (max(n) + {FANOUT - 1}) // {FANOUT} AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {name}_{k} GROUP BY tree, i // {FANOUT})")

    tree("leaf", "SELECT tree, i, n, leaf AS h FROM placed")
    tree("top", f"SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, h FROM leaf_{upper}")
    steps, joins, folded = [], [], "p.other"
    for name, place in (("leaf", "p.i"), ("top", "p.tree")):
        for k in range(upper):
            side = f"{name}_{k}s"
            joins.append(f"JOIN {name}_side_{k} {side} ON {side}.i = {place} // {FANOUT**k} AND {side}.tree = {'p.tree' if name == 'leaf' else 0}")
            steps.append(f"{side}.l || {side}.r")
            now = f"f{len(steps)}"
            ctes.append(f"{now} AS (SELECT p.* EXCLUDE (fold, proof), CASE WHEN {side}.n = 1 THEN p.fold ELSE sha256({side}.l || p.fold || {side}.r) END AS fold, p.proof || {side}.l || {side}.r AS proof FROM {'start' if len(steps) == 1 else f'f{len(steps) - 1}'} p {joins[-1]})")
    ctes.insert(1, "start AS (SELECT *, other AS fold, '' AS proof FROM placed)")
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(p.proof) AS proof_sha256, p.fold AS folded_root, p.fold = r.h AS verified "
        f"FROM f{len(steps)} p JOIN leaf_{upper} s ON s.tree = p.tree CROSS JOIN top_{upper} r"
    )


_FIELD = "coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: "
    "list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::bigint)"
)
_LOWERED = "CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
_LEAF = " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars"))
_SQL_LEAVES = (
    f"leaves AS (SELECT doc_id, source, sha256({_LEAF} || {_FIELD.format(c='text')}) AS leaf, sha256({_LEAF} || {_FIELD.format(c='t')}) AS other FROM (SELECT *, {_LOWERED.format(crc=_CRC)} AS t FROM documents)), "
    "placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves)"
)
