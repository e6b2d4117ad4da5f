"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised on their own; a pair of centroids is
a cell. A query visits cells by the sum of its two halves' distances to their
centroids, with a heap, until the cells seen hold `share` of all distinct
vectors. The cells of neighbouring first centroids are a group, cut into bounded
blocks of vectors; a task ranks a block's vectors, those of visited cells, for a block of
queries by exact distance, and each query's best of all blocks are its result. Equal vectors count as one in the index, with the
smallest of their ids that any result can need.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnspark.llm.common import stored

#: Centroids of a half; groups of cells; rows that the quantisers are fitted on at most; vectors and queries of a block.
CENTROIDS, GROUPS, SAMPLE, VECTORS, QUERIES = 256, 64, 20_000, 2048, 4096
#: Least share of the distinct vectors that a query's cells hold together.
SHARE = 0.35


def kmeans(rows: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    points = np.unique(rows, axis=0)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        n = np.bincount(near, minlength=len(centres))
        for d in range(points.shape[1]):
            total = np.bincount(near, points[:, d], minlength=len(centres))
            centres[n > 0, d] = total[n > 0] / n[n > 0]
    return centres


def squares(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squares(rows, centres).argmin(1)


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, want: int) -> list[int]:
    """Cells i * len(second) + j by ascending first[i] + second[j], until they hold `want`."""
    a, b = first.argsort(kind="stable"), second.argsort(kind="stable")
    one, two, held_in = first[a].tolist(), second[b].tolist(), counts.reshape(len(a), len(b))[a][:, b].tolist()
    width, out, held = len(b), [], 0
    heap, pop, push = [(one[0] + two[0], 0)], heapq.heappop, heapq.heappush
    while heap and held < want:
        _, at = pop(heap)
        i, j = divmod(at, width)
        if n := held_in[i][j]:
            out.append(int(a[i]) * width + int(b[j]))
            held += n
        if j + 1 < width:
            push(heap, (one[i] + two[j + 1], at + 1))
        if j == 0 and i + 1 < len(one):  # a row begins once the one above it has: each pair is pushed once
            push(heap, (one[i + 1] + two[0], at + width))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec array<double>) of rows that take part: finite, not all zero, of the usual size, each pair once."""
    vec = F.col("embedding").cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    usual = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.where(F.size("vec") == (usual["n"] if usual else 0)).withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64("vec", F.lit(1)))


def search(vectors: DataFrame, every: int = 100, top: int = 10, share: float = SHARE, centroids: int = CENTROIDS) -> DataFrame:
    """(query_id, rank, vec_id, score): the top nearest found for each vec_id divisible by `every`.

    A query's own id is no candidate; ties go to the smaller vec_id. Null
    vectors, zero vectors, those with null or non-finite components and those
    of another length than most take no part; repeated rows count once; of
    several vectors of a queried id the one that hashes lowest is asked; an
    empty table gives no rows; other columns are left out.
    """
    spark = vectors.sparkSession
    own = usable(vectors)
    shape = own.select("vec").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    half = max(1, len(shape["vec"]) // 2)
    few = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)  # SAMPLE rows
    sample = np.array([r["vec"] for r in few.select("vec").collect()])
    left, right = kmeans(sample[:, :half], centroids, 1), kmeans(sample[:, half:] if sample.shape[1] > 1 else sample, centroids, 2)
    books = spark.sparkContext.broadcast((left, right))  # two tables of `centroids` rows
    rest = half if sample.shape[1] > 1 else 0

    salted = Window.partitionBy("h1", "h2", F.pmod("vec_id", F.lit(97))).orderBy("vec_id")
    ids = own.select("h1", "h2", "vec_id").distinct().withColumn("r", F.row_number().over(salted)).where(F.col("r") <= top + 1)
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("r") <= top + 1)
    distinct = ids.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # top + 1 ids at most
    heads = distinct.withColumn("vec_id", F.get("ids", F.lit(0)))
    reps = heads.join(own.dropDuplicates(["vec_id", "h1", "h2"]).hint("merge"), ["vec_id", "h1", "h2"]).select("h1", "ids", "vec")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = books.value
        for batch in batches:
            rows = _matrix(batch.column(2))
            cells = nearest(rows[:, :half], a) * len(b) + nearest(rows[:, rest:], b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32))], ["h1", "ids", "vec", "cell"])

    index = stored(reps.mapInArrow(place, "h1 long, ids array<long>, vec array<double>, cell int"), "index")
    sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # centroids ** 2 rows at most
    counts = np.zeros(len(left) * len(right), np.int64)
    for cell, n in sizes.items():
        counts[cell] = n
    want = max(2 * top, int(np.ceil(share * counts.sum())))
    span = len(right) * -(-len(left) // GROUPS)  # cells of a group
    blocks = np.maximum(1, -(-np.bincount(np.arange(len(counts)) // span, counts).astype(np.int64) // VECTORS))
    plan = spark.sparkContext.broadcast((counts, blocks))

    asked = own.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by("vec", F.struct("h1", "h2")).alias("vec"))
    n_turns = max(1, -(-asked.count() // QUERIES))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b), (held, cut) = books.value, plan.value
        for batch in batches:
            rows = _matrix(batch.column(1))
            d1, d2 = squares(rows[:, :half], a), squares(rows[:, rest:], b)
            at, groups, cells, parts = [], [], [], []
            for q in range(len(rows)):
                seen: dict[int, list[int]] = {}
                for cell in visit(d1[q], d2[q], held, want):
                    seen.setdefault(cell // span, []).append(cell)
                for group, own in seen.items():
                    n = int(cut[group])
                    at += [q] * n
                    groups += [group] * n
                    cells += [own] * n
                    parts += range(n)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(groups, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(parts, pa.int32())], ["vec_id", "vec", "group", "cells", "part"])

    turn = F.pmod(F.xxhash64("vec_id"), F.lit(n_turns)).cast("int").alias("turn")
    probes = asked.mapInArrow(probe, "vec_id long, vec array<double>, group int, cells array<int>, part int").select("*", turn)
    number = F.get(F.array(*[F.lit(int(x)) for x in blocks]), F.col("group"))
    grouped = index.withColumn("group", F.floor(F.col("cell") / span).cast("int"))
    dealt = grouped.select("ids", "vec", "cell", "group", F.pmod("h1", number).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(n_turns - 1))).alias("turn"))

    def rank(queries: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if queries.num_rows and block.num_rows:
            every_row, every_id = _matrix(block.column("vec").combine_chunks()), block.column("ids").to_pylist()
            own_cell, asked_rows = block.column("cell").to_numpy(), _matrix(queries.column("vec").combine_chunks())
            for q, own_id, cells in zip(asked_rows, queries.column("vec_id").to_pylist(), queries.column("cells").to_pylist()):
                at = np.flatnonzero(np.isin(own_cell, cells))
                far = np.sqrt(((every_row[at] - q) ** 2).sum(1))
                edge = np.partition(far, top)[top] if len(far) > top + 1 else np.inf
                best = sorted((float(far[i]), v) for i in np.flatnonzero(far <= edge) for v in every_id[at[i]] if v != own_id)[:top]
                out += [(own_id, v, d) for d, v in best]
        cols = list(zip(*out)) or [[]] * 3
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.float64()])], ["query_id", "vec_id", "score"])

    keys = ["group", "part", "turn"]
    found = probes.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
