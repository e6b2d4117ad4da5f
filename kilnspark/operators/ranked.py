"""Running sums, maxima and last values within keys, made in two steps over ranges, so that a key that holds most rows is spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranged(df: DataFrame, order: Column) -> DataFrame:
    """df with _r: the number of the range of `order`, a number, that a row is in; ranges are about equal over the whole table."""
    n = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(order.cast("double"), [i / n for i in range(1, n)], F.lit(50 * n))).first()[0] or []
    bounds = F.array(*[F.lit(float(x)) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    return df.withColumn("_r", F.size(F.filter(bounds, lambda b: b < order.cast("double"))))


def _offsets(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of totals(keys, _r, ...) of its key and range; null keys are keys."""
    own = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_r").alias("_of"), *[c for c in totals.columns if c not in (*keys, "_r")])
    met = F.col("_r") == F.col("_of")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(own.hint("merge"), met).drop("_of", *[f"_k{i}" for i in range(len(keys))])


def running(own: DataFrame, keys: list[str], order: list[Column], inclusive: bool = False, **outs: tuple[str, Column]) -> DataFrame:
    """own, with _r of ranged(), and for each out=(kind, value) the value's sum, max or last one over the rows before, by order within keys.

    The first of order is what the ranges are of. Null values don't count; null
    if there are no others before. inclusive: over the rows up to the row.
    """
    own = own.withColumns({f"_v_{o}": value for o, (_, value) in outs.items()})
    at = F.struct(*order)

    def folded(kind: str, value: Column) -> Column:
        return {"sum": F.sum(value), "max": F.max(value), "last": F.max_by(value, F.when(value.isNotNull(), at))}[kind]

    def over(kind: str, value: Column, w) -> Column:
        return {"sum": F.sum(value), "max": F.max(value), "last": F.last(value, True)}[kind].over(w)

    def joined(kind: str, before: Column, inside: Column) -> Column:
        return {"sum": F.coalesce(before + inside, before, inside), "max": F.greatest(before, inside), "last": F.coalesce(inside, before)}[kind]

    totals = own.groupBy(*keys, "_r").agg(*[folded(kind, F.col(f"_v_{o}")).alias(f"_t_{o}") for o, (kind, _) in outs.items()])  # a row for each key and range
    ranges = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"_b_{o}": over(kind, F.col(f"_t_{o}"), ranges) for o, (kind, _) in outs.items()}).drop(*[f"_t_{o}" for o in outs])
    rows = Window.partitionBy(*keys, "_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inside = own.withColumns({f"_s_{o}": over(kind, F.col(f"_v_{o}"), rows) for o, (kind, _) in outs.items()})
    both = _offsets(inside, totals, keys).withColumns({o: joined(kind, F.col(f"_b_{o}"), F.col(f"_s_{o}")) for o, (kind, _) in outs.items()})
    return both.drop(*[f"_{x}_{o}" for o in outs for x in "bsv"])


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """df with out: the sum of value over the rows before, by order within keys; the first of order is a number."""
    return running(ranged(df, order[0]), keys, order, **{out: ("sum", value)}).withColumn(out, F.coalesce(out, F.lit(0))).drop("_r")


def running_last(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """df with out: the last value that isn't null up to the row, by order within keys; the first of order is a number."""
    return running(ranged(df, order[0]), keys, order, True, **{out: ("last", F.col(value))}).drop("_r")
