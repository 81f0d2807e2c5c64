"""Exact linearly interpolated quantiles without a buffer of all values.

Equal values are counted first.  Their running counts are made inside ranges of the value, and
the totals of ranges, a row for each, give every range its start.  So no task holds more than
one range of distinct values, and only those at a quantile's two ranks come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values; their bounds come from approximate quantiles and change no result.
RANGES = 64


def ranged(counts: DataFrame, value: str, ranges: int = RANGES) -> Column:
    """The number of the range that a value is in."""
    bounds = sorted(set(counts.approxQuantile(value, [i / ranges for i in range(1, ranges)], 0.01)))
    return F.lit(0) + sum((F.col(value) > b).cast("int") for b in bounds) if bounds else F.lit(0)


def running(counts: DataFrame, value: str, amounts: list[str], *keys: str) -> DataFrame:
    """``counts`` with ``before_<amount>``: the sum of each amount over smaller values of the same keys.

    Values are distinct per key.
    """
    parts = counts.withColumn("__range", ranged(counts, value))
    totals = parts.groupBy(*keys, "__range").agg(*(F.sum(a).alias(f"__{a}") for a in amounts))
    # a row for each key and range
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__range", *(F.coalesce(F.sum(f"__{a}").over(earlier), F.lit(0)).alias(f"__{a}") for a in amounts))
    inside = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    same = F.lit(True)
    for k in ("__range", *keys):
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}"))
    both = parts.withColumns({f"before_{a}": F.coalesce(F.sum(a).over(inside), F.lit(0)) for a in amounts}).alias("p").join(starts.alias("s"), same)
    return both.select(*(F.col(f"p.`{c}`") for c in counts.columns), *((F.col(f"before_{a}") + F.col(f"__{a}")).alias(f"before_{a}") for a in amounts))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """A row for each key with a column for each share: its quantile of ``value`` (nulls left out)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("n"))
    placed = running(counts, "__v", ["n"], *keys)
    n = counts.groupBy(*keys).agg(F.sum("n").alias("__n"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = placed.alias("a").join(n.alias("b"), same) if keys else placed.alias("a").crossJoin(F.broadcast(n).alias("b"))  # one row
    rank = lambda q: F.lit(q) * (F.col("__n") - 1)
    holds = lambda i: (F.col("before_n") <= i) & (i < F.col("before_n") + F.col("n"))
    rows = both.select(*(F.col(f"a.{k}") for k in keys), "__v", "__n", "before_n", "n")
    out = rows.groupBy(*keys).agg(
        F.max("__n").alias("__n"),
        *(F.max(F.when(holds(F.floor(rank(q))), F.col("__v"))).alias(f"__low{i}") for i, q in enumerate(shares.values())),
        *(F.max(F.when(holds(F.ceil(rank(q))), F.col("__v"))).alias(f"__high{i}") for i, q in enumerate(shares.values())),
    )
    between = lambda i, q: F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * (rank(q) - F.floor(rank(q)))
    return out.select(*keys, *(between(i, q).alias(name) for i, (name, q) in enumerate(shares.items())))


def lower_tail_mean(df: DataFrame, value: str, share: float, *keys: str) -> DataFrame:
    """keys and ``tail``: the mean of the lowest ``max(1, floor(share * n))`` values of each key.

    From counts of equal values and their running sums: no row is numbered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("n"))
    placed = running(counts, "__v", ["n"], *keys)
    sizes = counts.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.sum("n") * share)).alias("__k"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = placed.alias("a").join(sizes.alias("b"), same).drop(*(F.col(f"b.{k}") for k in keys))
    taken = F.least(F.col("n"), F.col("__k") - F.col("before_n"))
    return both.where("before_n < __k").groupBy(*keys).agg((F.sum(F.col("__v") * taken) / F.max("__k")).alias("tail"))


def running_max(df: DataFrame, order: str, value: str, inclusive: bool = True) -> DataFrame:
    """``df`` (distinct ``order``) with ``top``: the highest ``value`` up to each row, over ranges first and inside them then."""
    parts = df.withColumn("__range", ranged(df, order))
    tops = parts.groupBy("__range").agg(F.max(value).alias("__top"))
    # a row for each range
    before = tops.select("__range", F.max("__top").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = F.max(value).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return parts.withColumn("__inside", inside).join(F.broadcast(before), "__range").withColumn("top", F.greatest("__inside", "__before")).drop("__range", "__inside", "__before")
