"""Top-k, caps, interleaving, dominance and keep-first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.operators.quantiles import running_max
from rillspark.session import written


def top_of_each(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; Spark limits each task's groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def interleaved(df: DataFrame, source: str, order: list[Column], rounds: int) -> DataFrame:
    """The first of every source, then the second of every source, and so on."""
    return top_of_each(df, [source], order, rounds).orderBy("rank", source)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_of_each(df, keys, order, 1).drop("rank")


def skyline(df: DataFrame, low: str, high: str) -> DataFrame:
    """Rows that no other row beats with a smaller ``low`` and a larger ``high`` (one strictly).

    Rows are reduced to the best ``high`` of each ``low``; the running maximum of those, over
    ranges of ``low`` (bounds on the driver, 63 at most) first and inside a range then, decides.  No pair of rows is compared.
    """
    best = df.groupBy(F.col(low).alias("__low")).agg(F.max(high).alias("__high"))
    front = running_max(best, "__low", "__high", inclusive=False).where(F.coalesce(F.col("top") < F.col("__high"), F.lit(True)))
    return df.join(front.select("__low", "__high"), (F.col(low) == F.col("__low")) & (F.col(high) == F.col("__high")), "left_semi")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with numbers from 1 in a total order.

    Rows are dealt out in ranges of the order and written; each range numbers its own rows and starts where the
    counts of the ranges before it end, so no task sees more than its range.
    """
    ranges = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = sorted((r["__range"], r["count"]) for r in ranges.groupBy("__range").count().collect())  # one row a range
    starts, total = {}, 0
    for k, n in counts:
        starts[k], total = total, total + n
    before = F.lit(0).cast("long")
    if starts:
        before = F.element_at(F.create_map(*(F.lit(x) for k, n in starts.items() for x in (k, n))), F.col("__range")).cast("long")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn(name, before + own).drop("__range")
