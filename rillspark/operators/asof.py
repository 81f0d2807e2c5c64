"""As-of joins: for each left row the last right row of its key that is not later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_ts: str, right_ts: str, value: str, cell_days: int = 7) -> DataFrame:
    """The rows of ``left`` with ``value`` of the last right row at or before them; of equal times the largest.

    Both sides are dealt by key and a cell of ``cell_days`` days, so that a hot key is split by
    time and no window holds a whole key.  What a cell takes over from the cells before it is
    found on one row for each key and cell.
    """
    cell = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / cell_days)
    names = left.columns
    one = right.where(F.col(right_ts).isNotNull()).groupBy(F.col(right_key).alias("__k"), F.col(right_ts).alias("__t")).agg(F.max(value).alias("__v")).withColumn("__c", cell("__t"))
    ours = left.select(F.struct(*names).alias("__row"), F.col(left_key).alias("__k"), F.col(left_ts).alias("__t"), cell(left_ts).alias("__c"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__side"))
    both = ours.unionByName(one.withColumn("__side", F.lit(0)), allowMissingColumns=True)

    # one row for each key and cell that either side has, with the last value of earlier cells
    cells = both.groupBy("__k", "__c").agg(F.max(F.when(F.col("__side") == 0, F.struct("__t", "__v"))).alias("__last"))
    before = Window.partitionBy("__k").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(F.col("__k").alias("__of_k"), F.col("__c").alias("__of_c"), F.last("__last", True).over(before)["__v"].alias("__old"))

    inside = Window.partitionBy("__k", "__c").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__side") == 0, F.struct("__v")), True).over(inside)
    found = both.withColumn("__new", last).where("__side = 1").join(carried, F.col("__k").eqNullSafe(F.col("__of_k")) & F.col("__c").eqNullSafe(F.col("__of_c")), "left")
    known = F.col("__k").isNotNull() & F.col("__t").isNotNull()
    return found.select("__row.*", F.when(known, F.when(F.col("__new").isNotNull(), F.col("__new.__v")).otherwise(F.col("__old"))).alias(value))
