"""Operators over time series: everything works per key, and no window spans all rows.

Series are daily after aggregation, so a key's window holds days, not raw readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The place of a row in the files of its table.
PLACE = ("__file", "__row")


def placed(df: DataFrame) -> DataFrame:
    """``df``, a table read from Parquet files, with the place of each row."""
    return df.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


def in_file_order(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of :func:`placed` dealt by ``keys``, those of a key in the order of the files.

    Sums of doubles depend on their order in the last bits, and so do counts of distinct means and signs of differences.
    Aggregated by these keys, a key's rows are added up one after the other, however the files are split.
    """
    return df.repartition(*keys).sortWithinPartitions(*keys, *PLACE)


def daily(df: DataFrame, ts: str, value: str, *keys: str, how=F.avg) -> DataFrame:
    """One row a key and day, of a table of files; rows are added up in their order."""
    days = placed(df.where(F.col(value).isNotNull())).withColumn("day", F.to_date(ts))
    return in_file_order(days, *keys, "day").groupBy(*keys, "day").agg(how(value).alias("value"))


def by_day(*keys: str):
    return Window.partitionBy(*(keys or (F.lit(0),))).orderBy("day")


def rolling(c: str, rows: int, how, *keys: str) -> Column:
    """Over the last ``rows`` rows with at least one value; null only if all are."""
    return how(c).over(by_day(*keys).rowsBetween(-(rows - 1), 0))


def difference(c: str, *keys: str) -> Column:
    """Change from the row before; 0 where there is none."""
    return F.coalesce(F.col(c) - F.lag(c).over(by_day(*keys)), F.lit(0.0))


def interpolated(df: DataFrame, c: str, *keys: str) -> DataFrame:
    """``c`` filled linearly by row position; ends take the nearest value."""
    w = by_day(*keys)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    pos = df.withColumn("__i", F.row_number().over(w)).withColumn("__at", F.when(F.col(c).isNotNull(), F.struct("__i", F.col(c).alias("v"))))
    near = pos.withColumns({"__a": F.last("__at", True).over(back), "__b": F.first("__at", True).over(ahead)})
    a, b = F.col("__a"), F.col("__b")
    between = a["v"] + (b["v"] - a["v"]) * F.try_divide(F.col("__i") - a["__i"], b["__i"] - a["__i"])
    return near.withColumn(f"{c}_filled", F.coalesce(F.col(c), between, a["v"], b["v"])).drop("__i", "__at", "__a", "__b")


def contiguous_windows(df: DataFrame, c: str, history: int, horizon: int, *keys: str) -> DataFrame:
    """Samples of ``history`` days and the value ``horizon`` days later, without a gap between."""
    w = by_day(*keys)
    out = df.withColumns(
        {
            "start_day": F.lag("day", history - 1).over(w),
            "target_day": F.lead("day", horizon).over(w),
            "target": F.lead(c, horizon).over(w),
            "window": F.collect_list(c).over(w.rowsBetween(-(history - 1), 0)),
        }
    )
    return out.where(F.datediff("target_day", "start_day") == history + horizon - 1)


def chronological_split(df: DataFrame, train: float, valid: float, *keys: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy(*(keys or (F.lit(0),))))
    i = F.row_number().over(by_day(*keys))
    first, second = F.floor(n * train), F.floor(n * train) + F.floor(n * valid)
    return df.withColumn("split", F.when(i <= first, "train").when(i <= second, "valid").otherwise("test"))


def standardized(df: DataFrame, c: str, fit_on: Column, *keys: str) -> DataFrame:
    """Scaled by mean and population deviation of the rows where ``fit_on`` holds."""
    fit = df.where(fit_on).groupBy(*keys).agg(F.avg(c).alias("__m"), F.stddev_pop(c).alias("__s"))
    joined = df.join(fit, list(keys), "left") if keys else df.crossJoin(F.broadcast(fit))  # one row
    return joined.withColumn("scaled", (F.col(c) - F.col("__m")) / F.greatest(F.col("__s"), F.lit(1e-6))).drop("__m", "__s")


def strided_with_tail(df: DataFrame, stride: int, tail: int, *keys: str) -> DataFrame:
    """Every ``stride``-th day, the last one and the last ``tail`` days."""
    w = Window.partitionBy(*(keys or (F.lit(0),)))
    i, n = F.row_number().over(by_day(*keys)), F.count("*").over(w)
    return df.withColumns({"__i": i, "__n": n}).where(((F.col("__i") - 1) % stride == 0) | (F.col("__i") > F.col("__n") - F.greatest(F.lit(tail), F.lit(1)))).drop("__i", "__n")


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, days: int) -> DataFrame:
    """For each left row the right row of its key that is nearest, within ``days``; the earlier of two.

    Both sides are dealt by (key, week): a left row looks at its week and the two beside it,
    so a hot key is split by time and no range join is needed.
    """
    width = days + 1
    cell = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / width)
    l2 = left.withColumn("__c", F.explode(F.array(*(cell(left_day) + d for d in (-1, 0, 1)))))
    r2 = right.withColumn("__c", cell(right_day))
    near = l2.join(r2, [key, "__c"]).withColumn("offset", F.datediff(right_day, left_day)).where(F.abs("offset") <= days)
    best = near.groupBy(*(F.col(c) for c in left.columns)).agg(F.min(F.struct(F.abs("offset").alias("gap"), "offset", right_day)).alias("b"))
    return best.select(*left.columns, F.col(f"b.{right_day}").alias(right_day), F.col("b.offset").alias("offset"))


def column_screen(df: DataFrame, columns: list[str], most_missing: float = 0.85) -> DataFrame:
    """column, missing (share), n_distinct and dropped: mostly missing or constant columns; one aggregation."""
    rows = [F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("missing"), F.countDistinct(c).alias("n_distinct")) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r")).withColumn("dropped", (F.col("missing") >= most_missing) | (F.col("n_distinct") <= 1))


def feature_defaults(df: DataFrame, c: str, share: float, *keys: str) -> DataFrame:
    """Median, mean and population deviation (1e-6 at least, 1 where there is none) of the first ``share`` of each key's days."""
    w = Window.partitionBy(*(keys or (F.lit(0),)))
    early = df.withColumns({"__i": F.row_number().over(by_day(*keys)), "__n": F.count("*").over(w)}).where(F.col("__i") <= F.floor(F.col("__n") * share))
    clean = early.withColumn("__v", F.when(F.abs(c) < float("inf"), F.col(c)))
    return clean.groupBy(*keys).agg(F.coalesce(F.median("__v"), F.lit(0.0)).alias("middle"), F.coalesce(F.avg("__v"), F.lit(0.0)).alias("mean"), F.greatest(F.coalesce(F.stddev_pop("__v"), F.lit(1.0)), F.lit(1e-6)).alias("scale"))
