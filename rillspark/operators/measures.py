"""Aggregate measures: forecasts, classifiers, profiles, correlations, breakpoints."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.operators.quantiles import running


def regression(y: str, p: str) -> list[Column]:
    """MAE, RMSE, R2 and MAPE in one pass: R2 from sums of squares, not a second scan."""
    e = F.col(p) - F.col(y)
    sse, sst = F.sum(e * e), F.var_pop(y) * F.count(y)
    floor = F.when(F.abs(y) < 1e-6, 1.0).otherwise(F.abs(y))
    r2 = F.when((F.count(y) >= 3) & (sst > 1e-12), 1 - F.try_divide(sse, sst))
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2"), F.avg(F.abs(e) / floor).alias("mape")]


def binary(y: Column, p: Column) -> list[Column]:
    """Accuracy, precision, recall, F1 and positive rate of boolean columns."""
    tp, fp, fn = F.count_if(y & p), F.count_if(~y & p), F.count_if(y & ~p)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        F.avg((y == p).cast("double")).alias("accuracy"),
        zero(F.try_divide(tp, tp + fp)).alias("precision"),
        zero(F.try_divide(tp, tp + fn)).alias("recall"),
        zero(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        F.avg(y.cast("double")).alias("positive_rate"),
    ]


def correlations(df: DataFrame, columns: list[str], top: int) -> DataFrame:
    """Pearson correlations of all pairs of columns, pairwise complete, strongest first.

    All moments come from one aggregate over the rows; undefined pairs are dropped.
    """
    aggs, names = [], []
    for a, b in combinations(columns, 2):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when((F.var_pop(x) > 1e-12) & (F.var_pop(y) > 1e-12), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias("r")).alias(f"p{len(names)}"))
        names.append(f"p{len(names)}")
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*names))).where("r is not null").orderBy(F.abs("r").desc(), "a", "b").limit(top)


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("field"), F.count_if(F.col(c).isNull()).alias("missing"), F.count("*").alias("n")) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


_SUMS = ("n", "sx", "sy", "sxx", "sxy", "syy")


def _splits(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """For each distinct x of each key the sums over rows up to it (l_), after it (r_) and over all (t_), and n_x, the distinct x.

    Rows are summed up by distinct x first; running sums over ranges of those give both sides of every
    split, so nothing is fitted twice, no pair of rows is made and no task holds all values.
    """
    v, u = F.col(x).cast("double"), F.col(y).cast("double")
    good = df.where(v.isNotNull() & u.isNotNull() & (F.abs(v) < float("inf")) & (F.abs(u) < float("inf")))
    sums = good.groupBy(*keys, v.alias("x")).agg(F.count("*").cast("double").alias("n"), F.sum(u).alias("sy"), F.sum(u * u).alias("syy"))
    sums = sums.withColumns({"sx": F.col("x") * F.col("n"), "sxx": F.col("x") * F.col("x") * F.col("n"), "sxy": F.col("x") * F.col("sy")})
    totals = sums.groupBy(*keys).agg(F.count("*").alias("n_x"), *(F.sum(c).alias(f"t_{c}") for c in _SUMS))
    up_to = running(sums, "x", list(_SUMS), *keys).select(*keys, "x", *((F.col(f"before_{c}") + F.col(c)).alias(f"l_{c}") for c in _SUMS))
    if keys:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        wide = up_to.alias("a").join(totals.alias("b"), same).drop(*(F.col(f"b.{k}") for k in keys))
    else:
        wide = up_to.crossJoin(F.broadcast(totals))  # one row
    return wide.withColumns({f"r_{c}": F.col(f"t_{c}") - F.col(f"l_{c}") for c in _SUMS})


def _moments(side: str) -> tuple[Column, Column, Column]:
    n, sx, sy, sxx, sxy, syy = (F.col(f"{side}_{c}") for c in _SUMS)
    return sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n


def _sse(side: str) -> Column:
    vx, vy, vxy = _moments(side)
    return vy - F.when(vx > 1e-9, vxy * vxy / vx).otherwise(0.0)


def breakpoints(df: DataFrame, x: str, y: str, min_side: int, *keys: str) -> DataFrame:
    """The split of x into two straight lines that leaves the least squared error, per key."""
    good = _splits(df, x, y, *keys).where((F.col("l_n") >= min_side) & (F.col("r_n") >= min_side))
    errors = good.withColumns({"error": F.round(_sse("l") + _sse("r"), 4), "line_error": F.round(_sse("t"), 4)})
    return errors.groupBy(*keys).agg(F.min(F.struct("error", "x", "line_error")).alias("b")).select(*keys, F.col("b.x").alias("threshold"), F.col("b.error").alias("error"), F.col("b.line_error").alias("line_error"))


def two_lines(df: DataFrame, x: str, y: str, min_side: int, *keys: str) -> DataFrame:
    """Per key: n, status, threshold, R2 of one line and of two, their gain, slopes, means and counts of both sides.

    A split has more than ``min_side`` rows up to it and ``min_side`` after it; of equal ones the lowest is
    taken.  Keys with fewer than twice as many rows, fewer than four distinct x or a constant y
    are ``insufficient`` and have nulls.
    """
    splits = _splits(df, x, y, *keys)
    vy = _moments("t")[1]
    slope = lambda s: F.when(_moments(s)[0] > 1e-9, _moments(s)[2] / _moments(s)[0])
    known = F.when((F.col("t_n") >= 3) & (vy > 1e-12), vy)
    enough = (F.col("t_n") >= 2 * min_side) & (F.col("n_x") >= 4) & (F.col("l_n") > min_side) & (F.col("r_n") >= min_side)
    of_side = lambda s: F.col(f"{s}_sy") / F.col(f"{s}_n")
    record = F.struct(
        (-F.round(1 - (_sse("l") + _sse("r")) / known, 12)).alias("order"),
        F.col("x").alias("threshold"),
        (1 - _sse("t") / known).alias("linear_r2"),
        (1 - (_sse("l") + _sse("r")) / known).alias("piecewise_r2"),
        slope("t").alias("linear_slope"),
        slope("l").alias("slope_below"),
        slope("r").alias("slope_above"),
        of_side("l").alias("mean_below"),
        of_side("r").alias("mean_above"),
        F.col("l_n").cast("long").alias("n_below"),
        F.col("r_n").cast("long").alias("n_above"),
    )
    best = splits.groupBy(*keys).agg(F.max("t_n").cast("long").alias("n"), F.min(F.when(enough & known.isNotNull(), record)).alias("b"))
    b = F.col("b")
    return best.select(
        *keys,
        "n",
        F.when(b.isNull(), "insufficient").otherwise("ok").alias("status"),
        *(b[c].alias(c) for c in ("threshold", "linear_r2", "piecewise_r2")),
        (b["piecewise_r2"] - b["linear_r2"]).alias("r2_gain"),
        *(b[c].alias(c) for c in ("linear_slope", "slope_below", "slope_above", "mean_below", "mean_above")),
        (b["mean_above"] - b["mean_below"]).alias("jump"),
        b["n_below"].alias("n_below"),
        b["n_above"].alias("n_above"),
    )


def confidence(status: Column, n: Column, gain: Column) -> Column:
    """How far a threshold can be trusted. Limits are fixed values."""
    return F.when(status != "ok", "insufficient").when((n >= 40) & (gain >= 0.10), "high").when((n >= 25) & (gain >= 0.05), "medium").otherwise("exploratory")
