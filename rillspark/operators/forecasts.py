"""Baselines: ridge regression from moments, leave-one-out models, analog forecasts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.operators.ranking import top_of_each


def lagged(df: DataFrame, c: str, lags: int, horizon: int, *keys: str) -> DataFrame:
    """``df`` with lag_0 (the day itself) to lag_<lags-1> and target, ``horizon`` rows on; only whole rows."""
    w = Window.partitionBy(*(keys or (F.lit(0),))).orderBy("day")
    out = df.withColumns({f"lag_{i}": F.lag(c, i).over(w) for i in range(lags)} | {"target": F.lead(c, horizon).over(w)})
    return out.dropna(subset=[*(f"lag_{i}" for i in range(lags)), "target"])


def ridge(train: DataFrame, features: Sequence[str], targets: Sequence[str], alpha: float = 1.0) -> dict[str, tuple[np.ndarray, float]]:
    """For each target the coefficients and the intercept that minimise squared errors plus ``alpha`` times the squared coefficients.

    One aggregation of the rows gives the moments, (features + targets) squared of them whatever the rows, and the
    driver solves the normal equations.  The intercept is not penalised.
    """
    cols = [*features, *targets]
    sums = [F.count("*").alias("n"), *(F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)), *(F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j and i < len(features))]
    row = train.agg(*sums).first()
    k = len(features)
    at = lambda i, j: row[f"c_{min(i, j)}_{max(i, j)}"] * row["n"]
    xx = np.array([[at(i, j) for j in range(k)] for i in range(k)]) + alpha * np.eye(k)
    out = {}
    for t, name in enumerate(targets):
        w = np.linalg.solve(xx, np.array([at(i, k + t) for i in range(k)]))
        out[name] = (w, row[f"m_{k + t}"] - sum(w[i] * row[f"m_{i}"] for i in range(k)))
    return out


def predicted(features: Sequence[str], model: tuple[np.ndarray, float], low: float | None = None, high: float | None = None) -> Column:
    w, b = model
    p = sum((F.col(f) * float(c) for f, c in zip(features, w, strict=True)), F.lit(float(b)))
    if low is not None:
        p = F.greatest(p, F.lit(low))
    return p if high is None else F.least(p, F.lit(high))


def solve_ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    m, c = x.mean(0), y.mean()
    w = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - c))
    return w, c - m @ w


def _scaled(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Missing values by the median of the training rows, then their mean and population deviation."""
    middle = np.nan_to_num(np.nanmedian(np.where(np.isfinite(train), train, np.nan), 0)) if len(train) else np.zeros(train.shape[1])
    fill = lambda a: np.where(np.isfinite(a), a, middle)
    a, b = fill(train), fill(test)
    m, s = a.mean(0), np.maximum(a.std(0), 1e-9)
    return (a - m) / s, (b - m) / s


def ridge_fold(train: np.ndarray, y: np.ndarray, test: np.ndarray, base: np.ndarray, base_test: float, alpha: float = 1.0) -> float:
    a, b = _scaled(train, test[None])
    w, c = solve_ridge(a, y, alpha)
    return float((b @ w)[0] + c)


def residual_fold(train: np.ndarray, y: np.ndarray, test: np.ndarray, base: np.ndarray, base_test: float, alpha: float = 1.0, shrink: float = 0.5) -> float:
    """A base prediction and a shrunk ridge model of what it leaves."""
    a, b = _scaled(train, test[None])
    w, c = solve_ridge(a, y - base, alpha)
    return float(base_test + shrink * ((b @ w)[0] + c))


def leave_one_out(df: DataFrame, row: str, features: Sequence[str], target: str, base: str, fit: Callable = ridge_fold) -> DataFrame:
    """row, actual, predicted: each row by a model of all others.

    For the small tables that such a test is for (a model for each row): rows meet folds, and a fold is one task.
    """
    folds = df.select(F.col(row).alias("__fold"))
    cols = [row, *features, target, base]
    wide = df.select(*dict.fromkeys(cols)).crossJoin(F.broadcast(folds))  # a small table by its contract

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        mine = (g[row] == key[0]).to_numpy()
        x, y, b = g[list(features)].to_numpy(float), g[target].to_numpy(float), g[base].to_numpy(float)
        p = fit(x[~mine], y[~mine], x[mine][0], b[~mine], float(b[mine][0])) if (~mine).sum() else np.nan
        return pd.DataFrame({"row": [key[0]], "actual": [float(y[mine][0])], "predicted": [p]})

    kind = df.schema[row].dataType.simpleString()
    out = wide.groupBy("__fold").applyInPandas(one, f"row {kind}, actual double, predicted double")
    return out.select(F.col("row").alias(row), "actual", "predicted")


def analogs(df: DataFrame, day: str, features: Sequence[str], value: str, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_day, analog_day, distance, following (the value a day after the analog): the ``k`` nearest other days that have a next day.

    ``queries`` (column query_day) are few days; distances are Euclidean over features divided by
    their sample deviations.
    """
    scale = df.agg(*(F.greatest(F.coalesce(F.stddev_samp(f), F.lit(0.0)), F.lit(1e-6)).alias(f"__s_{f}") for f in features))  # one row
    following = df.select(F.date_sub(day, 1).alias("__before"), F.col(value).alias("following"))
    pool = df.join(following, F.col(day) == F.col("__before")).drop("__before")
    asked = queries.join(df, F.col("query_day") == F.col(day)).select("query_day", *(F.col(f).alias(f"__q_{f}") for f in features))
    pairs = pool.crossJoin(F.broadcast(asked)).crossJoin(F.broadcast(scale)).where(F.col(day) != F.col("query_day"))
    d = F.sqrt(sum((F.pow((F.col(f) - F.col(f"__q_{f}")) / F.col(f"__s_{f}"), 2) for f in features), F.lit(0.0)))
    near = top_of_each(pairs.withColumn("distance", F.round(d, 9)), ["query_day"], [F.col("distance"), F.col(day)], k)
    return near.select("query_day", F.col(day).alias("analog_day"), "distance", "following", "rank")


def analog_backtest(near: DataFrame, actual: DataFrame, rmse: float) -> DataFrame:
    """One row: queries, mean absolute error of the analogs' mean, share of errors within ``rmse``. ``actual`` has query_day and actual."""
    p = near.groupBy("query_day").agg(F.avg("following").alias("p")).join(actual, "query_day")
    e = F.abs(F.col("p") - F.col("actual"))
    return p.agg(F.count("*").alias("queries"), F.avg(e).alias("mae"), F.avg((e <= rmse).cast("double")).alias("success"))
