"""Windows of all days before a day, for series with keys or without, and ridge models of several targets over them.

A day is sent to each day that it comes before, so windows meet by key and day: no series is ever in one task, and a
series without a key is dealt out like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windows(df: DataFrame, day: str, features: Sequence[str], targets: Sequence[str], lags: int = 21, keys: Sequence[str] = ()) -> DataFrame:
    """keys, ``day``, x and the targets of every day that ``lags`` whole days come right before.

    ``x`` holds the features of those days, the oldest first.  Days are distinct for each key; days with a null feature are no
    whole days, and days with a null target have no row.
    """
    known = df.where(F.col(day).isNotNull())
    for f in features:
        known = known.where(F.col(f).isNotNull())
    row = F.array(*(F.col(f).cast("double") for f in features))
    sent = known.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("__lag"), F.col(day).alias("__from"), row.alias("__v")).withColumn("__day", F.date_add("__from", F.col("__lag")))
    held = sent.groupBy(*keys, "__day").agg(F.array_sort(F.collect_list(F.struct((-F.col("__lag")).alias("o"), F.col("__v").alias("v")))).alias("w")).where(F.size("w") == lags)
    x = held.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__day", F.flatten(F.transform("w", lambda r: r["v"])).alias("x"))
    same = F.to_date(day) == F.col("__day")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = df.join(x, same)
    for t in targets:
        out = out.where(F.col(t).isNotNull())
    return out.select(*keys, day, "x", *targets)


def _numbers(b: pa.RecordBatch, column: int) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def fitted(train: DataFrame, targets: Sequence[str], alpha: float = 1.0) -> dict[str, tuple[np.ndarray, float]] | None:
    """For each target the coefficients and the intercept of least squared errors plus ``alpha`` times squared coefficients; none without rows.

    Each task adds up products of its rows, about their first row; the driver gets one matrix, (features + targets) squared.
    """
    first = train.select("x", *(F.col(t).cast("double").alias(t) for t in targets)).head(1)
    if not first:
        return None
    origin = np.array([*first[0]["x"], *(first[0][t] for t in targets)])
    size = len(origin) + 1

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            y = np.stack([b.column(1 + i).to_numpy() for i in range(len(targets))], 1)
            z = np.concatenate([np.concatenate([_numbers(b, 0), y], 1) - origin, np.ones((b.num_rows, 1))], 1)
            total += z.T @ z
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(size * size), pa.int32()), "value": pa.array(total.ravel())})

    parts = train.select("x", *(F.col(t).cast("double") for t in targets)).mapInArrow(added, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()
    total = np.array([r["value"] for r in sorted(parts, key=lambda r: r["k"])]).reshape(size, size)
    n, sums = total[-1, -1], total[:-1, -1]
    centred = total[:-1, :-1] - np.outer(sums, sums) / n
    p = size - 1 - len(targets)
    w = np.linalg.solve(centred[:p, :p] + alpha * np.eye(p), centred[:p, p:])
    mean = sums / n + origin
    return {t: (w[:, i], float(mean[p + i] - mean[:p] @ w[:, i])) for i, t in enumerate(targets)}


def predicted(rows: DataFrame, model: Mapping[str, tuple[np.ndarray, float]], bounds: Mapping[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """``rows`` with predicted_<target>, within bounds where they are given."""
    out = rows
    for t, (w, c) in model.items():
        # a sum of products over two arrays: no column for each lag
        value: Column = F.aggregate(F.zip_with("x", F.array(*(F.lit(float(v)) for v in w)), lambda a, b: a * b), F.lit(float(c)), lambda s, v: s + v)
        low, high = (bounds or {}).get(t, (None, None))
        value = value if low is None else F.greatest(value, F.lit(float(low)))
        out = out.withColumn(f"predicted_{t}", value if high is None else F.least(value, F.lit(float(high))))
    return out
