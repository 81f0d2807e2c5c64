"""Windows of lags and ridge models over them against numpy."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.operators import lag_windows

FIRST = dt.date(2024, 1, 1)


def series(keys, days, seed):
    r = random.Random(seed)
    rows = []
    for k in keys:
        for d in range(days):
            if r.random() < 0.04:
                continue
            a, b = 1000 + r.gauss(0, 5) + d % 7, r.random()
            rows.append((k, FIRST + dt.timedelta(days=d), a, None if r.random() < 0.03 else b, a * 0.5 + r.random(), b if r.random() > 0.02 else None))
    return rows


def plain_windows(rows, lags):
    of = {(k, d): (a, b) for k, d, a, b, *_ in rows if b is not None}
    out = {}
    for k, d, _, _, y, z in rows:
        before = [of.get((k, d - dt.timedelta(days=j))) for j in range(lags, 0, -1)]
        if y is not None and z is not None and all(before):
            out[k, d] = ([v for p in before for v in p], y, z)
    return out


@pytest.mark.parametrize("keys", [["p", None, "q"], ["only"]])
def test_models_are_those_of_numpy(spark, keys):
    lags = 5
    rows = series(keys, 160, len(keys))
    df = spark.createDataFrame(rows, "k string, day date, a double, b double, y double, z double").repartition(5)
    by = ["k"] if len(keys) > 1 else []
    w = lag_windows.windows(df, "day", ["a", "b"], ["y", "z"], lags, by)
    want = plain_windows(rows, lags)
    assert {((r.k if by else "only"), r.day): (r.x, r.y, r.z) for r in w.collect()} == want
    cut = FIRST + dt.timedelta(days=110)
    model = lag_windows.fitted(w.where(F.col("day") < cut), ["y", "z"], 1.0)
    train = [v for (_, d), v in want.items() if d < cut]
    x, y = np.array([v[0] for v in train]), np.array([v[1:] for v in train])
    xc = x - x.mean(0)
    coef = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ (y - y.mean(0)))
    got = {((r.k if by else "only"), r.day): (r.predicted_y, r.predicted_z) for r in lag_windows.predicted(w, model, {"y": (0, None), "z": (0.45, 0.55)}).collect()}
    for key, (v, *_) in want.items():
        p = y.mean(0) + (np.array(v) - x.mean(0)) @ coef
        assert got[key] == pytest.approx((max(p[0], 0), min(max(p[1], 0.45), 0.55)), rel=1e-6)


def test_no_windows_no_model(spark):
    df = spark.createDataFrame([("k", FIRST, 1.0, 2.0)], "k string, day date, a double, y double")
    w = lag_windows.windows(df, "day", ["a"], ["y"], 3)
    assert w.count() == 0 and lag_windows.fitted(w, ["y"]) is None


def test_windows_need_no_window_of_a_whole_series(spark):
    df = spark.createDataFrame(series(["k"], 30, 1), "k string, day date, a double, b double, y double, z double")
    plan = lag_windows.windows(df, "day", ["a"], ["y"], 3)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window [" not in plan
