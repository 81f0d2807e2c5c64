"""Leave-one-out models from sums against models that are fitted anew."""

import numpy as np
import pytest

from rillspark.operators import leave_one_out


def refitted(x, y, i, alpha=5.0):
    train = np.arange(len(y)) != i
    a, b, t = x[train].copy(), x[i].copy(), y[train]
    if not len(t):
        return None
    for j in range(x.shape[1]):
        known = a[~np.isnan(a[:, j]), j]
        m = np.median(known) if len(known) else 0.0
        a[np.isnan(a[:, j]), j] = m
        b[j] = m if np.isnan(b[j]) or not len(known) else b[j]
    mean, std = a.mean(0), a.std(0)
    std[std < 1e-9] = np.inf
    a, b = (a - mean) / std, (b - mean) / std
    p, n = x.shape[1], len(t)
    if p > max(n, 6):
        k = min(3, max(1, n - 1), p)
        r = np.array([np.corrcoef(a[:, j], t)[0, 1] ** 2 if a[:, j].std() > 0 and t.std() > 0 else -1 for j in range(p)])
        chosen = np.sort(np.argsort(np.round(r, 9), kind="stable")[-k:])
        a, b = a[:, chosen], b[chosen]
        parts = min(2, n - 1, k)
        if 1 <= parts < k:
            _, _, axes = np.linalg.svd(a, full_matrices=False)
            a, b = a @ axes[:parts].T, b @ axes[:parts].T
    w = np.linalg.solve(a.T @ a + alpha * np.eye(a.shape[1]), a.T @ (t - t.mean()))
    return float(t.mean() + b @ w)


def table(n, p, seed, gaps=0.15):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, p)) * r.uniform(0.1, 100, p) + 1000
    x[:, -1] = 7.0
    if p > 2:
        x[:, 1] = np.round(x[:, 1] / 50)
    y = x[:, 0] / 10 + r.normal(size=n) * 3
    x[r.random(x.shape) < gaps] = np.nan
    return x, y


def asked(spark, x, y):
    p = x.shape[1]
    rows = [(i, *(None if np.isnan(v) and i % 2 else float(v) for v in x[i]), None if np.isnan(y[i]) else float(y[i])) for i in range(len(y))]
    df = spark.createDataFrame(rows, "id long, " + "".join(f"x{j} double, " for j in range(p)) + "y double").repartition(3)
    return {r.id: r for r in leave_one_out.predicted(df, "id", [f"x{j}" for j in range(p)], "y").collect()}


@pytest.mark.parametrize("n,p", [(40, 5), (41, 3), (7, 9), (6, 9), (5, 12), (3, 8), (2, 2), (1, 2)])
def test_folds_are_those_of_models_fitted_anew(spark, n, p):
    x, y = table(n, p, 100 * n + p)
    got = asked(spark, x, y)
    for i in range(n):
        want = refitted(x, y, i)
        assert got[i].actual == y[i] and (got[i].predicted is None if want is None else got[i].predicted == pytest.approx(want, rel=1e-6, abs=1e-6))


def test_rows_without_a_target_are_left_out(spark):
    x, y = table(20, 3, 5)
    x[:, 2], y[4] = np.nan, np.nan
    x[5, 0] = np.inf
    got = asked(spark, x, y)
    x[5, 0] = np.nan
    keep = np.arange(20) != 4
    assert set(got) == set(np.arange(20)[keep])
    assert got[7].predicted == pytest.approx(refitted(x[keep], y[keep], int(np.arange(20)[keep].tolist().index(7))))


def test_a_long_table(spark):
    from pyspark.sql import functions as F

    n = 100_000
    d = spark.range(n).select("id", (F.xxhash64("id") % 1000 / 10.0).alias("x0"), F.when(F.xxhash64("id", F.lit(1)) % 5 != 0, (F.xxhash64("id", F.lit(2)) % 77).cast("double")).alias("x1"))
    d = d.withColumn("y", 3 * F.col("x0") - F.coalesce("x1", F.lit(9.0)) + F.xxhash64("id", F.lit(3)) % 10)
    got = {r.id: r.predicted for r in leave_one_out.predicted(d, "id", ["x0", "x1"], "y").where("id % 25000 = 3").collect()}
    rows = d.orderBy("id").toPandas()
    x, y = rows[["x0", "x1"]].to_numpy(float), rows["y"].to_numpy(float)
    assert len(got) == 4 and all(p == pytest.approx(refitted(x, y, int(i)), rel=1e-7) for i, p in got.items())
