"""Operators against brute force on small inputs, with nulls, ties and empty tables."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.functions import scores
from rillspark.operators import graph, measures, ranking, series, texts

D0 = dt.date(2024, 1, 1)


def days(spark, values, key="a"):
    return spark.createDataFrame([(key, D0 + dt.timedelta(i), v) for i, v in enumerate(values)], "k string, day date, v double")


def test_interpolation_is_positional_and_fills_ends(spark):
    df = series.interpolated(days(spark, [None, 2.0, None, None, 8.0, None]), "v", "k").orderBy("day")
    assert [r.v_filled for r in df.collect()] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_interpolation_of_nothing_but_nulls(spark):
    assert {r.v_filled for r in series.interpolated(days(spark, [None, None]), "v", "k").collect()} == {None}


def test_windows_stop_at_gaps(spark):
    df = days(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]).where("day != '2024-01-04'")
    got = series.contiguous_windows(df, "v", 2, 1, "k").collect()
    assert [(r.window, r.target) for r in got] == [([1.0, 2.0], 3.0)]


def test_split_fractions_are_cut_off(spark):
    got = series.chronological_split(days(spark, [float(i) for i in range(9)]), 0.7, 0.15, "k").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 6, "valid": 1, "test": 2}


def test_nearest_in_time_against_all_pairs(spark):
    r = random.Random(5)
    a = sorted({(r.choice("xy"), r.randint(0, 60)) for _ in range(40)})
    b = sorted({(r.choice("xyz"), r.randint(0, 60)) for _ in range(25)})
    day = lambda i: D0 + dt.timedelta(i)
    left = spark.createDataFrame([(k, day(i)) for k, i in a], "k string, d date")
    right = spark.createDataFrame([(k, day(i)) for k, i in b], "k string, e date")
    want = {}
    for k, i in a:
        near = sorted((abs(j - i), j - i) for k2, j in b if k2 == k and abs(j - i) <= 7)
        if near:
            want[k, day(i)] = near[0][1]
    got = {(x.k, x.d): x.offset for x in series.nearest_in_time(left, right, "k", "d", "e", 7).collect()}
    assert got == want


def test_skyline_against_all_pairs(spark):
    r = random.Random(7)
    pts = [(i, float(r.randint(0, 30)), r.randint(0, 30)) for i in range(300)]
    want = {i for i, x, y in pts if not any(a <= x and b >= y and (a < x or b > y) for _, a, b in pts)}
    got = ranking.skyline(spark.createDataFrame(pts, "i long, x double, y long"), "x", "y")
    assert {x.i for x in got.collect()} == want


def test_breakpoint_against_refits(spark):
    x = np.arange(40.0)
    y = np.where(x < 20, x, 20 + 5 * (x - 20)) + np.sin(x) / 10
    best = None
    for cut in range(7, 32):
        error = 0.0
        for part in (slice(0, cut + 1), slice(cut + 1, 40)):
            fit = np.polyfit(x[part], y[part], 1)
            error += float(((np.polyval(fit, x[part]) - y[part]) ** 2).sum())
        if best is None or round(error, 4) < best[1]:
            best = (x[cut], round(error, 4))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double")
    got = measures.breakpoints(df, "x", "y", 8).collect()[0]
    assert got.threshold == best[0] and got.error == pytest.approx(best[1], abs=1e-3)


def test_metrics_of_a_constant_have_no_r2(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, p double")
    r = df.agg(*measures.regression("y", "p")).first()
    assert (r.mae, r.r2) == (0.5, None)


def test_correlations_drop_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.1, 3.0), (3.0, 5.9, 3.0)], "a double, b double, c double")
    assert [(r.a, r.b) for r in measures.correlations(df, ["a", "b", "c"], 6).collect()] == [("a", "b")]


def test_chunks_of_identical_characters(spark):
    df = spark.createDataFrame([(1, "x" * 3000), (2, ""), (3, None)], "doc_id long, text string")
    starts = lambda o: [r.char_start for r in texts.fixed_chunks(df, "doc_id", "text", 1000, o).orderBy("ordinal").collect()]
    assert starts(0) == [0, 1000, 2000] and starts(200) == [0, 800, 1600, 2400]


def test_sentinels_and_clamps(spark):
    df = spark.createDataFrame([("-",), ("-1",), (" 7.5 ",), ("x",), (None,)], "s string")
    got = df.select(scores.sentinel_float(F.col("s")).alias("v")).collect()
    assert [r.v for r in got] == [None, None, 7.5, None, None]
    assert spark.range(1).select(scores.clamp(F.lit(None).cast("double"), 0, 1).alias("v")).first().v is None


def test_degrees_count_parallel_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "a string, b string")
    assert {r.node: r.degree for r in graph.degrees(e, "a", "b").collect()} == {"a": 2, "b": 3, "c": 1}


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, day date, v double")
    assert series.interpolated(e, "v", "k").count() == 0
    assert series.contiguous_windows(e, "v", 3, 1, "k").count() == 0
    assert ranking.skyline(spark.createDataFrame([], "x double, y long"), "x", "y").count() == 0
