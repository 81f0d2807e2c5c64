"""Quantiles, breakpoints, chunks, names, baselines and graphs against brute force."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.operators import forecasts, formulas, graph, joins, measures, quantiles, records, site, texts, triage


def test_quantiles_and_tails_against_numpy(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(5), r.random() * 9])) for _ in range(400)]
    d = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "k string, v double")
    got = {x.k: (x.low, x.mid, x.high) for x in quantiles.quantiles(d, "v", {"low": 0.1, "mid": 0.5, "high": 1.0}, "k").collect()}
    tails = {x.k: x.tail for x in quantiles.lower_tail_mean(d, "v", 0.1, "k").collect()}
    for k in ("a", "b", None):
        v = sorted(float(x) for g, x in rows if g == k and x is not None)
        assert got[k] == pytest.approx(tuple(np.quantile(v, q) for q in (0.1, 0.5, 1.0)))
        assert tails[k] == pytest.approx(np.mean(v[: max(1, len(v) // 10)]))
    one = quantiles.quantiles(d, "v", {"q": 0.25}).first()
    assert one.q == pytest.approx(np.quantile([float(x) for _, x in rows if x is not None], 0.25))
    assert quantiles.quantiles(d.where("false"), "v", {"q": 0.5}).count() in (0, 1)


def test_running_max_is_a_cumulative_maximum(spark):
    r = random.Random(2)
    v = [(float(i), r.random()) for i in range(500)]
    got = [x.top for x in quantiles.running_max(spark.createDataFrame(v, "o double, v double").repartition(7), "o", "v").orderBy("o").collect()]
    assert got == list(np.maximum.accumulate([x for _, x in v]))


def plain_two_lines(x, y, side):
    """Every split fitted anew."""
    fit = lambda a, b: np.polyval(np.polyfit(a, b, 1), a) if len(set(a)) > 1 else np.full(len(b), b.mean())
    sst, best = ((y - y.mean()) ** 2).sum(), None
    xs = np.sort(x)
    for t in np.unique(xs[side : len(x) - side]):
        left = x <= t
        if left.sum() < side or (~left).sum() < side:
            continue
        sse = ((y[left] - fit(x[left], y[left])) ** 2).sum() + ((y[~left] - fit(x[~left], y[~left])) ** 2).sum()
        if best is None or 1 - sse / sst > best[1] + 1e-12:
            best = (t, 1 - sse / sst, y[~left].mean() - y[left].mean())
    return best


def test_two_lines_against_every_split(spark):
    r = np.random.default_rng(3)
    rows, want = [], {}
    for key in "abc":
        x = np.round(r.uniform(0, 40, 60), 1 if key == "a" else 0)
        y = np.where(x < 20, x, 20 + 5 * (x - 20)) + r.normal(0, 1, 60)
        rows += [(key, float(a), float(b)) for a, b in zip(x, y, strict=True)]
        want[key] = plain_two_lines(x, y, 8)
    rows += [("few", 1.0, 2.0), ("flat", None, 1.0), *[("const", float(i), 5.0) for i in range(30)]]
    got = {x.k: x for x in measures.two_lines(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", 8, "k").collect()}
    for key, (t, r2, jump) in want.items():
        assert (got[key].threshold, got[key].piecewise_r2, got[key].jump) == pytest.approx((t, r2, jump)) and got[key].status == "ok"
        assert got[key].r2_gain == pytest.approx(r2 - got[key].linear_r2)
    assert {got[k].status for k in ("few", "const")} == {"insufficient"}


def test_paragraph_chunks_by_hand(spark):
    d = spark.createDataFrame([(1, "x" * 3000), (2, "aa\n\n bb \ncc"), (3, None), (4, "")], "i int, t string")
    cut = lambda overlap: [(c.char_start, c.char_end) for c in texts.paragraph_chunks(d, "i", "t", 1000, overlap).where("i = 1").orderBy("ordinal").collect()]
    assert [a for a, _ in cut(0)] == [0, 1000, 2000] and [a for a, _ in cut(200)] == [0, 800, 1600, 2400] and cut(200)[-1][1] == 3000
    rows = texts.paragraph_chunks(d, "i", "t", 6, 0).where("i != 1").orderBy("i", "ordinal").collect()
    assert [(c.i, c.chunk) for c in rows] == [(2, "aa"), (2, "bb \ncc")]


def test_similar_names_against_difflib(spark):
    names = ["Paris", "Parise", "paris", "Berlin", "Berlyn", None, "Par"]
    got = {(x.a, x.b): x.ratio for x in texts.similar_names(spark.createDataFrame([(n,) for n in names], "n string"), "n", 0.5).collect()}
    known = [n for n in names if n]
    want = {(a, b): SequenceMatcher(None, a, b, autojunk=False).ratio() for a in known for b in known if a < b and a[:3].lower() == b[:3].lower()}
    assert got == {k: v for k, v in want.items() if v >= 0.5} and len(got) > 3


def test_ridge_and_leave_one_out_against_numpy(spark):
    r = np.random.default_rng(4)
    x, y = r.normal(size=(12, 3)), r.normal(size=12)
    base = y + r.normal(size=12)
    d = spark.createDataFrame([(i, *map(float, a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, base, strict=True))], "i int, a double, b double, c double, y double, base double")
    w, b = forecasts.ridge(d, ["a", "b", "c"], ["y"], 2.0)["y"]
    w2, b2 = forecasts.solve_ridge(x, y, 2.0)
    assert np.allclose(w, w2) and b == pytest.approx(b2)
    holed = d.withColumn("a", F.when(F.col("i") != 3, F.col("a")))
    x = x.copy()
    x[3, 0] = np.nan
    for fit in (forecasts.ridge_fold, forecasts.residual_fold):
        got = {z.i: z.predicted for z in forecasts.leave_one_out(holed, "i", ["a", "b", "c"], "y", "base", fit).collect()}
        for i in range(12):
            m = np.arange(12) != i
            mid = np.nanmedian(x[m], 0)
            t, q = np.where(np.isnan(x[m]), mid, x[m]), np.where(np.isnan(x[i]), mid, x[i])
            mu, s = t.mean(0), t.std(0)
            target = y[m] if fit is forecasts.ridge_fold else y[m] - base[m]
            w, c = forecasts.solve_ridge((t - mu) / s, target, 1.0)
            p = (q - mu) / s @ w + c
            assert got[i] == pytest.approx(p if fit is forecasts.ridge_fold else base[i] + 0.5 * p)


def test_labels_settle_on_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    got = {x.node: x.label for x in graph.spread_labels(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_undominated_paths(spark):
    rows = [([1, 2], 0.9), ([1, 2, 3], 0.9), ([1, 3, 2], 0.8), ([1, 4], 0.5), ([1, 4, 5], 0.4), ([2, 1], 0.9)]
    got = graph.undominated(spark.createDataFrame(rows, "path array<long>, score double")).collect()
    assert sorted(tuple(x.path) for x in got) == [(1, 2, 3), (1, 4), (1, 4, 5), (2, 1)]


def test_a_site_without_gauges_and_its_surrogate(spark):
    base = {"rain": 1.0, "wind": 2.0, "wind_dir": None, "pressure": 1000.0, "humidity": 50.0, "air_temp": 20.0, "water_temp": 18.0, "turbidity": 10.0, "conductivity": 300.0, "oxygen": 8.0, "cod": 3.0, "nh3": 0.2, "tn": 1.0, "tp": 0.05}
    d = spark.createDataFrame([("s", f"2024-01-{i:02d}", *(None if k == "rain" and i == 2 else (200.0 if k == "wind_dir" and i == 1 else v) for k, v in base.items())) for i in (1, 2, 3)], "site string, day string, " + ", ".join(f"{k} double" for k in base)).withColumn("day", F.to_date("day"))
    rows = site.surrogate(site.features(d)).orderBy("day").collect()
    assert [x.rain_3d for x in rows] == [1.0, 1.0, 2.0] and {x.flow_size for x in rows} == {0.0} and rows[0].wind_sin == pytest.approx(np.sin(np.radians(200)))
    assert rows[2].runoff == pytest.approx(2.0 * 1.5) and rows[2].settling == pytest.approx(1 / (1 + 2 + 2))
    assert all(x.net_response == pytest.approx(x.source_total - x.sink_total) and x.next_turbidity >= 0 for x in rows)
    assert "SELECT *, 1 + x AS y" in formulas.as_statement("t", [{"y": "{a} + x"}], {"a": 1})


def test_triage_bands_and_ties(spark):
    d = spark.createDataFrame([(0.96, 0.1, None), (0.72, None, None), (0.5, 0.4, None), (0.5, None, 0.5), (0.5, None, None)], "s double, a double, b double")
    assert [x[0] for x in d.select(triage.risk_band(F.col("s"), F.col("a"), F.col("b"))).collect()] == ["high", "heightened", "heightened", "heightened", "watch"]
    c = spark.createDataFrame([(0.9, 0.5), (0.85, 0.7), (0.6, 0.5), (0.59, 0.0)], "a double, b double")
    assert [x[0] for x in c.select(triage.confidence(F.col("a"), F.col("b"))).collect()] == ["high", "medium", "medium", "exploratory"]
    assert [x[0] for x in d.select(triage.exceedance(F.col("s"), F.col("a"))).collect()][1] == 0.0


def test_pages_upserts_and_windows(spark):
    d = spark.range(45).withColumn("day", F.when(F.col("id") % 9 > 0, F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))))
    assert records.matching(d, None, "day", "2024-02-01").count() == len([i for i in range(45) if i % 9 == 0 or i >= 31])
    last = records.page(d, ["id"], 40, 20).collect()
    assert [x.id for x in last] == [40, 41, 42, 43, 44] and not any(x.has_next for x in last) and records.page(d, ["id"], 45, 5).count() == 0
    old = spark.createDataFrame([(1, "a", 5), (2, None, 1)], "k int, s string, v int")
    new = spark.createDataFrame([(1, "b", 5), (2, "c", 0), (3, "d", None)], "k int, s string, v int")
    assert sorted(map(tuple, records.upserted(old, new, ["k"], "v").collect())) == [(1, "b", 5), (2, None, 1), (3, "d", None)]
    w = spark.createDataFrame([("2024-01-01", "2024-02-01"), ("2024-03-01", "2024-04-01")], "a string, b string")
    assert records.common_window(w, "a", "b").count() == 0 and records.values_of(old, "none").count() == 0


def test_labels_prefer_the_wanted_role(spark):
    left = spark.createDataFrame([("a", "2024-01-05"), ("b", "2024-01-05"), ("c", "2024-01-05")], "k string, d string").withColumn("d", F.to_date("d"))
    right = spark.createDataFrame([("a", "2024-01-05", "other"), ("a", "2024-01-07", "site"), ("b", "2024-01-06", "other"), ("c", "2024-01-20", "site")], "k string, e string, role string").withColumn("e", F.to_date("e"))
    got = {x.k: (x.alignment, round(x.confidence, 4)) for x in joins.labelled(left, right, "k", "d", "e", "role", "site").collect()}
    assert got == {"a": ("same_week_context", round(np.exp(-2 / 3), 4)), "b": ("near_day", round(np.exp(-1 / 3), 4)), "c": ("no_field_label", 0.0)}
