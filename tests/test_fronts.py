"""Fronts in many objectives, masks and bounded expansion against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.operators import graph, masks, pareto


def plain_front(rows, ways, slack):
    good = [r for r in rows if all(v is not None and math.isfinite(v) for v in r[1:])]
    x = [[v if w == "min" else -v for v, w in zip(r[1:], ways)] for r in good]
    beats = lambda a, b: all(p <= q + slack for p, q in zip(a, b)) and any(p < q - slack for p, q in zip(a, b))
    return sorted(r[0] for r, v in zip(good, x) if not any(beats(o, v) for o in x))


@pytest.mark.parametrize("d", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("kind", ["free", "ties", "opposed"])
def test_front_is_that_of_all_pairs(spark, d, kind):
    r = random.Random(10 * d)
    value = {"free": r.random, "ties": lambda: r.randrange(4) / 2, "opposed": r.random}[kind]
    rows = [(i, *(value() for _ in range(d))) for i in range(260)]
    if kind == "opposed":  # a large front
        rows = [(i, *v[:-1], 1 - sum(v[:-1]) + r.random() / 50) if d > 1 else (i, *v) for i, *v in rows]
    rows += [(1000 + k, *v) for k, (_, *v) in enumerate(rows[:20])] + [(2000, *[None] * d), (2001, *[float("nan")] * d), (2002, *[float("-inf")] * d), (2003, *[float("inf")] * d)]
    ways = [r.choice(["min", "max"]) for _ in range(d)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"c{i} double" for i in range(d))).repartition(3)
    got = pareto.front(df, {f"c{i}": w for i, w in enumerate(ways)}, chunk=40)
    assert sorted(x.id for x in got.collect()) == plain_front(rows, ways, 1e-9) and got.columns == df.columns


def test_slack_is_not_transitive(spark):
    # each is within the slack of the next in one objective and better in the other
    rows = [(i, i * 0.8, -i * 3.0) for i in range(6)] + [(9, 0.0, -1.0), (10, -0.0, -1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    for slack in (1.0, 0.5, 3.5):
        assert sorted(x.id for x in pareto.front(df, {"a": "min", "b": "min"}, slack=slack).collect()) == plain_front(rows, ["min", "min"], slack)


def test_front_of_nothing(spark):
    df = spark.createDataFrame([], "id long, a double")
    assert pareto.front(df, {"a": "min"}).count() == 0
    with pytest.raises(ValueError):
        pareto.front(df, {"a": "low"})


# -- masks --------------------------------------------------------------------------------


def test_masks_are_those_of_numpy(spark):
    r = np.random.default_rng(4)
    shapes = [(4, 6)] * 7 + [(3, 3)] * 4 + [(1, 5), (5, 1)]
    made = [(r.random(s) < 0.4).astype(int) for s in shapes]
    rows = [(k, m.shape[1], m.ravel().tolist()) for k, m in enumerate(made)] + [(99, 3, []), (98, 3, None)]
    got = {x.id: x for x in masks.measured(spark.createDataFrame(rows, "id long, width int, cells array<int>").repartition(3), "id", "width", "cells").collect()}
    assert set(got) == set(range(len(made)))
    for k, m in enumerate(made):
        same = [o for o in made if o.shape == m.shape]
        reference = np.mean(same, axis=0) >= 0.5
        assert got[k]["mean"] == pytest.approx(m.mean()) and got[k].disagreement == pytest.approx((m != reference).mean())
        if min(m.shape) > 1:
            assert got[k].edge_density == pytest.approx(((m[:, 1:] != m[:, :-1]).mean() + (m[1:] != m[:-1]).mean()) / 2)
        else:
            assert got[k].edge_density is None


# -- expansion ----------------------------------------------------------------------------


def plain_best(near, seeds, decay, floor, depth):
    """The best score of any simple path, by trying all of them."""
    best = dict(seeds)

    def go(path, score):
        if len(path) > depth:
            return
        for to, w in near.get(path[-1], {}).items():
            s = score * decay / (1 + math.log1p(w))
            if to not in path and s >= floor:
                best[to] = max(best.get(to, 0), s)
                go([*path, to], s)

    for n, s in seeds.items():
        go([n], s)
    return best


def test_expansion_finds_the_best_score_of_every_node(spark):
    r = random.Random(6)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(90)] + [(0, x) for x in range(1, 300)] * 2
    near = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, Counter())[v] += 1
            near.setdefault(v, Counter())[u] += 1
    seeds = {3: 1.0, 7: 0.9, 0: 0.3}
    table = graph.neighbours(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    found, best = graph.expanded(table, spark.createDataFrame([*seeds.items(), (3, 0.2)], "node long, score double"), 0.9, 0.02)
    assert {x.node: pytest.approx(x.score) for x in best.collect()} == plain_best(near, seeds, 0.9, 0.02, 3)
    rows = found.collect()
    assert all(len(set(x.path)) == len(x.path) <= 4 and x.score >= 0.02 for x in rows)
    # a hub of 300 neighbours is left once for each layer that betters it, not once for each path to it
    assert len(rows) <= 4 * 2 * len(set(edges))


def test_a_budget_keeps_seeds_and_the_best_neighbours(spark):
    near = [(0, x, 1, float(x % 7)) for x in range(1, 60)] + [(x, 0, 1, 0.0) for x in range(1, 60)]
    table = spark.createDataFrame(near, "node long, to long, weight long, lexical double")
    found, _ = graph.expanded(table, spark.createDataFrame([(0, 1.0), (50, 0.5)], "node long, score double"), 0.9, 0.01, depth=1, budget=5)
    ends = {x.path[-1] for x in found.collect() if x.path[0] == 0}
    assert ends == {50, 6, 13, 20, 27}
