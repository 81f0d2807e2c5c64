"""Communities, numbering and expansion against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rillspark.operators import communities, ranking


def modularity(edges, of):
    m, inside, total = 0, 0, Counter()
    for u, v in edges:
        if u != v:
            m += 1
            inside += of[u] == of[v]
            total[of[u]] += 1
            total[of[v]] += 1
    return inside / m - sum(t * t for t in total.values()) / (4 * m * m)


def plain_louvain(edges, seed=0):
    """One node at a time, in random order, and the graph of communities after that."""
    near = defaultdict(Counter)
    for u, v in edges:
        if u != v:
            near[u][v] += 1
            near[v][u] += 1
    loops, members = Counter(), {u: u for u in near}
    r = random.Random(seed)
    while True:
        k = {u: sum(near[u].values()) + loops[u] for u in near}
        two_m, own, total = sum(k.values()), {u: u for u in near}, Counter(k)
        moved_ever, moved = False, True
        while moved:
            moved = False
            order = sorted(near)
            r.shuffle(order)
            for u in order:
                w = Counter()
                for v, n in near[u].items():
                    w[own[v]] += n
                total[own[u]] -= k[u]
                best = max(w, key=lambda c: (w[c] * two_m - k[u] * total[c], -c))
                if w[best] * two_m - k[u] * total[best] > w[own[u]] * two_m - k[u] * total[own[u]]:
                    own[u], moved, moved_ever = best, True, True
                total[own[u]] += k[u]
        if not moved_ever:
            return members
        members = {u: own[c] for u, c in members.items()}
        folded, inner = defaultdict(Counter), Counter()
        for u in near:
            inner[own[u]] += loops[u]
            for v, n in near[u].items():
                if own[u] == own[v]:
                    inner[own[u]] += n
                else:
                    folded[own[u]][own[v]] += n
        near, loops = defaultdict(Counter, {c: folded[c] for c in set(own.values())}), inner


def planted(groups, size, inside, between, seed):
    r = random.Random(seed)
    n = groups * size
    out = [(g * size + r.randrange(size), g * size + r.randrange(size)) for g in range(groups) for _ in range(inside)]
    return out + [(r.randrange(n), r.randrange(n)) for _ in range(between)]


def checked(edges, rows):
    of = {r.node: r.community for r in rows}
    assert len(of) == len(rows) == len({x for u, v in edges if u != v for x in (u, v)})
    plain = max(modularity(edges, plain_louvain(edges, s)) for s in range(3))
    assert modularity(edges, of) >= plain - 0.01
    members = defaultdict(list)
    for r in rows:
        members[r.community].append(r.node)
        assert r.size == sum(x.community == r.community for x in rows)
    assert [c for c, _ in sorted(members.items(), key=lambda cm: (-len(cm[1]), min(cm[1])))] == list(range(1, len(members) + 1))


def test_modularity_is_near_that_of_plain_louvain(spark):
    edges = planted(25, 30, 300, 2500, 1)  # 10,000
    checked(edges, communities.communities(spark.createDataFrame(edges, "a long, b long").repartition(4), "a", "b").collect())


def test_hubs_and_loops_in_any_layout(spark):
    edges = planted(6, 8, 40, 20, 2) + [(0, 0), (7, 7)] + [(0, x) for x in range(48)]
    one = communities.communities(spark.createDataFrame(edges, "a long, b long").repartition(1), "a", "b").collect()
    two = communities.communities(spark.createDataFrame([(b, a) for a, b in reversed(edges)], "a long, b long").repartition(7), "a", "b").collect()
    checked(edges, one)
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_no_edges_no_communities(spark):
    for rows in ([], [(1, 1)], [(None, 2)]):
        assert communities.communities(spark.createDataFrame(rows, "a long, b long"), "a", "b").count() == 0


def test_names_are_nodes_too(spark):
    d = spark.createDataFrame([("x", "y"), ("y", "z"), ("x", "z"), ("u", "v"), ("z", "u")], "a string, b string")
    assert {(r.node, r.community, r.size) for r in communities.communities(d, "a", "b").collect()} == {("x", 1, 3), ("y", 1, 3), ("z", 1, 3), ("u", 2, 2), ("v", 2, 2)}


def test_numbers_follow_the_order(spark):
    r = random.Random(4)
    values = [r.randrange(1000) for _ in range(700)]
    d = spark.createDataFrame(list(enumerate(values)), "id long, v long").repartition(5)
    got = {x.id: x.n for x in ranking.numbered(d, [F.desc("v"), F.col("id")], "n").collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((-v, i) for i, v in enumerate(values)), 1)}
    assert got == want and ranking.numbered(d.limit(0), [F.col("id")], "n").count() == 0
