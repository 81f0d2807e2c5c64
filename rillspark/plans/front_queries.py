"""Queries of fronts in many objectives, masks and bounded expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.operators import graph, masks, pareto
from rillspark.plans.book import Book, Tables

BOOK = Book()

_ORDER_FACTS = (
    "o AS (SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS cost, sum(l_quantity) AS amount, max(l_discount) AS discount, CAST(max(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS INTEGER) AS days"
    " FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"
)


@BOOK.query(
    f"WITH {_ORDER_FACTS} SELECT o_orderkey, cost, amount, discount, days FROM o WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.cost <= o.cost + 1e-9 AND b.amount >= o.amount - 1e-9 AND b.discount >= o.discount - 1e-9 AND b.days <= o.days + 1e-9"
    " AND (b.cost < o.cost - 1e-9 OR b.amount > o.amount + 1e-9 OR b.discount > o.discount + 1e-9 OR b.days < o.days - 1e-9))"
)
def order_front(t: Tables):
    """Orders that no other order beats in cost, amount, discount and days at once, with the slack of 1e-9."""
    lines = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    facts = lines.groupBy("o_orderkey").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("cost"),
        F.sum("l_quantity").alias("amount"),
        F.max("l_discount").alias("discount"),
        F.max(F.datediff("l_shipdate", "o_orderdate")).alias("days"),
    )
    return pareto.front(facts, {"cost": "min", "amount": "max", "discount": "max", "days": "min"})


_CELLS = "(month(CAST(o_orderdate AS DATE)) - 1) * 31 + day(CAST(o_orderdate AS DATE)) - 1"


@BOOK.query(
    f"WITH c AS (SELECT c_nationkey AS k, {_CELLS} AS place, count(*) % 2 AS cell FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),"
    " g AS (SELECT DISTINCT c_nationkey AS k FROM customer), a AS (SELECT g.k, p AS place, CAST(coalesce(cell, 0) AS INTEGER) AS cell FROM (SELECT DISTINCT k FROM c) g CROSS JOIN range(372) AS r(p) LEFT JOIN c ON c.k = g.k AND c.place = p),"
    " m AS (SELECT place, CASE WHEN avg(cell) >= 0.5 THEN 1 ELSE 0 END AS ref FROM a GROUP BY 1),"
    " e AS (SELECT x.k, avg(x.cell) AS mean, avg(CASE WHEN x.cell <> m.ref THEN 1.0 ELSE 0.0 END) AS disagreement,"
    " avg(CASE WHEN x.place % 31 < 30 THEN CASE WHEN x.cell <> h.cell THEN 1.0 ELSE 0.0 END END) AS across, avg(CASE WHEN v.cell <> x.cell THEN 1.0 WHEN v.cell = x.cell THEN 0.0 END) AS down"
    " FROM a x JOIN m USING (place) LEFT JOIN a h ON h.k = x.k AND h.place = x.place + 1 LEFT JOIN a v ON v.k = x.k AND v.place = x.place + 31 GROUP BY 1)"
    " SELECT k AS c_nationkey, round(mean, 9) AS mean, round(CAST(disagreement AS DOUBLE), 9) AS disagreement, round((CAST(across AS DOUBLE) + CAST(down AS DOUBLE)) / 2, 9) AS edge_density FROM e"
)
def calendar_masks(t: Tables):
    """Masks of month and day for each nation (odd numbers of orders): means, disagreement with the majority, edges."""
    day = F.col("o_orderdate").cast("date")
    place = (F.month(day) - 1) * 31 + F.dayofmonth(day) - 1
    odd = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", place.alias("place")).agg((F.count("*") % 2).alias("cell")).where("cell = 1")
    every = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select("c_nationkey").distinct()
    # at most 372 places a nation
    set_places = odd.groupBy("c_nationkey").agg(F.collect_set("place").alias("places"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(371)), lambda p: F.coalesce(F.array_contains("places", p), F.lit(False)).cast("int"))
    m = every.join(set_places, "c_nationkey", "left").select("c_nationkey", F.lit(31).alias("width"), cells.alias("cells"))
    out = masks.measured(m, "c_nationkey", "width", "cells")
    return out.select("c_nationkey", *(F.round(c, 9).alias(c) for c in ("mean", "disagreement", "edge_density")))


def _layers(depth: int) -> str:
    """A layer for each edge of a path: nodes are left again only where they were reached with more than before."""
    out = ["b0 AS (SELECT node, score FROM seeds)", "f0 AS (SELECT node, score, [node] AS path FROM seeds)"]
    for i in range(1, depth + 1):
        out += [
            f"r{i} AS (SELECT near.node, near.\"to\", near.weight, f.score, f.path, s.node IS NOT NULL AS anchor, row_number() OVER (PARTITION BY near.node ORDER BY (s.node IS NULL), length(near.\"to\") DESC, near.\"to\") AS k FROM near JOIN f{i - 1} f ON f.node = near.node LEFT JOIN seeds s ON s.node = near.\"to\")",
            f"p{i} AS (SELECT \"to\" AS node, score * CAST(0.9 AS DOUBLE) / (1 + ln(1 + weight)) AS score, list_append(path, \"to\") AS path FROM r{i} WHERE (k <= 6 OR anchor) AND NOT list_contains(path, \"to\") AND score * CAST(0.9 AS DOUBLE) / (1 + ln(1 + weight)) >= 0.1)",
            f"m{i} AS (SELECT node, min(struct_pack(less := -score, path := path)) AS b FROM p{i} GROUP BY node)",
            f"f{i} AS (SELECT m.node, -m.b.less AS score, m.b.path AS path FROM m{i} m LEFT JOIN b{i - 1} b ON b.node = m.node WHERE b.node IS NULL OR -m.b.less > b.score)",
            f"b{i} AS (SELECT node, max(score) AS score FROM (SELECT node, score FROM b{i - 1} UNION ALL SELECT node, score FROM f{i}) GROUP BY node)",
        ]
    return ", ".join(out)


@BOOK.query(
    "WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark), e AS (SELECT ws[i] AS a, ws[i + 1] AS b FROM w, unnest(range(1, len(ws))) AS u(i)),"
    " n2 AS (SELECT a AS node, b AS \"to\" FROM e WHERE a <> b UNION ALL SELECT b, a FROM e WHERE a <> b), near AS (SELECT node, \"to\", count(*) AS weight FROM n2 GROUP BY 1, 2),"
    " seeds AS (SELECT DISTINCT node, CAST(1 AS DOUBLE) AS score FROM near WHERE length(node) >= 12),"
    f" {_layers(3)} SELECT array_to_string(path, '>') AS path, round(score, 9) AS score FROM (SELECT path, score FROM p1 UNION ALL SELECT path, score FROM p2 UNION ALL SELECT path, score FROM p3)"
)
def expanded_paths(t: Tables):
    """Paths from long words through neighbouring words, the longest neighbours of each first."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - 1, F.lit(1))), lambda i: F.struct(F.get("ws", i - 1).alias("a"), F.get("ws", i).alias("b")))
    near = graph.neighbours(t("benchmark").select(ws.alias("ws")).select(F.inline(pairs)), "a", "b").withColumn("lexical", F.length("to"))
    seeds = near.where(F.length("node") >= 12).select("node").distinct().withColumn("score", F.lit(1.0))
    found, _ = graph.expanded(near, seeds, 0.9, 0.1, depth=3, budget=6)
    return found.select(F.array_join("path", ">").alias("path"), F.round("score", 9).alias("score"))
