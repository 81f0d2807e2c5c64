"""Queries of model inputs from single readings, and of rows chosen with fallbacks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rillspark.operators import formulas, selection, series, states
from rillspark.plans.book import Book, Tables

BOOK = Book()
_READ = {
    "temperature": "CASE WHEN l_linenumber <> 3 THEN l_tax * 400 END",
    "rainfall": "CASE WHEN l_linenumber <> 2 THEN l_quantity / 5 END",
    "flow": "l_extendedprice / 1000 - 30",
    "level": "l_quantity / 10",
    "wind": "l_discount * 50",
    "oxygen": "l_discount * 160",
    "total_phosphorus": "l_tax * 2",
    "tn": "l_discount * 30",
}
_KEYS = "l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day"
_DERIVED = tuple(k for step in states.SINGLE for k in step)
_NULLS = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("rain_3d", "side_flow", "air_temp"))
_S = f"SELECT {_KEYS}, {', '.join(f'{v} AS {k}' for k, v in _READ.items())} FROM lineitem"
_SQL = f"WITH r AS (SELECT *, temperature AS water_temp, rainfall AS rain, total_phosphorus AS tp, {_NULLS}, CAST(dayofyear(day) AS DOUBLE) AS day_number FROM ({_S})), x AS ({formulas.as_statement('r', states.SINGLE)}) "


def _states(t: Tables):
    raw = t("lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"), *(F.expr(v).cast("double").alias(k) for k, v in _READ.items()))
    return states.derived(states.by_alias(raw, ["water_temp", "rain", "tp", "rain_3d"]).withColumn("day_number", F.dayofyear("day").cast("double")))


@BOOK.query(_SQL + "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({c}, 7) + 0.0 AS {c}" for c in _DERIVED) + " FROM x")
def state_features(t: Tables):
    return _states(t).select("l_orderkey", "l_linenumber", *((F.round(c, 7) + 0.0).alias(c) for c in _DERIVED))


_MEANS, _SCALES = (10.0, 20.0, 0.0), (5.0, 4.0, 0.5)
_SIN = f"sin(2 * {math.pi!r} * dayofyear(day - (2 - o)) / 366.0)"


@BOOK.query(
    _SQL
    + f"SELECT l_orderkey, l_linenumber, o AS offset, CAST(day - (2 - o) AS VARCHAR) AS day, round((coalesce(rain, 4.0) - 10) / 5, 7) + 0.0 AS a, round((coalesce(water_temp, 21.0) - 20) / 4, 7) + 0.0 AS b, round({_SIN} / 0.5, 7) + 0.0 AS c FROM x, (SELECT CAST(unnest([0, 1, 2]) AS INT) AS o) WHERE l_orderkey % 10 = 0"
)
def state_windows(t: Tables):
    d = _states(t).where("l_orderkey % 10 = 0")
    v = states.vector(d, ["rain", "water_temp", "day_sin"], "s_", {"rain": 4.0, "water_temp": 21.0})
    w = states.repeated_window(d, ["l_orderkey", "l_linenumber"], "day", v, 3, sin_at=2)
    z = w.withColumn("z", states.scaled(F.col("values"), _MEANS, _SCALES))
    return z.select("l_orderkey", "l_linenumber", "offset", F.col("day").cast("string").alias("day"), *((F.round(F.col("z")[i], 7) + 0.0).alias(k) for i, k in enumerate("abc")))


@BOOK.query(_SQL + "SELECT CASE WHEN water_temp IS NOT NULL AND rain IS NOT NULL THEN 'complete' WHEN water_temp IS NOT NULL OR rain IS NOT NULL THEN 'partial' ELSE 'missing' END AS access, count(*) AS n FROM x GROUP BY 1")
def station_access(t: Tables):
    d = _states(t)
    return d.groupBy(states.access(d, ["water_temp", "rain"]).alias("access")).agg(F.count("*").alias("n"))


@BOOK.query("WITH n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_name FROM nation) SELECT k AS episode, n_name FROM (SELECT CAST(unnest(range(0, 30)) AS BIGINT) AS k) JOIN n ON k * 10 % 24 = i")
def strided_episodes(t: Tables):
    # nations are a fixed table of 25 rows, numbered by their key
    return states.episodes(t("nation").select("n_nationkey", "n_name"), "n_nationkey", 25, 30).select("episode", "n_name")


@BOOK.query("SELECT count(*) AS n, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day, round(min(ln(1 + o_totalprice)), 8) AS log_low, round(max(ln(1 + o_totalprice)), 8) AS log_high FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-12-31'")
def scope_clip(t: Tables):
    o = t("orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    _, f = selection.scoped(o, "day", "o_totalprice", "1996-02-01", "1996-12-31")
    row = (f["n"], str(f["first_day"]), str(f["last_day"]), round(f["log_low"], 8), round(f["log_high"], 8))
    return o.sparkSession.createDataFrame([row], "n long, first_day string, last_day string, log_low double, log_high double")


@BOOK.query("SELECT 'test' AS asked, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 2 UNION ALL SELECT 'none', o_orderstatus, count(*) FROM orders GROUP BY 2")
def fallback_rows(t: Tables):
    o = t("orders")
    part = lambda label, status: selection.or_all(o, F.col("o_orderstatus") == status).groupBy("o_orderstatus").agg(F.count("*").alias("n")).select(F.lit(label).alias("asked"), "o_orderstatus", "n")
    return part("test", "P").unionByName(part("none", "Z"))


@BOOK.query("SELECT CASE WHEN contains(lower(p_name), 'anvil') THEN 'intake' WHEN contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'gizmo') THEN 'gate' ELSE 'other' END AS role, count(*) AS n FROM part GROUP BY 1")
def site_roles(t: Tables):
    return t("part").groupBy(selection.site_role(F.col("p_name"), {"intake": ("anvil",), "gate": ("bolt", "gizmo")}).alias("role")).agg(F.count("*").alias("n"))


@BOOK.query("SELECT CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) ELSE 'root' END AS category, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'x' || doc_id ELSE source || '/' || lang || '/' || doc_id END AS p, n_chars FROM documents) GROUP BY 1")
def artifact_categories(t: Tables):
    path = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("x"), "doc_id")).otherwise(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
    return selection.artifacts(t("documents").select(path.alias("path"), "n_chars"), "path", "n_chars")


@BOOK.query("SELECT p_partkey, least(greatest(p_size, 5), 40) AS dose, least(greatest(p_retailprice / 1000, 0), 1.5) AS ratio FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL")
def candidate_frame(t: Tables):
    p = t("part").select("p_partkey", F.col("p_size").cast("double"), (F.col("p_retailprice") / 1000).alias("ratio"))
    c = selection.candidates(p, {"p_size": "dose"}, {"dose": (5.0, 40.0), "ratio": (0.0, 1.5)})
    return c.select("p_partkey", F.col("dose").cast("int").alias("dose"), "ratio")


@BOOK.query(
    "WITH c AS (SELECT p_brand, p_type, p_retailprice AS price, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY abs(p_size - 25), p_retailprice) AS k FROM part WHERE p_partkey % 3 = 0), t AS (SELECT p_brand, p_type, min(p_retailprice) AS price FROM part GROUP BY 1, 2) SELECT t.p_brand, t.p_type, round(coalesce(c.price, t.price), 4) AS price FROM t LEFT JOIN c ON t.p_brand = c.p_brand AND t.p_type = c.p_type AND k = 1"
)
def technique_prices(t: Tables):
    p = t("part")
    cases = p.where("p_partkey % 3 = 0").select("p_brand", "p_type", F.abs(F.col("p_size") - 25).alias("d"), F.col("p_retailprice").alias("price"))
    offers = p.groupBy("p_brand", "p_type").agg(F.min("p_retailprice").alias("price"))
    return selection.priced(p, offers, cases, "p_brand", "p_type", "d", "price").select("p_brand", "p_type", F.round("price", 4).alias("price"))


@BOOK.query("SELECT l_orderkey, l_linenumber, concat_ws(', ', CASE WHEN l_quantity > 0 AND l_quantity <= 40 THEN 'q=' || CAST(l_quantity AS VARCHAR) END, CASE WHEN l_tax > 0 AND l_tax <= 0.05 THEN 't=' || CAST(l_tax AS VARCHAR) END) AS phrase FROM lineitem WHERE l_orderkey % 10 = 0")
def state_phrases(t: Tables):
    d = t("lineitem").where("l_orderkey % 10 = 0")
    return d.select("l_orderkey", "l_linenumber", selection.phrases([("q", F.col("l_quantity"), 4.0), ("t", F.col("l_tax"), 0.005)]).alias("phrase"))


@BOOK.query(
    "WITH h AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT user_id, max(day) AS last FROM h GROUP BY 1), w AS (SELECT h.user_id, day, v FROM h JOIN m ON h.user_id = m.user_id WHERE day < last AND day > last - 21 UNION ALL SELECT user_id, last, 99.0 FROM m)"
    " SELECT user_id, CAST(day AS VARCHAR) AS day, round(avg(v) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 7) AS mean3 FROM w"
)
def live_windows(t: Tables):
    h = t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    live = h.groupBy("user_id").agg(F.max("day").alias("day")).withColumn("value", F.lit(99.0))
    w = states.live_window(h, live, "user_id", "day", 21)
    return w.select("user_id", F.col("day").cast("string").alias("day"), F.round(series.rolling("value", 3, F.avg, "user_id"), 7).alias("mean3"))


@BOOK.query("SELECT event_type, count(*) AS n, round(avg(coalesce(value, 0)), 8) AS value FROM events GROUP BY 1")
def episode_means(t: Tables):
    return states.episode_means(t("events"), "event_type", ["value"]).select("event_type", "n", F.round("value", 8).alias("value"))
