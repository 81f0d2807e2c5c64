"""Queries of joins between sources and of rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions import words
from rillspark.operators import joins, ranking, rollups
from rillspark.plans.book import Book, Tables

BOOK = Book()

_W = "w AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS reading FROM events WHERE user_id % 10 = 1 GROUP BY 1)"
_O = "o AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS price FROM orders GROUP BY 1)"
_L = "l AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS flow FROM lineitem GROUP BY 1)"


def _daily(t: Tables, table: str, ts: str, column, name: str, where: str = "true"):
    return t(table).where(where).groupBy(F.to_date(ts).alias("day")).agg(column.alias(name))


def _day(c: str = "day"):
    return F.col(c).cast("string").alias(c)


@BOOK.query(f"WITH {_O}, y AS (SELECT year(l_shipdate) AS y, avg(l_discount) AS ndti FROM lineitem WHERE year(l_shipdate) % 2 = 0 GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, round(price, 4) AS price, round(ndti, 8) AS ndti FROM o LEFT JOIN y ON year(day) = y")
def annual_to_daily(t: Tables):
    y = t("lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.avg("l_discount").alias("ndti")).where("year % 2 = 0")
    return joins.yearly_on_days(_daily(t, "orders", "o_orderdate", F.avg("o_totalprice"), "price"), y, "day", "year").select(_day(), F.round("price", 4).alias("price"), F.round("ndti", 8).alias("ndti"))


@BOOK.query(f"WITH {_O}, {_L} SELECT CAST(l.day AS VARCHAR) AS target_day, round(flow, 4) AS flow, round(price, 4) AS price FROM l LEFT JOIN o ON l.day = o.day")
def predictions_with_features(t: Tables):
    p = _daily(t, "lineitem", "l_shipdate", F.sum("l_quantity"), "flow").withColumnRenamed("day", "target_day")
    f = _daily(t, "orders", "o_orderdate", F.avg("o_totalprice"), "price")
    return p.join(f, F.col("target_day") == F.col("day"), "left").select(_day("target_day"), F.round("flow", 4).alias("flow"), F.round("price", 4).alias("price"))


@BOOK.query(f"WITH {_O}, {_L}, w AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_tax) AS tax FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT CAST(l.day AS VARCHAR) AS day, flow, round(price, 4) AS price, round(tax, 8) AS tax FROM l LEFT JOIN o USING (day) LEFT JOIN w USING (day)")
def station_sources(t: Tables):
    flow = _daily(t, "lineitem", "l_shipdate", F.sum("l_quantity"), "flow")
    price = _daily(t, "orders", "o_orderdate", F.avg("o_totalprice"), "price")
    tax = _daily(t, "lineitem", "l_shipdate", F.avg("l_tax"), "tax", "l_returnflag = 'R'")
    return joins.station_sources(flow, price, tax, "day").select(_day(), "flow", F.round("price", 4).alias("price"), F.round("tax", 8).alias("tax"))


@BOOK.query(f"WITH {_O}, {_L} SELECT CAST(o.day AS VARCHAR) AS day, round(price, 4) AS water_price, flow AS weather_flow, CAST(12.5 AS DOUBLE) AS distance_km FROM o JOIN l USING (day)")
def proxy_days(t: Tables):
    p = joins.proxied(_daily(t, "orders", "o_orderdate", F.avg("o_totalprice"), "price"), _daily(t, "lineitem", "l_shipdate", F.sum("l_quantity"), "flow"), "day", 12.5)
    return p.select(_day(), F.round("water_price", 4).alias("water_price"), "weather_flow", "distance_km")


_KM = "6371.0 * 2 * atan2(sqrt(h), sqrt(greatest(1 - h, 1e-12)))"


@BOOK.query(
    "WITH d AS (SELECT DISTINCT l_suppkey AS s, CAST(l_shipdate AS DATE) AS day FROM lineitem), g AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_custkey % 5 = 0), c AS (SELECT s, count(*) AS overlap FROM d JOIN g USING (day) GROUP BY 1),"
    " h AS (SELECT s_suppkey AS s, coalesce(overlap, 0) AS overlap, pow(sin(radians(s_suppkey % 80 - 31) / 2), 2) + cos(radians(31)) * cos(radians(s_suppkey % 80)) * pow(sin(radians(s_suppkey % 170 - 121) / 2), 2) AS h FROM supplier LEFT JOIN c ON s = s_suppkey)"
    f" SELECT s, overlap, round({_KM}, 4) AS km, row_number() OVER (ORDER BY overlap DESC, {_KM}, s) AS rank FROM h ORDER BY rank LIMIT 5"
)
def best_station(t: Tables):
    k = F.col("s_suppkey")
    places = t("supplier").select(k.alias("s"), (k % 80).alias("lat"), (k % 170).alias("lon"))
    days = t("lineitem").select(F.col("l_suppkey").alias("s"), F.to_date("l_shipdate").alias("day"))
    target = t("orders").where("o_custkey % 5 = 0").select(F.to_date("o_orderdate").alias("day"))
    return joins.ranked_stations(target, 31.0, 121.0, days, places, "s", "day").select("s", "overlap", F.round("km", 4).alias("km"), F.col("rank").cast("long").alias("rank"))


@BOOK.query(
    "WITH a AS (SELECT DISTINCT user_id AS k, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id AS k, CAST(ts AS DATE) AS e, event_type AS role FROM events WHERE event_type IN ('purchase', 'view')),"
    " u AS (SELECT DISTINCT k, e FROM b WHERE role = 'purchase' OR k NOT IN (SELECT k FROM b WHERE role = 'purchase')), j AS (SELECT a.k, d, e, e - d AS o, row_number() OVER (PARTITION BY a.k, d ORDER BY abs(e - d), e - d) AS r FROM a JOIN u ON a.k = u.k AND abs(e - d) <= 7)"
    " SELECT a.k, CAST(a.d AS VARCHAR) AS d, CAST(e AS VARCHAR) AS e, CASE WHEN o = 0 THEN 'exact_same_day' WHEN abs(o) = 1 THEN 'near_day' WHEN abs(o) <= 7 THEN 'same_week_context' ELSE 'no_field_label' END AS alignment, round(coalesce(exp(-abs(o) / CAST(3 AS DOUBLE)), 0), 8) AS confidence FROM a LEFT JOIN j ON a.k = j.k AND a.d = j.d AND r = 1"
)
def field_labels(t: Tables):
    e = t("events")
    a = e.where("event_type = 'click'").select(F.col("user_id").alias("k"), F.to_date("ts").alias("d")).distinct()
    b = e.where("event_type in ('purchase', 'view')").select(F.col("user_id").alias("k"), F.to_date("ts").alias("e"), F.col("event_type").alias("role")).distinct()
    return joins.labelled(a, b, "k", "d", "e", "role", "purchase").select("k", _day("d"), _day("e"), "alignment", F.round("confidence", 8).alias("confidence"))


_DOMAINS = {"cheap": ("red", "small"), "heavy": ("anvil", "bolt"), "large": ("large",), "tool": ("gizmo", "widget")}
_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(p_name), {chr(39)}{k}{chr(39)})' for k in ks)} THEN '{d}' END" for d, ks in _DOMAINS.items()) + "], lambda x: x IS NOT NULL)"
_PAIRS = f"t AS (SELECT {_TAGS} AS l, ['cheap', 'tool'] AS r, p_size AS w FROM part), u AS (SELECT unnest(l) AS a, r, w FROM t), v AS (SELECT a, unnest(r) AS b, w FROM u), x AS (SELECT a, b, w FROM v UNION ALL SELECT b, a, w FROM v WHERE a <> b), p AS (SELECT a, b, CAST(sum(w) AS BIGINT) AS weight FROM x GROUP BY 1, 2)"


def _domain_pairs(t: Tables):
    return joins.domain_pairs(t("part"), words.domains(F.col("p_name"), _DOMAINS), F.array(F.lit("cheap"), F.lit("tool")), F.col("p_size"))


@BOOK.query(f"WITH {_PAIRS} SELECT a, b, weight FROM p")
def domain_pair_weights(t: Tables):
    return _domain_pairs(t)


@BOOK.query(
    f"WITH {_PAIRS}, f AS (SELECT 'n' || n_nationkey AS name, CASE n_nationkey % 3 WHEN 0 THEN ['cheap', 'large'] WHEN 1 THEN ['tool'] ELSE ['heavy', 'cheap'] END AS d FROM nation), g AS (SELECT name, unnest(d) AS d FROM f),"
    " m AS (SELECT x.name AS a, y.name AS b, max(weight) AS weight FROM g x JOIN p ON x.d = p.a JOIN g y ON y.d = p.b AND x.name < y.name GROUP BY 1, 2) SELECT a, b, round(weight / (SELECT max(weight) FROM m), 8) AS prior FROM m"
)
def feature_prior(t: Tables):
    k = F.col("n_nationkey") % 3
    lists = [F.array(*map(F.lit, d)) for d in (("cheap", "large"), ("tool",), ("heavy", "cheap"))]
    f = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.when(k == 0, lists[0]).when(k == 1, lists[1]).otherwise(lists[2]).alias("domains"))
    return joins.feature_prior(f, _domain_pairs(t)).select("a", "b", F.round("prior", 8).alias("prior"))


@BOOK.query("WITH c AS (SELECT l_returnflag AS r, l_linestatus AS c, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2) SELECT r, c, round(w / sum(w) OVER (PARTITION BY r), 8) AS share FROM c")
def row_shares(t: Tables):
    c = t("lineitem").groupBy(F.col("l_returnflag").alias("r"), F.col("l_linestatus").alias("c")).agg(F.count("*").cast("double").alias("w"))
    return joins.row_normalised(c, "r", "w").select("r", "c", F.round("share", 8).alias("share"))


# -- rollups ------------------------------------------------------------------------------


@BOOK.query("SELECT (SELECT event_type FROM events WHERE event_type IS NOT NULL ORDER BY event_id LIMIT 1) AS event_type, (SELECT round(value, 6) FROM events WHERE value > 50 ORDER BY event_id LIMIT 1) AS value")
def first_known_values(t: Tables):
    e = t("events").select("event_id", "event_type", F.when(F.col("value") > 50, F.round("value", 6)).alias("value"))
    return rollups.first_known(e, ["event_type", "value"], "event_id")


@BOOK.query(
    "WITH a AS (SELECT lang AS k, source AS role, CASE WHEN n_chars % 3 = 0 THEN 'image' ELSE 'video' END AS kind, n_chars AS size, CAST(doc_id AS VARCHAR) AS name FROM documents), r AS (SELECT k, role, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, role) AS i FROM a GROUP BY 1, 2),"
    " n AS (SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY name) AS i FROM (SELECT DISTINCT k, name FROM a)) SELECT a.k, max(r.role) AS role, CAST(count_if(kind = 'image') AS BIGINT) AS n_image, CAST(count_if(kind = 'video') AS BIGINT) AS n_video, CAST(sum(size) AS BIGINT) AS bytes, round(avg(size), 6) AS size_mean, max(size) AS size_max, min(size) AS size_min,"
    " (SELECT string_agg(name, ';' ORDER BY name) FROM n WHERE n.k = a.k AND i <= 6) AS names FROM a JOIN r ON a.k = r.k AND r.i = 1 GROUP BY a.k"
)
def asset_rollup(t: Tables):
    a = t("documents").select(F.col("lang").alias("k"), F.col("source").alias("role"), F.when(F.col("n_chars") % 3 == 0, "image").otherwise("video").alias("kind"), F.col("n_chars").alias("size"), F.col("doc_id").cast("string").alias("name"))
    r = rollups.assets(a, "k", "role", "kind", ["image", "video"], "size", "name", ["size"])
    return r.select("k", "role", "n_image", "n_video", "bytes", F.round("size_mean", 6).alias("size_mean"), "size_max", "size_min", "names")


@BOOK.query("SELECT p_brand, p_type, round(avg(p_size), 8) AS p_size, round(avg(p_retailprice), 7) AS p_retailprice, array_to_string(list_sort(list_distinct(list(split_part(p_name, ' ', 1)))), ',') AS labels, bool_or(p_size > 45) AS any_flag, min(p_partkey) AS first_id FROM part GROUP BY 1, 2")
def policy_rollup(t: Tables):
    p = t("part").withColumn("word", F.split_part("p_name", F.lit(" "), F.lit(1)))
    r = rollups.policies(p, ["p_brand", "p_type"], ["p_size", "p_retailprice"], "word", F.col("p_size") > 45, "p_partkey")
    return r.select("p_brand", "p_type", F.round("p_size", 8).alias("p_size"), F.round("p_retailprice", 7).alias("p_retailprice"), "labels", "any_flag", "first_id")


_NAMES = [f"x{i}" for i in range(10)]


@BOOK.query(
    "WITH v AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT label, 'x' || i AS feature, round(avg(abs(CAST(v AS DOUBLE))), 7) AS saliency FROM v WHERE i < 10 GROUP BY 1, 2) SELECT label, feature, saliency FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY saliency DESC, feature) AS k FROM s) WHERE k <= 3"
)
def feature_importance(t: Tables):
    e = t("embeddings").select("label", F.slice(F.col("embedding").cast("array<double>"), 1, 10).alias("v"))
    r = rollups.importance(e, "label", "v", _NAMES, 10).withColumn("saliency", F.round("saliency", 7))
    return ranking.top_of_each(r.drop("rank"), ["label"], [F.desc("saliency"), F.col("feature")], 3).select("label", "feature", "saliency")


_EFFECTS = {"quantity": "0.02 * l_quantity", "discount": "-8 * l_discount", "tax": "5 * l_tax", "bulk": "0.0001 * l_quantity * l_quantity"}


@BOOK.query(
    "WITH e AS (SELECT l_orderkey, l_linenumber, [" + ", ".join(f"{{'s': -abs({v}), 'n': '{k}', 'v': {v}}}" for k, v in _EFFECTS.items()) + "] AS p FROM lineitem) "
    "SELECT drivers, inhibitors, count(*) AS n FROM (SELECT array_to_string(list_transform(list_sort(list_filter(p, lambda x: x.v > 0))[1:3], lambda x: x.n), '|') AS drivers, array_to_string(list_transform(list_sort(list_filter(p, lambda x: x.v < 0))[1:3], lambda x: x.n), '|') AS inhibitors FROM e) GROUP BY 1, 2"
)
def driver_ranking(t: Tables):
    c = rollups.contributions(t("lineitem"), ["l_orderkey"], {k: F.expr(v).cast("double") for k, v in _EFFECTS.items()})
    return c.groupBy("drivers", "inhibitors").agg(F.count("*").alias("n"))


@BOOK.query(
    "WITH p AS (SELECT *, (l_quantity * 0.1 + 2) * (1 - l_discount) * (1 + l_tax) AS y FROM lineitem) SELECT feature, round(avg(effect), 7) AS effect FROM (SELECT 'l_quantity' AS feature, y - 2 * (1 - l_discount) * (1 + l_tax) AS effect FROM p UNION ALL SELECT 'l_discount', y - (l_quantity * 0.1 + 2) * (1 + l_tax) FROM p UNION ALL SELECT 'l_tax', y - (l_quantity * 0.1 + 2) * (1 - l_discount) FROM p) GROUP BY 1"
)
def zeroed_effects(t: Tables):
    names = ["l_quantity", "l_discount", "l_tax"]
    e = rollups.zeroed(t("lineitem"), names, lambda c: (c["l_quantity"] * 0.1 + 2) * (1 - c["l_discount"]) * (1 + c["l_tax"]))
    return t("lineitem").agg(F.array(*(F.struct(F.lit(k).alias("feature"), F.round(F.avg(v), 7).alias("effect")) for k, v in e.items())).alias("r")).select(F.inline("r"))


@BOOK.query("SELECT p_brand, p_type, p_size % 3 AS env, count(p_retailprice) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1, 2, 3")
def tensor_cells(t: Tables):
    p = t("part").withColumn("env", F.col("p_size") % 3)
    return rollups.tensor_cells(p, ["p_brand", "p_type", "env"], "p_retailprice").select("p_brand", "p_type", "env", "n", F.round("total", 2).alias("total"))


@BOOK.query("WITH m AS (SELECT l_linestatus, l_returnflag, avg(l_extendedprice) AS mae, avg(l_discount) AS r2 FROM lineitem GROUP BY 1, 2) SELECT l_linestatus, round(max(CASE WHEN l_returnflag = 'A' THEN mae END) - max(CASE WHEN l_returnflag = 'N' THEN mae END), 5) AS mae_delta, round(max(CASE WHEN l_returnflag = 'A' THEN r2 END) - max(CASE WHEN l_returnflag = 'N' THEN r2 END), 9) AS r2_delta FROM m GROUP BY 1")
def ablation_deltas(t: Tables):
    m = t("lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.avg("l_extendedprice").alias("mae"), F.avg("l_discount").alias("r2"))
    return rollups.differences(m, ["l_linestatus"], "l_returnflag", "A", "N", ["mae", "r2"]).select("l_linestatus", F.round("mae_delta", 5).alias("mae_delta"), F.round("r2_delta", 9).alias("r2_delta"))


@BOOK.query("SELECT quality, CAST(min(toxic) AS BIGINT) AS low, CAST(median(toxic) AS DOUBLE) AS middle, CAST(max(toxic) AS BIGINT) AS high FROM labels GROUP BY 1")
def label_statistics(t: Tables):
    return rollups.spread(t("labels"), "toxic", "quality").select("quality", F.col("low").cast("long").alias("low"), F.col("middle").cast("double").alias("middle"), F.col("high").cast("long").alias("high"))


@BOOK.query(
    "SELECT l_returnflag, round(avg(CASE WHEN abs(l_extendedprice - l_quantity * 1500) <= greatest(2000, 0.25 * abs(l_extendedprice)) THEN 1.0 ELSE 0.0 END), 8) AS success, round(avg(least(greatest(abs(l_discount - 0.05) / greatest(0.05, 1e-6), 0.15), 1)), 8) AS confidence FROM lineitem GROUP BY 1"
)
def success_rates(t: Tables):
    c = rollups.label_confidence(F.col("l_discount"), F.lit(0.05))
    return t("lineitem").groupBy("l_returnflag").agg(F.round(rollups.success(F.col("l_extendedprice"), F.col("l_quantity") * 1500, 2000.0, 0.25), 8).alias("success"), F.round(F.avg(c), 8).alias("confidence"))


@BOOK.query(
    "SELECT readiness, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NOT NULL AND i > 0 AND v > 0 THEN 'full_fusion' WHEN l.doc_id IS NOT NULL AND i > 0 THEN 'image_fusion' WHEN i > 0 OR v > 0 THEN 'visual_only' WHEN l.doc_id IS NOT NULL THEN 'label_only' ELSE 'not_ready' END AS readiness FROM (SELECT doc_id, n_chars % 3 AS i, n_chars % 2 AS v FROM documents) d LEFT JOIN labels l USING (doc_id)) GROUP BY 1"
)
def fusion_readiness(t: Tables):
    d = t("documents").select("doc_id", (F.col("n_chars") % 3).alias("i"), (F.col("n_chars") % 2).alias("v")).join(t("labels").select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    return d.groupBy(rollups.readiness(F.col("has").isNotNull(), F.col("i"), F.col("v")).alias("readiness")).agg(F.count("*").alias("n"))


_LIMITS = {"l_quantity": 45.0, "l_discount": 0.09, "l_tax": 0.07}


@BOOK.query("SELECT feature, count(*) AS n, round(sum(value / threshold), 5) AS ratio FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, {k} AS value, CAST({v} AS DOUBLE) AS threshold FROM lineitem" for k, v in _LIMITS.items()) + ") WHERE value > threshold GROUP BY 1")
def threshold_breaches(t: Tables):
    return rollups.breaches(t("lineitem"), ["l_orderkey"], _LIMITS).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum("ratio"), 5).alias("ratio"))


@BOOK.query("SELECT l_returnflag, round(avg(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 30 THEN (l_quantity - 10) * 0.03 WHEN l_quantity < 50 THEN 0.6 + (l_quantity - 30) * 0.02 ELSE 1 END), 8) AS runoff FROM lineitem GROUP BY 1")
def piecewise_terms(t: Tables):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.avg(rollups.piecewise(F.col("l_quantity"), [(10, 0.0), (30, 0.6), (50, 1.0)])), 8).alias("runoff"))


@BOOK.query("SELECT p_partkey, CAST(greatest(CASE WHEN contains(lower(p_name || ' ' || p_type), 'large') THEN 0.9 ELSE 0 END, CASE WHEN contains(lower(p_name || ' ' || p_type), 'red') THEN 0.5 ELSE 0 END) AS DOUBLE) AS turbidity, CAST(CASE WHEN contains(lower(p_name || ' ' || p_type), 'medium') THEN 0.4 ELSE 0 END AS DOUBLE) AS cost FROM part")
def effect_scores(t: Tables):
    e = rollups.effect_scores(F.concat_ws(" ", "p_name", "p_type"), {"turbidity": (("large", 0.9), ("red", 0.5)), "cost": (("medium", 0.4),)})
    return t("part").select("p_partkey", *(c.alias(k) for k, c in e.items()))


@BOOK.query(
    "WITH b AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d, min(p_partkey % 7) AS e, max(p_partkey % 7) AS f FROM part) SELECT p_partkey, round(0.45 * (p_size - a) / greatest(b - a, 1e-12) + 0.35 * (1 - (p_retailprice - c) / greatest(d - c, 1e-12)) + 0.2 * (p_partkey % 7 - e) / greatest(f - e, 1e-12), 8) AS balanced FROM part, b"
)
def balanced_scores(t: Tables):
    p = t("part").withColumn("k", F.col("p_partkey") % 7)
    return rollups.balanced(p, {"p_size": 0.45, "p_retailprice": 0.35, "k": 0.2}, ["p_retailprice"]).select("p_partkey", F.round("balanced", 8).alias("balanced"))
