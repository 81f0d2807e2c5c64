"""Queries that join, filter, page, deduplicate, rank and summarise records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillspark.functions import scores
from rillspark.operators import graph, measures, quantiles, ranking, series
from rillspark.plans.book import Book, Tables

BOOK = Book()
L = "lineitem"


@BOOK.query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_name), '7') AND c_acctbal > 0 ORDER BY c_custkey LIMIT 20 OFFSET 10")
def keyword_page_query(t: Tables):
    hit = t("customer").where(F.lower("c_name").contains("7") & (F.col("c_acctbal") > 0))
    return hit.join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).orderBy("c_custkey").offset(10).limit(20).select("c_custkey", "c_name", "n_name")


@BOOK.query("SELECT count(*) AS n, count(DISTINCT c_nationkey) AS nations, round(avg(c_acctbal), 6) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer WHERE contains(lower(c_name), '7')")
def query_summary(t: Tables):
    return t("customer").where(F.lower("c_name").contains("7")).agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("nations"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@BOOK.query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, min(c_custkey) AS first_key, max(c_custkey) AS last_key FROM customer GROUP BY 1")
def catalogue_summary(t: Tables):
    return t("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key"))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@BOOK.query(
    "WITH p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN var_pop({a}) > 1e-12 AND var_pop({b}) > 1e-12 THEN corr({a}, {b}) END AS r FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]) + ") SELECT a, b, round(r, 8) AS r FROM p WHERE r IS NOT NULL ORDER BY abs(r) DESC, a, b LIMIT 6"
)
def correlations_topk(t: Tables):
    return measures.correlations(t(L), _NUM, 6).select("a", "b", F.round("r", 8).alias("r"))


@BOOK.query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, CAST(0.1 AS DOUBLE)), 6) AS q10, round(quantile_cont(l_extendedprice, CAST(0.5 AS DOUBLE)), 6) AS q50, round(quantile_cont(l_extendedprice, CAST(0.9 AS DOUBLE)), 6) AS q90 FROM lineitem GROUP BY 1")
def quantile_interp(t: Tables):
    q = quantiles.quantiles(t(L), "l_extendedprice", {f"q{k}": k / 100 for k in (10, 50, 90)}, "l_returnflag")
    return q.select("l_returnflag", *(F.round(f"q{k}", 6).alias(f"q{k}") for k in (10, 50, 90)))


@BOOK.query("WITH q AS (SELECT quantile_cont(l_quantity, CAST(1 AS DOUBLE) / 3) AS a, quantile_cont(l_quantity, CAST(2 AS DOUBLE) / 3) AS b FROM lineitem) SELECT CASE WHEN l_quantity <= a THEN 'low' WHEN l_quantity <= b THEN 'mid' ELSE 'high' END AS label, count(*) AS n FROM lineitem, q GROUP BY 1")
def tertile_label(t: Tables):
    q = quantiles.quantiles(t(L), "l_quantity", {"a": 1 / 3, "b": 2 / 3})  # one row
    return t(L).crossJoin(F.broadcast(q)).groupBy(scores.tertile(F.col("l_quantity"), F.col("a"), F.col("b")).alias("label")).agg(F.count("*").alias("n"))


@BOOK.query("WITH x AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem) SELECT l_returnflag, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)), 6) AS r2 FROM x GROUP BY 1")
def regression_metrics_by_split(t: Tables):
    mae, rmse, r2, _ = measures.regression("y", "p")
    x = t(L).select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"))
    return x.groupBy("l_returnflag").agg(F.round(mae, 4).alias("mae"), F.round(rmse, 4).alias("rmse"), F.round(r2, 6).alias("r2"))


_BIN = "count(*) AS n, round(avg(CAST(y = p AS DOUBLE)), 6) AS accuracy, round(coalesce(count_if(y AND p) / nullif(CAST(count_if(p) AS DOUBLE), 0), 0), 6) AS \"precision\", round(coalesce(count_if(y AND p) / nullif(CAST(count_if(y) AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * count_if(y AND p) / nullif(CAST(count_if(y) + count_if(p) AS DOUBLE), 0), 0), 6) AS f1"


def _labelled(t: Tables):
    j = t("labels").join(t("documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return j.select("lang", (F.col("quality") == 1).alias("y"), (F.col("n_chars") > 1000).alias("p"))


def _binary():
    cols = measures.binary(F.col("y"), F.col("p"))[:4]
    return [F.count("*").alias("n"), *(F.round(c, 6).alias(k) for c, k in zip(cols, ("accuracy", "precision", "recall", "f1"), strict=True))]


_LAB = "WITH x AS (SELECT lang, quality = 1 AS y, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id)) "


@BOOK.query(_LAB + f"SELECT {_BIN} FROM x")
def binary_metrics(t: Tables):
    return _labelled(t).agg(*_binary())


@BOOK.query(_LAB + f"SELECT lang, {_BIN} FROM x GROUP BY GROUPING SETS ((lang), ())")
def two_level_metrics(t: Tables):
    x = _labelled(t)
    return x.groupingSets([[F.col("lang")], []], F.col("lang")).agg(*_binary())


@BOOK.query("SELECT l_returnflag, round(avg(l_tax), 9) AS mean, round(stddev_pop(l_tax), 9) AS sd_pop, round(stddev_samp(l_tax), 9) AS sd_samp, max(l_tax) AS top FROM lineitem GROUP BY 1")
def process_decomposition(t: Tables):
    return t(L).groupBy("l_returnflag").agg(F.round(F.avg("l_tax"), 9).alias("mean"), F.round(F.stddev_pop("l_tax"), 9).alias("sd_pop"), F.round(F.stddev_samp("l_tax"), 9).alias("sd_samp"), F.max("l_tax").alias("top"))


_EV = ["ts", "user_id", "event_type", "value", "props"]


@BOOK.query(" UNION ALL ".join(f"SELECT '{c}' AS field, CAST(count_if({c} IS NULL) AS BIGINT) AS missing, count(*) AS n FROM events" for c in _EV))
def missing_profile(t: Tables):
    return measures.missing_profile(t("events"), _EV)


@BOOK.query("SELECT event_type, CAST(count_if(value IS NULL) AS BIGINT) AS missing, CAST(count_if(value < 5 OR value > 95) AS BIGINT) AS out_of_range, round(avg(CASE WHEN value BETWEEN 5 AND 95 THEN value END), 6) AS mean FROM events GROUP BY 1")
def range_null_profile(t: Tables):
    inside = F.when(F.col("value").between(5, 95), F.col("value"))
    return t("events").groupBy("event_type").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(~F.col("value").between(5, 95)).alias("out_of_range"), F.round(F.avg(inside), 6).alias("mean"))


@BOOK.query(
    """WITH r AS (SELECT user_id, avg(CAST(value IS NULL AS DOUBLE)) AS m, avg(CAST(coalesce(value > 95, false) AS DOUBLE)) AS o, 1 - count(DISTINCT ts) / CAST(count(*) AS DOUBLE) AS d FROM events GROUP BY 1)
SELECT user_id, CASE WHEN m <= 0.05 AND o <= 0.01 AND d <= 0.01 THEN 'A' WHEN m <= 0.15 AND o <= 0.05 AND d <= 0.05 THEN 'B' WHEN m <= 0.35 AND o <= 0.15 THEN 'C' ELSE 'D' END AS grade FROM r"""
)
def quality_grade(t: Tables):
    r = t("events").groupBy("user_id").agg(F.avg(F.col("value").isNull().cast("double")).alias("m"), F.avg(F.coalesce(F.col("value") > 95, F.lit(False)).cast("double")).alias("o"), (1 - F.countDistinct("ts") / F.count("*")).alias("d"))
    return r.select("user_id", scores.grade(F.col("m"), F.col("o"), F.col("d")).alias("grade"))


@BOOK.query("SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity IS NOT NULL)")
def distinct_full_row(t: Tables):
    return t(L).where("l_quantity is not null").select("l_orderkey", "l_partkey", "l_quantity").distinct().agg(F.count("*").alias("n"))


@BOOK.query("WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS price FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS q FROM lineitem GROUP BY 1), c AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_discount) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT CAST(a.day AS VARCHAR) AS day, round(price, 2) AS price, q, round(d, 6) AS d FROM a JOIN b ON a.day = b.day JOIN c ON a.day = c.day")
def inner_daily_three_way(t: Tables):
    a = t("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("price"))
    ship = F.to_date("l_shipdate").alias("day")
    b = t(L).groupBy(ship).agg(F.sum("l_quantity").alias("q"))
    c = t(L).where("l_returnflag = 'R'").groupBy(ship).agg(F.avg("l_discount").alias("d"))
    return a.join(b, "day").join(c, "day").select(F.col("day").cast("string").alias("day"), F.round("price", 2).alias("price"), "q", F.round("d", 6).alias("d"))


@BOOK.query("SELECT d.doc_id, CAST(l.doc_id IS NOT NULL AS BIGINT) AS available, coalesce(CAST(quality AS BIGINT), 0) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_label_join_flag(t: Tables):
    lab = t("labels").select("doc_id", "quality", F.lit(1).alias("flag"))
    return t("documents").select("doc_id").join(lab, "doc_id", "left").select("doc_id", F.coalesce("flag", F.lit(0)).cast("long").alias("available"), F.coalesce("quality", F.lit(0)).cast("long").alias("quality"))


_HAV = "6371.0 * 2 * atan2(sqrt(h), sqrt(greatest(1 - h, 1e-12)))"


@BOOK.query(
    f"""WITH s AS (SELECT s_suppkey, s_nationkey * 7 % 90 AS la, s_nationkey * 13 % 180 AS lo FROM supplier), n AS (SELECT n_nationkey, n_nationkey * 11 % 90 AS lb, n_nationkey * 17 % 180 AS lp FROM nation),
p AS (SELECT s_suppkey, n_nationkey, pow(sin(radians(lb - la) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(lp - lo) / 2), 2) AS h FROM s, n),
r AS (SELECT *, round({_HAV}, 3) AS km FROM p) SELECT s_suppkey, n_nationkey, km FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY km, n_nationkey) AS k FROM r) WHERE k <= 3"""
)
def station_match_rank(t: Tables):
    s = t("supplier").select("s_suppkey", (F.col("s_nationkey") * 7 % 90).alias("la"), (F.col("s_nationkey") * 13 % 180).alias("lo"))
    n = t("nation").select("n_nationkey", (F.col("n_nationkey") * 11 % 90).alias("lb"), (F.col("n_nationkey") * 17 % 180).alias("lp"))
    # nations are a fixed table of 25 rows
    km = F.round(scores.haversine_km(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")), 3)
    return ranking.top_of_each(s.crossJoin(F.broadcast(n)).withColumn("km", km), ["s_suppkey"], [F.col("km"), F.col("n_nationkey")], 3).select("s_suppkey", "n_nationkey", "km")


@BOOK.query(
    """WITH a AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), b AS (SELECT DISTINCT o_custkey AS k, CAST(l_shipdate AS DATE) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
j AS (SELECT a.k, d, e, e - d AS o FROM a JOIN b ON a.k = b.k AND abs(e - d) <= 7)
SELECT k, CAST(d AS VARCHAR) AS d, CAST(e AS VARCHAR) AS e, CAST(o AS BIGINT) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY k, d ORDER BY abs(o), o) AS r FROM j) WHERE r = 1"""
)
def nearest_date_7d(t: Tables):
    o = t("orders")
    a = o.select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d")).distinct()
    b = t(L).join(o.select("o_orderkey", F.col("o_custkey").alias("k")), F.col("l_orderkey") == F.col("o_orderkey")).select("k", F.to_date("l_shipdate").alias("e")).distinct()
    return series.nearest_in_time(a, b, "k", "d", "e", 7).select("k", F.col("d").cast("string").alias("d"), F.col("e").cast("string").alias("e"), F.col("offset").cast("long").alias("gap"))


@BOOK.query("WITH m AS (SELECT l_linestatus, l_returnflag, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) SELECT l_linestatus, l_returnflag, round(v - max(CASE WHEN l_returnflag = 'N' THEN v END) OVER (PARTITION BY l_linestatus), 4) AS delta FROM m")
def baseline_delta_selfjoin(t: Tables):
    m = t(L).groupBy("l_linestatus", "l_returnflag").agg(F.avg("l_extendedprice").alias("v"))
    base = F.max(F.when(F.col("l_returnflag") == "N", F.col("v"))).over(Window.partitionBy("l_linestatus"))
    return m.select("l_linestatus", "l_returnflag", F.round(F.col("v") - base, 4).alias("delta"))


@BOOK.query("SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))")
def pareto_front(t: Tables):
    return ranking.skyline(t("part"), "p_retailprice", "p_size").select("p_partkey")


@BOOK.query("WITH s AS (SELECT p_retailprice AS x, max(p_size) AS y FROM part GROUP BY 1) SELECT x, CAST(max(y) OVER (ORDER BY x) AS BIGINT) AS envelope FROM s")
def running_max_envelope(t: Tables):
    s = t("part").groupBy(F.col("p_retailprice").alias("x")).agg(F.max("p_size").alias("y"))
    return quantiles.running_max(s, "x", "y").select("x", F.col("top").cast("long").alias("envelope"))


@BOOK.query("WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT a.p_brand AS a, b.p_brand AS b, greatest(a.n, b.n) AS top FROM b a JOIN b ON a.p_brand < b.p_brand")
def feature_pair_cross(t: Tables):
    b = t("part").groupBy("p_brand").agg(F.count("*").alias("n"))
    x, y = b.alias("x"), b.alias("y")
    return x.join(y, F.col("x.p_brand") < F.col("y.p_brand")).select(F.col("x.p_brand").alias("a"), F.col("y.p_brand").alias("b"), F.greatest("x.n", "y.n").alias("top"))


def _days(t: Tables, table: str, c: str):
    return t(table).select(F.to_date(c).cast("string").alias("day"))


@BOOK.query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders INTERSECT SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) FROM lineitem")
def intersect_dates(t: Tables):
    return _days(t, "orders", "o_orderdate").intersect(_days(t, L, "l_shipdate"))


@BOOK.query("SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day FROM lineitem EXCEPT SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders")
def except_dates(t: Tables):
    return _days(t, L, "l_shipdate").subtract(_days(t, "orders", "o_orderdate"))


@BOOK.query("SELECT src, count(*) AS n FROM (SELECT 'o' AS src FROM orders UNION ALL SELECT 'l' FROM lineitem) GROUP BY 1")
def union_all_sources(t: Tables):
    return t("orders").select(F.lit("o").alias("src")).unionByName(t(L).select(F.lit("l").alias("src"))).groupBy("src").agg(F.count("*").alias("n"))


@BOOK.query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def distinct_on_keep_first(t: Tables):
    return ranking.keep_first(t("orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@BOOK.query("SELECT source, k AS rank, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3")
def roundrobin_interleave(t: Tables):
    return ranking.interleaved(t("documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 3).select("source", F.col("rank").cast("long").alias("rank"), "doc_id")


@BOOK.query("WITH s AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS k FROM s) SELECT l_suppkey, l_partkey, q FROM r WHERE k <= 2 ORDER BY q DESC, l_suppkey, l_partkey LIMIT 8")
def per_group_cap_topk(t: Tables):
    s = t(L).groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return ranking.top_of_each(s, ["l_suppkey"], [F.desc("q"), F.col("l_partkey")], 2).orderBy(F.desc("q"), "l_suppkey", "l_partkey").limit(8).select("l_suppkey", "l_partkey", "q")


@BOOK.query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 25")
def priority_queue(t: Tables):
    return t("orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority")


@BOOK.query("SELECT o_custkey, max(o_orderkey) AS latest, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS done, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS latest_done FROM orders GROUP BY 1")
def latest_per_key(t: Tables):
    done = F.col("o_orderstatus") == "F"
    return t("orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("latest"), F.count_if(done).alias("done"), F.max(F.when(done, F.col("o_orderkey"))).alias("latest_done"))


@BOOK.query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) + grouping(o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_status(t: Tables):
    return t("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), (F.grouping("o_orderstatus") + F.grouping("o_orderpriority")).cast("long").alias("level"))


@BOOK.query("WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS t FROM orders), c AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY 1) SELECT o_custkey, CAST(t - d AS BIGINT) AS stale_days, t - d > 365 AS expired FROM c, m")
def staleness(t: Tables):
    d = t("orders").withColumn("d", F.to_date("o_orderdate"))
    last = d.agg(F.max("d").alias("t"))  # one row
    c = d.groupBy("o_custkey").agg(F.max("d").alias("d")).crossJoin(F.broadcast(last)).withColumn("stale_days", F.datediff("t", "d").cast("long"))
    return c.select("o_custkey", "stale_days", (F.col("stale_days") > 365).alias("expired"))


@BOOK.query("WITH w AS (SELECT o_custkey, o_orderkey, o_orderstatus AS b, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a FROM orders) SELECT a, b, a || b IN ('OP', 'PF', 'OF') AS allowed, count(*) AS n FROM w WHERE a IS NOT NULL AND a <> b GROUP BY ALL")
def transitions(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    s = t("orders").select(F.lag("o_orderstatus").over(w).alias("a"), F.col("o_orderstatus").alias("b")).where("a is not null and a != b")
    return s.groupBy("a", "b", F.concat("a", "b").isin("OP", "PF", "OF").alias("allowed")).agg(F.count("*").alias("n"))


@BOOK.query("WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderpriority, round(avg(o_totalprice), 4) AS cvar FROM r WHERE k <= greatest(1, floor(n * CAST(0.1 AS DOUBLE))) GROUP BY 1")
def cvar_tail(t: Tables):
    return quantiles.lower_tail_mean(t("orders"), "o_totalprice", 0.1, "o_orderpriority").select("o_orderpriority", F.round("tail", 4).alias("cvar"))


@BOOK.query("SELECT f AS flag, round(sum(l_extendedprice * w) / sum(w), 4) AS score FROM (SELECT l_returnflag AS f, l_extendedprice, CASE WHEN l_discount > 0 THEN l_discount ELSE 1 END AS w FROM lineitem) GROUP BY 1")
def weighted_mean(t: Tables):
    w = F.when(F.col("l_discount") > 0, F.col("l_discount")).otherwise(1.0)
    return t(L).groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.sum(F.col("l_extendedprice") * w) / F.sum(w), 4).alias("score"))


@BOOK.query("WITH e AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), n AS (SELECT a AS node FROM e UNION ALL SELECT b FROM e) SELECT node, count(*) AS degree FROM n GROUP BY 1")
def edge_degree(t: Tables):
    return graph.degrees(_edges(t), "a", "b")


def _edges(t: Tables):
    return t(L).select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))


@BOOK.query("SELECT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v, count(*) AS weight FROM lineitem GROUP BY 1, 2")
def undirected_count(t: Tables):
    return graph.multiplicities(t(L), "l_partkey", "l_suppkey")


@BOOK.query(
    """WITH e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), n AS (SELECT a AS node, b AS nb FROM e UNION SELECT b, a FROM e), k AS (SELECT node, count(*) AS k FROM n GROUP BY 1),
s0 AS (SELECT 'p1' AS node, CAST(1 AS DOUBLE) AS score), s1 AS (SELECT nb AS node, max(score * CAST(0.6 AS DOUBLE) / (1 + ln(1 + k))) AS score FROM s0 JOIN k USING (node) JOIN n USING (node) GROUP BY 1),
s2 AS (SELECT nb AS node, max(score * CAST(0.6 AS DOUBLE) / (1 + ln(1 + k))) AS score FROM s1 JOIN k USING (node) JOIN n USING (node) GROUP BY 1)
SELECT node, round(max(score), 9) AS score FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY 1"""
)
def two_hop_scores(t: Tables):
    e = _edges(t)
    seeds = e.sparkSession.createDataFrame([("p1", 1.0)], "node string, score double")
    return graph.two_hop(e, "a", "b", seeds, 0.6).select("node", F.round("score", 9).alias("score"))


@BOOK.query(
    """WITH e AS (SELECT DISTINCT s_nationkey AS a, 100 + n_regionkey AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey), r AS (SELECT b, min(a) AS m FROM e GROUP BY 1)
SELECT CAST(a AS BIGINT) AS node, CAST(m AS BIGINT) AS label FROM e JOIN r USING (b) UNION SELECT CAST(b AS BIGINT), CAST(m AS BIGINT) FROM r"""
)
def label_propagation(t: Tables):
    e = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").cast("long").alias("a"), (F.col("n_regionkey") + 100).cast("long").alias("b")).distinct()
    return graph.spread_labels(e, "a", "b")


@BOOK.query("WITH d AS (SELECT l_suppkey AS node, count(*) AS degree FROM lineitem GROUP BY 1) SELECT node, degree FROM d ORDER BY degree DESC, node LIMIT 10")
def subgraph_budget(t: Tables):
    return t(L).groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(10)


@BOOK.query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_payload(t: Tables):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@BOOK.query("SELECT a.o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = a.o_orderkey AND l.l_returnflag = 'R')")
def anti_lookup(t: Tables):
    return t("orders").select("o_orderkey").join(t(L).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
