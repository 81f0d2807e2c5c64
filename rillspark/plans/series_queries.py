"""Queries over daily series: events are the readings of stations, orders a second source."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions import scores
from rillspark.operators import measures, quantiles, series
from rillspark.plans.book import Book, Tables

BOOK = Book()
#: Daily readings of stations, and daily order totals, as SQL.
EV = "d AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"
OD = "d AS (SELECT o_orderstatus AS s, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"
W = "PARTITION BY user_id ORDER BY day"
WS = "PARTITION BY s ORDER BY day"


def _day():
    return F.date_format("day", "yyyy-MM-dd").alias("day")


def _stations(t: Tables):
    return series.daily(t("events"), "ts", "value", "user_id")


def _orders(t: Tables):
    return series.daily(t("orders").withColumnRenamed("o_orderstatus", "s"), "o_orderdate", "o_totalprice", "s")


@BOOK.query(
    f"""WITH {EV}, q AS (SELECT quantile_cont(value, CAST(1 AS DOUBLE) / 3) AS a, quantile_cont(value, CAST(2 AS DOUBLE) / 3) AS b FROM d)
SELECT user_id, CAST(day AS VARCHAR) AS day, round(value, 6) AS value, round(sum(value) OVER ({W} ROWS 2 PRECEDING), 6) AS sum3,
 round(sum(value) OVER ({W} ROWS 6 PRECEDING), 6) AS sum7, round(coalesce(value - lag(value) OVER ({W}), 0), 6) AS change,
 CASE WHEN value <= a THEN 'low' WHEN value <= b THEN 'mid' ELSE 'high' END AS label FROM d, q"""
)
def daily_station_profile(t: Tables):
    d = _stations(t)
    q = quantiles.quantiles(d, "value", {"a": 1 / 3, "b": 2 / 3})  # one row
    return d.crossJoin(F.broadcast(q)).select(
        "user_id",
        _day(),
        scores.rounded(F.col("value"), 6).alias("value"),
        scores.rounded(series.rolling("value", 3, F.sum, "user_id"), 6).alias("sum3"),
        scores.rounded(series.rolling("value", 7, F.sum, "user_id"), 6).alias("sum7"),
        scores.rounded(series.difference("value", "user_id"), 6).alias("change"),
        scores.tertile(F.col("value"), F.col("a"), F.col("b")).alias("label"),
    )


@BOOK.query("SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def daily_mean(t: Tables):
    return series.daily(t("events"), "ts", "value", "event_type").select("event_type", _day(), F.round("value", 6).alias("value"))


@BOOK.query(f"WITH {EV} SELECT user_id, CAST(day AS VARCHAR) AS day, round(avg(value) OVER ({W} ROWS 6 PRECEDING), 6) AS mean7, round(value - avg(value) OVER ({W} ROWS 6 PRECEDING), 6) AS anomaly FROM d")
def rolling_mean_anomaly(t: Tables):
    mean = series.rolling("value", 7, F.avg, "user_id")
    return _stations(t).select("user_id", _day(), F.round(mean, 6).alias("mean7"), F.round(F.col("value") - mean, 6).alias("anomaly"))


@BOOK.query(f"WITH {EV}, c AS (SELECT *, coalesce(value - lag(value) OVER ({W}), 0) AS ch FROM d) SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(ch > 0 AS BIGINT) AS rise, CAST(ch < 0 AS BIGINT) AS fall FROM c")
def day_diff_flags(t: Tables):
    d = _stations(t).withColumn("ch", series.difference("value", "user_id"))
    return d.select("user_id", _day(), (F.col("ch") > 0).cast("long").alias("rise"), (F.col("ch") < 0).cast("long").alias("fall"))


@BOOK.query(
    f"""WITH {OD}, p AS (SELECT s, day, CASE WHEN day(day) % 3 = 0 THEN NULL ELSE value END AS v, row_number() OVER ({WS}) AS i FROM d),
n AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER ({WS} ROWS UNBOUNDED PRECEDING) AS ia,
 min(CASE WHEN v IS NOT NULL THEN i END) OVER ({WS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM p)
SELECT n.s, CAST(n.day AS VARCHAR) AS day, round(coalesce(n.v, a.v + (b.v - a.v) * (n.i - n.ia) / nullif(n.ib - n.ia, 0), a.v, b.v), 4) AS filled
FROM n LEFT JOIN p a ON a.s = n.s AND a.i = n.ia LEFT JOIN p b ON b.s = n.s AND b.i = n.ib"""
)
def interpolate_linear(t: Tables):
    d = _orders(t).withColumn("v", F.when(F.dayofmonth("day") % 3 != 0, F.col("value")))
    return series.interpolated(d, "v", "s").select("s", _day(), F.round("v_filled", 4).alias("filled"))


@BOOK.query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS o, max(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS p FROM orders GROUP BY 1")
def pivot_status(t: Tables):
    wide = t("orders").groupBy(F.to_date("o_orderdate").alias("day")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_orderkey"))
    return wide.select(_day(), F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@BOOK.query(
    f"""WITH {EV}, w AS (SELECT user_id, day, lag(day, 2) OVER ({W}) AS a, lead(day, 1) OVER ({W}) AS b, lead(value, 1) OVER ({W}) AS y,
 sum(value) OVER ({W} ROWS 2 PRECEDING) AS x FROM d)
SELECT user_id, CAST(day AS VARCHAR) AS day, round(x, 6) AS window_sum, round(y, 6) AS target FROM w WHERE b - a = 3"""
)
def sliding_samples_contiguous(t: Tables):
    w = series.contiguous_windows(_stations(t), "value", 3, 1, "user_id")
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return w.select("user_id", _day(), F.round(total, 6).alias("window_sum"), F.round("target", 6).alias("target"))


@BOOK.query(
    f"""WITH {OD}, w AS (SELECT *, lag(value) OVER ({WS}) AS p, lead(value) OVER ({WS}) AS n FROM d)
SELECT s, CAST(day AS VARCHAR) AS day, coalesce(value > 1.5 * p, false) AS surge, coalesce(value > p AND n > value, false) AS no_recovery, coalesce((value - p) * (n - value) < 0, false) AS turning FROM w"""
)
def aux_event_labels(t: Tables):
    w = series.by_day("s")
    d = _orders(t).withColumns({"p": F.lag("value").over(w), "n": F.lead("value").over(w)})
    rules = {"surge": "value > 1.5 * p", "no_recovery": "value > p and n > value", "turning": "(value - p) * (n - value) < 0"}
    return d.select("s", _day(), *(F.coalesce(F.expr(r), F.lit(False)).alias(k) for k, r in rules.items()))


_SPLIT = f"{OD}, x AS (SELECT *, row_number() OVER ({WS}) AS i, count(*) OVER (PARTITION BY s) AS n FROM d), sp AS (SELECT s, day, value, CASE WHEN i <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN i <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'valid' ELSE 'test' END AS split FROM x)"


@BOOK.query(f"WITH {_SPLIT} SELECT s, split, count(*) AS n, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM sp GROUP BY 1, 2")
def chrono_split(t: Tables):
    d = series.chronological_split(_orders(t), 0.7, 0.15, "s").groupBy("s", "split").agg(F.count("*").alias("n"), F.min("day").alias("a"), F.max("day").alias("b"))
    return d.select("s", "split", "n", F.col("a").cast("string").alias("first_day"), F.col("b").cast("string").alias("last_day"))


@BOOK.query(f"WITH {_SPLIT}, f AS (SELECT s, avg(value) AS m, stddev_pop(value) AS d FROM sp WHERE split = 'train' GROUP BY 1) SELECT sp.s, CAST(day AS VARCHAR) AS day, split, round((value - m) / greatest(f.d, 1e-6), 6) AS scaled FROM sp JOIN f ON sp.s = f.s")
def zscore_train_fit(t: Tables):
    d = series.chronological_split(_orders(t), 0.7, 0.15, "s")
    return series.standardized(d, "value", F.col("split") == "train", "s").select("s", _day(), "split", F.round("scaled", 6).alias("scaled"))


_METRICS = "round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)), 6) AS r2, round(avg(abs(p - y) / CASE WHEN abs(y) < 1e-6 THEN 1 ELSE abs(y) END), 6) AS mape"


def _rounded():
    mae, rmse, r2, mape = measures.regression("y", "p")
    return F.round(mae, 4).alias("mae"), F.round(rmse, 4).alias("rmse"), F.round(r2, 6).alias("r2"), F.round(mape, 6).alias("mape")


@BOOK.query(f"WITH {_SPLIT}, l AS (SELECT s, split, value AS y, lag(value) OVER ({WS}) AS p FROM sp) SELECT split, {_METRICS} FROM l WHERE p IS NOT NULL GROUP BY split")
def persistence_forecast_metrics(t: Tables):
    d = series.chronological_split(_orders(t), 0.7, 0.15, "s")
    p = d.select("split", F.col("value").alias("y"), F.lag("value").over(series.by_day("s")).alias("p")).where("p is not null")
    return p.groupBy("split").agg(*_rounded())


@BOOK.query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k, value - lag(value) OVER ({W}) AS delta FROM d) SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(max(CASE WHEN k = 1 THEN value END), 6) AS latest, round(max(CASE WHEN k = 1 THEN delta END), 6) AS delta FROM r WHERE k <= 5 GROUP BY 1")
def last_n_latest_delta(t: Tables):
    w = series.by_day("user_id")
    d = _stations(t).withColumns({"delta": F.col("value") - F.lag("value").over(w), "k": F.row_number().over(w.orderBy(F.desc("day")))}).where("k <= 5")
    first = lambda c: F.round(F.max(F.when(F.col("k") == 1, F.col(c))), 6)
    return d.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), first("value").alias("latest"), first("delta").alias("delta"))


@BOOK.query("SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, round(sin(2 * pi() * dayofyear(o_orderdate) / CAST(365.25 AS DOUBLE)), 9) AS s, round(cos(2 * pi() * dayofyear(o_orderdate) / CAST(365.25 AS DOUBLE)), 9) AS c FROM orders")
def cyclic_calendar(t: Tables):
    s, c = scores.cyclic_day(F.col("day"))
    return t("orders").select(F.to_date("o_orderdate").alias("day")).distinct().select(_day(), F.round(s, 9).alias("s"), F.round(c, 9).alias("c"))


@BOOK.query(f"WITH {OD}, x AS (SELECT *, row_number() OVER ({WS}) AS i, count(*) OVER (PARTITION BY s) AS n FROM d) SELECT s, CAST(day AS VARCHAR) AS day FROM x WHERE (i - 1) % 10 = 0 OR i > n - 5")
def stride_sample_dense_tail(t: Tables):
    return series.strided_with_tail(_orders(t), 10, 5, "s").select("s", _day())


@BOOK.query("SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY ts, event_id) AS seq FROM events")
def sequence_number(t: Tables):
    w = F.row_number().over(series.Window.partitionBy(F.to_date("ts"), "event_type").orderBy("ts", "event_id"))
    return t("events").select("event_id", w.cast("long").alias("seq"))


@BOOK.query(f"WITH {OD}, m AS (SELECT min(value) AS a, max(value) AS b FROM d) SELECT s, CAST(day AS VARCHAR) AS day, round(1 - (value - a) / greatest(b - a, 1e-6), 6) AS clearness FROM d, m")
def minmax_clearness(t: Tables):
    d = _orders(t)
    m = d.agg(F.min("value").alias("a"), F.max("value").alias("b"))  # one row
    return d.crossJoin(F.broadcast(m)).select("s", _day(), F.round(1 - (F.col("value") - F.col("a")) / F.greatest(F.col("b") - F.col("a"), F.lit(1e-6)), 6).alias("clearness"))


@BOOK.query(f"WITH {EV} SELECT user_id, count(*) AS present, CAST(max(day) - min(day) + 1 - count(*) AS BIGINT) AS gaps FROM d GROUP BY 1")
def gap_days(t: Tables):
    return _stations(t).groupBy("user_id").agg(F.count("*").alias("present"), (F.datediff(F.max("day"), F.min("day")) + 1 - F.count("*")).cast("long").alias("gaps"))


@BOOK.query("SELECT event_type, CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window_batch(t: Tables):
    w = t("events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "total")


@BOOK.query(
    f"""WITH {OD}, c AS (SELECT s, month(day) AS m, CASE WHEN day(day) <= 10 THEN 'early' WHEN day(day) <= 20 THEN 'middle' ELSE 'late' END AS part, value FROM d)
SELECT s, CAST(m AS BIGINT) AS m, part, round(median(value), 4) AS med, round(quantile_cont(value, CAST(0.75 AS DOUBLE)) - quantile_cont(value, CAST(0.25 AS DOUBLE)), 4) AS iqr FROM c GROUP BY ALL"""
)
def context_median_iqr(t: Tables):
    d = _orders(t).select("s", F.month("day").cast("long").alias("m"), scores.month_part(F.col("day")).alias("part"), "value")
    p = lambda q: F.percentile("value", F.lit(q))
    return d.groupBy("s", "m", "part").agg(F.round(p(0.5), 4).alias("med"), F.round(p(0.75) - p(0.25), 4).alias("iqr"))


@BOOK.query(
    f"""WITH {OD}, c AS (SELECT s, month(day) AS m, CASE WHEN day(day) <= 10 THEN 'early' WHEN day(day) <= 20 THEN 'middle' ELSE 'late' END AS part, day, value FROM d),
f AS (SELECT s, m, part, avg(value) AS v FROM c WHERE year(day) < 1997 GROUP BY ALL), g AS (SELECT s, m, avg(value) AS v FROM c WHERE year(day) < 1997 GROUP BY ALL)
SELECT c.s, CAST(c.day AS VARCHAR) AS day, round(coalesce(f.v, g.v), 4) AS usual FROM c LEFT JOIN f ON c.s = f.s AND c.m = f.m AND c.part = f.part LEFT JOIN g ON c.s = g.s AND c.m = g.m WHERE year(c.day) >= 1997"""
)
def seasonal_context(t: Tables):
    d = _orders(t).withColumns({"m": F.month("day"), "part": scores.month_part(F.col("day"))})
    past = d.where(F.year("day") < 1997)
    fine = past.groupBy("s", "m", "part").agg(F.avg("value").alias("fine"))
    rough = past.groupBy("s", "m").agg(F.avg("value").alias("rough"))
    return d.where(F.year("day") >= 1997).join(fine, ["s", "m", "part"], "left").join(rough, ["s", "m"], "left").select("s", _day(), F.round(F.coalesce("fine", "rough"), 4).alias("usual"))


@BOOK.query(f"WITH {OD} SELECT s, CAST(day AS VARCHAR) AS day, round(coalesce(p.value, d.value), 4) AS value FROM d LEFT JOIN (SELECT day AS pd, value FROM d WHERE s = 'P') p ON d.day = p.pd WHERE s = 'O'")
def combine_first_calendar(t: Tables):
    d = _orders(t)
    sampled = d.where("s = 'P'").select("day", F.col("value").alias("sampled"))
    return d.where("s = 'O'").join(sampled, "day", "left").select("s", _day(), F.round(F.coalesce("sampled", "value"), 4).alias("value"))


@BOOK.query(
    f"""WITH {OD}, st AS (SELECT s, avg(value) AS m, greatest(stddev_samp(value), 1e-6) AS sd FROM d GROUP BY 1), z AS (SELECT d.s, day, (value - m) / sd AS v FROM d JOIN st ON d.s = st.s),
w AS (SELECT s, day, v, lag(v) OVER ({WS}) AS v1, max(day) OVER (PARTITION BY s) AS last FROM z), t AS (SELECT s, v, v1 FROM w WHERE day = last),
r AS (SELECT w.s, w.day, round(sqrt((w.v - t.v) * (w.v - t.v) + (w.v1 - t.v1) * (w.v1 - t.v1)), 9) AS distance FROM w JOIN t ON w.s = t.s WHERE w.day < w.last AND w.v1 IS NOT NULL)
SELECT s, CAST(day AS VARCHAR) AS day, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY distance, day) AS k FROM r) WHERE k <= 5"""
)
def analog_topk(t: Tables):
    from rillspark.operators.ranking import top_of_each

    d = _orders(t)
    st = d.groupBy("s").agg(F.avg("value").alias("m"), F.greatest(F.stddev_samp("value"), F.lit(1e-6)).alias("sd"), F.max("day").alias("last"))
    z = d.join(st, "s").withColumn("v", (F.col("value") - F.col("m")) / F.col("sd")).withColumn("v1", F.lag("v").over(series.by_day("s")))
    now = z.where("day = last").select("s", F.col("v").alias("tv"), F.col("v1").alias("tv1"))
    r = z.where("day < last and v1 is not null").join(now, "s").withColumn("distance", F.round(F.sqrt((F.col("v") - F.col("tv")) * (F.col("v") - F.col("tv")) + (F.col("v1") - F.col("tv1")) * (F.col("v1") - F.col("tv1"))), 9))
    return top_of_each(r, ["s"], [F.col("distance"), F.col("day")], 5).select("s", _day(), F.round("distance", 6).alias("distance"))
