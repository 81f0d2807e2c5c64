"""Queries of baselines: ridge windows, leave-one-out, analogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.operators import forecasts, lag_windows, leave_one_out, measures
from rillspark.plans.book import Book, Tables

BOOK = Book()
_D = "d AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS q, avg(l_discount) AS s, avg(l_tax) AS x FROM lineitem GROUP BY 1)"


def _days(t: Tables):
    return t("lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("s"), F.avg("l_tax").alias("x"))


_X = "w AS (SELECT day, q AS a, lag(q) OVER (ORDER BY day) AS b, lead(q) OVER (ORDER BY day) AS y FROM d), r AS (SELECT * FROM w WHERE b IS NOT NULL AND y IS NOT NULL), t AS (SELECT * FROM r WHERE day < DATE '1997-01-01'), m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) + 1 AS aa, var_pop(b) * count(*) + 1 AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS \"by\" FROM t), c AS (SELECT (ay * bb - \"by\" * ab) / (aa * bb - ab * ab) AS wa, (\"by\" * aa - ay * ab) / (aa * bb - ab * ab) AS wb, ma, mb, my FROM m)"


@BOOK.query(
    f"WITH {_D}, {_X}, p AS (SELECT y, greatest(my + wa * (a - ma) + wb * (b - mb), 0) AS p FROM r, c WHERE day >= DATE '1997-01-01') SELECT count(*) AS n, round(avg(abs(p - y)), 5) AS mae, round(sqrt(avg((p - y) * (p - y))), 5) AS rmse, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 7) AS r2 FROM p"
)
def ridge_window(t: Tables):
    d = forecasts.lagged(_days(t), "q", 2, 1)  # a row for each day
    early = F.col("day") < F.lit("1997-01-01").cast("date")
    names = ["lag_0", "lag_1"]
    model = forecasts.ridge(d.where(early), names, ["target"], 1.0)["target"]
    p = d.where(~early).withColumn("p", forecasts.predicted(names, model, low=0.0))
    return p.agg(F.count("*").alias("n"), *measures.regression("target", "p")).select("n", F.round("mae", 5).alias("mae"), F.round("rmse", 5).alias("rmse"), F.round("r2", 7).alias("r2"))


def _nations(t: Tables):
    c = t("customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("x1"), F.count("*").cast("double").alias("x2"))
    s = t("supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("x3"))
    n = t("nation").select("n_nationkey", (F.col("n_nationkey") * 3.0 + F.col("n_regionkey")).alias("y"), (F.col("n_nationkey") * 2.5).alias("base"))
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "x1", "x2", "x3", "y", "base")


@BOOK.query()
def leave_one_out_ridge(t: Tables):
    out = forecasts.leave_one_out(_nations(t), "n_nationkey", ["x1", "x2", "x3"], "y", "base")
    return out.select("n_nationkey", "actual", F.round("predicted", 6).alias("predicted"))


@BOOK.query()
def leave_one_out_residual(t: Tables):
    out = forecasts.leave_one_out(_nations(t), "n_nationkey", ["x1", "x2", "x3"], "y", "base", forecasts.residual_fold)
    return out.select("n_nationkey", "actual", F.round("predicted", 6).alias("predicted"))


@BOOK.query(
    f"WITH {_D}, sd AS (SELECT stddev_samp(q) AS sq, stddev_samp(s) AS ss, stddev_samp(x) AS sx FROM d), g AS (SELECT a.*, b.q AS following FROM d a JOIN d b ON b.day = a.day + 1), u AS (SELECT * FROM d WHERE day >= DATE '1998-01-01' AND day < DATE '1998-02-01'),"
    " p AS (SELECT u.day AS query_day, g.day, following, round(sqrt(pow((g.q - u.q) / sq, 2) + pow((g.s - u.s) / ss, 2) + pow((g.x - u.x) / sx, 2)), 9) AS dist FROM g, u, sd WHERE g.day <> u.day), k AS (SELECT *, row_number() OVER (PARTITION BY query_day ORDER BY dist, day) AS r FROM p),"
    " f AS (SELECT query_day, avg(following) AS p FROM k WHERE r <= 20 GROUP BY 1), a AS (SELECT f.*, d.q AS actual FROM f JOIN d ON d.day = query_day + 1) SELECT count(*) AS queries, round(avg(abs(p - actual)), 6) AS mae, round(avg(CASE WHEN abs(p - actual) <= 100 THEN 1.0 ELSE 0.0 END), 6) AS success FROM a"
)
def analog_backtest(t: Tables):
    d = _days(t)
    asked = d.where("day >= '1998-01-01' and day < '1998-02-01'").select(F.col("day").alias("query_day"))
    near = forecasts.analogs(d, "day", ["q", "s", "x"], "q", asked)
    b = forecasts.analog_backtest(near, d.select(F.date_sub("day", 1).alias("query_day"), F.col("q").alias("actual")), 100.0)
    return b.select("queries", F.round("mae", 6).alias("mae"), F.round("success", 6).alias("success"))


@BOOK.query()
def leave_one_out_customers(t: Tables):
    """Each customer's balance by a model of all others: their orders, with gaps for those without any; tested against models fitted anew."""
    o = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("top"), F.countDistinct("o_orderstatus").alias("states"))
    c = t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("nation", F.col("c_nationkey").cast("double"))
    out = leave_one_out.predicted(c, "c_custkey", ["n", "mean", "top", "states", "nation"], "c_acctbal")
    return out.select("c_custkey", F.round("actual", 6).alias("actual"), F.round("predicted", 6).alias("predicted"), F.round("absolute_error", 6).alias("absolute_error"))


@BOOK.query()
def ridge_of_three_weeks(t: Tables):
    """Daily amount and discount of each return flag by a ridge model of the 21 days before, fitted on the days before 1997; tested against numpy."""
    d = t("lineitem").groupBy("l_returnflag", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("amount"), F.avg("l_discount").alias("discount"), F.avg("l_extendedprice").alias("price"))
    w = lag_windows.windows(d, "day", ["amount", "discount", "price"], ["amount", "discount"], 21, ["l_returnflag"])
    model = lag_windows.fitted(w.where("day < '1997-01-01'"), ["amount", "discount"], 1.0)
    if model is None:
        return w.limit(0).select("l_returnflag", F.lit(0).cast("long").alias("days"), F.lit(0.0).alias("amount_mae"), F.lit(0.0).alias("discount_mae"))
    p = lag_windows.predicted(w.where("day >= '1997-01-01'"), model, {"amount": (0, None), "discount": (0, 1)})
    return p.groupBy("l_returnflag").agg(F.count("*").alias("days"), *(F.round(F.avg(F.abs(F.col(c) - F.col(f"predicted_{c}"))), 6).alias(f"{c}_mae") for c in ("amount", "discount")))
