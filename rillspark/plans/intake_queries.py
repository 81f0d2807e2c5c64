"""Queries of acceptance, and extensions: sessions, cubes and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillspark.operators import acceptance, asof
from rillspark.plans.book import Book, Tables
from rillspark.streaming import daily

BOOK = Book()

RULES = StructType(
    [
        acceptance.rule("day", "date", required=True, also=["Sample Time"]),
        acceptance.rule("station", "string", also=["User"], key=True),
        acceptance.rule("reading", required=True, also=["Value"], unit="g/L", low=0.0, high=0.15),
    ]
)
UNITS = acceptance.Units(factors={("mg/l", "g/l"): 0.001})


def _raw(t: Tables):
    """The events as a raw table of strings, with headers as people write them."""
    return t("events").select(F.col("ts").cast("string").alias("Sample Time"), F.col("user_id").cast("string").alias("User"), F.when(F.col("event_type") != "error", F.col("value")).cast("string").alias("Value (mg/L)"))


_MAPPED = "WITH m AS (SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS station, CASE WHEN event_type <> 'error' THEN value * CAST(0.001 AS DOUBLE) END AS reading FROM events) "
_OK = "reading BETWEEN CAST(0 AS DOUBLE) AND CAST(0.15 AS DOUBLE)"


@BOOK.query(_MAPPED + f"SELECT CAST(day AS VARCHAR) AS day, station, round(avg(CASE WHEN {_OK} THEN reading END), 9) AS reading FROM m WHERE reading IS NOT NULL GROUP BY m.day, station")
def intake_daily(t: Tables):
    rows = acceptance.aligned(acceptance.cleaned(acceptance.mapped(_raw(t), RULES, UNITS), RULES), RULES)
    return rows.select(F.col("day").cast("string").alias("day"), "station", F.round("reading", 9).alias("reading"))


@BOOK.query(_MAPPED + f"SELECT count(*) AS n_rows, CAST(count_if(reading IS NULL) AS BIGINT) AS n_padding, CAST(0 AS BIGINT) AS n_no_day, CAST(0 AS BIGINT) AS reading_missing, CAST(count_if(reading IS NOT NULL AND NOT {_OK}) AS BIGINT) AS reading_out_of_range FROM m")
def intake_profile(t: Tables):
    return acceptance.profile(_raw(t), RULES, UNITS).select("n_rows", "n_padding", "n_no_day", "reading_missing", "reading_out_of_range")


@BOOK.query(
    _MAPPED
    + f"SELECT 'reading' AS field, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS unparseable, CAST(count_if(reading IS NOT NULL AND NOT {_OK}) AS BIGINT) AS out_of_range, round(min(CASE WHEN {_OK} THEN reading END), 9) AS low, round(max(CASE WHEN {_OK} THEN reading END), 9) AS high, round(avg(CASE WHEN {_OK} THEN reading END), 9) AS mean FROM m"
)
def field_profile(t: Tables):
    p = acceptance.by_field(acceptance.profile(_raw(t), RULES, UNITS), RULES)
    return p.select("field", "missing", "unparseable", "out_of_range", F.round("min", 9).alias("low"), F.round("max", 9).alias("high"), F.round("mean", 9).alias("mean"))


_CHAIN = (
    _MAPPED
    + f", c AS (SELECT day, station, CASE WHEN {_OK} THEN reading END AS reading FROM m WHERE reading IS NOT NULL), o AS (SELECT DISTINCT * FROM c), a AS (SELECT day, station, avg(reading) AS reading FROM o GROUP BY 1, 2),"
    f" g AS (SELECT (SELECT count(*) FROM m) AS n_raw, (SELECT count(*) FROM c) AS n_clean, (SELECT count(*) FROM o) AS n_once, (SELECT count(*) FROM m WHERE reading IS NULL) AS n_padding, (SELECT count(*) FROM m WHERE reading IS NOT NULL AND NOT {_OK}) AS n_out,"
    " count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS n_days, count(DISTINCT station) AS n_keys, count(reading) AS n_model, 1 - count(reading) / count(*) AS missing FROM a),"
    " h AS (SELECT *, CASE WHEN n_model < 30 THEN 'D' WHEN missing <= 0.05 AND n_out / n_rows <= 0.01 AND (n_clean - n_once) / n_raw <= 0.01 THEN 'A' WHEN missing <= 0.2 AND n_out / n_rows <= 0.05 AND (n_clean - n_once) / n_raw <= 0.05 THEN 'B' WHEN missing <= 0.4 AND n_out / n_rows <= 0.15 AND (n_clean - n_once) / n_raw <= 0.15 THEN 'C' ELSE 'D' END AS grade FROM g) "
)


@BOOK.query(
    _CHAIN
    + "SELECT * FROM (SELECT 0 AS ordinal, 'uploaded' AS stage, true AS ok, NULL AS rows, NULL AS detail FROM h UNION ALL SELECT 1, 'validated', true, NULL, NULL FROM h UNION ALL SELECT 2, 'mapped', true, NULL, NULL FROM h"
    " UNION ALL SELECT 3, 'cleaned', true, CAST(n_once AS VARCHAR), CAST(n_out AS VARCHAR) FROM h UNION ALL SELECT 4, 'aligned', true, CAST(n_rows AS VARCHAR), CAST(last_day - first_day + 1 - n_days AS VARCHAR) FROM h UNION ALL SELECT 5, 'graded', grade <> 'D', NULL, grade FROM h)"
)
def acceptance_stages(t: Tables):
    raw = _raw(t)
    report = acceptance.chain(raw, RULES, UNITS).report(raw.sparkSession)
    fact = lambda k: F.try_element_at("facts", F.lit(k))
    return report.select("ordinal", "stage", "ok", F.coalesce(fact("n_rows"), fact("rows")).alias("rows"), F.coalesce(fact("gap_days"), fact("out_of_range"), fact("grade")).alias("detail"))


@BOOK.query(_CHAIN + "SELECT n_rows, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, n_days, CAST(last_day - first_day + 1 - n_days AS BIGINT) AS gap_days, n_keys, n_model AS n_modelable, round(missing, 6) AS missing_rate FROM h")
def frame_summary(t: Tables):
    rows = acceptance.aligned(acceptance.cleaned(acceptance.mapped(_raw(t), RULES, UNITS), RULES).distinct(), RULES)
    d = acceptance.daily_figures(rows, RULES)
    return d.select("n_rows", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "n_days", "gap_days", "n_keys", "n_modelable", F.round("missing_rate", 6).alias("missing_rate"))


@BOOK.query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),"
    " s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)"
    " SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"
)
def event_sessions(t: Tables):
    return daily.sessions(t("events"), "ts", "6 hours", "user_id").select("user_id", "start", "n")


@BOOK.query("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def order_cube(t: Tables):
    cube = t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return cube.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "total")


@BOOK.query("SELECT event_id, o_orderkey FROM events ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) ON user_id = o_custkey AND ts >= o_orderdate")
def last_order_before_event(t: Tables):
    return asof.asof_backward(t("events").select("event_id", "user_id", "ts"), t("orders"), "user_id", "o_custkey", "ts", "o_orderdate", "o_orderkey").select("event_id", "o_orderkey")
