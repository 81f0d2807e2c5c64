"""Queries of records: explorer pages, upserts, histories, versions, coverage, life cycles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillspark.operators import records
from rillspark.plans.book import Book, Tables

BOOK = Book()

_HITS = "h AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND contains(lower(concat_ws(' ', CAST(o_orderkey AS VARCHAR), o_orderpriority)), 'high'))"


def _hits(t: Tables):
    return records.matching(t("orders"), {"o_orderstatus": ["O", "F"]}, "o_orderdate", "1996-01-01", "1997-06-30", "HIGH", ["o_orderkey", "o_orderpriority"])


@BOOK.query(f"WITH {_HITS} SELECT o_orderkey, CAST(day AS VARCHAR) AS day, (SELECT count(*) FROM h) > 40 AS has_next FROM h ORDER BY o_orderkey LIMIT 20 OFFSET 20")
def explorer_page(t: Tables):
    return records.page(_hits(t), ["o_orderkey"], 20, 20).select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"), "has_next")


@BOOK.query(f"WITH {_HITS} SELECT count(*) AS n, count(DISTINCT o_custkey) AS stations, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, round(avg(o_totalprice), 4) AS mean_price FROM h")
def explorer_summary(t: Tables):
    s = records.summary(_hits(t), "o_custkey", "o_orderdate", ["o_totalprice"])
    return s.select("n", "stations", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), F.round("mean_o_totalprice", 4).alias("mean_price"))


@BOOK.query("SELECT DISTINCT CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size IS NOT NULL")
def available_values(t: Tables):
    return records.values_of(t("part"), "p_size")


@BOOK.query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7 AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') ORDER BY o_orderdate DESC, o_orderkey LIMIT 5 OFFSET 1")
def record_list(t: Tables):
    hit = records.matching(t("orders"), {"o_custkey": 7, "o_orderpriority": ["1-URGENT", "2-HIGH", "5-LOW"]})
    return hit.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(1).limit(5).select("o_orderkey", "o_orderstatus")


@BOOK.query("SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS open_orders FROM customer WHERE c_custkey = 42")
def point_lookup(t: Tables):
    one = records.matching(t("customer"), {"c_custkey": 42}).select("c_custkey", "c_name")
    n = records.matching(t("orders"), {"o_custkey": 42, "o_orderstatus": "O"}).agg(F.count("*").alias("open_orders"))
    return one.crossJoin(F.broadcast(n))  # one row


_OLD = "old AS (SELECT o_orderkey, o_orderstatus, o_totalprice, 1 AS v FROM orders WHERE o_orderkey % 3 <> 0)"
_NEW = "new AS (SELECT o_orderkey, 'N' AS o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderkey % 4 AS v FROM orders WHERE o_orderkey % 2 = 0)"


def _sides(t: Tables):
    o, k = t("orders"), F.col("o_orderkey")
    old = o.where(k % 3 != 0).select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(1).cast("long").alias("v"))
    return old, o.where(k % 2 == 0).select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"), (k % 4).alias("v"))


@BOOK.query(f"WITH {_OLD}, {_NEW}, b AS (SELECT *, 0 AS side FROM old UNION ALL SELECT *, 1 FROM new) SELECT o_orderstatus, v, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY v DESC, side DESC) AS k FROM b) WHERE k = 1 GROUP BY 1, 2")
def upsert_latest(t: Tables):
    u = records.upserted(*_sides(t), ["o_orderkey"], "v")
    return u.groupBy("o_orderstatus", "v").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@BOOK.query(f"WITH {_OLD}, {_NEW} SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)) GROUP BY 1")
def insert_missing(t: Tables):
    return records.inserted(*_sides(t), ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@BOOK.query("SELECT event_id, 'k=' || CASE WHEN event_id % 2 = 0 THEN 'new' ELSE json_extract_string(props, '$.k') END || '|type=' || event_type AS record FROM events")
def record_merge(t: Tables):
    old = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit("new")))
    entries = F.array_sort(F.map_entries(records.merged(old, new)))
    return t("events").select("event_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "|").alias("record"))


_ALLOWED = (("P", "O"), ("O", "F"), ("F", "F"), ("O", "O"))


@BOOK.query("WITH w AS (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) SELECT o_custkey, count(*) AS changes, CAST(count_if(b IS NULL OR b || '>' || o_orderstatus IN ('P>O', 'O>F', 'F>F', 'O>O')) AS BIGINT) AS ok FROM w GROUP BY 1")
def transition_guard(t: Tables):
    g = records.guarded(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus", _ALLOWED)
    return g.groupBy("o_custkey").agg(F.count("*").alias("changes"), F.count_if("ok").alias("ok"))


@BOOK.query("SELECT o_custkey, string_agg(o_orderstatus, '>' ORDER BY o_orderdate, o_orderkey) AS history FROM orders GROUP BY 1")
def state_history(t: Tables):
    h = records.histories(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")
    return h.select("o_custkey", F.array_join("history", ">").alias("history"))


@BOOK.query(
    "WITH k AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS version FROM part WHERE p_partkey % 2 = 0), n AS (SELECT p_brand, p_size, p_partkey FROM part WHERE p_partkey % 2 = 1), "
    "u AS (SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.p_brand = n.p_brand AND k.p_size = n.p_size) GROUP BY 1, 2), l AS (SELECT p_brand, max(version) AS last FROM k GROUP BY 1) "
    "SELECT u.p_brand, p_size, p_partkey, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY u.p_brand ORDER BY p_partkey) AS BIGINT) AS version FROM u LEFT JOIN l ON u.p_brand = l.p_brand"
)
def versioned_ingest(t: Tables):
    p = t("part").select("p_brand", "p_size", "p_partkey")
    known = p.where("p_partkey % 2 = 0").withColumn("version", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    return records.versioned(known, p.where("p_partkey % 2 = 1"), "p_brand", "p_size", ["p_partkey"]).select("p_brand", "p_size", "p_partkey", "version")


@BOOK.query("SELECT p_brand, p_partkey, p_partkey = first_value(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC) AS is_default FROM part")
def publish_default(t: Tables):
    return records.published(t("part").select("p_brand", "p_partkey", "p_size"), "p_brand", "p_size", "p_partkey").select("p_brand", "p_partkey", "is_default")


_COVER = "CASE WHEN p_partkey % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE [p_brand, 'Brand#' || (10 + p_size)] END"


def _versions(t: Tables):
    cover = F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", F.concat(F.lit("Brand#"), (F.col("p_size") + 10).cast("string"))))
    return t("part").select("p_partkey", "p_size", cover.alias("coverage"))


@BOOK.query(f"SELECT p_partkey FROM part WHERE len({_COVER}) = 0 OR list_contains({_COVER}, 'Brand#12')")
def usable_versions(t: Tables):
    return records.usable(_versions(t), "coverage", "Brand#12").select("p_partkey")


@BOOK.query("SELECT CAST(max(a) AS VARCHAR) AS first_day, CAST(min(b) AS VARCHAR) AS last_day FROM (SELECT o_orderpriority, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1) HAVING max(a) <= min(b)")
def coverage_window(t: Tables):
    day = F.to_date("o_orderdate")
    v = t("orders").groupBy("o_orderpriority").agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return records.common_window(v, "a", "b").select(F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"))


@BOOK.query("SELECT o_orderkey FROM orders o WHERE CAST(coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, o_orderdate + INTERVAL 30 DAY) AS DATE) <= DATE '1995-03-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')")
def expired_records(t: Tables):
    used = t("lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("used", F.lit(True))
    o = t("orders").withColumns({"finished": F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")), "created": F.date_add(F.to_date("o_orderdate"), 30)}).join(used, "o_orderkey", "left")
    return records.expired(o, ["finished", "created"], F.lit("1995-03-01").cast("date"), F.col("used").isNull()).select("o_orderkey")


@BOOK.query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || '; ;' || p_type, ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS paths, array_to_string(list_sort(list_distinct([p_brand, p_type, p_brand])), '|') AS lineage FROM part")
def path_lists(t: Tables):
    paths = records.listed(F.concat_ws("; ;", "p_name", "p_type"))
    lineage = F.array_sort(F.array_union(F.array("p_brand", "p_type"), F.array("p_brand")))
    return t("part").select("p_partkey", F.array_join(paths, "|").alias("paths"), F.array_join(lineage, "|").alias("lineage"))


@BOOK.query("SELECT event_id, CAST(coalesce(json_extract_string(props, '$.state.level'), json_extract_string(props, '$.k'), '0') AS DOUBLE) AS level FROM events")
def nested_state(t: Tables):
    return t("events").select("event_id", F.coalesce(F.get_json_object("props", "$.state.level"), F.get_json_object("props", "$.k"), F.lit("0")).cast("double").alias("level"))


@BOOK.query(
    "WITH m AS (SELECT max(ts) AS t FROM events) SELECT event_id, CAST(date_diff('second', ts, t) AS BIGINT) AS elapsed, CASE WHEN date_diff('second', ts, t) > 864000 THEN 'timeout' ELSE 'running' END AS state,"
    " round(CASE event_type WHEN 'view' THEN (0 + 20 * s) * 100 / 100 WHEN 'click' THEN (20 + 50 * s) * 100 / 100 WHEN 'purchase' THEN (70 + 30 * s) * 100 / 100 END, 6) AS percent FROM (SELECT *, least(greatest(coalesce(value, 0) / 100, 0), 1) AS s FROM events), m"
)
def job_progress(t: Tables):
    e = t("events")
    e = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("t"))))  # one row
    p = records.progress({"view": 20.0, "click": 50.0, "purchase": 30.0}, F.col("event_type"), F.coalesce("value", F.lit(0.0)) / 100)
    return records.timed_out(e, "ts", F.col("t"), 864000).select("event_id", "elapsed", "state", F.round(p, 6).alias("percent"))


@BOOK.query("SELECT actor, action, n FROM (SELECT 'c' || o_custkey AS actor, 'order' AS action, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'u' || user_id, event_type, count(*) FROM events GROUP BY 1, 2) ORDER BY n DESC, actor, action LIMIT 20")
def audit_list(t: Tables):
    a = t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("actor"), F.lit("order").alias("action"))
    b = t("events").select(F.concat(F.lit("u"), "user_id").alias("actor"), F.col("event_type").alias("action"))
    return a.unionByName(b).groupBy("actor", "action").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "actor", "action").limit(20)
