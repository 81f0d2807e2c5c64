"""Queries of streams and sinks: life cycles of users, merges of batches, registered contents."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.plans.book import Book, Tables
from rillspark.session import shared_folder
from rillspark.sinks import merging
from rillspark.streaming import lifecycles

BOOK = Book()
_STEPS = (("view", "click"), ("click", "purchase"), ("click", "view"), ("view", "error"), ("error", "view"), ("timeout", "view"), ("timeout", "click"))
_OK = "(" + ", ".join(f"'{a}>{b}'" for a, b in _STEPS) + ")"


def _place(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


@BOOK.query(
    "WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS want, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),"
    " u AS (SELECT max(us) // 1000 - 3600000 AS until FROM e),"
    " run(user_id, k, id, us, want, due, before, state, since, ok) AS ("
    "  SELECT user_id, k, event_id, us, want, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CASE WHEN want = 'view' THEN want END, CASE WHEN want = 'view' THEN us END, want = 'view' FROM e, u WHERE k = 1 AND us // 1000 <= until"
    "  UNION ALL SELECT user_id, k, id, us, want, CASE WHEN late THEN since + 86400000000 END, before, CASE WHEN ok THEN want ELSE before END, CASE WHEN ok THEN us WHEN late THEN since + 86400000000 ELSE since END, ok FROM ("
    f"   SELECT *, CASE WHEN before IS NULL THEN want = 'view' ELSE before || '>' || want IN {_OK} END AS ok FROM ("
    "    SELECT e.user_id, e.k, e.event_id AS id, e.us, e.want, r.since, coalesce(r.state NOT IN ('purchase', 'timeout') AND (r.since + 86400000000) // 1000 <= e.us // 1000, false) AS late,"
    "    CASE WHEN coalesce(r.state NOT IN ('purchase', 'timeout') AND (r.since + 86400000000) // 1000 <= e.us // 1000, false) THEN 'timeout' ELSE r.state END AS before"
    "    FROM run r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1, u WHERE e.us // 1000 <= until))),"
    " l AS (SELECT user_id, arg_max(state, k) AS state, arg_max(since, k) AS since FROM (SELECT user_id, k, coalesce(state, '') AS state, coalesce(since, 0) AS since FROM run) GROUP BY user_id),"
    " p AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY k) AS was FROM run)"
    " SELECT user_id, id AS event_id, us AS at_us, before, want AS state, CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS outcome FROM run"
    " UNION ALL SELECT user_id, NULL, due, was, 'timeout', 'timeout' FROM p WHERE due IS NOT NULL"
    " UNION ALL SELECT user_id, NULL, since + 86400000000, state, 'timeout', 'timeout' FROM l, u WHERE state NOT IN ('', 'purchase', 'timeout') AND (since + 86400000000) // 1000 <= until"
)
def event_lifecycles(t: Tables):
    """Steps of each user as a guarded life cycle with a time-out of a day, run on a stream of the events."""
    events = t("events")
    spark = events.sparkSession
    # a stream reads a folder: that of the table, or for a table of one file the folder that it lies in
    files = events.inputFiles()
    folder, name = files[0].rsplit("/", 1)
    reader = spark.readStream.schema(events.schema)
    stream = (reader.option("pathGlobFilter", name) if len(files) == 1 else reader).parquet(folder)
    states = lifecycles.lifecycles(stream, "user_id", "ts", "event_id", "event_type", _STEPS, timedelta(days=1), ["view"], ["purchase"], "1 hour")
    out = _place(events, "lifecycles")
    lifecycles.replayed(states, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.schema(states.schema).parquet(f"{out}/rows")
    return rows.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), F.unix_micros("at").alias("at_us"), "before", "state", "outcome")


@BOOK.query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def merged_orders(t: Tables):
    """The last order of each customer, merged into a table in four batches, one of them twice."""
    orders = t("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    path = _place(orders, "orders")
    for batch, part in enumerate((0, 1, 1, 2, 3)):
        merging.merge(orders.where(F.col("o_orderkey") % 4 == part), batch, path, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return merging.read(orders.sparkSession, path)


@BOOK.query(
    "WITH h AS (SELECT source AS dataset, sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1, 2)"
    " SELECT dataset, doc_id, sha256, row_number() OVER (PARTITION BY dataset ORDER BY doc_id) AS version FROM h"
)
def registered_texts(t: Tables):
    """Different texts of each source, registered by the hash of their content, numbered by document."""
    docs = t("documents").where("text is not null")
    files = docs.select(F.col("source").alias("dataset"), F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("name"), F.lit(None).cast("string").alias("parent"), F.col("text").cast("binary").alias("content"))
    path = _place(docs, "files")
    merging.registered(files, 0, path)
    merging.registered(files, 1, path)
    rows = merging.read(docs.sparkSession, path)
    return rows.select("dataset", F.col("name").cast("long").alias("doc_id"), "sha256", "version")
