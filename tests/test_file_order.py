"""Sums of doubles do not depend on how files are split: they are those of one reading in their order."""

import math
import os
import random
from datetime import datetime, timedelta

import pytest

from rillspark.operators import series
from rillspark.plans import catalog


@pytest.fixture
def files(spark, tmp_path, monkeypatch):
    """A folder for tables of many small files, each of which is read by a task of its own."""
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    yield str(tmp_path)
    spark.conf.set("spark.sql.files.openCostInBytes", was)


def write(spark, rows, schema, path, parts=6):
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{path}/part={k}")
    out = f"{path}.parquet"
    os.makedirs(out)
    for k in range(parts):
        (name,) = (n for n in os.listdir(f"{path}/part={k}") if n.endswith(".parquet"))
        os.rename(f"{path}/part={k}/{name}", f"{out}/{k:03d}.parquet")


def sequential(rows):
    sums = {}
    for u, ts, v in rows:
        n, s = sums.get((u, ts.date()), (0, 0.0))
        sums[u, ts.date()] = n + 1, s + v
    return {k: s / n for k, (n, s) in sums.items()}


def test_daily_means_profile_and_flags_in_file_order(spark, files):
    r = random.Random(4)
    begin = datetime(2024, 1, 1)
    # both days have one mean; only the order of the sums tells them apart
    values = {0: [59.71, 57.35], 1: [60.32, 110.86, 17.23, 45.71]}
    rows = [(u, begin + timedelta(days=d), v) for k in range(60) for u in range(30) if k < 2 * u + 2 for d in (0, 1) for v in r.sample(values[d], len(values[d]))]
    write(spark, [(i, u, ts, v) for i, (u, ts, v) in enumerate(rows)], "event_id long, user_id long, ts timestamp, value double", f"{files}/events")
    want = sequential(rows)
    got = {(x.user_id, x.day): x.value for x in series.daily(spark.read.parquet(f"{files}/events.parquet"), "ts", "value", "user_id").collect()}
    assert got == want
    change = {u: want[u, (begin + timedelta(days=1)).date()] - want[u, begin.date()] for u in range(30)}
    assert len({math.copysign(1, c) if c else 0 for c in change.values()}) > 1, "the order tells some apart"
    flags = {x.user_id: (x.rise, x.fall) for x in catalog.QUERIES["day_diff_flags"](spark, files).where("day = '2024-01-02'").collect()}
    assert flags == {u: (int(c > 0), int(c < 0)) for u, c in change.items()}
    profile = {x.user_id: x.change for x in catalog.QUERIES["daily_station_profile"](spark, files).where("day = '2024-01-02'").collect()}
    assert {u: math.copysign(1, c) for u, c in profile.items()} == {u: math.copysign(1, c) for u, c in change.items()}


def test_screened_columns_in_file_order(spark, files):
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(5)
    rows = [(r.choice("ANR"), datetime(1996, 1, 1) + timedelta(days=r.randrange(60)), float(r.randint(1, 50)), r.randint(90000, 9000000) / 100, r.randint(0, 10) / 100, r.randint(0, 8) / 100) for _ in range(6000)]
    write(spark, rows, "l_returnflag string, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double, l_tax double", f"{files}/lineitem")
    duck = duckdb.connect()
    duck.sql("SET threads = 1")
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{files}/lineitem.parquet/*.parquet'")
    want = {r[0]: r[2] for r in duck.sql(catalog.ORACLE["column_screen"]).fetchall()}
    assert {x.column: x.n_distinct for x in catalog.QUERIES["column_screen"](spark, files).collect()} == want
