"""Values are rounded as the SQL rounds them, also where they tie."""

import math
import random
from datetime import datetime

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from rillspark.functions import scores
from rillspark.operators import triage
from rillspark.plans import catalog


def test_ties_are_rounded_as_in_sql(spark):
    r = random.Random(1)
    for digits in (6, 12):
        values = [s * (r.randrange(10**7) + 0.5) / 10**digits for _ in range(1500) for s in (1, -1)]
        values += [math.nextafter(v, 0) for v in values[:500]] + [0.3 * 10**-digits, -0.3 * 10**-digits, 0.0]
        duck = duckdb.connect()
        duck.register("t", pa.table({"i": range(len(values)), "v": values}))
        want = [str(v) for (v,) in duck.sql(f"SELECT round(v, {digits}) FROM t ORDER BY i").fetchall()]
        d = spark.createDataFrame(list(enumerate(values)), "i int, v double")
        assert [str(x.v) for x in d.orderBy("i").select(scores.rounded(F.col("v"), digits).alias("v")).collect()] == want


def test_triage_goes_by_scores_of_twelve_digits(spark):
    r = random.Random(2)
    columns = sorted({c for parts in triage.SCORES.values() for _, what, c in parts if c} | {"failure_prob"})
    d = spark.createDataFrame([(i, *(r.randint(0, 40) / 10 for _ in columns)) for i in range(60)], "id int, " + ", ".join(f"{c} double" for c in columns))
    limits = spark.createDataFrame([(c, 1.2) for c in (*triage.DRIVERS, "flushing")], "feature string, threshold double")
    got = triage.triaged(d, limits, ["id"]).collect()
    whole = {x.id: x for x in triage.scored(d, limits).collect()}
    c_form = lambda v: math.floor(v * 1e12 + 0.5) / 1e12
    assert any(whole[x.id][x.primary] != c_form(whole[x.id][x.primary]) for x in got), "some have more digits"
    assert all(x.primary_score == c_form(whole[x.id][x.primary]) and x.secondary_score == c_form(whole[x.id][x.secondary]) for x in got)


def test_daily_means_that_tie_are_rounded_as_in_sql(spark, tmp_path):
    # the mean of 32 amounts of two digits ends in a 5 at its seventh digit, or in none
    r = random.Random(3)
    rows = [(u, datetime(2024, 1, 1 + d), r.randint(1, 40000) / 100) for u in range(60) for d in range(6) for _ in range(32)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"SET threads = 1; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.QUERIES["daily_station_profile"](spark, str(tmp_path)).collect()
    assert sorted(tuple(map(str, x)) for x in got) == sorted(tuple(map(str, x)) for x in duck.sql(catalog.ORACLE["daily_station_profile"]).fetchall())
