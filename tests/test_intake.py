"""Readers, acceptance, as-of joins and streams on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillspark.operators import acceptance, asof
from rillspark.sources import tolerant
from rillspark.streaming import daily

RULES = StructType(
    [
        acceptance.rule("day", "date", required=True, also=["日期", "date"]),
        acceptance.rule("station", "string", key=True),
        acceptance.rule("level", required=True, also=["depth"], unit="m", low=0.0, high=10.0),
    ]
)
UNITS = acceptance.Units(factors={("cm", "m"): 0.01}, endings=("m3s", "mgl"))


def accepted(raw, hints=None):
    return acceptance.aligned(acceptance.cleaned(acceptance.mapped(raw, RULES, UNITS, hints), RULES), RULES)


def test_headers_and_units():
    assert acceptance.parted("﻿ Dissolved Oxygen（mg/L）", UNITS) == ("dissolvedoxygen", "mg/l")
    assert acceptance.parted("west_flow_m3s", UNITS) == ("west_flow_m3s", "m3s")
    assert acceptance.parted("plain_name", UNITS) == ("plain_name", None)
    assert [UNITS.factor(u, "m") for u in (None, "-", "M", "cm", "ntu")] == [1.0, 1.0, 1.0, 0.01, None]


def test_csv_with_units_is_accepted(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿date,station,Depth (m)\nd,-,cm\n2024-01-01 03:00:00,s,100\n2024-01-01 09:00:00,s,300\n2024-01-02,s,9999999\n2024-01-03,s,\nnever,s,5\n", encoding="utf-8")
    rows, units = tolerant.split_units(tolerant.read_raw(spark, str(tmp_path / "a.csv")))
    assert units["Depth (m)"] == "cm"
    got = accepted(rows, units).orderBy("day").collect()
    assert [tuple(r) for r in got] == [(dt.date(2024, 1, 1), "s", 2.0), (dt.date(2024, 1, 2), "s", None)]
    counts = acceptance.profile(rows, RULES, UNITS, units).first().asDict()
    assert counts == {"n_rows": 5, "n_padding": 1, "n_no_day": 1, "level_missing": 0, "level_unparseable": 0, "level_out_of_range": 1, "level_min": 0.05, "level_max": 3.0, "level_mean": pytest.approx(1.35)}


def test_json_records_lines_and_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"records": [{"x": 1, "y": [1]}, {"x": null, "y": []}]}')
    assert [tuple(r) for r in tolerant.read_raw(spark, str(tmp_path / "a.json")).collect()] == [("1", "[1]"), (None, "[]")]
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\nnot json\n{"x": 2}\n')
    assert sorted(r.x for r in tolerant.read_json_lines(spark, str(tmp_path / "b.jsonl"), "x int").collect()) == [1, 2]
    for bad in ("a.xyz", "missing.csv"):
        with pytest.raises(tolerant.SourceError):
            tolerant.read_raw(spark, str(tmp_path / bad))


def test_missing_fields_units_and_made_days(spark):
    with pytest.raises(acceptance.NotAccepted, match="no day"):
        acceptance.mapped(spark.createDataFrame([("1",)], "depth string"), RULES, UNITS)
    with pytest.raises(acceptance.NotAccepted, match="unit of"):
        acceptance.mapped(spark.createDataFrame([("1", "2024-01-01")], "`depth(ntu)` string, date string"), RULES, UNITS)
    made = acceptance.mapped(spark.createDataFrame([("2024", "2", "30", "1"), ("2024", "2", "29", "2")], "Year string, Mon string, Day string, depth string"), StructType([acceptance.rule("when", "date", required=True), RULES["level"]]), UNITS)
    assert [tuple(r) for r in made.collect()] == [(None, 1.0), (dt.date(2024, 2, 29), 2.0)]
    assert accepted(spark.createDataFrame([], "date string, depth string")).count() == 0


def chain_of(spark, rows, schema="date string, station string, depth string", **more):
    return acceptance.chain(spark.createDataFrame(rows, schema), RULES, UNITS, **more)


def test_chain_of_stages(spark):
    days = [f"2024-01-{d:02d}" for d in range(1, 32)] + [f"2024-02-{d:02d}" for d in range(1, 10)]
    good = chain_of(spark, [(d, "s", "5") for d in days])
    assert (good.accepted, good.grade, [s.name for s in good.stages]) == (True, "A", ["uploaded", "validated", "mapped", "cleaned", "aligned", "graded"])
    assert good.rows.count() == 40 and good.stages[4].facts["gap_days"] == 0
    padded = chain_of(spark, [(d, "s", "5") for d in days] + [(f"2024-03-{d:02d}", "s", "") for d in range(1, 29)])
    assert padded.accepted and padded.stages[3].facts["padding"] == 28 and padded.stages[4].facts["missing_rate"] == 0
    two = chain_of(spark, [(d, "s", "5") for d in days] + [("2024-01-01", "s", "7"), ("2024-01-01", "s", "7")])
    assert two.rows.where("day = '2024-01-01'").first().level == 6.0 and two.stages[3].facts["repeated"] == 1
    outlier = chain_of(spark, [(d, "s", "99999" if d == days[0] else "5") for d in days])
    assert outlier.stages[3].facts["out_of_range"] == 1 and outlier.grade == "B"
    converted = chain_of(spark, [(d, "s", "800") for d in days], "date string, station string, `depth(cm)` string")
    assert converted.stages[2].facts["conversions"] == {"level": 0.01} and converted.rows.first().level == 8.0
    for bad, stage, reason in (
        (chain_of(spark, [(d, "s", "5") for d in days[:3]]), "graded", "insufficient_modelable_rows"),
        (chain_of(spark, [("x", "s")], "date string, station string"), "validated", "missing_required_fields"),
        (chain_of(spark, [], "date string, depth string"), "validated", "file_is_empty"),
        (chain_of(spark, [("2024-01-01", "5", "1")], "date string, depth string, `flow 1月` string", markers=("1月",)), "validated", "requires_dedicated_preprocessor"),
        (chain_of(spark, [("2024-01-01", "5")], "date string, `depth(ntu)` string"), "mapped", "unconvertible_unit"),
        (chain_of(spark, [("never", "s", "5")]), "aligned", "no_aligned_rows"),
    ):
        assert (bad.accepted, bad.grade, bad.stages[-1].name, bad.stages[-1].errors, bad.rows) == (False, "D", stage, [reason], None)
    report = good.report(spark).collect()
    assert [r.stage for r in report][-1] == "graded" and report[3].facts["rows"] == "40"


def test_asof_takes_the_last_at_or_before(spark):
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    left = spark.createDataFrame([(1, "a", at(1)), (2, "a", at(2)), (3, "a", at(30)), (4, "b", at(30)), (5, None, at(30)), (6, "a", None)], "i int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", at(1, 1), 10), ("a", at(2), 20), ("a", at(2), 21), (None, at(1), 5), ("b", at(31), 7)], "rk string, rt timestamp_ntz, v int")
    got = {r.i: r.v for r in asof.asof_backward(left, right, "k", "rk", "t", "rt", "v").collect()}
    assert got == {1: None, 2: 21, 3: 21, 4: None, 5: None, 6: None}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3000).alias("ts"), F.col("id").cast("double").alias("v"))
    last = spark.sql("select 9L as k, timestamp'2024-06-01' as ts, 0D as v")  # lets the watermark pass all days
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    last.write.mode("append").parquet(str(tmp_path / "in"))
    stream = daily.readings(spark, str(tmp_path / "in"), rows.schema)
    daily.to_parquet(daily.daily_means(stream, "ts", "v", "k"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.k != 9}
    assert got == {tuple(r) for r in daily.daily_means(rows, "ts", "v", "k").collect()}
