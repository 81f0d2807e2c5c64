"""Readers and sinks of plain tables on small files."""

import datetime as dt
import json

import pytest

from rillspark.operators import acceptance
from rillspark.sinks import bundles
from rillspark.sources import tables
from rillspark.sources.tolerant import SourceError
from pyspark.sql.types import StructType


def test_one_path_and_the_first_place(spark, tmp_path):
    for n in ("a1.csv", "a2.csv", "b.csv"):
        (tmp_path / n).write_text("x\n1\n")
    assert tables.only_path(spark, f"{tmp_path}/b*.csv").endswith("/b.csv")
    for bad in ("a*.csv", "c*.csv"):
        with pytest.raises(SourceError):
            tables.only_path(spark, f"{tmp_path}/{bad}")
    assert tables.first_path(spark, f"{tmp_path}/none", f"{tmp_path}/a1.csv") == f"{tmp_path}/a1.csv"
    assert tables.read_tabular(spark, f"{tmp_path}/x.pdf") is None and tables.read_tabular(spark, f"{tmp_path}/b.csv").count() == 1


def test_cells_objects_and_probes(spark, tmp_path):
    d = spark.createDataFrame([(1, None), (None, "x")], "a int, b string")
    assert sorted(map(tuple, tables.cells(d).collect())) == [("", "x"), ("1", "")]
    assert tables.missing_columns(d, ["b", "c"]) == ["c"]
    (tmp_path / "o.json").write_text('{"k": 1,\n "v": [1, 2]}')
    assert tables.read_object(spark, f"{tmp_path}/o.json").first().k == 1
    (tmp_path / "bad.json").write_text('{"k": ')
    with pytest.raises(SourceError):
        tables.read_object(spark, f"{tmp_path}/bad.json")


def test_weather_and_sheets(spark):
    d = spark.createDataFrame([("2024", "2", "30", "1"), ("2024", "2", "9", " 2.5"), ("2024", "2", "10", "")], "Year string, Mon string, Day string, rain string")
    assert sorted(map(tuple, tables.weather(d, ["rain"]).collect())) == [(dt.date(2024, 2, 9), 2.5), (dt.date(2024, 2, 10), None)]
    sheet = spark.createDataFrame([("1", "5", "-3"), ("30", "6", "7"), ("sum", "99", "99"), ("31", "", "8")], "d string, jan string, feb string")
    long = tables.month_sheet(sheet, 2023, "d", ["jan", "feb"], station="main", variable="flow")
    assert sorted((str(r.day), r.station, r.value) for r in long.collect()) == [("2023-01-01", "main", 5.0), ("2023-01-30", "main", 6.0), ("2023-02-01", "main", -3.0)]
    level = tables.level_sheet(spark.createDataFrame([("2023-01-01", "2.5"), ("never", "1")], "a string, b string"), "a", "b", station="main", variable="level")
    wide = tables.wide_gauges(long.unionByName(level), ["main"])
    assert sorted((str(r.day), r.main_flow, r.main_level) for r in wide.collect())[0] == ("2023-01-01", 5.0, 2.5)
    blocks = [spark.createDataFrame([("d1", "p", 1)], "day string, place string, v int"), spark.createDataFrame([("d1", "p", 2), ("d2", "p", 3)], "day string, place string, v int")]
    assert [tuple(r) for r in tables.field_rows(blocks, ["day", "place"]).select("day", "v").collect()] == [("d1", 1), ("d2", 3)]


def test_graph_sources_and_chunks(spark, tmp_path):
    (tmp_path / "occ.jsonl").write_text('{"s": "a", "t": "b", "ordinal": 2, "chunk_id": "c2"}\nbroken\n{"s": "a", "t": "b", "ordinal": 1, "chunk_id": "c1"}\n{"s": "a", "t": "b", "ordinal": 1, "chunk_id": "c1"}\n')
    got = tables.occurrences(spark, f"{tmp_path}/occ.jsonl", ["s", "t"], "s string, t string, ordinal int, chunk_id string").first()
    assert [(c.ordinal, c.chunk_id) for c in got.chunks] == [(1, "c1"), (2, "c2")]
    spark.createDataFrame([("a", "b", "why")], "source string, target string, description string").write.parquet(f"{tmp_path}/old.parquet")
    r = tables.relations(spark, f"{tmp_path}/new.csv", f"{tmp_path}/old.parquet").first()
    assert (r.source, r.relation, r.target, r.evidence) == ("a", None, "b", "why")
    with pytest.raises(SourceError):
        tables.relations(spark, f"{tmp_path}/nothing.csv")
    (tmp_path / "notes.txt").write_text("one two\n\nthree four\n" + "x" * 30)
    c = tables.text_chunks(spark, f"{tmp_path}/notes.txt", most=20).orderBy("ordinal").collect()
    assert [(x.chunk_id, x.chunk) for x in c] == [("notes#0001", "one two\n\nthree four"), ("notes#0002", "x" * 20), ("notes#0003", "x" * 10)]


def test_bundles(spark, tmp_path):
    rules = StructType([acceptance.rule("day", "date", required=True), acceptance.rule("v", required=True, unit="m")])
    raw = spark.createDataFrame([(f"2024-01-{d:02d}", str(d)) for d in range(1, 32)], "day string, v string")
    outcome = acceptance.chain(raw, rules, acceptance.Units())
    bundles.write_accepted(f"{tmp_path}/a", outcome, rules, {"from": "x.csv"})
    facts = bundles.read_facts(spark, f"{tmp_path}/a/facts.json")
    assert facts["grade"] == "A" and facts["fields"][1]["unit"] == "m" and spark.read.parquet(f"{tmp_path}/a/rows").count() == 31
    with pytest.raises(ValueError):
        bundles.write_accepted(f"{tmp_path}/b", acceptance.chain(raw.limit(3), rules, acceptance.Units()), rules)
    triples = spark.createDataFrame([("b", "X", "r", "a", "Y", "e2", "c1"), ("b", "X", "r", "a", "Y", "e1", "c2"), ("b", "Z", "q", "c", "Y", "e", None)], "source string, source_type string, relation string, target string, target_type string, evidence string, chunk_id string")
    t = bundles.graph_tables(triples)
    assert sorted((r.source, r.relation, r.target, r.evidence) for r in t["relations"].collect()) == [("b", "q", "c", "e"), ("b", "r", "a", "e1")]
    assert [(r.entity_id, r.name, r.type) for r in t["entities"].orderBy("entity_id").collect()] == [("E0001", "a", "Y"), ("E0002", "b", "Z"), ("E0003", "c", "Y")]
    assert t["occurrences"].count() == 2
    p = bundles.predictions({"m1": spark.createDataFrame([(1, 2.0)], "d int, y double"), "m2": spark.createDataFrame([(1, 3.0, 0.5)], "d int, y double, risk double")}, ["d"])
    assert p.columns == ["model", "d", "y", "risk"] and p.where("model = 'm1'").first().risk is None
    bundles.write_bundle(f"{tmp_path}/c", {"p": p}, {"n": 2}, "csv")
    assert json.loads((tmp_path / "c" / "facts.json").read_text())["tables"]["p"] == p.columns


def test_threads_keep_their_own_tables(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from rillspark.session import removed, tables_so_far, written

    meet = Barrier(2)

    def one(k):
        mark = tables_so_far()
        a, b = written(spark.range(k), "a"), None
        meet.wait()  # both have written their first table
        b = written(spark.range(k + 1), "b")
        meet.wait()
        gone = removed(spark, mark, keep=[b])
        meet.wait()  # both have removed theirs
        return gone, b.count(), a._written_at != b._written_at

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(one, (3, 5))) == [(1, 4, True), (1, 6, True)]
