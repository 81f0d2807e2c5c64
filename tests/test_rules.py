"""Rules by hand-worked rows."""

import pytest
from pyspark.sql import functions as F

from rillspark.functions import rules
from rillspark.operators import retrieval


def test_scenarios_by_hand(spark):
    rows = [(37.0, 9.0, 4.0, "s1_external_input"), (36.0, 9.0, 4.0, "s3_algae_bloom"), (None, 8.0, 3.1, "s4_chronic_combo"), (0.0, None, 3.0, "s2_internal_release"), (None, None, None, "s2_internal_release")]
    d = spark.createDataFrame(rows, "r double, c double, t double, want string")
    assert all(x.want == x.got for x in d.withColumn("got", rules.scenario(F.col("r"), F.col("c"), F.col("t"))).collect())


def test_indicators_by_hand(spark):
    # 5 NTU; 5 of 10 in flow, 60 of 50 in aeration, 50 of 100 in dosage: 0.09 + 0.09 + 0.045
    rows = [(5.0, 5.0, 60.0, 50.0), (None, float("nan"), float("inf"), None), (10.0, 40.0, 0.0, 0.0)]
    got = [x.k for x in spark.createDataFrame(rows, "t double, r double, a double, c double").select(rules.indicators(*map(F.col, "trac")).alias("k")).collect()]
    assert got[0].turbidity_reduction_ratio == pytest.approx(0.225) and got[0].turbidity_reduction == pytest.approx(1.125)
    assert got[0].energy_cost == pytest.approx(5 * 86400 * 0.02 + 60 * 12 + 5) and got[0].cost_saving_ratio == pytest.approx(1 - 9365 / 35000)
    assert got[0].action_magnitude == pytest.approx(1 / 3 + 0.6 + 0.1) and got[0].stability == pytest.approx(1 - 0.04 * (1 / 3 + 0.7)) and got[0].response_time_hours == 1.0
    assert (got[1].turbidity_reduction, got[1].energy_cost, got[1].stability, got[1].response_time_hours) == (0.0, 0.0, 1.0, 0.5)
    assert got[2].turbidity_reduction == pytest.approx(1.8) and got[2].cost_saving_ratio == 0.0


def test_keywords_and_points_by_hand(spark):
    q = "如何用obs-3a监测透明度 in Lakes?"
    k = spark.createDataFrame([(q,)], "q string").select(rules.keywords(F.col("q"))).first()[0]
    assert {"OBS", "OBS-3A", "监测", "透明度", "obs-3a", "in", "Lakes", "塞氏盘"} <= set(k) and "?" not in k and k == sorted(k, key=lambda s: s.encode())
    rows = [("透明度", "塞氏盘", "相关", "", 31, ["透明度", "", "x"]), ("a", "b", "测量", "measured x", 10, ["x"]), (None, None, None, None, 0, None)]
    d = spark.createDataFrame(rows, "s string, t string, r string, e string, want int, k array<string>").withColumn("q", F.lit("透明度 监测 塞氏盘"))
    got = d.withColumn("got", rules.relation_score(F.col("s"), F.col("t"), F.col("r"), F.col("e"), F.col("q"), F.col("k"))).collect()
    assert all(x.got == x.want for x in got)


def test_routes_take_the_first_that_holds(spark):
    table = [("one", {"a": 1, "b": "x"}), ("two", {"a": 1}), ("three", {"b": None})]
    d = spark.createDataFrame([(1, "x", "one"), (1, "y", "two"), (2, None, "three"), (2, "x", "unknown")], "a int, b string, want string")
    assert all(x.want == x.got for x in d.withColumn("got", rules.routed(table)).collect())


def test_caps_fall_back_only_where_nothing_is_left(spark):
    d = spark.createDataFrame([("a", i, 9.0 - i) for i in range(5)] + [("b", 9, 5.5)], "anchor string, id long, score double")
    order = [F.desc("score"), F.col("id")]
    ranked = lambda each, most: [(x.id, x["rank"]) for x in retrieval.capped_with_overflow(d, "anchor", order, each, most).orderBy("rank").collect()]
    assert ranked(2, 8) == [(0, 1), (1, 2), (9, 3)]
    assert ranked(0, 3) == [(0, 1), (1, 2), (2, 3)]


def test_links_and_chains_by_hand(spark):
    gold = spark.createDataFrame([(1, "Wind"), (1, "Lake"), (2, "Rain"), (3, None)], "q long, name string")
    seen = spark.createDataFrame([(1, "WIND"), (1, "x"), (2, "snow")], "q long, name string")
    assert {(x.q, x.link_recall) for x in retrieval.link_recall(gold, seen, "q", "name").collect()} == {(1, 0.5), (2, 0.0)}
    chains = spark.createDataFrame([(1, ["a", "b", "c"]), (1, ["a", "c"]), (2, ["a"]), (2, ["b", "a"])], "q long, chain array<string>")
    edges = spark.createDataFrame([(1, "b", "a"), (1, "b", "c"), (2, "a", "b"), (2, "a", "b")], "q long, u string, v string")
    assert {(x.q, x.chain_hit) for x in retrieval.chain_hit(chains, edges, "q", "chain", "u", "v").collect()} == {(1, 0.5), (2, 0.5)}
