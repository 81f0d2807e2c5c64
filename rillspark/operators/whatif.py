"""Sensitivity and counterfactuals of a model that is given as a function of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[DataFrame], DataFrame]


def single_factor(df: DataFrame, model: Model, factors: list[str], outputs: list[str], thresholds: Mapping[str, float], share: float = 0.2) -> DataFrame:
    """factor, intervention and the mean change of each output, for each factor lowered, raised and set to its threshold.

    Each row meets each intervention once (a handful), inside a projection; the model runs on those rows.
    """
    base = model(df).select(*df.columns, *(F.col(o).alias(f"__{o}") for o in outputs))
    cases = [F.struct(F.lit(f).alias("factor"), F.lit(name).alias("intervention"), F.lit(value).cast("double").alias("to"), F.lit(times).cast("double").alias("times")) for f in factors for name, value, times in (("lowered", None, 1 - share), ("raised", None, 1 + share), ("to_threshold", thresholds.get(f), None)) if times or value is not None]
    wide = base.withColumn("__case", F.explode(F.array(*cases)))
    changed = wide.withColumns({f: F.when(F.col("__case.factor") == f, F.coalesce(F.col("__case.to"), F.col(f) * F.col("__case.times"))).otherwise(F.col(f)) for f in factors})
    return model(changed).groupBy("__case.factor", "__case.intervention").agg(*(F.avg(F.col(o) - F.col(f"__{o}")).alias(o) for o in outputs))


def best_actions(changes: DataFrame, by: list[str]) -> DataFrame:
    """For each factor the intervention with the least change by these columns, best factor first."""
    best = changes.groupBy("factor").agg(F.min(F.struct(*by, "intervention")).alias("b"))
    return best.select("factor", F.col("b.intervention").alias("intervention"), *(F.col(f"b.{c}").alias(c) for c in by)).orderBy(*by, "factor")


def bundles(df: DataFrame, model: Model, actions: Mapping[str, Column], output: str, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """For each bundle of actions (factor -> its new value): the joint mean change, the sum of the single ones, and what they differ by."""
    base = model(df).select(*df.columns, F.col(output).alias("__base"))
    groups = [(f,) for f in actions] + [g for k in sizes for g in combinations(actions, k)]
    wide = base.withColumn("__bundle", F.explode(F.array(*(F.array(*map(F.lit, g)) for g in groups))))
    changed = wide.withColumns({f: F.when(F.array_contains("__bundle", f), new).otherwise(F.col(f)) for f, new in actions.items()})
    deltas = model(changed).groupBy(F.array_join("__bundle", "|").alias("bundle"), F.size("__bundle").alias("k")).agg(F.avg(F.col(output) - F.col("__base")).alias("joint"))
    one = deltas.where("k = 1").agg(F.map_from_entries(F.collect_list(F.struct("bundle", "joint"))).alias("one"))  # one row
    parts = F.aggregate(F.split("bundle", r"\|"), F.lit(0.0), lambda s, f: s + F.col("one")[f])
    return deltas.where("k > 1").crossJoin(F.broadcast(one)).select("bundle", "joint", parts.alias("additive"), (F.col("joint") - parts).alias("synergy"))


def sobol(samples: DataFrame, model: Model, factors: list[str], output: str) -> DataFrame:
    """factor, first and total index of a model over columns a_<factor> and b_<factor>, other inputs as they are.

    Every sample is evaluated for A, B and A with each column of B; the squares of A and B
    give the variance (with one degree of freedom less).
    """
    names = ["a", "b", *factors]
    rows = samples.withColumn("__i", F.monotonically_increasing_id()).withColumn("__which", F.explode(F.array(*map(F.lit, names))))
    inputs = rows.withColumns({f: F.when((F.col("__which") == "b") | (F.col("__which") == f), F.col(f"b_{f}")).otherwise(F.col(f"a_{f}")) for f in factors})
    y = model(inputs).groupBy("__i").agg(F.map_from_entries(F.collect_list(F.struct("__which", output))).alias("y"))
    at = lambda k: F.col("y")[k]
    both = F.array(at("a"), at("b"))
    total, squares, n = F.sum(at("a") + at("b")), F.sum(F.aggregate(both, F.lit(0.0), lambda s, x: s + x * x)), F.count("*")
    var = (squares - total * total / (2 * n)) / (2 * n - 1)
    out = [F.struct(F.lit(k).alias("factor"), (F.avg(at("b") * (at(k) - at("a"))) / var).alias("first"), (F.avg(F.pow(at("a") - at(k), 2)) / 2 / var).alias("total")) for k in factors]
    return y.agg(F.array(*out).alias("r")).select(F.inline("r"))
