"""Mechanism scores, rule-based triage, counterfactuals and sensitivity indices as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.functions.scores import clamp, sigmoid, softplus


def surrogate(rain: Column, flow: Column, load: Column) -> dict[str, Column]:
    """Pulse, dilution, resuspension and the turbidity that they add up to."""
    pulse = F.log1p(rain) * sigmoid((rain - 20.0) / 10.0)
    dilution = F.tanh(flow / 50.0)
    resuspension = softplus(load - 1.0)
    turbidity = clamp(2.0 + 3.0 * pulse - 1.5 * dilution + 0.8 * resuspension, 0.0, 500.0)
    return {"pulse": pulse, "dilution": dilution, "resuspension": resuspension, "turbidity": turbidity}


def ranked_labels(scores: dict[str, Column]) -> Column:
    """Labels by descending score; ties in the order given."""
    items = [F.struct((-c).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, c) in enumerate(scores.items())]
    return F.transform(F.sort_array(F.array(*items)), lambda x: x["k"])


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in their order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))


def sobol(samples: DataFrame, factors: list[str], f) -> DataFrame:
    """factor, first, total of a function over columns a_<factor> and b_<factor>.

    One aggregate: the matrix with one column of B is never made, only evaluated in place.
    """
    at = lambda which: f({k: F.col(f"{'b' if k == which else 'a'}_{k}") for k in factors})
    base, other = at(None), f({k: F.col(f"b_{k}") for k in factors})
    wide = samples.select(base.alias("fa"), other.alias("fb"), *(at(k).alias(f"f_{k}") for k in factors))
    both = F.array("fa", "fb")
    n = F.count("*")
    total = F.sum(F.aggregate(both, F.lit(0.0), lambda s, x: s + x))
    squares = F.sum(F.aggregate(both, F.lit(0.0), lambda s, x: s + x * x))
    var = (squares - total * total / (2 * n)) / (2 * n - 1)
    rows = [F.struct(F.lit(k).alias("factor"), (F.avg(F.col("fb") * (F.col(f"f_{k}") - F.col("fa"))) / var).alias("first"), (F.avg(F.pow(F.col("fa") - F.col(f"f_{k}"), 2)) / 2 / var).alias("total")) for k in factors]
    return wide.agg(F.array(*rows).alias("r")).select(F.inline("r"))
