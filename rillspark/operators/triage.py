"""Scenario triage: exceedance of thresholds and quantile scores, ranked labels, bands and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.functions.scores import inverse_quantile_score, quantile_score, rounded
from rillspark.operators.mechanism import ranked_labels
from rillspark.operators.quantiles import quantiles

#: Fixed values: (weight, what, column) of each scenario's score. ``over`` is the exceedance of a threshold up
#: to 1.5, ``high`` and ``low`` are quantile scores, ``calm`` is what is missing to a threshold.
SCORES = {
    "external_input": ((0.32, "over", "rain_3d"), (0.20, "over", "rain_7d"), (0.22, "high", "runoff_source"), (0.16, "high", "runoff"), (0.10, "high", "surge_prob")),
    "internal_release": ((0.28, "over", "bed_shear_proxy"), (0.24, "over", "resuspension_potential"), (0.22, "high", "erosion_source"), (0.14, "high", "velocity_proxy"), (0.12, "calm", "flushing")),
    "algal_dominant": ((0.28, "over", "air_temp"), (0.26, "high", "phytoplankton_source"), (0.18, "high", "nutrient_risk"), (0.16, "low", "self_purification"), (0.12, "low", "intensity")),
    "chronic_composite": ((0.24, "drivers", ""), (0.24, "high", "transition_prob"), (0.18, "high", "failure_prob"), (0.18, "low", "self_purification"), (0.16, "calm", "flushing")),
}
#: What counts as a driver, at its threshold or above; and flushing below its own.
DRIVERS = ("rain_3d", "rain_7d", "bed_shear_proxy", "resuspension_potential", "air_temp")
#: Evidence phrases in their order, with the digits of the value.
PHRASES = (("rain_3d", "3-day rain over threshold", 1), ("rain_7d", "7-day rain over threshold", 1), ("bed_shear_proxy", "bed shear over threshold", 3), ("resuspension_potential", "resuspension over threshold", 1), ("air_temp", "warm air over threshold", 1))
QUANTILES = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
#: What is advised for each scenario.
PLAYBOOK = {
    "external_input": ("raise intake monitoring", "divert first flush"),
    "internal_release": ("lower gate speed", "dose coagulant"),
    "algal_dominant": ("shade inlet", "increase flushing"),
    "chronic_composite": ("joint dispatch", "review thresholds"),
}


def exceedance(value: Column, threshold: Column) -> Column:
    """Value over threshold, 0 where either is missing or the threshold is not positive."""
    return F.coalesce(F.when(threshold > 0, F.greatest(value / threshold, F.lit(0.0))), F.lit(0.0))


def confidence(first: Column, second: Column) -> Column:
    return F.when((first >= 0.85) & (first - second >= 0.18), "high").when((first >= 0.60) & (first - second >= 0.08), "medium").otherwise("exploratory")


def risk_band(first: Column, transition: Column, failure: Column) -> Column:
    return F.when(first >= 0.95, "high").when((first >= 0.72) | (transition >= 0.40) | (failure >= 0.40), "heightened").otherwise("watch")


def scored(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``df`` with a column ``exceeds`` (map) and one score for each scenario.

    ``thresholds`` has feature and threshold, a row for each feature; quantiles are those of ``df``.
    """
    columns = sorted({c for parts in SCORES.values() for _, what, c in parts if what in ("high", "low")})
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))))
    at = quantiles(long, "value", QUANTILES, "column").agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct(*QUANTILES)))).alias("at"))  # one row
    limits = thresholds.where("threshold is not null").agg(F.map_from_entries(F.collect_list(F.struct("feature", "threshold"))).alias("limits"))  # one row
    wide = df.crossJoin(F.broadcast(at)).crossJoin(F.broadcast(limits))
    over = {c: exceedance(F.col(c), F.try_element_at("limits", F.lit(c))) for c in (*DRIVERS, "flushing")}

    def part(what: str, c: str) -> Column:
        q = F.try_element_at("at", F.lit(c))
        if what == "over":
            return F.least(over[c], F.lit(1.5))
        if what == "calm":
            return 1 - F.least(over[c], F.lit(1.0))
        if what == "drivers":
            return (sum((over[d] >= 1).cast("double") for d in DRIVERS) + (over["flushing"] < 1).cast("double")) / (len(DRIVERS) + 1)
        return quantile_score(F.col(c), q["q50"], q["q90"]) if what == "high" else inverse_quantile_score(F.col(c), q["q10"], q["q50"])

    scores = {name: sum(weight * part(what, c) for weight, what, c in parts) for name, parts in SCORES.items()}
    return wide.withColumns({"exceeds": F.create_map(*(x for c, o in over.items() for x in (F.lit(c), o))), **scores}).drop("at", "limits")


def triaged(df: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, primary and secondary scenario with their scores, confidence, risk band and evidence of each row."""
    # scores have twelve digits, so that equal formulas tie and what is made of a score does not hang on its last bits
    out = scored(df, thresholds).withColumns({name: rounded(F.col(name), 12) for name in SCORES})
    ranked = ranked_labels({name: F.col(name) for name in SCORES})
    by_name = F.create_map(*(x for name in SCORES for x in (F.lit(name), F.col(name))))
    out = out.withColumns({"primary": ranked[0], "secondary": ranked[1], "by_name": by_name}).withColumns({"first": F.col("by_name")[F.col("primary")], "second": F.col("by_name")[F.col("secondary")]})
    phrase = [F.when(F.col("exceeds")[c] >= 1, F.format_string(f"{text} (%.{digits}f)", F.col(c))) for c, text, digits in PHRASES]
    flushing = F.when(F.col("exceeds")["flushing"] >= 1, F.lit("flushing was strong")).when(F.col("flushing").isNotNull(), F.lit("flushing below threshold"))
    return out.select(
        *keys,
        "primary",
        "secondary",
        F.col("first").alias("primary_score"),
        F.col("second").alias("secondary_score"),
        confidence(F.col("first"), F.col("second")).alias("confidence"),
        risk_band(F.col("first"), F.col("transition_prob"), F.col("failure_prob")).alias("risk_band"),
        "transition_prob",
        F.array_join(F.slice(F.array_compact(F.array(*phrase, flushing)), 1, 4), "; ").alias("evidence"),
    )


def summary(triage: DataFrame) -> DataFrame:
    """Rows and mean primary score of each scenario."""
    return triage.groupBy("primary").agg(F.count("*").alias("n"), F.avg("primary_score").alias("mean_score"))


def most_urgent(triage: DataFrame, keys: list[str], k: int = 12) -> DataFrame:
    return triage.orderBy(F.desc("primary_score"), F.desc("transition_prob"), *keys).limit(k)


def playbook(triage: DataFrame, actions: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A row for each triaged row and advised action, in the order of the playbook."""
    book = F.create_map(*(x for name, todo in (actions or PLAYBOOK).items() for x in (F.lit(name), F.array(*map(F.lit, todo)))))
    return triage.select("*", F.posexplode(F.coalesce(F.try_element_at(book, F.col("primary")), F.array().cast("array<string>"))).alias("step", "action"))
