"""Choices of rows with guards and fallbacks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ScopeError(ValueError):
    """A scope that keeps too few rows."""


def scoped(df: DataFrame, day: str, value: str, first: str | None = None, last: str | None = None, least: int = 30) -> tuple[DataFrame, dict]:
    """Rows of the days asked for, both ends included, and what is true of those rows: n, first_day, last_day, log_low, log_high.

    The bounds of the logarithm are those of the rows that are left, as a target is scaled by them.
    """
    out = df
    if first:
        out = out.where(F.col(day) >= F.lit(first).cast("date"))
    if last:
        out = out.where(F.col(day) <= F.lit(last).cast("date"))
    log = F.log1p(F.greatest(F.col(value), F.lit(0.0)))
    facts = out.agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.min(log).alias("log_low"), F.max(log).alias("log_high")).first().asDict()
    if (first or last) and facts["n"] < least:
        raise ScopeError(f"{facts['n']} rows from {first} to {last}, fewer than {least}")
    return out, facts


def or_all(df: DataFrame, wanted: Column) -> DataFrame:
    """The rows that are wanted, or all of them where none is."""
    return df.where(wanted) if not df.where(wanted).isEmpty() else df


def series(df: DataFrame, columns: Sequence[str], day: str, **equal: object) -> DataFrame:
    """Predictions of a model and split by day, with the columns asked for; what the table lacks is null."""
    for c, v in equal.items():
        df = df.where(F.col(c) == F.lit(v))
    return df.select(day, *(F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns)).orderBy(day)


def site_role(name: Column, roles: Mapping[str, Sequence[str]], default: str = "other") -> Column:
    """The first role of which a word stands in a site's name."""
    out = F.lit(default)
    for role, words in reversed(list(roles.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(name), F.lit(w))
        out = F.when(hit, F.lit(role)).otherwise(out)
    return out


def label_threshold(low: Column, quantile: Column, positives: Column, least: int, relaxed: Column) -> Column:
    """The higher of a floor and a quantile; the relaxed one where that leaves fewer than ``least`` positives."""
    return F.when(positives >= least, F.greatest(low, quantile)).otherwise(relaxed)


def phrases(state: Sequence[tuple[str, Column, float]]) -> Column:
    """``name=value`` of readings that are numbers above 0 and not over ten times their reference, joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when((v > 0) & (v <= 10 * ref), F.concat(F.lit(f"{name}="), F.round(v, 2).cast("string"))) for name, v, ref in state))), ", ")


def artifacts(df: DataFrame, path: str, size: str) -> DataFrame:
    """category (the first folder), n and bytes of listed files."""
    top = F.when(F.contains(F.col(path), F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("root")
    return df.groupBy(top.alias("category")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def candidates(df: DataFrame, synonyms: Mapping[str, str], bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows under their usual names, without infinite or missing measures, the measures inside their bounds."""
    for old, new in synonyms.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    good = F.lit(True)
    for c in bounds:
        good = good & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    return df.where(good).withColumns({c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)) for c, (lo, hi) in bounds.items()})


def priced(scenarios: DataFrame, techniques: DataFrame, cases: DataFrame, scenario: str, technique: str, distance: str, price: str) -> DataFrame:
    """Each technique of a scenario with the price of the scenario's closest case that has it; the technique's own price where none has."""
    best = cases.groupBy(scenario, technique).agg(F.min(F.struct(distance, price)).alias("b")).select(scenario, technique, F.col(f"b.{price}").alias("__p"))
    offered = scenarios.select(scenario).distinct().join(techniques, scenario)
    return offered.join(best, [scenario, technique], "left").withColumn(price, F.coalesce("__p", price)).drop("__p")
