"""Joins of daily sources: yearly values on days, prefixed proxies, best stations, labels by role, keyword domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.functions.scores import haversine_km
from rillspark.operators.ranking import top_of_each
from rillspark.operators.series import nearest_in_time


def yearly_on_days(days: DataFrame, yearly: DataFrame, day: str, year: str) -> DataFrame:
    """Each day with the values of its year; null for years without any."""
    return days.withColumn(year, F.year(day)).join(F.broadcast(yearly), year, "left")  # a row for each year


def prefixed(df: DataFrame, prefix: str, but: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in but else F.col(c).alias(f"{prefix}{c}") for c in df.columns))


def proxied(water: DataFrame, weather: DataFrame, day: str, km: float) -> DataFrame:
    """Days that both stations have, with prefixes and the constant distance between them."""
    return prefixed(water, "water_", [day]).join(prefixed(weather, "weather_", [day]), day).withColumn("distance_km", F.lit(km))


def station_sources(water: DataFrame, weather: DataFrame, hydro: DataFrame, day: str) -> DataFrame:
    """All days of the water table with what the others have of them."""
    return water.join(weather, day, "left").join(hydro, day, "left")


def ranked_stations(target_days: DataFrame, target_lat: float, target_lon: float, station_days: DataFrame, places: DataFrame, station: str, day: str, most: int = 5) -> DataFrame:
    """Stations by the days they share with the target, then by distance (km): station, overlap, km, rank.

    ``places`` has station, lat and lon.
    """
    shared = station_days.select(station, day).distinct().join(target_days.select(day).distinct(), day, "left_semi").groupBy(station).agg(F.count("*").alias("overlap"))
    all_of = places.join(shared, station, "left").withColumns({"overlap": F.coalesce("overlap", F.lit(0)), "km": haversine_km(F.lit(target_lat), F.lit(target_lon), F.col("lat"), F.col("lon"))})
    best = all_of.orderBy(F.desc("overlap"), "km", station).limit(most).withColumn("__one", F.lit(1))  # few rows
    return top_of_each(best, ["__one"], [F.desc("overlap"), F.col("km"), F.col(station)], most).select(station, "overlap", "km", "rank")


def labelled(left: DataFrame, labels: DataFrame, key: str, left_day: str, right_day: str, role: str, wanted: str, days: int = 7) -> DataFrame:
    """The nearest label within ``days``: of the wanted role where a key has any, else of all. alignment and confidence tell how near.

    Confidence falls as exp(-gap / 3).
    """
    has = labels.where(F.col(role) == wanted).select(key).distinct().withColumn("__has", F.lit(True))
    usable = labels.join(has, key, "left").where(F.col("__has").isNull() | (F.col(role) == wanted)).drop("__has")
    near = nearest_in_time(left, usable.select(key, right_day).distinct(), key, left_day, right_day, days)
    out = left.join(near.select(*left.columns, right_day, "offset"), left.columns, "left")
    gap = F.abs("offset")
    return out.withColumns(
        {
            "alignment": F.when(gap == 0, "exact_same_day").when(gap == 1, "near_day").when(gap <= days, "same_week_context").otherwise("no_field_label"),
            "confidence": F.coalesce(F.exp(-gap / 3.0), F.lit(0.0)),
        }
    )


def domain_pairs(df: DataFrame, left: Column, right: Column, weight: Column) -> DataFrame:
    """a, b, weight: the summed weight of each pair of domains of two tag arrays, in both directions."""
    pairs = df.select(F.explode(left).alias("a"), right.alias("__r"), weight.alias("w")).select("a", F.explode("__r").alias("b"), "w")
    both = pairs.unionByName(pairs.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy("a", "b").agg(F.sum("w").alias("weight"))


def feature_prior(features: DataFrame, weights: DataFrame) -> DataFrame:
    """a, b, prior: for features (few: name, domains) the highest weight over their pairs of domains, over the highest of all."""
    tagged = features.select("name", F.explode("domains").alias("domain"))
    x, y = tagged.alias("x"), tagged.alias("y")
    w = F.broadcast(weights.alias("w"))  # a row for each pair of domains
    met = x.join(w, F.col("x.domain") == F.col("w.a")).join(y, (F.col("y.domain") == F.col("w.b")) & (F.col("x.name") < F.col("y.name")))
    top = met.groupBy(F.col("x.name").alias("a"), F.col("y.name").alias("b")).agg(F.max("w.weight").alias("weight"))
    peak = top.agg(F.max("weight").alias("__m"))  # one row
    return top.crossJoin(F.broadcast(peak)).select("a", "b", (F.col("weight") / F.col("__m")).alias("prior"))


def row_normalised(cells: DataFrame, row: str, weight: str) -> DataFrame:
    """Each row's weights over their sum; rows without weight stay as they are."""
    total = cells.groupBy(row).agg(F.sum(weight).alias("__t"))
    return cells.join(total, row).withColumn("share", F.when(F.col("__t") > 0, F.col(weight) / F.col("__t")).otherwise(F.col(weight))).drop("__t")
