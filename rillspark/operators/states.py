"""One reading of a site as the input of a model: aliases, derived values, defaults, windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.operators.formulas import Steps, evaluated, with_missing

# Other names of a reading, and the formulas of a single reading, which differ from those of a series.
ALIASES = {"water_temp": ("water_temp", "temperature"), "rain": ("rain", "rainfall"), "rain_3d": ("rain_3d", "rainfall_3d"), "cod": ("cod", "cod_mn"), "nh3": ("nh3", "ammonia_n"), "tp": ("tp", "total_phosphorus"), "tn": ("tn", "total_nitrogen")}
SINGLE: Steps = (
    {
        "s_rain_3d": "coalesce(rain_3d, rain, 0)",
        "s_resuspension": "abs(coalesce(flow, 0)) * 0.01 + coalesce(wind, 0) * 0.05",
        "s_nutrient_risk": "coalesce(tp, 0) + 0.1 * coalesce(tn, 0)",
        "s_self_purification": "greatest(coalesce(oxygen, 0) - 6, 0)",
        "s_intensity": "abs(coalesce(flow, 0)) + abs(coalesce(side_flow, 0))",
        "s_settling": "greatest(0, 1 - least(abs(coalesce(flow, 0)) / 100, 1))",
        "s_temp_gap": "coalesce(water_temp, 15) - coalesce(air_temp, water_temp, 15)",
        "s_coupling": "coalesce(flow, 0) * coalesce(level, 0)",
        "s_resuspension_potential": "abs(coalesce(flow, 0)) * 0.05",
        "s_day_sin": "sin(2 * pi() * coalesce(day_number, 1) / 366.0)",
    },
    {"s_runoff": "s_rain_3d * 0.1", "s_mixing": "coalesce(wind, 0) + 0.01 * s_intensity", "s_tidal_pumping": "abs(s_coupling)", "s_sediment_pulse": "s_rain_3d * greatest(coalesce(rain, 0), 1)"},
)


def finite(c: Column) -> Column:
    return F.when(F.abs(c.cast("double")) < float("inf"), c.cast("double"))


def by_alias(df: DataFrame, wanted: Sequence[str], aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``df`` with the wanted columns: of a reading's names the first that the table has."""
    names = aliases or ALIASES
    found = {w: next((a for a in names.get(w, (w,)) if a in df.columns), None) for w in wanted}
    return with_missing(df.withColumns({w: finite(F.col(a)) for w, a in found.items() if a}), wanted)


def derived(df: DataFrame) -> DataFrame:
    """``df`` with the columns of :data:`SINGLE`."""
    return evaluated(with_missing(df, ["rain", "rain_3d", "flow", "side_flow", "level", "wind", "tp", "tn", "oxygen", "water_temp", "air_temp", "day_number"]), SINGLE)


def vector(df: DataFrame, features: Sequence[str], own: str, defaults: Mapping[str, float]) -> Column:
    """The features in their order: the reading's value, else the derived one (``own`` + name), else the default."""
    pick = lambda f: F.coalesce(*(F.col(c) for c in (f, f"{own}{f}") if c in df.columns), F.lit(float(defaults.get(f, 0.0))))
    return F.array(*(pick(f) for f in features))


def repeated_window(df: DataFrame, keys: Sequence[str], day: str, values: Column, days: int, sin_at: int | None = None) -> DataFrame:
    """keys, offset (0 is the oldest), day and values of ``days`` days that end at each row's day, all with its values; the place ``sin_at`` follows the day's own angle on 366 days."""
    wide = df.select(*keys, F.col(day).alias("__day"), values.alias("__v"), F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("offset"))
    out = wide.withColumn("day", F.date_sub("__day", F.lit(days - 1) - F.col("offset")))
    if sin_at is None:
        return out.select(*keys, "offset", "day", F.col("__v").alias("values"))
    angle = F.sin(F.lit(2 * 3.141592653589793) * F.dayofyear("day") / F.lit(366.0))
    return out.select(*keys, "offset", "day", F.transform("__v", lambda x, i: F.when(i == sin_at, angle).otherwise(x)).alias("values"))


def scaled(values: Column, means: Sequence[float], scales: Sequence[float]) -> Column:
    m, s = (F.array(*(F.lit(float(x)) for x in v)) for v in (means, scales))
    return F.transform(values, lambda x, i: (x - F.get(m, i)) / F.get(s, i))


def episodes(df: DataFrame, ordinal: str, n: int, count: int, stride: int = 10) -> DataFrame:
    """episode and the row that it starts from: ``(k * stride) mod (n - 1)`` of rows numbered from 0 to n - 1."""
    starts = df.sparkSession.range(count).select(F.col("id").alias("episode"), (F.col("id") * stride % max(n - 1, 1)).alias("__at"))
    return F.broadcast(starts).join(df, F.col("__at") == F.col(ordinal)).drop("__at")  # few episodes


def access(df: DataFrame, required: Sequence[str]) -> Column:
    """complete, partial or missing, by how many of the required readings a row has."""
    have = F.size(F.filter(F.array(*(finite(F.col(c)) for c in required)), lambda x: x.isNotNull()))
    return F.when(have == len(required), "complete").when(have > 0, "partial").otherwise("missing")


def live_window(history: DataFrame, live: DataFrame, key: str, day: str, days: int) -> DataFrame:
    """The last ``days`` days of each key up to its live row, which stands for its own day; to be derived anew as a series."""
    last = live.select(key, F.col(day).alias("__last"))
    old = history.join(last, key).where((F.col(day) < F.col("__last")) & (F.col(day) > F.date_sub("__last", days))).drop("__last")
    return old.unionByName(live, allowMissingColumns=True)


def episode_means(df: DataFrame, scenario: str, metrics: Sequence[str]) -> DataFrame:
    """Runs and mean metrics of each scenario; a metric that a run lacks counts as 0."""
    return df.groupBy(scenario).agg(F.count("*").alias("n"), *(F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in metrics))
