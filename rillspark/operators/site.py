"""Formulas of a water site: derived daily features, mechanism surrogate, scenario scores.

Expected columns: site, day; rain, wind, wind_dir, pressure, humidity, air_temp; water_temp, turbidity,
conductivity, oxygen, cod, nh3, tn, tp; and, where a gauge exists, flow, level (main gauge) and side_flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.operators.formulas import Steps, evaluated, with_missing
from rillspark.operators.quantiles import quantiles

OPTIONAL = ("flow", "level", "side_flow")
_OVER = "OVER (PARTITION BY site ORDER BY day"


def _past(how: str, c: str, rows: int) -> str:
    return f"{how}({c}) {_OVER} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def _step_of(c: str) -> str:
    return f"coalesce({c} - lag({c}) {_OVER}), 0)"


def _log(c: str) -> str:
    return f"ln(1 + greatest({c}, 0))"


#: What a gauge gives: all zero where there is none.
GAUGES: Steps = (
    {
        "flow_size": "coalesce(abs(flow), 0)",
        "reverse": "coalesce(CASE WHEN flow < 0 THEN 1 ELSE 0 END, 0)",
        "flow_3d": f"coalesce({_past('avg', 'flow', 3)}, 0)",
        "flow_7d": f"coalesce({_past('avg', 'flow', 7)}, 0)",
        "side_flow_3d": f"coalesce({_past('avg', 'side_flow', 3)}, 0)",
        "flow_step": _step_of("flow"),
        "side_flow_step": _step_of("side_flow"),
        "level_jump": f"abs({_step_of('level')})",
        "coupling": "coalesce(flow * level, 0)",
    },
    {"flow_rise": "CASE WHEN flow_step > 0 THEN 1 ELSE 0 END", "side_flow_rise": "CASE WHEN side_flow_step > 0 THEN 1 ELSE 0 END"},
)

#: The weights of the derived features.
FEATURES: Steps = (
    *GAUGES,
    {
        "wind_sin": "sin(radians(coalesce(wind_dir, wind_dir_mid, 0)))",
        "wind_cos": "cos(radians(coalesce(wind_dir, wind_dir_mid, 0)))",
        "rain_filled": "coalesce(rain, 0)",
        "wind_filled": "coalesce(wind, 0)",
        "pressure_drop": f"greatest(-({_step_of('pressure')}), 0)",
        "conductivity_anomaly": f"conductivity - {_past('avg', 'conductivity', 7)}",
        "temp_gap": "coalesce(water_temp, water_temp_mid) - coalesce(air_temp, air_temp_mid)",
        "day_sin": "sin(2 * pi() * day_number / 365.25)",
        "day_cos": "cos(2 * pi() * day_number / 365.25)",
        "clearness": "1 - (ln(1 + greatest(turbidity, 0)) - log_low) / greatest(log_high - log_low, 1e-6)",
        "nutrient_risk": "coalesce(nh3, 0) + coalesce(tn, 0) + 10 * coalesce(tp, 0)",
        "self_purification": f"coalesce(oxygen, 0) / (1 + coalesce(cod, 0) + coalesce(nh3, 0) + 10 * coalesce(tp, 0)) * (1 + 0.02 * {_log('flow_7d')})",
    },
    {"rain_3d": _past("sum", "rain_filled", 3), "rain_7d": _past("sum", "rain_filled", 7)},
    {
        "mixing": f"wind_filled * (1 + abs(wind_sin)) + 0.15 * {_log('flow_size')}",
        "resuspension": "wind_filled * (1 + rain_3d) + 0.35 * level_jump + 0.20 * reverse",
        "runoff": f"rain_7d * (1 + coalesce(humidity, 0) / 100) + 0.15 * {_log('abs(side_flow_3d)')}",
        "settling": "1 / (1 + wind_filled + rain_3d + pressure_drop)",
        "intensity": f"0.6 * wind_filled + 0.2 * rain_3d + 0.2 * pressure_drop + 0.25 * {_log('flow_size')} + 0.10 * level_jump + 0.10 * reverse + 0.15 * {_log('abs(coupling)')}",
        "tidal_pumping": "flow_size * reverse * (1 + level_jump)",
        "resuspension_potential": "(flow_size + abs(flow_step)) * (1 + level_jump)",
        "flushing": "greatest(flow_3d, 0) / (1 + coalesce(turbidity, 0))",
        "sediment_pulse": "rain_3d * greatest(side_flow_step, 0)",
    },
)
NEW_FEATURES = tuple(k for step in FEATURES for k in step if k not in ("rain_filled", "wind_filled", "side_flow_3d"))

_SIGMOID = "1 / (1 + exp(-({})))"
_STOCK = "log_now / (1 + log_now)"
#: The form of the mechanism surrogate. Numbers in braces are its 26 coefficients.
SURROGATE: Steps = (
    {
        "log_now": f"{_log('coalesce(turbidity, 0)')}",
        "velocity_proxy": f"({{flow_scale}} * {_log('flow_size')} + {{side_flow_scale}} * {_log('abs(coalesce(side_flow, 0))')}) / (1 + {{depth_scale}} * ln(1 + abs(coalesce(level, 0))))",
        "light": "least(greatest(0.5 * (1 + day_sin), 0), 1)",
        "nitrogen": "greatest(coalesce(tn, 0), 0) + 0.5 * greatest(coalesce(nh3, 0), 0)",
        "phosphorus": "greatest(coalesce(tp, 0), 0)",
    },
    {"bed_shear_proxy": f"{{shear_flow}} * velocity_proxy * velocity_proxy + {{shear_wind}} * {_log('wind_filled')} + {{shear_level}} * {_log('level_jump')}"},
    {
        "erosion_source": "{erosion} * ln(1 + exp(bed_shear_proxy - {erosion_from})) * (1 + 0.5 * reverse + 0.25 * flow_rise)",
        "runoff_source": f"{{runoff}} * ({_log('sediment_pulse')} + 0.35 * {_log('rain_3d')} + 0.25 * {_log('abs(coalesce(side_flow, 0))')})",
        "tidal_source": f"{{tidal}} * ({_log('tidal_pumping')} + 0.30 * {_log('abs(coupling)')})",
        "phytoplankton_source": "{bloom} * exp(-power((greatest(coalesce(water_temp, 0), 0) - {best_temp}) / ({temp_width} + 1e-6), 2)) * "
        + _SIGMOID.format("{light_slope} * (light - {light_from})")
        + " * least(nitrogen / (nitrogen + {half_n} + 1e-6), phosphorus / (phosphorus + {half_p} + 1e-6)) * "
        + _SIGMOID.format("4 * ({best_flow} - velocity_proxy) / ({flow_width} + 1e-6)"),
        "deposition_sink": f"{{deposition}} * {_STOCK} * "
        + _SIGMOID.format("4 * ({deposition_below} - bed_shear_proxy) / ({flow_width} + 1e-6)")
        + f" * (1 + {{floc}} * tanh(ln(1 + abs(coalesce(conductivity, 0))) / 5)) * (1 + 0.25 * {_log('settling')})",
        "flushing_sink": f"{{flush}} * {_STOCK} * velocity_proxy * {_log('flushing')}",
        "purification_sink": f"{{purify}} * {_STOCK} * " + _SIGMOID.format("{oxygen_slope} * (greatest(coalesce(oxygen, 0), 0) - {oxygen_mid})") + f" * {_log('self_purification')}",
    },
    {"source_total": "runoff_source + erosion_source + tidal_source + phytoplankton_source", "sink_total": "deposition_sink + flushing_sink + purification_sink"},
    {"net_response": "source_total - sink_total"},
    {"next_log_turbidity": "greatest(log_now + net_response, 0)"},
    {"next_turbidity": "exp(next_log_turbidity) - 1"},
)
PROCESS = ("velocity_proxy", "bed_shear_proxy", "erosion_source", "runoff_source", "tidal_source", "phytoplankton_source", "deposition_sink", "flushing_sink", "purification_sink", "source_total", "sink_total", "net_response", "next_log_turbidity", "next_turbidity")

#: An example set of coefficients; a user brings those of a fitted model.
COEFFICIENTS = {
    "flow_scale": 0.30, "side_flow_scale": 0.12, "depth_scale": 0.25, "shear_flow": 0.40, "shear_wind": 0.15, "shear_level": 0.20,
    "erosion": 0.18, "erosion_from": 0.90, "runoff": 0.05, "tidal": 0.04, "bloom": 0.35, "best_temp": 26.0, "temp_width": 8.0,
    "light_slope": 6.0, "light_from": 0.45, "half_n": 0.8, "half_p": 0.05, "best_flow": 0.8, "flow_width": 0.5, "floc": 0.3,
    "deposition": 0.30, "deposition_below": 0.7, "flush": 0.08, "purify": 0.10, "oxygen_slope": 0.9, "oxygen_mid": 5.5,
}


def features(df: DataFrame) -> DataFrame:
    """``df`` with :data:`FEATURES`; a window per site, and one row of medians and bounds for the table."""
    wide = with_missing(df, OPTIONAL)
    logs = wide.agg(F.log1p(F.greatest(F.min("turbidity"), F.lit(0.0))).alias("log_low"), F.log1p(F.greatest(F.max("turbidity"), F.lit(0.0))).alias("log_high"))  # one row
    wide = wide.crossJoin(F.broadcast(logs))
    for c in ("wind_dir", "water_temp", "air_temp"):
        wide = wide.crossJoin(F.broadcast(quantiles(df, c, {f"{c}_mid": 0.5})))  # one row
    return evaluated(wide.withColumn("day_number", F.dayofyear("day")), FEATURES)


def surrogate(df: DataFrame, coefficients: dict[str, float] | None = None) -> DataFrame:
    """``df`` (with its features) and the columns :data:`PROCESS`."""
    return evaluated(df, SURROGATE, coefficients or COEFFICIENTS)
