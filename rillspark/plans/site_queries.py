"""Queries of a water site: derived features, mechanism surrogate, thresholds, triage, sensitivity.

Line items stand in for the readings of three sites (return flags), by ship date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.functions.scores import rounded
from rillspark.operators import formulas, measures, series, site, triage, whatif
from rillspark.plans.book import Book, Tables

BOOK = Book()
#: Daily readings of a site as aggregates of line items; the same text for both engines.
READINGS = {
    "rain": "sum(l_quantity) / 20",
    "wind": "avg(l_tax) * 100",
    "wind_dir": "CASE WHEN count(*) > 1 THEN avg(l_discount) * 3600 END",
    "pressure": "1000 + avg(l_extendedprice) / 1000",
    "humidity": "avg(l_discount) * 1000",
    "air_temp": "avg(l_tax) * 500",
    "water_temp": "CASE WHEN count(*) > 1 THEN avg(l_tax) * 450 END",
    "turbidity": "avg(l_quantity)",
    "conductivity": "avg(l_extendedprice) / 100",
    "oxygen": "avg(l_discount) * 160",
    "cod": "avg(l_tax) * 60",
    "nh3": "avg(l_tax) * 20",
    "tn": "avg(l_discount) * 30",
    "tp": "avg(l_tax) * 2",
    "flow": "avg(l_extendedprice) / 1000 - 35",
    "level": "avg(l_quantity) / 10",
    "side_flow": "sum(l_extendedprice) / 100000",
}
PROBABILITIES = ({"surge_prob": "1 / (1 + exp(-(rain_3d - 15) / 5))", "transition_prob": "1 / (1 + exp(-(intensity - 8)))", "failure_prob": "1 / (1 + exp(self_purification - 1))"},)
_DAYS = "SELECT l_returnflag AS site, CAST(l_shipdate AS DATE) AS day, " + ", ".join(f"{v} AS {k}" for k, v in READINGS.items()) + " FROM lineitem GROUP BY 1, 2"
_MID = ", ".join(f"(SELECT quantile_cont({c}, CAST(0.5 AS DOUBLE)) FROM days) AS {c}_mid" for c in ("wind_dir", "water_temp", "air_temp"))
_FEATURES = formulas.as_statement(f"(SELECT *, {_MID}, CAST(dayofyear(day) AS DOUBLE) AS day_number, (SELECT ln(1 + greatest(min(turbidity), 0)) FROM days) AS log_low, (SELECT ln(1 + greatest(max(turbidity), 0)) FROM days) AS log_high FROM days)", site.FEATURES)
_WITH = f"WITH days AS ({_DAYS}), f AS ({_FEATURES}), p AS ({formulas.as_statement('f', site.SURROGATE, site.COEFFICIENTS)}), q AS ({formulas.as_statement('p', PROBABILITIES)}) "


def _rounded(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def _days(t: Tables) -> DataFrame:
    rows = series.placed(t("lineitem")).withColumnsRenamed({"l_returnflag": "site"}).withColumn("day", F.to_date("l_shipdate"))
    return series.in_file_order(rows, "site", "day").groupBy("site", "day").agg(*(F.expr(v).alias(k) for k, v in READINGS.items()))


def _features(t: Tables) -> DataFrame:
    return site.features(_days(t))


def _process(t: Tables) -> DataFrame:
    return formulas.evaluated(site.surrogate(_features(t)), PROBABILITIES)


def _round(df: DataFrame, keys: list, columns, digits: int = 6) -> DataFrame:
    return df.select(*keys, *((F.round(c, digits) + 0.0).alias(c) for c in columns))


def _day():
    return F.col("day").cast("string").alias("day")



@BOOK.query(_WITH + f"SELECT site, CAST(day AS VARCHAR) AS day, {_rounded(site.NEW_FEATURES, 9)} FROM f")
def site_features(t: Tables):
    return _round(_features(t), ["site", _day()], site.NEW_FEATURES, 9)


@BOOK.query(_WITH + f"SELECT site, CAST(day AS VARCHAR) AS day, {_rounded(site.PROCESS)} FROM p")
def process_surrogate(t: Tables):
    return _round(_process(t), ["site", _day()], site.PROCESS)


THRESHOLD_FEATURES = ("rain_3d", "rain_7d", "bed_shear_proxy", "resuspension_potential", "flushing", "air_temp")
_LINES = ("threshold", "linear_r2", "piecewise_r2", "r2_gain", "linear_slope", "slope_below", "slope_above", "mean_below", "mean_above", "jump")


def _lines_sql(rows: str, keys: str, min_side: int) -> str:
    """Both regressions of every split by DuckDB's own functions, over windows of ``keys``."""
    w = f"PARTITION BY {keys} ORDER BY x"
    up, after = f"{w} RANGE UNBOUNDED PRECEDING", f"{w} RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    moments = ", ".join(f"sum({v}) OVER ({frame}) AS {side}_{k}" for side, frame in (("l", up), ("t", after)) for k, v in (("n", "CAST(1 AS DOUBLE)"), ("sx", "x"), ("sy", "y"), ("sxx", "x * x"), ("sxy", "x * y"), ("syy", "y * y")))
    right = ", ".join(f"t_{k} - l_{k} AS r_{k}" for k in ("n", "sx", "sy", "sxx", "sxy", "syy"))
    v = lambda s, a, b: f"({s}_s{a}{b} - {s}_s{a} * {s}_s{b} / nullif({s}_n, 0))"
    sse = lambda s: f"({v(s, 'y', 'y')} - CASE WHEN {v(s, 'x', 'x')} > 1e-9 THEN {v(s, 'x', 'y')} * {v(s, 'x', 'y')} / {v(s, 'x', 'x')} ELSE 0 END)"
    slope = lambda s: f"CASE WHEN {v(s, 'x', 'x')} > 1e-9 THEN {v(s, 'x', 'y')} / {v(s, 'x', 'x')} END"
    return (
        f"a AS (SELECT *, (SELECT count(DISTINCT x) FROM {rows} z WHERE ({', '.join('z.' + k.strip() for k in keys.split(','))}) = ({', '.join('o.' + k.strip() for k in keys.split(','))})) AS n_x, {moments} FROM {rows} o), b AS (SELECT *, {right} FROM a),"
        f" c AS (SELECT *, 1 - {sse('t')} / {v('t', 'y', 'y')} AS linear_r2, 1 - ({sse('l')} + {sse('r')}) / {v('t', 'y', 'y')} AS piecewise_r2, {slope('t')} AS linear_slope, {slope('l')} AS slope_below, {slope('r')} AS slope_above, l_sy / l_n AS mean_below, r_sy / nullif(r_n, 0) AS mean_above,"
        f" t_n >= {2 * min_side} AND n_x >= 4 AND l_n > {min_side} AND r_n >= {min_side} AND {v('t', 'y', 'y')} > 1e-12 AS enough FROM b),"
        f" d AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY enough DESC, CASE WHEN enough THEN round(piecewise_r2, 12) END DESC, x) AS k FROM c),"
        f" e AS (SELECT {keys}, CAST(t_n AS BIGINT) AS n, CASE WHEN enough THEN 'ok' ELSE 'insufficient' END AS status, CASE WHEN enough THEN x END AS threshold, piecewise_r2 - linear_r2 AS r2_gain, mean_above - mean_below AS jump, * EXCLUDE ({keys}, t_n), CAST(l_n AS BIGINT) AS n_below, CAST(r_n AS BIGINT) AS n_above FROM d WHERE k = 1)"
    )


def _unpivoted(df: DataFrame, keys: list[str], columns) -> DataFrame:
    return df.select(*keys, F.col("turbidity").alias("y"), F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))))


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, turbidity AS y FROM p" for c in THRESHOLD_FEATURES)
_OK = ", ".join(f"CASE WHEN enough THEN round({c}, 5) + 0.0 END AS {c}" for c in _LINES)
_LABEL = "CASE WHEN NOT enough THEN 'insufficient' WHEN n >= 40 AND r2_gain >= 0.10 THEN 'high' WHEN n >= 25 AND r2_gain >= 0.05 THEN 'medium' ELSE 'exploratory' END"


def _thresholds(process: DataFrame) -> DataFrame:
    return measures.two_lines(_unpivoted(process, [], THRESHOLD_FEATURES), "x", "y", 8, "feature")


@BOOK.query(_WITH + f", long AS ({_LONG}), {_lines_sql('long', 'feature', 8)} SELECT feature, n, status, {_OK}, CASE WHEN enough THEN n_below END AS n_below, CASE WHEN enough THEN n_above END AS n_above, {_LABEL} AS confidence FROM e")
def threshold_table(t: Tables):
    b = _thresholds(_process(t))
    return b.select("feature", "n", "status", *((F.round(c, 5) + 0.0).alias(c) for c in _LINES), "n_below", "n_above", measures.confidence(F.col("status"), F.col("n"), F.col("r2_gain")).alias("confidence"))


_CONTEXTS = {"season": "CASE WHEN month(day) BETWEEN 4 AND 9 THEN 'warm' ELSE 'cold' END", "direction": "CASE WHEN reverse > 0 THEN 'reverse' ELSE 'forward' END", "place": "site"}
_CONTEXT_FEATURES = ("rain_3d", "bed_shear_proxy", "flushing")
_CONTEXT_LONG = " UNION ALL ".join(f"SELECT '{k}' AS context_type, {v} AS context, '{c}' AS feature, {c} AS x, turbidity AS y FROM p" for k, v in _CONTEXTS.items() for c in _CONTEXT_FEATURES)


@BOOK.query(
    _WITH + f", long AS ({_CONTEXT_LONG}), {_lines_sql('long', 'context_type, context, feature', 5)} SELECT context_type, context, feature, n, threshold, r2_gain FROM (SELECT context_type, context, feature, n, round(threshold, 5) AS threshold, round(r2_gain, 5) AS r2_gain FROM e WHERE enough ORDER BY round(r2_gain, 5) DESC, context_type, context, feature LIMIT 24)"
)
def threshold_contexts(t: Tables):
    p = _process(t)
    kinds = F.array(*(F.struct(F.lit(k).alias("context_type"), F.expr(v).alias("context")) for k, v in _CONTEXTS.items()))
    long = _unpivoted(p.select("*", F.inline(kinds)), ["context_type", "context"], _CONTEXT_FEATURES)
    b = measures.two_lines(long, "x", "y", 5, "context_type", "context", "feature").where("status = 'ok'")
    return b.select("context_type", "context", "feature", "n", F.round("threshold", 5).alias("threshold"), F.round("r2_gain", 5).alias("r2_gain")).orderBy(F.desc("r2_gain"), "context_type", "context", "feature").limit(24)


# -- triage -------------------------------------------------------------------------------

#: Thresholds of the triage queries: a model owner's table of a row for each feature.
LIMITS = {"rain_3d": 18.0, "rain_7d": 40.0, "bed_shear_proxy": 1.2, "resuspension_potential": 12.0, "flushing": 0.4, "air_temp": 20.0}


def _triage_sql() -> str:
    over = lambda c: f"greatest({c} / {LIMITS[c]}, 0)"
    q = lambda c, v: f"(SELECT quantile_cont({c}, CAST({v} AS DOUBLE)) FROM q)"

    def part(what: str, c: str) -> str:
        if what == "over":
            return f"least({over(c)}, 1.5)"
        if what == "calm":
            return f"(1 - least({over(c)}, 1))"
        if what == "drivers":
            return "((" + " + ".join(f"CASE WHEN {over(d)} >= 1 THEN 1 ELSE 0 END" for d in triage.DRIVERS) + f" + CASE WHEN {over('flushing')} < 1 THEN 1 ELSE 0 END) / 6.0)"
        a, b = (q(c, 0.5), q(c, 0.9)) if what == "high" else (q(c, 0.1), q(c, 0.5))
        up = f"({c} - {a})" if what == "high" else f"({b} - {c})"
        return f"coalesce(least(greatest({up} / nullif({b} - {a}, 0), 0), 1.25), 0)"

    scores = ", ".join(f"round({' + '.join(f'{w} * {part(what, c)}' for w, what, c in parts)}, 12) AS {name}" for name, parts in triage.SCORES.items())
    pairs = ", ".join(f"{{'s': -{name}, 'i': {i}, 'k': '{name}'}}" for i, name in enumerate(triage.SCORES))
    phrase = ", ".join(f"CASE WHEN {over(c)} >= 1 THEN printf('{text} (%.{digits}f)', {c}) END" for c, text, digits in triage.PHRASES)
    flushing = f"CASE WHEN {over('flushing')} >= 1 THEN 'flushing was strong' WHEN flushing IS NOT NULL THEN 'flushing below threshold' END"
    return (
        f", s AS (SELECT *, {scores} FROM q), r AS (SELECT *, list_sort([{pairs}]) AS ranked, list_filter([{phrase}, {flushing}], lambda x: x IS NOT NULL)[1:4] AS said FROM s),"
        " u AS (SELECT site, CAST(day AS VARCHAR) AS day, ranked[1].k AS \"primary\", ranked[2].k AS secondary, -ranked[1].s AS a, -ranked[2].s AS b, transition_prob, failure_prob, array_to_string(said, '; ') AS evidence FROM r),"
        " v AS (SELECT *, CASE WHEN a >= 0.85 AND a - b >= 0.18 THEN 'high' WHEN a >= 0.60 AND a - b >= 0.08 THEN 'medium' ELSE 'exploratory' END AS confidence,"
        " CASE WHEN a >= 0.95 THEN 'high' WHEN a >= 0.72 OR transition_prob >= 0.40 OR failure_prob >= 0.40 THEN 'heightened' ELSE 'watch' END AS risk_band FROM u) "
    )


def _triage(t: Tables) -> DataFrame:
    p = _process(t)
    limits = p.sparkSession.createDataFrame(list(LIMITS.items()), "feature string, threshold double")
    return triage.triaged(p, limits, ["site", "day"])


@BOOK.query(_WITH + _triage_sql() + 'SELECT site, day, "primary", secondary, round(a, 6) AS primary_score, round(b, 6) AS secondary_score, confidence, risk_band, regexp_replace(evidence, \' \\([0-9.-]+\\)\', \'\', \'g\') AS evidence FROM v')
def scenario_triage(t: Tables):
    # values are printed to their digits, which two engines round differently at ties
    return _triage(t).select("site", _day(), "primary", "secondary", rounded(F.col("primary_score"), 6).alias("primary_score"), rounded(F.col("secondary_score"), 6).alias("secondary_score"), "confidence", "risk_band", F.regexp_replace("evidence", r" \([0-9.-]+\)", "").alias("evidence"))


@BOOK.query(_WITH + _triage_sql() + 'SELECT "primary", count(*) AS n, round(avg(a), 4) AS mean_score FROM v GROUP BY 1')
def triage_summary(t: Tables):
    return triage.summary(_triage(t)).select("primary", "n", F.round("mean_score", 4).alias("mean_score"))


@BOOK.query(_WITH + _triage_sql() + 'SELECT site, day, "primary", round(a, 6) AS primary_score, risk_band FROM (SELECT * FROM v ORDER BY round(a, 9) DESC, round(transition_prob, 9) DESC, site, day LIMIT 12)')
def high_risk_days(t: Tables):
    urgent = _triage(t).withColumns({c: rounded(F.col(c), 9) for c in ("primary_score", "transition_prob")})
    return triage.most_urgent(urgent, ["site", "day"]).select("site", _day(), "primary", rounded(F.col("primary_score"), 6).alias("primary_score"), "risk_band")


_BOOK_SQL = " UNION ALL ".join(f"SELECT '{k}' AS p, {i} AS step, '{a}' AS action" for k, v in triage.PLAYBOOK.items() for i, a in enumerate(v))


@BOOK.query(_WITH + _triage_sql() + f'SELECT site, "primary", step, action, count(*) AS n FROM v JOIN ({_BOOK_SQL}) ON p = "primary" GROUP BY ALL')
def response_playbook(t: Tables):
    return triage.playbook(_triage(t)).groupBy("site", "primary", "step", "action").agg(F.count("*").alias("n"))


# -- sensitivity --------------------------------------------------------------------------

FACTORS = ("rain_3d", "sediment_pulse", "flow_size", "water_temp", "tidal_pumping")
OUTPUTS = ("next_turbidity", "net_response", "source_total", "sink_total", "runoff_source", "phytoplankton_source")
TO = {"rain_3d": 10.0, "sediment_pulse": 20.0, "flow_size": 5.0, "water_temp": 18.0, "tidal_pumping": 2.0}
_S = formulas.as_statement("{rows}", site.SURROGATE, site.COEFFICIENTS)


def _model(rows: str) -> str:
    return f"({_S.replace('{rows}', rows)})"


def _changed(values: dict[str, str]) -> str:
    return "(SELECT * REPLACE (" + ", ".join(f"{v} AS {k}" for k, v in values.items()) + ") FROM g)"


_GAUGED = "SELECT *, row_number() OVER (ORDER BY site, day) AS rid FROM f WHERE water_temp IS NOT NULL"
_CASES = [(f, name, expr) for f in FACTORS for name, expr in (("lowered", f"{f} * 0.8"), ("raised", f"{f} * 1.2"), ("to_threshold", f"CAST({TO[f]} AS DOUBLE)"))]
_SINGLE = (
    f", g AS ({_GAUGED}), b AS (SELECT rid, {', '.join(f'{o} AS b_{o}' for o in OUTPUTS)} FROM {_model('g')}), c AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS factor, '{name}' AS intervention, {', '.join(f'avg({o} - b_{o}) AS {o}' for o in OUTPUTS)} FROM {_model(_changed({f: expr}))} JOIN b USING (rid)" for f, name, expr in _CASES)
    + ") "
)


def _surrogate(df: DataFrame) -> DataFrame:
    return site.surrogate(df)


def _single(t: Tables) -> DataFrame:
    return whatif.single_factor(_features(t).where("water_temp is not null"), _surrogate, list(FACTORS), list(OUTPUTS), TO)


@BOOK.query(_WITH + _SINGLE + f"SELECT factor, intervention, {_rounded(OUTPUTS, 7)} FROM c")
def surrogate_counterfactuals(t: Tables):
    return _round(_single(t), ["factor", "intervention"], OUTPUTS, 7)


@BOOK.query(_WITH + _SINGLE + "SELECT factor, intervention, change FROM (SELECT factor, intervention, round(next_turbidity, 6) + 0.0 AS change, row_number() OVER (PARTITION BY factor ORDER BY round(next_turbidity, 6), round(net_response, 6), intervention) AS k FROM c) WHERE k = 1 ORDER BY change, factor LIMIT 3")
def best_interventions(t: Tables):
    changes = _single(t).withColumns({o: F.round(o, 6) + 0.0 for o in ("next_turbidity", "net_response")})
    return whatif.best_actions(changes, ["next_turbidity", "net_response"]).limit(3).select("factor", "intervention", F.col("next_turbidity").alias("change"))


_BUNDLED = {"rain_3d": "rain_3d * 0.8", "sediment_pulse": "sediment_pulse * 0.8", "flow_size": "flow_size * 1.2"}
_GROUPS = [("rain_3d", "sediment_pulse"), ("rain_3d", "flow_size"), ("sediment_pulse", "flow_size"), tuple(_BUNDLED)]
_ALONE = ", ".join(f"(SELECT avg(next_turbidity - b0) FROM {_model(_changed({k: v}))} JOIN b USING (rid)) AS d_{k}" for k, v in _BUNDLED.items())


@BOOK.query(
    _WITH
    + f", g AS ({_GAUGED}), b AS (SELECT rid, next_turbidity AS b0 FROM {_model('g')}), o AS (SELECT {_ALONE}), j AS ("
    + " UNION ALL ".join(f"SELECT '{'|'.join(g)}' AS bundle, avg(next_turbidity - b0) AS joint, max({' + '.join(f'd_{k}' for k in g)}) AS additive FROM {_model(_changed({k: _BUNDLED[k] for k in g}))} JOIN b USING (rid), o" for g in _GROUPS)
    + ") SELECT bundle, round(joint, 7) AS joint, round(additive, 7) AS additive, round(joint - additive, 7) + 0.0 AS synergy FROM j"
)
def joint_interventions(t: Tables):
    d = _features(t).where("water_temp is not null")
    b = whatif.bundles(d, _surrogate, {k: F.expr(v) for k, v in _BUNDLED.items()}, "next_turbidity")
    return _round(b, ["bundle"], ("joint", "additive", "synergy"), 7)


_DRAWS = {"rain_3d": (7919, 104729, 80.0), "sediment_pulse": (6007, 15485863, 200.0), "flow_size": (3571, 32452843, 40.0), "water_temp": (2741, 49979687, 35.0), "tidal_pumping": (9973, 86028121, 30.0)}
_CALM = {c: "CAST(1 AS DOUBLE)" for c in ("turbidity", "side_flow", "level", "tn", "nh3", "tp", "day_sin", "wind_filled", "level_jump", "reverse", "flow_rise", "coupling", "conductivity", "settling", "flushing", "oxygen", "self_purification")}
_SAMPLES = "SELECT o_orderkey AS rid, " + ", ".join(f"(o_orderkey * {a} % 10007) / CAST(10007 AS DOUBLE) * {s} AS a_{k}, (o_orderkey * {b} % 10009) / CAST(10009 AS DOUBLE) * {s} AS b_{k}" for k, (a, b, s) in _DRAWS.items()) + ", " + ", ".join(f"{v} AS {k}" for k, v in _CALM.items()) + " FROM orders"


def _from_sample(b: set[str]) -> str:
    return "(SELECT *, " + ", ".join(f"{'b' if k in b else 'a'}_{k} AS {k}" for k in _DRAWS) + " FROM s)"


@BOOK.query(
    f"WITH s AS ({_SAMPLES}), "
    + ", ".join(f"y_{n} AS (SELECT rid, next_turbidity AS y FROM {_model(_from_sample(b))})" for n, b in {"a": set(), "b": set(_DRAWS), **{k: {k} for k in _DRAWS}}.items())
    + ", f AS (SELECT y_a.y AS fa, y_b.y AS fb, " + ", ".join(f"y_{k}.y AS f_{k}" for k in _DRAWS) + " FROM y_a JOIN y_b USING (rid)" + "".join(f" JOIN y_{k} USING (rid)" for k in _DRAWS) + "), "
    "v AS (SELECT (sum(fa * fa + fb * fb) - sum(fa + fb) * sum(fa + fb) / (2 * count(*))) / (2 * count(*) - 1) AS v FROM f) "
    + " UNION ALL ".join(f"SELECT '{k}' AS factor, round(avg(fb * (f_{k} - fa)) / max(v), 5) + 0.0 AS first, round(avg((fa - f_{k}) * (fa - f_{k})) / 2 / max(v), 5) + 0.0 AS total FROM f, v" for k in _DRAWS)
)
def surrogate_sobol(t: Tables):
    draw = lambda m, n, s: F.col("o_orderkey") * m % n / F.lit(float(n)) * s
    samples = t("orders").select(*(draw(a, 10007, s).alias(f"a_{k}") for k, (a, _, s) in _DRAWS.items()), *(draw(b, 10009, s).alias(f"b_{k}") for k, (_, b, s) in _DRAWS.items()), *(F.lit(1.0).alias(k) for k in _CALM))
    return _round(whatif.sobol(samples, _surrogate, list(_DRAWS), "next_turbidity"), ["factor"], ("first", "total"), 5)


# -- the table of a site before it is modelled ---------------------------------------------


@BOOK.query(
    _WITH
    + "SELECT column_name AS \"column\", round(missing, 6) AS missing, n_distinct, missing >= 0.85 OR n_distinct <= 1 AS dropped FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS missing, count(DISTINCT {c}) AS n_distinct FROM f" for c in ("water_temp", "wind_dir", "rain", "reverse", "turbidity"))
    + ")"
)
def column_screen(t: Tables):
    s = series.column_screen(_features(t), ["water_temp", "wind_dir", "rain", "reverse", "turbidity"])
    return s.select("column", F.round("missing", 6).alias("missing"), "n_distinct", "dropped")


@BOOK.query(
    f"WITH days AS ({_DAYS}), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY day) AS i, count(*) OVER (PARTITION BY site) AS n FROM days), h AS (SELECT * FROM k WHERE i <= floor(n * CAST(0.7 AS DOUBLE))) "
    "SELECT site, round(median(water_temp), 6) AS middle, round(avg(water_temp), 6) AS mean, round(greatest(coalesce(stddev_pop(water_temp), 1), 1e-6), 6) AS scale FROM h GROUP BY 1"
)
def feature_defaults(t: Tables):
    d = series.feature_defaults(_days(t), "water_temp", 0.7, "site")
    return d.select("site", *(F.round(c, 6).alias(c) for c in ("middle", "mean", "scale")))
