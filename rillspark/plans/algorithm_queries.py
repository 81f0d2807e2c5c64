"""Queries of the analytic algorithms: surrogates, triage, breakpoints, sensitivity, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions import scores
from rillspark.operators import blocks, measures, mechanism, quantiles, ranking
from rillspark.plans.book import Book, Tables

BOOK = Book()
L = "lineitem"
_S = "1 / (1 + exp(-({q} - 20.0) / 10.0))"


def _turb(q: str, p: str, d: str) -> str:
    return f"greatest(0, least(500, 2.0 + 3.0 * ln(1 + {q}) / (1 + exp(-({q} - 20.0) / 10.0)) - 1.5 * tanh({p} / 50.0) + 0.8 * ln(1 + exp({d} - 1.0))))"


@BOOK.query(f"SELECT l_returnflag, l_linestatus, round(avg(ln(1 + l_quantity) / (1 + exp(-(l_quantity - 20.0) / 10.0))), 6) AS pulse, round(avg(tanh(l_extendedprice / 1000 / 50.0)), 6) AS dilution, round(avg({_turb('l_quantity', 'l_extendedprice / 1000', 'l_tax * 100')}), 6) AS turbidity FROM lineitem GROUP BY 1, 2")
def surrogate_expressions(t: Tables):
    c = mechanism.surrogate(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_tax") * 100)
    return t(L).groupBy("l_returnflag", "l_linestatus").agg(*(F.round(F.avg(c[k]), 6).alias(k) for k in ("pulse", "dilution", "turbidity")))


_Q = "WITH q AS (SELECT quantile_cont(l_quantity, CAST(0.1 AS DOUBLE)) AS a, quantile_cont(l_quantity, CAST(0.5 AS DOUBLE)) AS b, quantile_cont(l_quantity, CAST(0.9 AS DOUBLE)) AS c FROM lineitem), x AS (SELECT lineitem.*, greatest(0, least(1.25, (l_quantity - b) / (c - b))) AS hi, greatest(0, least(1.25, (b - l_quantity) / (b - a))) AS lo FROM lineitem, q) "


def _scored(t: Tables):
    q = quantiles.quantiles(t(L), "l_quantity", {"a": 0.1, "b": 0.5, "c": 0.9})  # one row
    v = F.col("l_quantity")
    return t(L).crossJoin(F.broadcast(q)).withColumns({"hi": scores.quantile_score(v, F.col("b"), F.col("c")), "lo": scores.inverse_quantile_score(v, F.col("a"), F.col("b"))})


@BOOK.query(_Q + "SELECT l_returnflag, round(avg(hi), 6) AS hi, round(avg(lo), 6) AS lo FROM x GROUP BY 1")
def quantile_scores(t: Tables):
    return _scored(t).groupBy("l_returnflag").agg(F.round(F.avg("hi"), 6).alias("hi"), F.round(F.avg("lo"), 6).alias("lo"))


@BOOK.query(_Q + ", y AS (SELECT hi AS external, lo AS internal, l_tax * 10 AS algal FROM x) SELECT CASE WHEN external >= internal AND external >= algal THEN 'external' WHEN internal >= algal THEN 'internal' ELSE 'algal' END AS scenario, count(*) AS n FROM y GROUP BY 1")
def scenario_argmax(t: Tables):
    r = mechanism.ranked_labels({"external": F.col("hi"), "internal": F.col("lo"), "algal": F.col("l_tax") * 10})
    return _scored(t).groupBy(r[0].alias("scenario")).agg(F.count("*").alias("n"))


@BOOK.query("WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS q, avg(l_tax) AS t FROM lineitem GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, CASE WHEN q > 700 THEN 'storm' WHEN t > 0.045 THEN 'bloom' WHEN q < 200 THEN 'calm' ELSE 'normal' END AS scenario FROM d")
def scenario_rules(t: Tables):
    d = t(L).groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("q"), F.avg("l_tax").alias("t"))
    return d.select(F.col("day").cast("string").alias("day"), F.when(F.col("q") > 700, "storm").when(F.col("t") > 0.045, "bloom").when(F.col("q") < 200, "calm").otherwise("normal").alias("scenario"))


@BOOK.query("SELECT l_linestatus, array_to_string(list_filter([CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_discount > 0.09 THEN 'discount' END, CASE WHEN l_tax > 0.07 THEN 'tax' END], lambda v: v IS NOT NULL), '|') AS broken, count(*) AS n, round(sum(least(l_quantity, 45)), 2) AS clamped FROM lineitem GROUP BY 1, 2")
def safety_clamp(t: Tables):
    v = mechanism.violations({"quantity": F.col("l_quantity") > 45, "discount": F.col("l_discount") > 0.09, "tax": F.col("l_tax") > 0.07})
    return t(L).groupBy("l_linestatus", F.array_join(v, "|").alias("broken")).agg(F.count("*").alias("n"), F.round(F.sum(F.least("l_quantity", F.lit(45.0))), 2).alias("clamped"))


@BOOK.query("SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS gain, round(sum(l_extendedprice * l_tax), 4) AS cost, round(0.45 * avg(l_discount) + 0.35 * avg(l_tax) + 0.2 * avg(l_quantity), 6) AS balanced FROM lineitem GROUP BY 1")
def kpi_vector(t: Tables):
    gain, cost = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), F.sum(F.col("l_extendedprice") * F.col("l_tax"))
    balanced = 0.45 * F.avg("l_discount") + 0.35 * F.avg("l_tax") + 0.2 * F.avg("l_quantity")
    return t(L).groupBy("l_suppkey").agg(F.round(gain, 4).alias("gain"), F.round(cost, 4).alias("cost"), F.round(balanced, 6).alias("balanced"))


_BP = """WITH s AS (SELECT {k} AS g, l_quantity AS x, CAST(count(*) AS DOUBLE) AS n, sum(y) AS sy, sum(y * y) AS syy FROM (SELECT *, round(l_extendedprice / 1000, 3) AS y FROM lineitem) GROUP BY 1, 2),
u AS (SELECT g, x, n, sy, syy, x * n AS sx, x * x * n AS sxx, x * sy AS sxy FROM s),
w AS (SELECT g, x, {l}, {t} FROM u),
e AS (SELECT g, x, {sl} AS a, {sr} AS b, l_n, t_n - l_n AS r_n FROM w),
m AS (SELECT g, x, round(a + b, 4) AS err FROM e WHERE l_n >= 8 AND r_n >= 8)
SELECT {out}x AS threshold, round(err, 2) AS error FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY err, x) AS k FROM m) WHERE k = 1"""
_C = ("n", "sx", "sy", "sxx", "sxy", "syy")


def _sse(p) -> str:
    n, sx, sy, sxx, sxy, syy = (p(c) for c in _C)
    vx, vxy = f"({sxx} - {sx} * {sx} / {n})", f"({sxy} - {sx} * {sy} / {n})"
    return f"({syy} - {sy} * {sy} / {n} - CASE WHEN {vx} > 1e-9 THEN {vxy} * {vxy} / {vx} ELSE 0 END)"


def _bp(key: str, out: str) -> str:
    return _BP.format(
        k=key, out=out, l=", ".join(f"sum({c}) OVER (PARTITION BY g ORDER BY x) AS l_{c}" for c in _C), t=", ".join(f"sum({c}) OVER (PARTITION BY g) AS t_{c}" for c in _C),
        sl=_sse(lambda c: f"l_{c}"), sr=f"CASE WHEN t_n - l_n > 0 THEN {_sse(lambda c: f'(t_{c} - l_{c})')} ELSE 0 END",
    )


@BOOK.query(_bp("1", ""))
def breakpoint_search(t: Tables):
    b = measures.breakpoints(t(L).withColumn("y", F.round(F.col("l_extendedprice") / 1000, 3)), "l_quantity", "y", 8)
    return b.select("threshold", F.round("error", 2).alias("error"))


@BOOK.query(_bp("l_returnflag", "g AS l_returnflag, "))
def contextual_breakpoints(t: Tables):
    b = measures.breakpoints(t(L).withColumn("y", F.round(F.col("l_extendedprice") / 1000, 3)), "l_quantity", "y", 8, "l_returnflag")
    return b.select("l_returnflag", "threshold", F.round("error", 2).alias("error"))


_FR = {"x": (7919, 104729), "y": (6007, 15485863), "z": (3571, 32452843)}


@BOOK.query(
    "WITH s AS (SELECT " + ", ".join(f"(o_orderkey * {a} % 10007) / CAST(10007 AS DOUBLE) AS a_{k}, (o_orderkey * {b} % 10009) / CAST(10009 AS DOUBLE) AS b_{k}" for k, (a, b) in _FR.items()) + " FROM orders), "
    "f AS (SELECT 2 * a_x + a_y * a_y + 0.5 * a_z AS fa, 2 * b_x + b_y * b_y + 0.5 * b_z AS fb, 2 * b_x + a_y * a_y + 0.5 * a_z AS f_x, 2 * a_x + b_y * b_y + 0.5 * a_z AS f_y, 2 * a_x + a_y * a_y + 0.5 * b_z AS f_z FROM s), "
    "v AS (SELECT (sum(fa * fa + fb * fb) - sum(fa + fb) * sum(fa + fb) / (2 * count(*))) / (2 * count(*) - 1) AS v FROM f) "
    + " UNION ALL ".join(f"SELECT '{k}' AS factor, round(avg(fb * (f_{k} - fa)) / max(v), 6) AS first, round(avg((fa - f_{k}) * (fa - f_{k})) / 2 / max(v), 6) AS total FROM f, v" for k in _FR)
)
def sobol_indices(t: Tables):
    frac = lambda m, n: (F.col("o_orderkey") * m % n) / F.lit(float(n))
    s = t("orders").select(*(frac(a, 10007).alias(f"a_{k}") for k, (a, _) in _FR.items()), *(frac(b, 10009).alias(f"b_{k}") for k, (_, b) in _FR.items()))
    r = mechanism.sobol(s, list(_FR), lambda c: 2 * c["x"] + c["y"] * c["y"] + 0.5 * c["z"])
    return r.select("factor", F.round("first", 6).alias("first"), F.round("total", 6).alias("total"))


def _delta(t: Tables):
    return lambda q, p, d: mechanism.surrogate(q, p, d)["turbidity"]


@BOOK.query("SELECT factor, round(avg(delta), 6) AS delta FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS factor, {_turb(*v)} - {_turb('l_quantity', 'l_extendedprice / 1000', 'l_tax * 100')} AS delta FROM lineitem" for k, v in {"rain": ("l_quantity * 0.8", "l_extendedprice / 1000", "l_tax * 100"), "flow": ("l_quantity", "l_extendedprice / 1000 * 1.2", "l_tax * 100"), "load": ("l_quantity", "l_extendedprice / 1000", "l_tax * 100 * 0.8")}.items()) + ") GROUP BY 1")
def counterfactual_deltas(t: Tables):
    q, p, d, f = F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_tax") * 100, _delta(t)
    base = f(q, p, d)
    cases = {"rain": f(q * 0.8, p, d), "flow": f(q, p * 1.2, d), "load": f(q, p, d * 0.8)}
    wide = t(L).agg(F.array(*(F.struct(F.lit(k).alias("factor"), F.round(F.avg(c - base), 6).alias("delta")) for k, c in cases.items())).alias("r"))
    return wide.select(F.inline("r"))


@BOOK.query(
    f"WITH x AS (SELECT {_turb('l_quantity', 'l_extendedprice / 1000', 'l_tax * 100')} AS b, {_turb('l_quantity * 0.8', 'l_extendedprice / 1000', 'l_tax * 100')} AS r, {_turb('l_quantity', 'l_extendedprice / 1000 * 1.2', 'l_tax * 100')} AS f, {_turb('l_quantity * 0.8', 'l_extendedprice / 1000 * 1.2', 'l_tax * 100')} AS j FROM lineitem) SELECT round(avg(j - b), 6) AS joint, round(avg(r - b) + avg(f - b), 6) AS additive, round(avg(j - b) - avg(r - b) - avg(f - b), 6) + 0.0 AS synergy FROM x"
)
def joint_bundle(t: Tables):
    q, p, d, f = F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_tax") * 100, _delta(t)
    x = t(L).select(f(q, p, d).alias("b"), f(q * 0.8, p, d).alias("r"), f(q, p * 1.2, d).alias("f"), f(q * 0.8, p * 1.2, d).alias("j"))
    gap = lambda c: F.avg(F.col(c) - F.col("b"))
    return x.agg(F.round(gap("j"), 6).alias("joint"), F.round(gap("r") + gap("f"), 6).alias("additive"), (F.round(gap("j") - gap("r") - gap("f"), 6) + 0.0).alias("synergy"))


@BOOK.query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE vec_id <> 0 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) DESC, vec_id LIMIT 10")
def cosine_topk(t: Tables):
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    q = e.where("vec_id = 0").select(F.col("e").alias("q"))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = dot("e", "q") / F.sqrt(dot("e", "e")) / F.sqrt(dot("q", "q"))
    return e.where("vec_id != 0").crossJoin(F.broadcast(q)).select("vec_id", score.alias("s")).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("score"))


@BOOK.query(
    "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) "
    "SELECT query_id, vec_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS k FROM s WHERE NOT isnan(s)) WHERE k <= 10"
)
def cosine_topk_all_queries(t: Tables):
    e = t("embeddings").select("vec_id", "embedding")
    s = blocks.nearest_by_cosine(e.where("vec_id % 50 = 0"), e, 10)
    return s.select(F.col("query").alias("query_id"), F.col("row").alias("vec_id"), F.round("score", 6).alias("score"))


@BOOK.query("WITH r AS (SELECT p_partkey, p_brand, round(1 - (abs(p_size - 25) / 50.0 + abs(p_retailprice - 1000) / 2000.0) / 2, 6) AS sim FROM part) SELECT p_brand, p_partkey, sim FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY sim DESC, p_partkey) AS k FROM r) WHERE k <= 2")
def case_similarity_topk(t: Tables):
    sim = F.round(1 - (F.abs(F.col("p_size") - 25) / 50.0 + F.abs(F.col("p_retailprice") - 1000) / 2000.0) / 2, 6)
    return ranking.top_of_each(t("part").withColumn("sim", sim), ["p_brand"], [F.desc("sim"), F.col("p_partkey")], 2).select("p_brand", "p_partkey", "sim")


@BOOK.query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem GROUP BY 1")
def linear_fit(t: Tables):
    y, x = "l_extendedprice", "l_quantity"
    return t(L).groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 8).alias("r2"))
