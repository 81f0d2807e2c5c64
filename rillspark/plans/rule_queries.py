"""Queries of rules: scenarios, routing, indicators, keywords, points of relations, hits of links and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions import rules
from rillspark.operators import retrieval
from rillspark.plans.book import Book, Tables

BOOK = Book()


@BOOK.query(
    "WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) / 100 AS rain, avg(l_discount) * 160 AS chl, avg(l_tax) * 75 AS turb FROM lineitem GROUP BY 1)"
    " SELECT CAST(day AS VARCHAR) AS day, CASE WHEN rain > 36 THEN 's1_external_input' WHEN chl > 8 THEN 's3_algae_bloom' WHEN turb > 3 THEN 's4_chronic_combo' ELSE 's2_internal_release' END AS scenario FROM d"
)
def lake_scenarios(t: Tables):
    d = t("lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg((F.sum("l_quantity") / 100).alias("rain"), (F.avg("l_discount") * 160).alias("chl"), (F.avg("l_tax") * 75).alias("turb"))
    return d.select(F.col("day").cast("string").alias("day"), rules.scenario(F.col("rain"), F.col("chl"), F.col("turb")).alias("scenario"))


_ROUTES = (("closed", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}), ("running", {"o_orderstatus": "O"}), ("urgent", {"o_orderpriority": "1-URGENT"}))


@BOOK.query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'closed' WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'unknown' END AS route FROM orders")
def routed_orders(t: Tables):
    return t("orders").select("o_orderkey", rules.routed(_ROUTES).alias("route"))


@BOOK.query(
    "WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS t, l_extendedprice / 10000 AS r, l_quantity AS a, l_discount * 2000 AS c FROM lineitem),"
    " b AS (SELECT *, least(0.18::DOUBLE * least(r / 10, 1) + 0.09::DOUBLE * least(a / 50, 1) + 0.09::DOUBLE * least(c / 100, 1), 0.4::DOUBLE) AS ratio, r * 86400 * 0.02::DOUBLE + a * 24 * 0.5::DOUBLE + c * 0.1::DOUBLE AS cost, abs(r) / 15 + abs(a) / 100 + abs(c) / 500 AS size FROM a)"
    " SELECT l_orderkey, l_linenumber, round(t * ratio, 10) AS turbidity_reduction, round(ratio, 10) AS turbidity_reduction_ratio, round(cost, 8) AS energy_cost, round(greatest(0, least(1, 1 - cost / 35000)), 10) AS cost_saving_ratio,"
    " round(greatest(0, least(1, 1 - 0.04::DOUBLE * size)), 10) AS stability, CASE WHEN size > 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS response_time_hours, round(size, 10) AS action_magnitude FROM b"
)
def action_indicators(t: Tables):
    k = rules.indicators(F.col("l_quantity") / 10, F.col("l_extendedprice") / 10000, F.col("l_quantity"), F.col("l_discount") * 2000)
    d = t("lineitem").select("l_orderkey", "l_linenumber", k.alias("k"))
    rest = ("turbidity_reduction", "turbidity_reduction_ratio", "cost_saving_ratio", "stability", "action_magnitude")
    return d.select("l_orderkey", "l_linenumber", *(F.round(f"k.{c}", 10).alias(c) for c in rest), F.round("k.energy_cost", 8).alias("energy_cost"), "k.response_time_hours")


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _keywords_sql(c: str) -> str:
    brought = ", ".join(f"CASE WHEN contains(trim({c}), '{k}') THEN {_sql_list(v)} ELSE [] END" for k, v in rules.ALIASES.items())
    return f"list_sort(list_distinct(flatten([list_filter({_sql_list(rules.DOMAIN_TERMS)}, lambda x: contains(lower(trim({c})), lower(x))), {brought}, list_filter(regexp_extract_all(trim({c}), '[A-Za-z0-9\\-]+'), lambda w: length(w) >= 2)])))"


@BOOK.query(f"SELECT doc_id, len(k) AS n, md5(array_to_string(k, ',')) AS keywords FROM (SELECT doc_id, {_keywords_sql('text')} AS k FROM documents WHERE text IS NOT NULL)")
def question_keywords(t: Tables):
    """Keywords of every document, as their number and a digest."""
    k = t("documents").where("text is not null").select("doc_id", rules.keywords(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", ",")).alias("keywords"))


_POINTS_SQL = (
    "list_sum(list_transform(k, lambda w: CASE WHEN w = '' THEN 0 WHEN contains(s, w) OR contains(g, w) THEN 6 WHEN contains(r, w) THEN 5 WHEN contains(e, w) THEN 2 ELSE 0 END))"
    " + CASE WHEN s <> '' AND contains(q, s) THEN 10 ELSE 0 END + CASE WHEN g <> '' AND contains(q, g) THEN 10 ELSE 0 END + CASE WHEN r <> '' AND contains(q, r) THEN 8 ELSE 0 END"
)


@BOOK.query(
    "WITH w AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2), p AS (SELECT a.conv_id, a.turn, a.text AS q, string_split(trim(regexp_replace(b.text, '\\s+', ' ', 'g')), ' ') AS ws, b.text AS e FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),"
    f" f AS (SELECT conv_id, turn, q, e, ws[1] AS s, coalesce(ws[2], '') AS r, ws[-1] AS g, {_keywords_sql('q')} AS k FROM p)"
    # the invented texts have no question about methods
    f" SELECT conv_id, turn, CAST(coalesce({_POINTS_SQL}, 0) AS INTEGER) AS points FROM f"
)
def relation_points(t: Tables):
    """Points of each turn, taken as a relation of its first, second and last word, for the turn before it."""
    w = t("conversations").where("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("e"), F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("ws"))
    p = w.withColumnRenamed("text", "q").join(after, ["conv_id", "turn"])
    points = rules.relation_score(F.get("ws", F.lit(0)), F.element_at("ws", -1), F.get("ws", F.lit(1)), F.col("e"), F.col("q"), rules.keywords(F.col("q")))
    return p.select("conv_id", "turn", points.cast("int").alias("points"))


_CHAIN = "SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+')[1:3] AS c FROM conversations WHERE text IS NOT NULL"


@BOOK.query(
    f"WITH g AS ({_CHAIN}), e AS (SELECT DISTINCT conv_id, least(x.a, x.b) AS u, greatest(x.a, x.b) AS v FROM (SELECT conv_id, unnest([struct_pack(a := ws[i], b := ws[i + 1]) for i in range(1, len(ws))]) AS x FROM (SELECT conv_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM conversations WHERE role = 'assistant')) WHERE x.b IS NOT NULL),"
    " h AS (SELECT g.conv_id, g.turn, len(c) > 1 AND EXISTS (SELECT 1 FROM e WHERE e.conv_id = g.conv_id AND e.u = least(c[1], c[2]) AND e.v = greatest(c[1], c[2])) AND (len(c) < 3 OR EXISTS (SELECT 1 FROM e WHERE e.conv_id = g.conv_id AND e.u = least(c[2], c[3]) AND e.v = greatest(c[2], c[3]))) AS hit FROM g)"
    " SELECT conv_id, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS chain_hit FROM h GROUP BY 1"
)
def chain_hits(t: Tables):
    """The share of turns whose first three words are joined by pairs of neighbouring words of the answers."""
    c = t("conversations").where("text is not null")
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    chains = c.select("conv_id", F.slice(ws, 1, 3).alias("chain"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - 1, F.lit(1))), lambda i: F.struct(F.get("ws", i - 1).alias("a"), F.get("ws", i).alias("b")))
    edges = c.where("role = 'assistant'").select("conv_id", ws.alias("ws")).select("conv_id", F.inline(pairs)).where("b is not null")
    return retrieval.chain_hit(chains, edges, "conv_id", "chain", "a", "b").select("conv_id", F.round("chain_hit", 9).alias("chain_hit"))


@BOOK.query(
    "WITH g AS (SELECT DISTINCT conv_id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]+'))) AS n FROM conversations WHERE role = 'user'), l AS (SELECT DISTINCT conv_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS n FROM conversations WHERE role = 'assistant')"
    " SELECT g.conv_id, round(count(l.n) / count(*)::DOUBLE, 9) AS link_recall FROM g LEFT JOIN l ON l.conv_id = g.conv_id AND l.n = g.n GROUP BY 1"
)
def link_recalls(t: Tables):
    """The share of capitalized words of questions that the answers take up."""
    c = t("conversations")
    gold = c.where("role = 'user'").select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("name"))
    found = c.where("role = 'assistant'").select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("name"))
    return retrieval.link_recall(gold, found, "conv_id", "name").select("conv_id", F.round("link_recall", 9).alias("link_recall"))
