"""Queries of a sparse graph of parts: paths, fusion, communities, subgraphs, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.functions import words
from rillspark.operators import graph, ranking, retrieval
from rillspark.plans.book import Book, Tables

BOOK = Book()
#: Each part has edges to two others, which a rule of arithmetic gives.
_E = "e AS (SELECT p_partkey AS a, p_partkey * 3 % 1999 + 1 AS b FROM part UNION ALL SELECT p_partkey, p_partkey * 5 % 1999 + 1 FROM part)"
_NEAR = f"{_E}, n2 AS (SELECT a AS node, b AS \"to\" FROM e WHERE a <> b UNION ALL SELECT b, a FROM e WHERE a <> b), near AS (SELECT node, \"to\", count(*) AS weight FROM n2 GROUP BY 1, 2), deg AS (SELECT node, count(*) AS k FROM near GROUP BY 1)"
_PATHS = (
    f"WITH RECURSIVE {_NEAR}, p AS (SELECT CAST(p_partkey AS BIGINT) AS node, CAST(1 AS DOUBLE) AS score, [CAST(p_partkey AS BIGINT)] AS path FROM part WHERE p_partkey % 97 = 0 "
    "UNION ALL SELECT near.\"to\", score * CAST(0.9 AS DOUBLE) / (1 + ln(1 + k)), list_append(path, near.\"to\") FROM p JOIN deg USING (node) JOIN near USING (node) WHERE len(path) < 4 AND NOT list_contains(path, near.\"to\") AND score * CAST(0.9 AS DOUBLE) / (1 + ln(1 + k)) >= 0.05) "
)
_JOINED = "array_to_string(path, '>')"


def _edges(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t("part").select(k.alias("a"), F.explode(F.array(k * 3 % 1999 + 1, k * 5 % 1999 + 1)).alias("b"))


def _near(t: Tables) -> DataFrame:
    return graph.neighbours(_edges(t), "a", "b")


def _seeds(t: Tables) -> DataFrame:
    return t("part").where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("node"), F.lit(1.0).alias("score"))


def _paths(t: Tables) -> DataFrame:
    return graph.paths(_near(t), _seeds(t), 0.9, 0.05)


def _text(c: str = "path"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ">").alias("path")


@BOOK.query(_PATHS + f"SELECT {_JOINED} AS path, round(score, 9) AS score FROM p WHERE len(path) > 1")
def seed_paths(t: Tables):
    return _paths(t).select(_text(), F.round("score", 9).alias("score"))


@BOOK.query(
    _PATHS
    + ", s AS (SELECT path[1] AS seed, list_sort(path) AS nodes, round(score, 12) AS score, path FROM p WHERE len(path) > 1), o AS (SELECT seed, nodes, max(score) AS score, min_by(path, {'a': -score, 'b': path}) AS path FROM s GROUP BY 1, 2) "
    f"SELECT {_JOINED} AS path, round(score, 9) AS score FROM o WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.seed = o.seed AND len(x.nodes) > len(o.nodes) AND x.score >= o.score AND list_has_all(x.nodes, o.nodes))"
)
def undominated_paths(t: Tables):
    return graph.undominated(_paths(t).withColumn("score", F.round("score", 12))).select(_text(), F.round("score", 9).alias("score"))


_FUSED = (
    _PATHS
    + ", f AS (SELECT path, node, path[1] AS anchor, score, 1.0 / (len(path) - 1) AS short, (SELECT weight FROM near WHERE near.node = path[len(path) - 1] AND near.\"to\" = p.node) AS w, CASE WHEN p.node % 10 = 0 THEN 1.0 ELSE 0.0 END AS lexical FROM p WHERE len(path) > 1),"
    " m AS (SELECT max(score) AS ms, max(w) AS mw FROM f), g AS (SELECT path, node, anchor, round(0.35 * score / ms + 0.45 * lexical + 0.15 * w / mw + 0.05 * short, 9) AS fused FROM f, m),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY fused DESC, array_to_string(path, '>')) AS k FROM g) "
)


def _fused(t: Tables) -> DataFrame:
    near, found = _near(t), _paths(t)
    last = near.select(F.col("node").alias("__from"), F.col("to").alias("node"), "weight")
    f = found.withColumn("__from", F.element_at("path", -2)).join(last, ["__from", "node"]).withColumn("lexical", F.when(F.col("node") % 10 == 0, 1.0).otherwise(0.0))
    return retrieval.fused(f, {"score": 0.35, "weight": 0.15}, {"lexical": 0.45}, 0.05).withColumn("fused", F.round("fused", 9))


@BOOK.query(_FUSED + f"SELECT anchor, {_JOINED} AS path, fused FROM r WHERE k <= 2 ORDER BY fused DESC, path LIMIT 8")
def fused_paths(t: Tables):
    f = _fused(t).select(F.col("path")[0].alias("anchor"), _text(), "fused")
    return ranking.top_of_each(f, ["anchor"], [F.desc("fused"), F.col("path")], 2).orderBy(F.desc("fused"), "path").limit(8).select("anchor", "path", "fused")


@BOOK.query(
    _FUSED
    + ", x AS (SELECT array_to_string(path, '>') AS name, fused, path, unnest(range(1, len(path))) AS i FROM r WHERE k <= 2), y AS (SELECT least(path[i], path[i + 1]) AS u, greatest(path[i], path[i + 1]) AS v, fused, name, i FROM x),"
    " z AS (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY fused DESC, name, i) AS c FROM y) SELECT u, v, fused FROM (SELECT * FROM z WHERE c = 1 ORDER BY fused DESC, name, i LIMIT 30)"
)
def path_relations(t: Tables):
    f = _fused(t).select(F.col("path")[0].alias("anchor"), _text().alias("name"), "path", "fused")
    top = ranking.top_of_each(f, ["anchor"], [F.desc("fused"), F.col("name")], 2)
    return retrieval.relations_of(top, "path", "name", "fused", 30).select("u", "v", "fused")


_LABELS = "lab AS (SELECT node, min(\"to\") AS label FROM (SELECT node, node AS \"to\" FROM near UNION ALL SELECT node, \"to\" FROM near) GROUP BY 1)"


@BOOK.query(
    f"WITH {_NEAR}, {_LABELS}, i AS (SELECT x.label, n.node AS u, n.\"to\" AS v, a.k + b.k AS weight FROM near n JOIN lab x ON x.node = n.node JOIN lab y ON y.node = n.\"to\" JOIN deg a ON a.node = n.node JOIN deg b ON b.node = n.\"to\" WHERE n.node < n.\"to\" AND x.label = y.label) "
    "SELECT label, u, v, weight FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, u, v) AS r FROM i) WHERE r <= 2"
)
def community_edges(t: Tables):
    near = _near(t)
    labels = near.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label"))
    return graph.community_edges(near, labels, 2).select("label", "u", "v", "weight")


@BOOK.query(
    f"WITH {_NEAR}, {_LABELS}, c AS (SELECT label, count(*) AS size, string_agg(CAST(node AS VARCHAR), ', ' ORDER BY k DESC, node) AS names FROM lab JOIN deg USING (node) GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY size DESC, label) AS BIGINT) AS rank, label, size, left(names, 40) AS summary FROM c ORDER BY size DESC, label LIMIT 10"
)
def community_summaries(t: Tables):
    near = _near(t)
    labels = near.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label"))
    return retrieval.community_digests(near, labels, 10, 40)


@BOOK.query(
    f"WITH {_NEAR}, cited AS (SELECT CAST(p_partkey AS BIGINT) AS node, 0 AS tier FROM part WHERE p_partkey % 97 = 0), around AS (SELECT DISTINCT \"to\" AS node, 1 AS tier FROM near WHERE node IN (SELECT node FROM cited) AND \"to\" NOT IN (SELECT node FROM cited)),"
    " ch AS (SELECT node FROM (SELECT * FROM cited UNION ALL SELECT * FROM around) JOIN deg USING (node) ORDER BY tier, k DESC, node LIMIT 30) "
    "SELECT node AS u, \"to\" AS v, node IN (SELECT node FROM ch) AND \"to\" IN (SELECT node FROM ch) AS inside FROM near WHERE node < \"to\" AND (node IN (SELECT node FROM ch) OR \"to\" IN (SELECT node FROM ch))"
)
def cited_subgraph(t: Tables):
    return graph.subgraph(_near(t), _seeds(t), 30)[1]


_CHUNKS = "o AS (SELECT l_partkey AS a, l_suppkey AS b, l_orderkey AS chunk, l_linenumber AS ordinal FROM lineitem WHERE l_suppkey < 5)"


@BOOK.query(f"WITH {_CHUNKS}, d AS (SELECT a, b, chunk, min(ordinal) AS ordinal FROM o GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ordinal, chunk) AS k FROM d) SELECT a, b, string_agg(CAST(chunk AS VARCHAR), '|' ORDER BY k) AS chunks FROM r WHERE k <= 2 GROUP BY 1, 2")
def relation_chunks(t: Tables):
    o = t("lineitem").where("l_suppkey < 5").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("ordinal"))
    return retrieval.with_chunks(o, ["a", "b"], "chunk", "ordinal", 2)


@BOOK.query(
    "WITH p AS (SELECT 'path' AS origin, p_partkey AS k, p_size AS s, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE p_brand = 'Brand#11'), b AS (SELECT p_type AS origin, p_partkey AS k, p_size AS s, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS r FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')),"
    " u AS (SELECT *, 0 AS tier FROM p WHERE r <= 6 UNION ALL SELECT *, 1 AS tier FROM b), d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, r, origin) AS c FROM u) SELECT origin, k FROM (SELECT * FROM d WHERE c = 1 ORDER BY tier, r, origin, k LIMIT 15)"
)
def merged_relations(t: Tables):
    p = t("part").select("p_partkey", "p_size", "p_brand", "p_type")
    order = [F.desc("p_size"), F.col("p_partkey")]
    first = p.where("p_brand = 'Brand#11'").orderBy(*order).limit(6)
    return retrieval.backfilled(first.select(F.col("p_partkey").alias("k"), "p_size"), p.where("p_brand in ('Brand#11', 'Brand#12')").select(F.col("p_type").alias("origin"), F.col("p_partkey").alias("k"), "p_size"), "k", [F.desc("p_size"), F.col("k")], 15).select("origin", "k")


_ROUTE = "CASE WHEN n_seeds = 0 AND NOT broad THEN 'none' WHEN broad AND n_seeds = 0 THEN 'global' WHEN broad THEN 'hybrid' ELSE 'local' END"


@BOOK.query(
    f"WITH q AS (SELECT item_id, contains(lower(text), ' the ') AS broad, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 12)) AS n_seeds, CASE WHEN contains(lower(text), 'why') THEN 'cause' WHEN contains(lower(text), 'how') THEN 'method' WHEN contains(lower(text), 'what') THEN 'fact' ELSE 'other' END AS intent FROM benchmark) SELECT item_id, {_ROUTE} AS route, intent FROM q"
)
def question_routes(t: Tables):
    low = F.lower("text")
    seeds = F.size(F.filter(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 12))
    return t("benchmark").select("item_id", retrieval.route(seeds, low.contains(" the ")).alias("route"), words.intent(F.col("text"), {"cause": ("why",), "method": ("how",), "fact": ("what",)}).alias("intent"))


_RANKED = (
    "WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS w FROM documents), s AS (SELECT item_id, doc_id, count(*) AS hits FROM q JOIN d USING (w) GROUP BY 1, 2),"
    " r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS k FROM s), g AS (SELECT i.item_id, doc_id FROM benchmark i JOIN documents d ON contains(lower(d.text), lower(i.text))) "
)


@BOOK.query(
    _RANKED
    + "SELECT count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM (SELECT g.item_id, avg(CASE WHEN k <= 8 THEN 1.0 ELSE 0.0 END) AS recall, coalesce(max(CASE WHEN k <= 8 THEN 1.0 / k END), 0) AS rr FROM g LEFT JOIN r USING (item_id, doc_id) GROUP BY 1)"
)
def retrieval_quality(t: Tables):
    from rillspark.operators import blocks

    w = F.filter(F.array_distinct(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+")), lambda x: x != "").alias("w")
    found = blocks.most_shared_words(t("benchmark").select("item_id", w), t("documents").select("doc_id", w), 8).select("query", "row", "score")
    ranked = ranking.top_of_each(found, ["query"], [F.desc("score"), F.col("row")], 8)
    gold = retrieval.containing(t("benchmark"), "item_id", t("documents"), "doc_id", "text")
    q = retrieval.quality(ranked.select(F.col("query").alias("item_id"), F.col("row").alias("doc_id"), "rank"), gold, "item_id", "doc_id", 8)
    return q.select("questions", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


def _vote(i: int) -> str:
    return f"l{i} AS (SELECT node, label FROM (SELECT n.node, l.label, row_number() OVER (PARTITION BY n.node ORDER BY sum(weight) DESC, l.label) AS r FROM near n JOIN l{i - 1} l ON l.node = n.\"to\" GROUP BY 1, 2) WHERE r = 1)"


@BOOK.query(f"WITH {_NEAR}, l0 AS (SELECT DISTINCT node, node AS label FROM near), {_vote(1)}, {_vote(2)}, {_vote(3)} SELECT node, label FROM l3")
def weighted_communities(t: Tables):
    return graph.weighted_labels(_near(t), 3)


@BOOK.query(
    "WITH v AS (SELECT p_partkey AS term, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS trigger FROM part WHERE p_partkey <= 60), q AS (SELECT conv_id, turn, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS tokens FROM (SELECT conv_id, turn, text || CASE conv_id % 3 WHEN 0 THEN ' a red, small bolt' WHEN 1 THEN ' blue old anvil' ELSE ' large gizmo' END AS text FROM conversations))"
    " SELECT conv_id, turn, term FROM q JOIN v ON regexp_matches(tokens, ' ' || array_to_string(trigger, ' (.* )?') || ' ')"
)
def triggered_terms(t: Tables):
    vocabulary = t("part").where("p_partkey <= 60").select(F.col("p_partkey").alias("term"), F.col("p_name").alias("surface"))
    more = F.when(F.col("conv_id") % 3 == 0, " a red, small bolt").when(F.col("conv_id") % 3 == 1, " blue old anvil").otherwise(" large gizmo")
    asked = t("conversations").select("conv_id", "turn", F.concat("text", more).alias("text"))
    return retrieval.triggered(asked, ["conv_id", "turn"], "text", vocabulary)
