"""Queries of similar names, surfaces in texts and entity seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.operators import communities, linking, search_index, similarity
from rillspark.plans.book import Book, Tables

BOOK = Book()
_WORDS = "SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM {}) WHERE length(w) >= 6"
_BAG = "SELECT w, g, unnest(range(1, count(*) + 1)) AS k FROM (SELECT w, unnest(list_transform(range(1, length(w) + 2), lambda i: (' ' || w || ' ')[i:i + 1])) AS g FROM {}) GROUP BY w, g"


def _words(t: Tables, table: str, name: str) -> DataFrame:
    return t(table).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias(name)).where(F.length(name) >= 6).distinct()


@BOOK.query(
    f"WITH a AS ({_WORDS.format('benchmark')}), b AS ({_WORDS.format('conversations')}), x AS ({_BAG.format('a')}), y AS ({_BAG.format('b')}),"
    " n AS (SELECT x.w AS word, y.w AS other, count(*) AS shared FROM x JOIN y ON x.g = y.g AND x.k = y.k GROUP BY 1, 2),"
    " s AS (SELECT word, other, 2 * shared / CAST(length(word) + length(other) + 2 AS DOUBLE) AS dice FROM n)"
    " SELECT word, other, round(dice, 9) AS dice FROM s WHERE dice >= CAST(0.75 AS DOUBLE) - 1e-9"
)
def fuzzy_words(t: Tables):
    """Words of conversations that are nearly words of the benchmark."""
    pairs = similarity.joined(_words(t, "benchmark", "word"), _words(t, "conversations", "other"), "word", similarity.padded_grams(F.col("word")), 0.75, "dice", "other", similarity.padded_grams(F.col("other")))
    return pairs.select(F.col("left").alias("word"), F.col("right").alias("other"), F.round("similarity", 9).alias("dice"))


@BOOK.query(
    f"WITH n AS (SELECT DISTINCT p_name AS w FROM part), x AS ({_BAG.format('n')}),"
    " p AS (SELECT a.w AS a, b.w AS b, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.k = b.k AND a.w < b.w GROUP BY 1, 2),"
    " s AS (SELECT a, b, shared / CAST(length(a) + length(b) + 2 - shared AS DOUBLE) AS jaccard FROM p)"
    " SELECT a, b, round(jaccard, 9) AS jaccard FROM s WHERE jaccard >= CAST(0.4 AS DOUBLE) - 1e-9"
)
def fuzzy_part_names(t: Tables):
    names = t("part").select("p_name").distinct()
    pairs = similarity.joined(names, None, "p_name", similarity.padded_grams(F.col("p_name")), 0.4, "jaccard")
    return pairs.select(F.col("left").alias("a"), F.col("right").alias("b"), F.round("similarity", 9).alias("jaccard"))


@BOOK.query(
    "WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark),"
    " s AS (SELECT DISTINCT ws[i] || ' ' || ws[i + 1] AS surface FROM w, unnest(range(1, len(ws))) AS u(i) UNION SELECT DISTINCT x FROM (SELECT unnest(ws) AS x FROM w) WHERE length(x) >= 8),"
    " f AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[()\\[\\]{}<>]', '', 'g'), '\\s+', ' ', 'g')) AS spaced FROM documents WHERE text IS NOT NULL),"
    " c AS (SELECT doc_id, spaced, string_split(spaced, ' ') AS cs FROM f),"
    " o AS (SELECT DISTINCT doc_id, unnest(string_split_regex(spaced, '[^a-z0-9]+')) AS surface FROM f"
    " UNION SELECT DISTINCT doc_id, regexp_extract(cs[i], '[a-z0-9]+$') || ' ' || regexp_extract(cs[i + 1], '^[a-z0-9]+') FROM c, unnest(range(1, len(cs))) AS u(i))"
    " SELECT surface, count(*) AS n_docs FROM o JOIN s USING (surface) GROUP BY surface"
)
def surface_documents(t: Tables):
    """Documents in which words and pairs of words of the benchmark stand, found by automata."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - 1, F.lit(1))), lambda i: F.array_join(F.slice("ws", i, F.lit(2)), " "))
    items = t("benchmark").select(ws.alias("ws"))
    long = items.select(F.explode("ws").alias("surface")).where("length(surface) >= 8")
    listed = items.where("size(ws) > 1").select(F.explode(pairs).alias("surface")).union(long).distinct()
    return linking.occurrences(t("documents"), "doc_id", "text", listed).groupBy("surface").agg(F.count("*").alias("n_docs"))


def _entities(t: Tables) -> DataFrame:
    """Long words of the benchmark with the number of items that hold them."""
    w = t("benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("name")).where("length(name) >= 8").distinct()
    return w.groupBy("name").agg(F.count("*").alias("degree"), F.when(F.min("item_id") % 2 == 0, "even").otherwise("odd").alias("source")).withColumn("node", F.col("name"))


@BOOK.query()
def entity_seeds(t: Tables):
    """The entities that each conversation is about, by names, related names, evidence and near names; tested against plain Python."""
    entities = _entities(t)
    beside = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - 1, F.lit(1))), lambda i: F.struct(F.get("ws", i - 1).alias("node"), F.get("ws", i).alias("text")))
    evidence = t("benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("ws")).select(F.inline(beside)).where("text is not null").distinct()
    related = entities.select(F.substring("name", 1, 7).alias("group"), F.col("name").alias("member"))
    table = linking.surfaces(entities, related=related, evidence=evidence)
    asked = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    return linking.linked(asked, "conv_id", "text", entities, table, most=12, least=0.35).select("conv_id", "source", "node", F.round("score", 9).alias("score"), "via", "surface", "rank")


@BOOK.query()
def word_communities(t: Tables):
    """Communities of the graph of neighbouring words of the benchmark; modularity is tested against a plain Louvain."""
    ws = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - 1, F.lit(1))), lambda i: F.struct(F.get("ws", i - 1).alias("a"), F.get("ws", i).alias("b")))
    return communities.communities(t("benchmark").select(ws.alias("ws")).select(F.inline(pairs)), "a", "b")


@BOOK.query(
    "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),"
    " n AS (SELECT count(*) AS n FROM documents), x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN df USING (term), n),"
    " d AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM x),"
    " q AS (SELECT item_id, term, (1 + ln(count(*))) * (ln((1 + any_value(n)) / CAST(1 + any_value(df) AS DOUBLE)) + 1) AS q FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark) JOIN df USING (term), n GROUP BY 1, 2),"
    " s AS (SELECT item_id, doc_id, round(sum(w * q), 9) AS score FROM d JOIN q USING (term) GROUP BY 1, 2)"
    " SELECT item_id, doc_id AS doc, score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s) WHERE k <= 5"
)
def indexed_search(t: Tables):
    """The five documents nearest to each benchmark item by TF-IDF, over a written index that is read block by block."""
    split = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    docs = t("documents").select("doc_id", "text")
    index, df = search_index.of_texts(docs, "doc_id", split)
    n = docs.count()
    tf = t("benchmark").select("item_id", F.explode(split).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("tf"))
    asked = tf.join(df, "term").select("item_id", "term", ((1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("weight"))
    return search_index.searched(index, asked, "item_id", 5)[0]
