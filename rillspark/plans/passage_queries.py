"""Queries over passages: heads, reading order, sections, chunks, linking, character n-grams, word columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.functions import words
from rillspark.operators import texts
from rillspark.plans.book import Book, Tables

BOOK = Book()

_BLOCKS = "b AS (SELECT o_orderstatus AS doc, o_custkey AS page, o_orderpriority || ' ' || (o_orderkey % 7) AS text, o_orderkey % 100 AS y0 FROM orders)"


def _blocks(t: Tables):
    k = F.col("o_orderkey")
    return t("orders").select(F.col("o_orderstatus").alias("doc"), F.col("o_custkey").alias("page"), F.concat_ws(" ", "o_orderpriority", (k % 7).cast("string")).alias("text"), (k % 100).alias("y0"))


@BOOK.query(
    f"WITH {_BLOCKS}, n AS (SELECT doc, count(DISTINCT page) AS pages FROM b GROUP BY 1), e AS (SELECT doc, 'top' AS place, text FROM b WHERE y0 <= 15 UNION ALL SELECT doc, 'bottom', text FROM b WHERE y0 + 5 >= 88), l AS (SELECT doc, place, regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g') AS line, count(*) AS n FROM e GROUP BY 1, 2, 3)"
    " SELECT l.doc, place, line, n FROM l JOIN n ON l.doc = n.doc WHERE n >= greatest(2, floor(pages * CAST(0.12 AS DOUBLE)))"
)
def running_heads(t: Tables):
    return texts.running_heads(_blocks(t), "doc", "page", F.col("text"), F.col("y0"), F.col("y0") + 5, F.lit(100.0), 0.12)


@BOOK.query(
    f"WITH {_BLOCKS}, n AS (SELECT doc, count(DISTINCT page) AS pages FROM b GROUP BY 1), e AS (SELECT doc, 'top' AS place, text FROM b WHERE y0 <= 15 UNION ALL SELECT doc, 'bottom', text FROM b WHERE y0 + 5 >= 88), l AS (SELECT doc, place, regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g') AS line, count(*) AS n FROM e GROUP BY 1, 2, 3),"
    " h AS (SELECT DISTINCT l.doc, line FROM l JOIN n ON l.doc = n.doc WHERE n >= greatest(2, floor(pages * CAST(0.25 AS DOUBLE)))) SELECT doc, count(*) AS kept FROM b WHERE (doc, regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g')) NOT IN (SELECT (doc, line) FROM h) GROUP BY 1"
)
def blocks_without_heads(t: Tables):
    b = _blocks(t)
    heads = texts.running_heads(b, "doc", "page", F.col("text"), F.col("y0"), F.col("y0") + 5, F.lit(100.0), 0.25)
    return texts.without_heads(b, heads, "doc", F.col("text")).groupBy("doc").agg(F.count("*").alias("kept"))


_PLACED = "b AS (SELECT l_orderkey AS page, l_linenumber AS i, CAST(l_partkey % 100 AS DOUBLE) AS x0, l_partkey % 100 + l_quantity AS x1, CAST(l_suppkey % 97 AS DOUBLE) AS y0 FROM lineitem), m AS (SELECT *, (x0 + x1) / 2 < 49 AS l, x1 - x0 < 70 AS narrow FROM b), t AS (SELECT *, count_if(l) OVER w >= 3 AND count_if(NOT l) OVER w >= 3 AND count_if(narrow) OVER w / count(*) OVER w > 0.6 AS two FROM m WINDOW w AS (PARTITION BY page)), c AS (SELECT *, CASE WHEN two AND NOT l THEN 1 ELSE 0 END AS \"column\" FROM t)"


@BOOK.query(f"WITH {_PLACED} SELECT page, i, \"column\", CAST(row_number() OVER (PARTITION BY page ORDER BY \"column\", y0, x0, i) AS BIGINT) AS ordinal FROM c")
def reading_order(t: Tables):
    x = (F.col("l_partkey") % 100).cast("double")
    b = t("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("i"), x.alias("x0"), (x + F.col("l_quantity")).alias("x1"), (F.col("l_suppkey") % 97).cast("double").alias("y0"))
    return texts.reading_order(b, ["page"], "x0", "x1", "y0", 100.0, "i").select("page", "i", "column", F.col("ordinal").cast("long").alias("ordinal"))


@BOOK.query("SELECT p_brand AS doc, arg_min(trim(p_name), {'f': -p_size, 'y': p_partkey, 't': p_name}) AS title FROM part WHERE length(trim(p_name)) BETWEEN 5 AND 200 AND regexp_matches(p_name, '[a-zA-Z]') GROUP BY 1")
def title_candidates(t: Tables):
    return texts.titles(t("part").select(F.col("p_brand").alias("doc"), "p_name", "p_size", "p_partkey"), "doc", "p_name", "p_size", "p_partkey")


@BOOK.query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([a-z])-\\n([a-z])', '\\1\\2', 'g'), '([^.!?:\\n])\\n([^\\n])', '\\1 \\2', 'g')) AS digest FROM documents")
def joined_lines(t: Tables):
    return t("documents").select("doc_id", F.md5(texts.joined_lines(F.col("text"))).alias("digest"))


_HEADS = {"license": "^(Licensed|Copyright)", "list": "^[-*#]", "numbered": "^[0-9]+[.)]"}
_SECTION = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in _HEADS.items()) + " END"


@BOOK.query(
    f"WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM s), m AS (SELECT *, {_SECTION} AS h FROM l),"
    " w AS (SELECT *, max(CASE WHEN h IS NOT NULL THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS spot FROM m), g AS (SELECT w.*, coalesce((SELECT h FROM m WHERE m.doc_id = w.doc_id AND m.i = w.spot), 'front') AS section FROM w)"
    " SELECT doc_id, section, CAST(min(i) AS BIGINT) AS first_line, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM g GROUP BY doc_id, section, spot"
)
def document_sections(t: Tables):
    s = texts.sections(t("documents").where("text is not null"), "doc_id", "text", _HEADS)
    return s.select("doc_id", "section", F.col("first_line").cast("long").alias("first_line"), "n_lines", "n_chars")


@BOOK.query()
def paragraph_chunks(t: Tables):
    c = texts.paragraph_chunks(t("documents"), "doc_id", "text", 1200, 200)
    return c.select("doc_id", "ordinal", "char_start", "char_end", F.md5("chunk").alias("digest"), F.format_string("doc%d#%04d", "doc_id", F.col("ordinal") + 1).alias("chunk_id"))


_GRAM = "SELECT item_id, unnest(list_filter(flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), lambda w: flatten([list_transform(range(1, length(w) + 3), lambda i: substring(' ' || w || ' ', i, 1)), list_transform(range(1, length(w) + 2), lambda i: substring(' ' || w || ' ', i, 2)), list_transform(range(1, length(w) + 1), lambda i: substring(' ' || w || ' ', i, 3))]))), lambda g: trim(g) <> '')) AS term FROM benchmark"


@BOOK.query(
    f"WITH g AS ({_GRAM}), tf AS (SELECT item_id, term, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM benchmark),"
    " x AS (SELECT item_id, tf.term, (1 + ln(tf)) * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN df ON tf.term = df.term, n), y AS (SELECT item_id, sqrt(sum(w * w)) AS len FROM x GROUP BY 1), u AS (SELECT x.item_id, term, w / len AS w FROM x JOIN y ON x.item_id = y.item_id),"
    " s AS (SELECT q.item_id AS query_id, d.item_id, round(sum(q.w * d.w), 9) AS score FROM u q JOIN u d ON q.term = d.term AND q.item_id % 5 = 0 GROUP BY 1, 2)"
    " SELECT query_id, item_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS k FROM s) WHERE k <= 5"
)
def char_ngram_search(t: Tables):
    b = t("benchmark").select("item_id", "text")
    q = b.where("item_id % 5 = 0").select(F.col("item_id").alias("query_id"), "text")
    return texts.lexical_search(q, "query_id", b, "item_id", "text", 5).select("query_id", "item_id", F.round("score", 6).alias("score"))


_SURFACES = "w AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM benchmark), s AS (SELECT DISTINCT w AS node, w AS flat, 'name' AS kind FROM w WHERE length(w) >= 8 AND item_id % 2 = 0 UNION SELECT DISTINCT w, w[1:6], 'alias' FROM w WHERE length(w) >= 8 AND item_id % 4 = 0)"
_SET = "list_distinct(list_filter(string_split({}, ''), lambda x: x <> ''))"


@BOOK.query(
    f"WITH {_SURFACES}, q AS (SELECT DISTINCT item_id, w AS run FROM w WHERE w <> ''), e AS (SELECT item_id, node, CASE WHEN kind = 'name' THEN 1.0 ELSE 0.8 END AS score, CASE WHEN kind = 'name' THEN 'exact' ELSE 'alias' END AS how FROM q JOIN s ON run = flat),"
    f" f AS (SELECT item_id, node, len(list_intersect({_SET.format('run')}, {_SET.format('flat')})) / CAST(len(list_distinct(list_concat({_SET.format('run')}, {_SET.format('flat')}))) AS DOUBLE) AS j FROM q JOIN s ON run[1:3] = flat[1:3] AND run <> flat AND length(run) >= 5 AND length(flat) >= 5),"
    " u AS (SELECT item_id, node, CAST(score AS DOUBLE) AS score, how FROM e UNION ALL SELECT item_id, node, round(j * CAST(0.6 AS DOUBLE), 9), 'jaccard' FROM f WHERE j >= CAST(0.7 AS DOUBLE))"
    " SELECT item_id, node, max({'s': score, 'h': how}).s AS score, max({'s': score, 'h': how}).h AS how FROM u GROUP BY 1, 2"
)
def entity_links(t: Tables):
    b = t("benchmark").select("item_id", "text")
    w = b.select("item_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("w")).where("length(w) >= 8")
    names = w.where("item_id % 2 = 0").select(F.col("w").alias("node"), F.col("w").alias("surface"), F.lit("name").alias("kind"))
    aliases = w.where("item_id % 4 = 0").select(F.col("w").alias("node"), F.substring("w", 1, 6).alias("surface"), F.lit("alias").alias("kind"))
    # surfaces here are single words, so runs of words meet nothing
    return texts.linked(b, "item_id", "text", names.unionByName(aliases).distinct())


@BOOK.query()
def similar_names(t: Tables):
    return texts.similar_names(t("part"), "p_name", 0.6).select("a", "b", F.round("ratio", 6).alias("ratio"))


@BOOK.query(
    "SELECT p_partkey, lower(replace(p_name, ' ', '')) AS folded, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat([p_name || ' (' || p_type || ')/' || p_brand], regexp_split_to_array(p_name || ' (' || p_type || ')/' || p_brand, '[()/]+')), lambda x: trim(x)), lambda x: x <> ''))), '|') AS variants,"
    " contains(' ' || lower(p_name) || ' ', ' ' || split_part(lower(p_name), ' ', 1) || ' ') AS occurs, left(lower(replace(p_name, ' ', '')), 3) AS key FROM part"
)
def name_columns(t: Tables):
    name = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")/"), "p_brand")
    v = F.array_sort(words.variants(name))
    return t("part").select("p_partkey", words.folded(F.col("p_name")).alias("folded"), F.array_join(v, "|").alias("variants"), words.occurs(F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_name")).alias("occurs"), words.prefix_key(F.col("p_name")).alias("key"))


@BOOK.query(
    "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(line, '(?i)^\\s*(page\\s*)?[0-9]{1,4}(\\s*(/|of)\\s*[0-9]{1,4})?\\s*$') THEN 'page_number' WHEN regexp_matches(line, '(?i)^\\s*(fig(ure)?|table)\\.?\\s*[0-9]+') THEN 'caption' WHEN regexp_matches(line, '^\\s*\\[[0-9]+\\]\\s') OR regexp_matches(line, '(?i)\\bdoi\\s*:') THEN 'reference'"
    " WHEN regexp_matches(line, '(?i)^\\s*(acknowledge?ments?|funding)\\b') THEN 'thanks' WHEN regexp_matches(line, '(?i)\\b(university|institute|department|laboratory)\\b.*,') THEN 'affiliation' ELSE 'body' END AS kind FROM l) GROUP BY 1"
)
def line_kinds(t: Tables):
    lines = t("documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(words.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@BOOK.query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, regexp_replace(regexp_replace('x ' || o_orderpriority || '/' || o_orderkey || '.csv', '[^a-zA-Z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS file, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'urgent' WHEN o_orderpriority LIKE '%LOW%' THEN 'low' ELSE 'other' END AS failure, CAST(o_orderkey % 10 AS VARCHAR) AS payload FROM orders"
)
def small_parsers(t: Tables):
    o = t("orders")
    day = words.day_in(F.concat(F.lit("taken on "), F.date_format("o_orderdate", "yyyy.M.d"), F.lit(" at noon")))
    file = words.safe_name(F.concat(F.lit("x "), "o_orderpriority", F.lit("/"), "o_orderkey", F.lit(".csv")))
    failure = words.first_match(F.col("o_orderpriority"), [("urgent", "URGENT"), ("low", "LOW")], "other")
    payload = F.get_json_object(words.object_in(F.concat(F.lit('Sure, here it is: {"k": '), (F.col("o_orderkey") % 10).cast("string"), F.lit("} done"))), "$.k")
    return o.select("o_orderkey", day.alias("day"), file.alias("file"), failure.alias("failure"), payload.alias("payload"))


@BOOK.query(
    "WITH a AS (SELECT conv_id, 'see [' || (turn % 3 + 1) || '] and [' || (turn % 5 + 1) || ']' AS answer FROM conversations), m AS (SELECT conv_id, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[([0-9]{1,3})\\]', 1), lambda x: CAST(x AS INT)))) AS m FROM a)"
    " SELECT conv_id, CAST(sum(len(m)) AS BIGINT) AS cited, round(sum(len(list_filter(m, lambda x: x <= 3))) / sum(len(m)), 6) AS valid, round(avg(CASE WHEN len(list_filter(m, lambda x: x <= 3)) > 0 THEN 1.0 ELSE 0.0 END), 6) AS grounded FROM m GROUP BY 1"
)
def citation_validity(t: Tables):
    k = F.col("turn")
    answer = F.concat(F.lit("see ["), (k % 3 + 1).cast("string"), F.lit("] and ["), (k % 5 + 1).cast("string"), F.lit("]"))
    m = t("conversations").select("conv_id", words.markers(answer).alias("m")).withColumn("good", F.size(F.filter("m", lambda x: x <= 3)))
    return m.groupBy("conv_id").agg(F.sum(F.size("m")).cast("long").alias("cited"), F.round(F.sum("good") / F.sum(F.size("m")), 6).alias("valid"), F.round(F.avg((F.col("good") > 0).cast("double")), 6).alias("grounded"))
