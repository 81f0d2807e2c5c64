"""Queries over documents, conversations and retrieval passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.operators import blocks, ranking, texts
from rillspark.plans.book import Book, Tables

BOOK = Book()


@BOOK.query("WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS line FROM documents) SELECT doc_id, count(*) AS n, CAST(count_if(line <> '') AS BIGINT) AS filled, CAST(count_if(regexp_matches(line, '^[0-9]+$')) AS BIGINT) AS page_numbers, CAST(count_if(regexp_matches(line, '(?i)licensed under')) AS BIGINT) AS legal, CAST(sum(length(line)) AS BIGINT) AS chars FROM l GROUP BY 1")
def clean_lines(t: Tables):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("raw")).select("doc_id", texts.clean_line(F.col("raw")).alias("line"))
    c = F.col("line")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(c != "").alias("filled"), F.count_if(c.rlike("^[0-9]+$")).alias("page_numbers"), F.count_if(c.rlike("(?i)licensed under")).alias("legal"), F.sum(F.length(c)).alias("chars"))


@BOOK.query("WITH l AS (SELECT DISTINCT doc_id, regexp_replace(lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g'))), '[0-9]+', '#', 'g') AS line FROM documents) SELECT line, count(*) AS n_docs FROM l WHERE line <> '' GROUP BY 1 HAVING count(*) >= 5")
def repeated_lines(t: Tables):
    return texts.repeated_lines(t("documents"), "doc_id", "text", 5)


@BOOK.query("WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1 - 200, 0) + 1, 800)) AS a FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(a // 800 AS BIGINT) AS ordinal, CAST(a AS BIGINT) AS char_start, CAST(least(a + 1000, length(text)) AS BIGINT) AS char_end, md5(text[a + 1:least(a + 1000, length(text))]) AS digest FROM s")
def chunk_spans(t: Tables):
    c = texts.fixed_chunks(t("documents"), "doc_id", "text", 1000, 200)
    return c.select("doc_id", *(F.col(k).cast("long").alias(k) for k in ("ordinal", "char_start", "char_end")), F.md5("chunk").alias("digest"))


_KW = ("license", "token", "password", "version")


@BOOK.query("SELECT doc_id, " + ", ".join(f"CAST(contains(lower(text), '{k}') AS BIGINT) AS has_{k}" for k in _KW) + ", CAST(" + " + ".join(f"CAST(contains(lower(text), '{k}') AS INT) * {w}" for k, w in zip(_KW, (10, 8, 6, 2), strict=True)) + " AS BIGINT) AS score FROM documents")
def keyword_hits(t: Tables):
    low = F.lower("text")
    score = sum((low.contains(k).cast("int") * w for k, w in zip(_KW, (10, 8, 6, 2), strict=True)), F.lit(0))
    return t("documents").select("doc_id", *(low.contains(k).cast("long").alias(f"has_{k}") for k in _KW), score.cast("long").alias("score"))


_LW = "regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')"


@BOOK.query(
    f"WITH w AS (SELECT item_id, unnest({_LW}) AS term FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM benchmark), "
    "x AS (SELECT item_id, tf.term, (1 + ln(tf)) * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN df ON tf.term = df.term, n), y AS (SELECT item_id, sqrt(sum(w * w)) AS len FROM x GROUP BY 1) "
    "SELECT x.item_id, term, round(w / len, 6) AS weight FROM x JOIN y ON x.item_id = y.item_id"
)
def tfidf_weights(t: Tables):
    w = F.filter(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    return texts.tf_idf(t("benchmark"), "item_id", w).select("item_id", "term", F.round("weight", 6).alias("weight"))


@BOOK.query("WITH c AS (SELECT n_nationkey AS k, list_distinct(string_split(lower(n_name), '')) AS s FROM nation) SELECT CAST(a.k AS BIGINT) AS a, CAST(b.k AS BIGINT) AS b, round(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE), 6) AS similarity FROM c a JOIN c b ON a.k < b.k")
def char_jaccard(t: Tables):
    # nations are a fixed table of 25 names
    c = t("nation").select(F.col("n_nationkey").cast("long").alias("k"), texts.char_set(F.col("n_name")).alias("s"))
    x, y = c.alias("x"), F.broadcast(c.alias("y"))
    return x.join(y, F.col("x.k") < F.col("y.k")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.round(texts.jaccard(F.col("x.s"), F.col("y.s")), 6).alias("similarity"))


@BOOK.query("SELECT conv_id, count(*) AS turns, CAST(sum(len(regexp_extract_all(text, '[a-z]+'))) AS BIGINT) AS tokens, round(avg(CAST(regexp_matches(text, '[0-9]') AS DOUBLE)), 6) AS cited FROM conversations GROUP BY 1")
def citation_ratio(t: Tables):
    n = F.regexp_count("text", F.lit("[a-z]+"))
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(n).cast("long").alias("tokens"), F.round(F.avg(F.col("text").rlike("[0-9]").cast("double")), 6).alias("cited"))


@BOOK.query(
    f"WITH q AS (SELECT DISTINCT item_id, unnest({_LW}) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({_LW}) AS w FROM documents), s AS (SELECT item_id, doc_id, count(*) AS hits FROM q JOIN d USING (w) WHERE length(w) > 12 GROUP BY 1, 2) "
    "SELECT item_id, doc_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS k FROM s) WHERE k <= 3"
)
def retrieval_topk(t: Tables):
    w = F.explode(F.array_distinct(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+"))).alias("w")
    q = t("benchmark").select("item_id", w).where(F.length("w") > 12)
    d = t("documents").select("doc_id", w).where(F.length("w") > 12)
    s = d.join(q, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))
    return ranking.top_of_each(s, ["item_id"], [F.desc("hits"), F.col("doc_id")], 3).select("item_id", "doc_id", "hits")


@BOOK.query(
    f"WITH q AS (SELECT DISTINCT item_id, unnest({_LW}) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({_LW}) AS w FROM documents), s AS (SELECT item_id, doc_id, count(*) AS hits FROM q JOIN d USING (w) GROUP BY 1, 2) "
    "SELECT item_id, doc_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS k FROM s) WHERE k <= 3"
)
def retrieval_topk_all_words(t: Tables):
    w = F.filter(F.array_distinct(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+")), lambda x: x != "").alias("w")
    s = blocks.most_shared_words(t("benchmark").select("item_id", w), t("documents").select("doc_id", w), 3)
    return s.select(F.col("query").alias("item_id"), F.col("row").alias("doc_id"), F.col("score").alias("hits"))


@BOOK.query("WITH r AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, text FROM conversations) SELECT conv_id, count(*) AS turns, max(CASE WHEN k = 1 THEN md5(text) END) AS opening FROM r GROUP BY 1")
def first_turn_digest(t: Tables):
    first = F.min(F.struct("turn", "role", "text"))
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.md5(first["text"]).alias("opening"))
