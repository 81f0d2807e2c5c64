"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


from rillspark.llm import bpe, centroids, decontaminate, html_text, lm_score, near_dup, packing, pii, pu_quality, quality, sharding, spelling, token_count, token_files


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_docs(spark, sf_dir))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_docs(spark, sf_dir), 16)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_docs(spark, sf_dir), token_count.default_path())


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(_docs(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_docs(spark, sf_dir), bpe.default_path())


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_components(_docs(spark, sf_dir), size=2)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_ids(token_files.write_ids(_docs(spark, sf_dir), bpe.default_path()))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_docs(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_docs(spark, sf_dir), shortest=6, fewest=5, noise=199)


def op12_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.scored(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), dimensions=64, clusters=40, rounds=5, seed=2)


QUERIES = {f.__name__: f for f in (op1_pii, op2_html, op3_shards, op4_token_counts, op5_lm_scores, op6_packing, op7_near_dup, op8_token_files, op9_decontaminate, op10_quality, op11_spelling, op12_pu_quality, op13_centroids)}


def _rounds_sql(rounds: int) -> str:
    """Assignments (near0, ...) and centroids (c0, ...) of k-means, one pair of tables for each round."""
    near = """near{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, k := k)) AS m
  FROM (SELECT r, vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{i}) GROUP BY r)"""
    moved = """c{j} AS MATERIALIZED (
  SELECT c{i}.k, coalesce(n.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c
    FROM (SELECT m.k AS k, j, sum(v[j]) AS s, count(*) AS n FROM near{i}, unnest(range(1, 65)) AS u(j) GROUP BY m.k, j) GROUP BY k) n ON n.k = c{i}.k)"""
    return ",\n".join(x.format(i=i, j=i + 1) for i in range(rounds + 1) for x in ([near, moved] if i < rounds else [near]))

ORACLE = {
    "op10_quality": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS h FROM w, unnest(range(1, len(ws) - 6)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, t, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 10 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 2 * n_dup_lines > n_lines
            OR 10 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * word_chars
            OR 10 * len(regexp_replace(t, '[^\p{L}]+', '', 'g')) < 6 * word_chars
            OR 10 * len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) > 3 * n_words
            OR (n_words >= 50 AND 10 * len(list_distinct(ws)) < n_words)) AS kept
FROM b
""",
    # crc32 goes byte by byte through a table of 256 numbers; words one edit apart share what is left without one code point
    "op11_spelling": r"""
WITH tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS BIGINT)) ELSE a // 2 END, CAST(b AS BIGINT))) AS t),
runs AS MATERIALIZED (
  SELECT id, run, hex(encode(CAST(id AS VARCHAR) || ':' || run)) AS x, count(*) AS n FROM (
    SELECT doc_id AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents) GROUP BY id, run),
hashed AS (
  SELECT run, n, 4294967295 - list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
                             lambda a, b: xor(a // 256, t[CAST(xor(a % 256, b) AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)) AS h
  FROM runs, tab),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % len(run) AS INTEGER)) || substr(run, CAST(h % len(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed)
  WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM words, unnest(range(len(word))) AS u(i)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, near := near)) AS m FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.m.less >= 5 * w.n THEN b.m.near END AS form, CASE WHEN -b.m.less >= 5 * w.n THEN -b.m.less END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  WITH RECURSIVE up(word, last, step) AS (
    SELECT word, form, 1 FROM forms WHERE form IS NOT NULL
    UNION ALL SELECT up.word, f.form, up.step + 1 FROM up JOIN forms f ON f.word = up.last WHERE f.form IS NOT NULL)
  SELECT word, arg_max(last, step) AS root FROM up GROUP BY word)
SELECT f.word, f.form, coalesce(c.root, f.word) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f LEFT JOIN chain c ON c.word = f.word
""",
    "op13_centroids": f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS k, v AS c FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) <= 40),
{_rounds_sql(5)}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance,
       CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c5.c, ',')) AS centroid_sha256
FROM near5 JOIN c5 ON c5.k = m.k
""",
}
