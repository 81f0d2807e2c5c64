"""The search index against sums over all documents."""

import random
from collections import defaultdict

import pytest

from rillspark.operators import search_index


def plain(postings, questions, k):
    best = defaultdict(dict)
    for (d, t), w in postings.items():
        for (q, u), v in questions.items():
            if t == u:
                best[q][d] = best[q].get(d, 0) + w * v
    return {(q, d, round(s, 9), n) for q, found in best.items() for n, (d, s) in enumerate(sorted(found.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k], 1)}


@pytest.mark.parametrize("listed", [1000, 2])
def test_best_documents_are_those_of_all_sums(spark, listed, monkeypatch):
    monkeypatch.setattr(search_index, "LISTED_TERMS", listed)
    r = random.Random(3)
    terms = [f"t{i}" for i in range(40)]
    # "hot" stands in every document; few documents weigh much, so that blocks can be ruled out
    postings = {(d, t): round(r.random() ** 6 * (50 if d % 97 == 0 else 1), 6) for d in range(600) for t in ["hot", *r.sample(terms, 5)]}
    postings |= {(d, t): w for (d, t), w in list(postings.items())[:30]}
    questions = {(q, t): round(r.random() + 0.1, 3) for q in range(8) for t in ["hot", *r.sample(terms, 3)]} | {(8, "nowhere"): 1.0, (9, "t1"): 0.0}
    d = spark.createDataFrame([(d, t, w) for (d, t), w in postings.items()] + [(None, "t1", 9.0), (1, None, 9.0)], "doc long, term string, weight double").repartition(3)
    q = spark.createDataFrame([(k, t, w) for (k, t), w in questions.items()], "q long, term string, weight double")
    index = search_index.built(d, "doc", docs_of_block=20, buckets=8)
    best, facts = search_index.searched(index, q, "q", 4, buckets=8, first=2)
    assert {(x.q, x.doc, x.score, x["rank"]) for x in best.collect()} == plain(postings, {k: w for k, w in questions.items() if w}, 4)
    read = facts.collect()
    assert len(read) == 8 and all(x.postings_read <= x.postings_there for x in read)
    assert sum(x.blocks_read for x in read) < sum(x.blocks_there for x in read), "blocks are ruled out"


def test_an_empty_index_and_no_questions(spark):
    d = spark.createDataFrame([], "doc long, term string, weight double")
    one = spark.createDataFrame([(1, "a", 1.0)], "doc long, term string, weight double")
    q = spark.createDataFrame([(1, "a", 1.0)], "q long, term string, weight double")
    assert search_index.searched(search_index.built(d, "doc"), q, "q", 3)[0].count() == 0
    best, facts = search_index.searched(search_index.built(one, "doc"), q.limit(0), "q", 3)
    assert best.count() == 0 and facts.count() == 0


def test_only_the_buckets_of_the_terms_are_read(spark):
    d = spark.createDataFrame([(i, f"t{i}", 1.0) for i in range(50)], "doc long, term string, weight double")
    asked = spark.createDataFrame([(1, "t3", 1.0)], "query long, term string, w double")
    rows = search_index._of_terms(search_index.built(d, "doc"), asked, search_index.BUCKETS)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1][:60] and "In(term" in plan.replace("EqualTo(term", "In(term")
    assert [r.docs for r in rows.collect()] == [[3]]


def test_lists_made_block_by_block_are_those_of_the_postings(spark):
    from pyspark.sql import functions as F

    from rillspark.operators import texts

    r = random.Random(5)
    # repeated ids, ids and texts that are null, texts without words
    rows = [(i // 2 if i % 9 == 0 else i, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 12)))) for i in range(120)]
    rows += [(None, "a hh new"), (None, "a"), (500, None), (501, ""), (502, "12 34")]
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    split = F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))
    index, frequencies = search_index.of_texts(docs, "doc", split, docs_of_block=16, buckets=4)
    flat = lambda d: {(x.term, x.block, a): b for x in d.collect() for a, b in zip(x.docs, x.weights, strict=True)}
    got = flat(index)
    want = {(t, d): w for d, t, w in texts.tf_idf(docs, "doc", split).select("doc", "term", "weight").collect()}
    assert {(t, d): w for (t, _, d), w in got.items()} == pytest.approx(want) and len(got) == len(want)
    assert all(x.top == max(x.weights) and x.n == len(x.docs) for x in index.collect()) and index.select("block").distinct().count() > 3
    df = defaultdict(set)
    for d, text in rows:
        for t in (text or "").split():
            if t.isalpha():
                df[t].add(d)
    assert {x.term: x.df for x in frequencies.collect()} == {t: len(d) for t, d in df.items()}
    empty = search_index.of_texts(docs.limit(0), "doc", split)
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_questions_meet_a_block_in_groups(spark, monkeypatch):
    monkeypatch.setattr(search_index, "QUESTIONS_OF_GROUP", 2)
    postings = {(d, f"t{d % 5 + i}"): (d * 7 + i) % 11 + 1.0 for d in range(60) for i in range(3)}
    questions = {(q, f"t{q % 4 + i}"): 1.0 + i for q in range(7) for i in range(2)}
    d = spark.createDataFrame([(d, t, w) for (d, t), w in postings.items()], "doc long, term string, weight double")
    q = spark.createDataFrame([(k, t, w) for (k, t), w in questions.items()], "q long, term string, weight double")
    best, _ = search_index.searched(search_index.built(d, "doc", docs_of_block=20), q, "q", 3)
    assert {(x.q, x.doc, x.score, x["rank"]) for x in best.collect()} == plain(postings, questions, 3)
