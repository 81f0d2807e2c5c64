"""Searches block against block, against brute force, and the queries that use them."""

import os
import random

import numpy as np
import pytest

from rillspark.operators import blocks
from rillspark.plans import catalog

SF = "/root/testdata/sf0.01"


def test_shared_words_of_any_length_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "QUERIES", 7)
    monkeypatch.setattr(blocks, "ROWS", 11)
    r = random.Random(5)
    vocabulary = ["the", "a"] + ["w%d" % i for i in range(60)]
    make = lambda n, far: [(i * far, sorted({"the", *r.choices(vocabulary, k=r.randint(1, 15))})) for i in range(n)]
    items, docs = make(30, 1) + [(99, ["nowhere"]), (100, []), (101, None)], make(120, -3) + [(7, None), (8, [])]
    kind = "id long, w array<string>"
    got = blocks.most_shared_words(spark.createDataFrame(items, kind).repartition(3), spark.createDataFrame(docs, kind).repartition(5), 3)
    want = set()
    for i, w in items:
        hits = sorted((-len(set(w or ()) & set(v or ())), d) for d, v in docs)
        want |= {(i, d, -h) for h, d in hits[:3] if h}
    assert {tuple(x) for x in got.collect()} == want
    assert blocks.most_shared_words(spark.createDataFrame([], kind), spark.createDataFrame(docs, kind), 3).count() == 0


def test_cosine_with_equal_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "QUERIES", 4)
    monkeypatch.setattr(blocks, "ROWS", 9)
    r = np.random.default_rng(2)
    v = r.standard_normal((90, 6)).astype(np.float32)
    v[20:60] = v[20]  # ties, told apart by the id alone
    rows = [(i * 5, x.tolist()) for i, x in enumerate(v)] + [(1001, [0.0] * 6), (1002, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(4)
    got = blocks.nearest_by_cosine(df.where("id % 25 = 0"), df, 5).collect()
    unit = v.astype(float) / np.sqrt((v.astype(float) ** 2).sum(1))[:, None]
    want = {(i * 5, j * 5) for i in range(0, 90, 5) for j in sorted((j for j in range(90) if j != i), key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))[:5]}
    assert {(x["query"], x["row"]) for x in got} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_item_is_answered(spark):
    got = catalog.QUERIES["retrieval_topk_all_words"](spark, SF).select("item_id").distinct().count()
    assert got == spark.read.parquet(f"{SF}/benchmark.parquet").count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_query_vector_is_answered(spark):
    got = catalog.QUERIES["cosine_topk_all_queries"](spark, SF)
    assert got.count() == 10 * spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()
