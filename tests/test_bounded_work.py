"""Work of bounded size: chunks of big batches, postings that are made once."""

import random
from collections import defaultdict

import pyarrow as pa

from rillspark.operators import search_index, texts


def test_chunks_of_a_batch_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(texts, "CHUNKED_BYTES", 100)
    rows = [(i, None if i % 7 == 0 else "\n".join("p%d é" % j * (i % 5) for j in range(i % 11))) for i in range(60)]
    batch = pa.RecordBatch.from_pylist([{"i": i, "t": t} for i, t in rows], pa.schema([("i", pa.int64()), ("t", pa.string())]))
    pieces = list(texts._by_size(iter([batch, batch.slice(0, 0)]), 100))
    assert pa.Table.from_batches(pieces).to_pylist() == batch.to_pylist() and len(pieces) > 3
    longest = max(len((t or "").encode()) for _, t in rows)
    assert all(sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 100 + longest for p in pieces)
    docs = spark.createDataFrame(rows, "i long, t string").coalesce(1)
    got = defaultdict(list)
    for x in texts.paragraph_chunks(docs, "i", "t", 20, 5).orderBy("i", "ordinal").collect():
        got[x.i].append((x.ordinal, x.char_start, x.char_end, x.chunk))
    assert all(c == dict(rows)[i][a:b] for i, found in got.items() for _, a, b, c in found)
    assert set(got) == {i for i, t in rows if t and t.strip()}


def test_an_index_makes_its_postings_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    r = random.Random(2)
    rows = [(d, f"t{k}", r.random()) for d in range(200) for k in r.sample(range(30), 5)]
    rows += [(d, t, w / 2) for d, t, w in rows[:50]]  # a posting twice counts at its highest weight
    made = spark.createDataFrame(rows, "doc long, term string, weight double").mapInArrow(counted, "doc long, term string, weight double")
    index = search_index.built(made, "doc", docs_of_block=30, buckets=4)
    assert runs.value == len(rows)
    got = {(x.term, d): w for x in index.collect() for d, w in zip(x.docs, x.weights, strict=True)}
    want = defaultdict(float)
    for d, t, w in rows:
        want[t, d] = max(want[t, d], w)
    assert got == want and sum(len(x.docs) for x in index.collect()) == len(want)
    assert all(x.top == max(x.weights) and x.docs == sorted(x.docs) for x in index.collect())


def test_a_page_is_sorted_once_for_its_reading_order(spark):
    r = random.Random(4)
    rows = [(p, i, r.choice([None, 0.0, 5.0, 60.0]), r.choice([20.0, 80.0]), float(r.randrange(4))) for p in range(120) for i in range(r.randint(1, 9))]
    blocks = spark.createDataFrame(rows, "p long, i long, x0 double, w double, y0 double").selectExpr("p", "i", "x0", "x0 + w AS x1", "y0")
    out = texts.reading_order(blocks, ["p"], "x0", "x1", "y0", 100.0, "i")
    assert out._jdf.queryExecution().sparkPlan().toString().count("Window ") == 1
    got, pages = {(x.p, x.i): (x.column, x.ordinal) for x in out.collect()}, defaultdict(list)
    for p, i, x0, w, y0 in rows:
        pages[p].append((y0, x0 is not None, x0 or 0.0, i, None if x0 is None else x0 + w / 2 < 49, x0 is not None and w < 70))
    both = 0
    for p, page in pages.items():
        known = [b for b in page if b[4] is not None]
        two = sum(b[4] for b in known) >= 3 and sum(not b[4] for b in known) >= 3 and sum(b[5] for b in known) / len(page) > 0.6
        both += two
        placed = sorted((1 if two and b[4] is False else 0, *b[:4]) for b in page)
        assert {(p, b[4]): (b[0], k) for k, b in enumerate(placed, 1)}.items() <= got.items()
    assert both and len(got) == len(rows)
