"""Every operator on awkward tables: long texts, repeated rows and ids, no rows, columns of the operators' own names."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from rillspark.llm import bpe, decontaminate, lm_score, near_dup, packing, pii, quality, sharding, token_count, token_files

NAMES = "id key n words block blocks size shard slot tokens chunk length start spans n_email redacted kept n_words base_failed row text__ bits bands hub bucket component seed place salt signature doc_ids ids counts h i c number first".split()
KIND = "doc_id long, text string, " + ", ".join(f"{c} string" for c in NAMES)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(21)
    word = lambda: "".join(r.choice("aeioudlnrst") for _ in range(r.randint(1, 9)))
    long = " ".join(word() for _ in range(30_000))
    return [long, long, "short text of a few words", None, "", "one", "one", " ".join(word() for _ in range(2600))]


@pytest.fixture(scope="module")
def plain(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def clashing(spark, texts):
    return spark.createDataFrame([(i, t, *["x"] * len(NAMES)) for i, t in enumerate(texts)], KIND).repartition(2)


BENCH = [(0, "a few words of some benchmark item that nobody would write down twice here")]
RUNS = {
    "op1": lambda d: pii.found(d),
    "op3": lambda d: sharding.sharded(d, 4).drop("shard", "slot"),
    "op4": lambda d: token_count.token_counts(d, token_count.default_path()),
    "op5": lambda d: lm_score.scored(d),
    "op6": lambda d: packing.packed(d, bpe.default_path()).drop("sequence_id"),
    "op7": lambda d: near_dup.near_components(d, 2),
    "op8": lambda d: token_files.read_ids(token_files.write_ids(d, bpe.default_path())),
    "op9": lambda d: decontaminate.contamination(d, d.sparkSession.createDataFrame(BENCH, "item_id long, text string")),
    "op10": lambda d: quality.judged(d),
}


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_columns_of_any_name_change_nothing(name, plain, clashing):
    assert rounded(RUNS[name](plain).collect()) == rounded(RUNS[name](clashing).collect())


@pytest.mark.parametrize("name", sorted(RUNS))
def test_no_rows_give_no_rows(name, clashing):
    assert RUNS[name](clashing.limit(0)).count() == 0


def test_long_documents_are_cut_at_the_longest_piece(plain, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    rows = packing.packed(plain, bpe.default_path(), with_ids=True).collect()
    assert max(r.length for r in rows) == 2048 and len(ids[0]) > 20_000
    for i, want in ids.items():
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in mine for x in np.frombuffer(r.ids, "<u4").tolist()] == want
        assert Counter(r.length for r in mine)[2048] == len(want) // 2048
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))


def test_random_access_to_token_files(spark, texts, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "BLOCK", 5000)
    tok = Tokenizer.from_file(bpe.default_path())
    rows = [(7 if i % 3 == 0 else i, t) for i, t in enumerate(texts)] + [(None, "no id")]
    files = token_files.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bpe.default_path())
    want = Counter((k, tuple(tok.encode(t or "", add_special_tokens=False).ids + [0])) for k, t in rows)
    for keys in ([7], [1, 5], [99]):
        got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in token_files.read_documents(files, keys).collect())
        assert got == Counter({k: n for k, n in want.items() if k[0] in keys})
    back = token_files.read_ids(files, with_ids=True).orderBy("start").collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in back) == want
    assert [r.doc_id for r in back] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back)])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in back)


def test_no_frequent_pair_is_left():
    r = np.random.default_rng(5)
    passage = r.integers(0, 50_000, 700)
    ids = np.concatenate([x for _ in range(40) for x in (passage, r.integers(0, 300, 500))])
    ends = np.array([9000, 28_000, len(ids)])
    rules, lengths, seq, cut = token_files.compress(ids, ends)
    inside = np.ones(len(seq) - 1, bool)
    inside[cut[:-1] - 1] = False
    pairs = Counter(zip(seq[:-1][inside].tolist(), seq[1:][inside].tolist(), strict=True))
    # pairs of one symbol overlap themselves: half of a run can be replaced
    assert max(n for (a, b), n in pairs.items() if a != b) < token_files.LEAST
    assert (token_files.expand(seq, rules, lengths) == ids).all() and lengths.max() > 300
    assert (token_files.expand_some(seq[cut[0] : cut[1]], rules) == ids[ends[0] : ends[1]]).all()


def plain_place(sizes, shards):
    """Vector bin packing item by item, without numpy."""
    total = [max(sum(s[d] for s in sizes), 1) for d in range(3)]
    share = [[s[d] / total[d] * shards for d in range(3)] for s in sizes]
    w = sharding.WEIGHTS.tolist()
    left, out = [[1.0] * 3 for _ in range(shards)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sum(share[i][d] * w[d] for d in range(3)), i)):
        best = max(range(shards), key=lambda k: (sum(left[k][d] * share[i][d] * w[d] for d in range(3)), -k))
        out[i] = best
        left[best] = [left[best][d] - share[i][d] for d in range(3)]
    return out


def test_placement_against_a_plain_form():
    r = random.Random(6)
    for _ in range(20):
        sizes = [[r.randint(1, 1000), r.randint(0, 200), r.randint(1, 9)] for _ in range(r.randint(1, 60))]
        assert sharding.place(np.array(sizes, float), 5).tolist() == plain_place(sizes, 5)


def test_groups_stay_whole_or_are_split_evenly(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    small = [" ".join(word() for _ in range(r.randint(5, 40))) for _ in range(600)]
    texts = small + small[:50] * 3 + ["hot text " * 20] * 500  # a group of over a third of all bytes
    got = sharding.sharded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), 8).collect()
    shards = {}
    for x in got:
        shards.setdefault(texts[x.doc_id], set()).add(x.shard)
    assert all(len(shards[t]) == 1 for t in small) and len(shards["hot text " * 20]) > 1
    sizes = [sum(x.size for x in got if x.shard == k) for k in range(8)]
    assert max(sizes) < 1.05 * sum(sizes) / 8 and min(sizes) > 0.95 * sum(sizes) / 8
    for k in range(8):
        assert sorted(x.slot for x in got if x.shard == k) == list(range(sum(x.shard == k for x in got)))


def test_pipeline_keeps_columns_of_any_name(spark, clashing, tmp_path):
    r = random.Random(9)
    prose = lambda: " ".join("".join(r.choice("aeioudlnrst") for _ in range(r.randint(2, 8))) for _ in range(60))
    rows = [(i, prose(), *["x"] * len(NAMES)) for i in range(4)]
    docs = spark.createDataFrame(rows, KIND)
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(rows)
    assert all(stage(spark, docs.limit(0), str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)
