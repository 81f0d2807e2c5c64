"""Spelling variants, positive-unlabelled quality and exact centroids against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rillspark.llm import catalog, centroids, pu_quality, spelling

SF = "/root/testdata/sf0.01"
CLASH = "word n key near form root id text_ train half x positive score cluster distance hash v ids wide matrix total".split()


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(c) for c in CLASH if c not in df.columns))


# -- spelling -----------------------------------------------------------------------------

LETTERS = "abcxyzàéÿÖ×"


def plain_variants(rows, shortest, fewest, noise):
    counts = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= fewest}
    alphabet = {c for w in words for c in w}
    near = {}
    for w in words:
        made = {w[:i] + w[i + 1 :] for i in range(len(w))}
        made |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
        made |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        near[w] = [x for x in made - {w} if x in words]
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda x: (-words[x], x))
            if words[best] >= 5 * words[w]:
                form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


@pytest.fixture(scope="module")
def spelled():
    r = random.Random(5)
    base = ["".join(r.choice(LETTERS) for _ in range(r.randint(5, 9))) for _ in range(12)] + ["aaaaaaa", "ababab"]
    said = []
    for w in base:
        said += [w] * r.choice([3, 40, 400])
        for _ in range(6):
            k, c = r.randrange(len(w)), r.choice(LETTERS)
            said += [r.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]])] * r.choice([4, 5, 6, 30, 170])
    said += ["cacbcax"] * 9 + ["cacbca"] * 80 + ["cacbcb"] * 700  # a chain of forms
    r.shuffle(said)
    rows = [(i, " ".join(said[40 * i : 40 * i + 40])) for i in range(len(said) // 40 + 1)]
    long = "".join(r.choice("abé") for _ in range(4000))
    return rows + [(None, "WORDÉ wordÉ, Abcabcabc"), (900, None), (901, ""), (902, " 1 2 -- \n")] + [(910 + i, f"{long} {long[:-1]}") for i in range(6)] + rows[:2]


def test_variants_are_those_of_all_strings(spark, spelled):
    docs = spark.createDataFrame(spelled, "doc_id long, text string").repartition(3)
    chains = 0
    for noise in (None, 7):
        got = {tuple(r) for r in spelling.variants(docs, noise=noise).collect()}
        assert got == plain_variants(spelled, 6, 5, noise)
        assert got == {tuple(r) for r in spelling.variants(clashing(docs), noise=noise).collect()}
        chains += sum(bool(f) and r != f for _, f, r, *_ in got)
    assert chains, "the table has chains"
    assert max(len(r[0]) for r in got) > 3000


def test_ties_take_the_smallest_form(spark):
    texts = ["bbbbbb " * 50 + "cccccb " * 50 + "bcbbbb " * 10 + "cbbbbb " * 50]
    rows = {r.word: r for r in spelling.variants(spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")).collect()}
    assert rows["bcbbbb"].form == "bbbbbb" and rows["bcbbbb"].n_near == 1
    assert rows["bbbbbb"].form is None and rows["bbbbbb"].n_near == 2


def test_no_words_give_no_rows(spark):
    for rows in ([], [(1, None), (2, "a b c")]):
        df = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))
        assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and df.count() == 0


@pytest.mark.parametrize("word", ["aab", "abba", "aaaa", "éxé", "a"])
def test_candidates_are_distinct_and_complete(word):
    alphabet = np.array(sorted({ord(c) for c in "abxé"}), np.uint64)
    keys = []
    for at in range(0, len(word) + 1, 2):
        for _, _, _, k, distinct in spelling.neighbourhood(spelling._codes(word).reshape(1, -1), alphabet, slice(at, at + 2)):
            keys += spelling.mixed(k)[distinct].view(np.int64).tolist()
    letters = "abxé"
    made = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    made -= {word}
    assert len(keys) == len(made)
    assert set(keys) == {0 if not w else int(spelling.word_keys([w])[0]) for w in made} if len(word) > 1 else True


# -- quality ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def scores(spark, tables):
    return {r.doc_id: r for r in pu_quality.scored(*tables).collect()}


def test_held_out_labels_are_predicted(tables, scores):
    truth = {r.doc_id: r.quality for r in tables[1].collect()}
    ours = [(scores[i].predicted, q, scores[i].score) for i, q in truth.items() if scores[i].held_out]
    assert len(ours) > 50 and np.mean([p == q for p, q, _ in ours]) >= 0.97
    bad, good = [s for _, q, s in ours if not q], [s for _, q, s in ours if q]
    assert np.mean([g > b for g in good for b in bad]) >= 0.99
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in scores.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in scores.items())


def test_prior_is_near_the_share_of_good_labels(tables, scores):
    share = np.mean([r.quality for r in tables[1].collect()])
    assert abs(next(iter(scores.values())).prior - share) < 0.06


def test_nothing_is_learned_from_held_out_labels_and_columns(spark, tables, scores):
    from pyspark.sql import functions as F

    docs, labels = tables
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0)})
    for r in pu_quality.scored(clashing(other), turned.union(turned)).collect():
        assert abs(r.score - scores[r.doc_id].score) < 1e-6


def test_quality_of_awkward_tables(spark):
    rows = [(1, None), (2, ""), (3, "word " * 40_000), (3, "word " * 40_000), (None, "one two three"), (5, "Some words, and some more."), (6, "\n\n \t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(5, 1), (5, 1), (5, 0), (3, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in pu_quality.scored(docs, labels).collect()} == {0.5}, "contradicting labels trust nothing"
    got = pu_quality.scored(docs, labels.limit(2)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert pu_quality.scored(docs.limit(0), labels).count() == 0
    assert {r.score for r in pu_quality.scored(docs, labels.limit(0)).collect()} == {0.5}


def test_features_cover_whole_texts(monkeypatch):
    text = "Ab, c1 \n#é" * 300
    whole = pu_quality.features(text)
    monkeypatch.setattr(pu_quality, "STRETCH", 7)
    assert np.array_equal(pu_quality.features(text), whole)
    assert not np.array_equal(pu_quality.features(text + "!" * 200), whole)


# -- centroids ----------------------------------------------------------------------------


def plain_kmeans(rows, dims, clusters, rounds, seed):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [math.floor(256 * x) for x in v]))
    name = lambda k: hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()
    now = [v for _, v in sorted(kept, key=lambda kv: (name(kv[0]), kv[1]))[:clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((apart(v, c), k) for k, c in enumerate(now))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        now = [[sum(x) // len(members[k]) for x in zip(*members[k])] if k in members else c for k, c in enumerate(now)]
    final = [(key, *near(v)) for key, v in kept]
    inertia = defaultdict(int)
    for _, d, k in final:
        inertia[k] += d
    capped = lambda v: min(v, 2**63 - 1)
    return sorted((str(key), k, capped(d), capped(sum(min(x[1], 2**63 - 1) for x in final if x[2] == k)), capped(sum(min(x[1], 2**63 - 1) for x in final)), hashlib.sha256(",".join(map(str, now[k])).encode()).hexdigest()) for key, d, k in final)


def vectors(kind):
    r = np.random.default_rng(8)
    x = [v.tolist() for v in np.round(r.normal(size=(400, 8)), 3)]
    if kind == "ties":
        x = [v.tolist() for v in r.integers(-2, 3, (400, 8)) / 256]
    if kind == "hot":
        x = x[:40] + [x[0]] * 200
    if kind == "wide":
        x = [[float(y * 10.0 ** r.integers(-2, 19)) for y in v] for v in x[:80]]
    if kind == "few":
        x = x[:3]
    rows = list(enumerate(x))
    return rows + [(900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 9), (904, [1.0] * 7 + [math.nan]), (905, [1.0] * 7 + [math.inf]), (906, [1.0] * 7 + [None]), (None, x[1]), (0, x[2]), (0, x[2])]


@pytest.mark.parametrize("kind", ["plain", "ties", "hot", "wide", "few"])
def test_centroids_are_those_of_whole_numbers(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for table in (df, clashing(df)):
        got = centroids.clustered(table, dimensions=8, clusters=7, rounds=4, seed=3).collect()
        assert sorted((str(r.vec_id), *tuple(r)[1:]) for r in got) == plain_kmeans(rows, 8, 7, 4, 3)


def test_no_vectors_give_no_rows(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        df = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and df.count() == 0


@pytest.mark.parametrize("largest", [3, 1000, 2**24, 2**26, 2**60])
def test_intervals_hold_the_exact_distances(largest):
    r = random.Random(largest)
    c = centroids.Centroids([[r.randint(-largest, largest) for _ in range(64)] for _ in range(12)])
    x = np.array([[float(int(float(v) + r.randint(-1, 1))) for v in c.exact[k % 12]] for k in range(60)])
    low, high = c.intervals(x)
    for v, lo, hi in zip(x, low, high):
        for k in range(12):
            s = sum(int(y) ** 2 for y in c.exact[k]) - 2 * sum(int(a) * int(b) for a, b in zip(v, c.exact[k]))
            assert lo[k] <= s <= hi[k]
    number, exact = c.nearest(x if largest > 2**26 else x.astype(np.int32))
    assert number.tolist() == [min(range(12), key=lambda k: (sum((int(a) - int(b)) ** 2 for a, b in zip(v, c.exact[k])), k)) for v in x]


def test_only_overlapping_intervals_are_computed_exactly():
    r = np.random.default_rng(2)
    c = centroids.Centroids(r.integers(-99, 99, (20, 64)).tolist())
    x = (c.exact[[3, 4]] + r.integers(-1, 2, (2, 64))).astype(np.int32)
    middle = ((c.exact[3] + c.exact[4]) // 2).astype(np.int32)[None]
    assert c.nearest(x)[1].tolist() == [0, 0] and c.nearest(middle)[0][0] in (3, 4)


def test_new_queries_are_registered():
    assert {"op11_spelling", "op12_pu_quality", "op13_centroids"} <= set(catalog.QUERIES)


# -- null and repeated ids in decontamination -------------------------------------------------


def test_rows_without_an_id_are_judged_by_their_texts(spark, tmp_path):
    import corpus_pipeline
    from rillspark.llm import decontaminate

    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    clean = "nothing of that kind stands here at all but some other words that nobody asked for"
    rows = [(None, f"before {item} after"), (None, clean), (None, None), (5, item), (5, clean), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (None, "a b c d e f g h i j k l m n")], "item_id long, text string")
    got = sorted(((r.doc_id, r.contaminated) for r in decontaminate.contamination(docs, bench).collect()), key=str)
    assert got == sorted([(None, True), (None, False), (None, False), (5, True), (5, False), (6, False)], key=str)
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)


# -- pages inside wrappers, groups of equal texts ----------------------------------------------


@pytest.mark.parametrize("wrap", ["<form id='aspnetForm' action='/x'><input type='hidden' value='1'>{}</form>", "<fieldset>{}</fieldset>", "<dialog open>{}</dialog>", "<form><fieldset><label>{}</label></fieldset></form>"])
def test_wrapped_pages_are_read_like_plain_ones(spark, wrap):
    from rillspark.llm import html_text

    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").limit(40).collect()]
    plain = [html_text.main_text(p) for p in pages]
    inside = [re.sub(r"(?is)(<body[^>]*>)(.*)(</body>)", lambda m: m[1] + wrap.format(m[2]) + m[3], p) for p in pages]
    assert sum(a != b for a, b in zip(inside, pages)) > 30
    assert [html_text.main_text(p) for p in inside] == plain


def test_forms_stay_furniture():
    from rillspark.llm import html_text

    prose = "Some words of an article that go on and on until they are many more than those of any form. " * 4
    login = "<form action='/login'><p>Your name</p><label>Name</label><input><label>Word</label><input><button>Go</button></form>"
    comment = "<form class='reply'><h3>Leave a reply</h3><p>Your address is not shown</p><p>Fields are needed</p><textarea></textarea></form>"
    page = f"<html><body><nav><a href='/'>x</a></nav>{login}<article><h1>Head line</h1><p>{prose}</p></article>{comment}</body></html>"
    assert html_text.main_text(page) == f"Head line\n{prose.strip()}"
    assert html_text.main_text(f"<html><body>{login}</body></html>") == ""


def test_equal_texts_stay_in_one_shard_unless_they_exceed_it(spark):
    from rillspark.llm import sharding

    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(20)) for _ in range(3000)]
    half = " ".join(word() for _ in range(1700))  # twice: about half of a shard
    huge = " ".join(word() for _ in range(40))  # six hundred times: more than a shard
    rows = list(enumerate(texts + [half] * 2 + [huge] * 600))
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    of = {x.doc_id: x.shard for x in got}
    assert of[3000] == of[3001] and len({of[i] for i in range(3002, 3602)}) > 1
    sizes = Counter()
    for x in got:
        sizes[x.shard] += x["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 0.03 * sum(sizes.values()) / 16
