"""Similarity joins and entity linking against all pairs."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import functions as F

from rillspark.functions import words
from rillspark.operators import linking, similarity


def bag(text, size=2):
    t = " " * (size - 1) + text + " " * (size - 1)
    return Counter(t[i : i + size] for i in range(max(1, len(t) - size + 1)))


def measured(a, b, measure):
    shared = sum((a & b).values())
    both = sum(a.values()) + sum(b.values())
    return 2 * shared / both if measure == "dice" else shared / (both - shared)


def names(n, seed, letters="abcde"):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(n // 4)]
    out = set(base) | {"a" * k for k in range(1, 9)}
    while len(out) < n:
        w = list(r.choice(base))
        k = r.randrange(len(w))
        w[k : k + r.randint(0, 1)] = r.choice(letters)
        out.add("".join(w))
    return sorted(out)


@pytest.mark.parametrize("measure,least", [("dice", 0.8), ("jaccard", 0.5), ("dice", 1.0), ("jaccard", 0.8)])
def test_similarity_join_gives_all_pairs(spark, measure, least):
    texts = names(120, 3)
    d = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(3)
    got = {(r.left, r.right): r.similarity for r in similarity.joined(d, None, "t", similarity.padded_grams(F.col("t")), least, measure).collect()}
    bags = {t: bag(t) for t in texts}
    want = {(a, b): s for a in texts for b in texts if a < b and (s := measured(bags[a], bags[b], measure)) >= least - 1e-12}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert least == 1.0 or len(want) > 20


def test_similarity_join_of_two_tables(spark):
    one, two = names(60, 4), names(70, 5)
    a, b = spark.createDataFrame([(t,) for t in one], "x string"), spark.createDataFrame([(t,) for t in two], "y string")
    got = {(r.left, r.right) for r in similarity.joined(a, b, "x", similarity.characters(F.col("x")), 0.75, "dice", "y", similarity.characters(F.col("y"))).collect()}
    assert got == {(p, q) for p in one for q in two if measured(Counter(p), Counter(q), "dice") >= 0.75 - 1e-12}
    assert similarity.joined(a.limit(0), b, "x", similarity.characters(F.col("x")), 0.75, "dice", "y", similarity.characters(F.col("y"))).count() == 0


@pytest.mark.parametrize("measure,least", [("dice", 0.7), ("jaccard", 0.5)])
def test_short_and_long_bags_in_many_parts_give_all_pairs(spark, measure, least, monkeypatch):
    monkeypatch.setattr(similarity, "SHORT", 6)
    monkeypatch.setattr(similarity, "MET_ROWS", 3)
    one, two = names(90, 8), names(70, 9)
    bags = {t: bag(t) for t in [*one, *two]}
    a, b = spark.createDataFrame([(t,) for t in one], "t string"), spark.createDataFrame([(t,) for t in two], "t string")
    for right, others in ((b, two), (None, one)):
        got = [(r.left, r.right, round(r.similarity, 9)) for r in similarity.joined(a, right, "t", similarity.padded_grams(F.col("t")), least, measure).collect()]
        want = {(p, q, round(s, 9)) for p in one for q in others if (right is not None or p < q) and (s := measured(bags[p], bags[q], measure)) >= least - 1e-12}
        assert sorted(got) == sorted(want) and {len(p) > 6 for p, *_ in want} == {True, False}


def test_pairs_of_few_bytes_are_met_in_many_tasks(spark):
    one = spark.createDataFrame([(t,) for t in names(1500, 10, "abcdefgh")], "t string")
    pairs = similarity.joined(one, None, "t", similarity.padded_grams(F.col("t")), 0.6)
    shares = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(shares) >= 4 and max(shares) < 0.6 * sum(shares)


def test_close_names_are_those_of_matching_blocks(spark):
    tokens, known = names(50, 6, "abcdefgh"), names(80, 7, "abcdefgh")
    got = {(r.token, r.name, round(r.ratio, 9)) for r in linking.close_names(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(t,) for t in known], "name string")).collect()}
    want = {(t, m, round(SequenceMatcher(None, t, m).ratio(), 9)) for t in tokens for m in get_close_matches(t, known, n=3, cutoff=0.82)}
    assert got == want and want


# -- linking ------------------------------------------------------------------------------

ENTITIES = [(1, "Turbidity (NTU)", "g", 9), (2, "wind speed", "g", 3), (3, "浊度", "p", 2), (4, "风", "p", 5), (5, "沉积物再悬浮", "p", 1), (6, "phytoplankton", "g", 2), (7, "air/temp", "g", 1), (8, "speed", "h", 7), (9, "9", "g", 1), (10, None, "g", 1), (11, "resuspension", "g", 4), (12, "总磷浓度", "p", 2)]
SYNONYMS = [(1, "turbidity"), (1, "cloudiness"), (2, "algae"), (2, "phytoplankton")]
RELATED = [(1, "wind speed"), (1, "gusts")]
FORMS = [("turbidity", "浊度"), ("wind speed", "风速")]
EVIDENCE = [(3, "The measured light attenuation in lakes, more words follow"), (5, "中文证据不是拉丁字母 abc"), (4, "Wind of the lakes")]
TEXTS = [
    (1, "How does Wind  Speed change TURBIDITY and the Cloudiness?"), (2, "浊度与风速的关系"), (3, "the windspeed and speedy"), (4, None), (5, ""), (6, "phytoplancton blooms"), (7, "沉积物再悬浮了"), (8, "总磷浓"),
    (9, "gusts, attenuation, air temp"), (10, "Ｔｕｒｂｉｄｉｔｙ（ntu）, algae; resuspensoin"), (11, "再悬浮沉积物"), (12, "temp air speed"),
]


def fold(t, spaces=False):
    wide = {0xFEE0 + i: i for i in range(0x21, 0x7F)} | {0x3000: 0x20}
    flat = re.sub(r"[()\[\]{}<>【】《》「」]", "", t.translate(wide).lower())
    return re.sub(r"\s+", " ", flat).strip() if spaces else re.sub(r"\s+", "", flat)


HAN = re.compile(r"[㐀-鿿豈-﫿]")


def plain_surfaces():
    out = {}

    def add(s, node, via):
        score = linking.STRENGTHS[via]
        if len(s) < 2:
            if not HAN.search(s):
                return
            score, via = min(score, 0.65), "contained_short"
        out[s, node] = max(out.get((s, node), (0, "")), (score, via))

    junk = lambda n: n is None or len(n.strip()) < 2 and not HAN.search(n) or re.fullmatch("[0-9.%-]+", n or "")
    for node, name, *_ in ENTITIES:
        if junk(name) or len(name.strip()) < 2:
            continue
        own = {fold(v) for v in [name, *re.split(r"[()（）/、,;|]+", name)] if v.strip()} - {""}
        for s in own:
            add(s, node, "exact" if s == fold(name) else "contained")
        for groups, via in ((SYNONYMS, "synonym"), (RELATED, "related")):
            for g in {g for g, m in groups if fold(m) in own}:
                for m in (m for h, m in groups if h == g):
                    add(fold(m), node, via)
        for term, form in FORMS:
            if fold(term) in own:
                add(fold(form), node, "bilingual")
        for n, text in EVIDENCE:
            if n == node and len(re.sub("[^A-Za-z]", "", text)) >= 0.6 * max(len(text), 1):
                for token in list(dict.fromkeys(re.findall("[a-z][a-z0-9-]+", text.lower())))[:6]:
                    if len(token) >= 4:
                        add(token, node, "evidence_alias")
    return out


def plain_links(text, table, most):
    spaced, tight, hits = fold(text, True), fold(text), {}
    keep = lambda node, score, via, s: hits.__setitem__(node, max(hits.get(node, (0, "", "")), (round(score, 9), via, s)))
    for (s, node), (score, via) in table.items():
        if s in tight if HAN.search(s) else re.search(rf"(?<![a-z0-9]){re.escape(s)}(?![a-z0-9])", spaced):
            keep(node, score, via, s)
    if len(hits) < 3:
        known = {n: fold(name) for n, name, *_ in ENTITIES if name and len(name.strip()) > 1}
        latin = {n: w for n, w in known.items() if re.fullmatch("[A-Za-z0-9][A-Za-z0-9 ._/-]*", next(x[1] for x in ENTITIES if x[0] == n)) and re.search("[a-z]", w)}
        for token in dict.fromkeys(re.findall("[a-z][a-z0-9-]+", text.lower())):
            if len(token) >= 4:
                for m in get_close_matches(token, sorted(set(latin.values())), n=3, cutoff=0.82):
                    for n, w in latin.items():
                        if w == m:
                            keep(n, 0.6 + 0.2 * (SequenceMatcher(None, token, m).ratio() - 0.82) / 0.18, "fuzzy", token)
        chars = {c for c in tight if HAN.match(c)}
        for n, w in known.items():
            if HAN.search(w) and len(w) >= 3 and chars & set(w):
                if len(chars & set(w)) / len(chars | set(w)) >= 0.6:
                    keep(n, 0.40, "jaccard", w)
                elif (r := SequenceMatcher(None, w, tight).ratio()) >= 0.70:
                    keep(n, 0.6 + 0.2 * (r - 0.7) / 0.3, "fuzzy", w)
    out, facts = set(), {e[0]: e for e in ENTITIES}
    for source in {facts[n][2] for n in hits}:
        mine = sorted((n for n in hits if facts[n][2] == source), key=lambda n: (-hits[n][0], -facts[n][3], facts[n][1], n))
        out |= {(source, n, *hits[n], k) for k, n in enumerate(mine[:most], 1)}
    return out


@pytest.mark.parametrize("shard,chunk", [(50_000, 32_000_000), (2, 25)])
def test_links_are_those_of_every_surface_in_every_text(spark, shard, chunk, monkeypatch):
    occurrences = linking.occurrences
    monkeypatch.setattr(linking, "occurrences", lambda *a: occurrences(*a, shard_surfaces=shard, chunk_chars=chunk))
    make = spark.createDataFrame
    table = linking.surfaces(make([e[:2] for e in ENTITIES], "node long, name string"), make(SYNONYMS, "group int, member string"), make(RELATED, "group int, member string"), make(FORMS, "term string, form string"), make(EVIDENCE, "node long, text string"))
    plain = plain_surfaces()
    assert {(r.surface, r.node): (r.score, r.via) for r in table.collect()} == plain
    assert {via for _, via in plain.values()} == {"exact", "contained", "synonym", "related", "bilingual", "evidence_alias"} or "contained_short" in {via for _, via in plain.values()}
    rows = linking.linked(make(TEXTS, "id long, text string").repartition(2), "id", "text", make(ENTITIES, "node long, name string, source string, degree long"), table, most=3).collect()
    got = {i: {(r.source, r.node, round(r.score, 9), r.via, r.surface, r["rank"]) for r in rows if r.id == i} for i, _ in TEXTS}
    assert got == {i: plain_links(t, plain, 3) if t is not None else set() for i, t in TEXTS}
    assert {r.via for r in rows} >= {"exact", "synonym", "bilingual", "related", "evidence_alias", "fuzzy", "jaccard"}


def test_occurrences_in_long_and_repeated_texts(spark):
    r = random.Random(9)
    found = ["".join(r.choice("ab1") for _ in range(r.randint(1, 4))) for _ in range(40)]
    texts = [(i, " ".join("".join(r.choice("ab1") for _ in range(r.randint(1, 5))) for _ in range(3000 if i == 0 else 6))) for i in range(12)]
    listed = spark.createDataFrame([(s,) for s in [*found, "", "aa b"]], "surface string")
    got = {(x.id, x.surface) for x in linking.occurrences(spark.createDataFrame(texts + texts[1:3], "id long, text string"), "id", "text", listed, 7, 5000).distinct().collect()}
    assert got == {(i, s) for i, t in texts for s in {*found, "aa b"} if re.search(rf"(?<![a-z0-9]){s}(?![a-z0-9])", t)}


def test_texts_stay_where_they_are_read_if_one_shard_holds_all_surfaces(spark):
    texts = [(i, t) for i, t in enumerate(["Light (green) lakes", "the light\n green\u3000lakes", "twilight greens", "浊 度 and light", None, "", "light light"])]
    d = spark.createDataFrame(texts, "id long, text string").repartition(3)
    for surfaces, want in ((["light", "green lakes", "light green"], {(0, "light"), (0, "light green"), (0, "green lakes"), (1, "light"), (1, "light green"), (1, "green lakes"), (3, "light"), (6, "light")}), (["浊度", "and"], {(3, "浊度"), (3, "and")}), ([], set())):
        listed = spark.createDataFrame([(s,) for s in surfaces], "surface string")
        still, moved = (linking.occurrences(d, "id", "text", listed, **by) for by in ({}, {"shard_surfaces": 1}))
        assert sorted(map(tuple, still.collect())) == sorted(map(tuple, moved.collect())) == sorted(want)
        plan = still._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "CoGroup" not in plan
        long = linking.occurrences(d, "id", "text", listed, shard_chars=3)
        assert sorted(map(tuple, long.collect())) == sorted(want) and ("CoGroup" in long._jdf.queryExecution().optimizedPlan().toString()) == bool(surfaces)


def test_folding_is_that_of_plain_patterns(spark):
    signs = [chr(c) for c in [*range(1, 0x250), 0x3A3, *range(0x2000, 0x2010), *range(0x3000, 0x3020), *range(0xFF00, 0xFF70)]]
    rows = [t for c in signs for t in (c, f" {c} {c}a", f"ΑΣ{c}", f"ΑΣ{c} Β", f"{c}{c}Σ", f"Ａ{c}Σ\t\n( {c}")]
    wide = "".join(chr(0xFEE0 + i) for i in range(0x21, 0x7F)) + "\u3000"
    flat = F.regexp_replace(F.lower(F.translate("t", wide, "".join(map(chr, range(0x21, 0x7F))) + " ")), r"[()\[\]{}<>【】《》「」]", "")
    d = spark.createDataFrame([(t,) for t in [*rows, "", None]], "t string")
    both = d.select(words.folded(F.col("t")).alias("a"), F.regexp_replace(flat, r"\s+", "").alias("b"), words.folded(F.col("t"), keep_spaces=True).alias("c"), F.trim(F.regexp_replace(flat, r"\s+", " ")).alias("d"))
    assert [r for r in both.collect() if r.a != r.b or r.c != r.d] == []
