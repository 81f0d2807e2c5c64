"""The ten operators against brute force on one small table of awkward documents."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rillspark.llm import bpe, catalog, components, decontaminate, hashing, html_text, lm_score, near_dup, packing, pii, quality, sharding, token_count, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    out = [None, "", "   \n\t", "one", "One", "<|endoftext|> a", "é ü  ñ x\n\n y ", "a" * 5000, "@" * 300 + "a@b.c", "1" * 3000 + ".2.3.4.5", "word " * 300]
    for _ in range(25):
        base = prose(r.randint(10, 250)).split()
        out.append(" ".join(base))
        for k in range(r.randint(0, 4)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // (8 + 6 * k)))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
    out += [out[12]] * 6 + ["line one\nline two\nline one\n" + prose(30), "mail bob.x@mail.example.com +1 (555) 555-1234, 4111 1111 1111 1111 at 10.20.30.40 999.1.1.1"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None, "s", None, 7, "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], KIND)


def ids_of(texts, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    return [tok.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# 1

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(t):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            s = [int(x) * (1 + i % 2) for i, x in enumerate(reversed(d))]
            good = {
                "email": True,
                "ip": kind == "ip" and all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in s) % 10 == 0,
                "phone": 9 <= len(d) <= 15,
            }
            if good[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_match_their_plain_forms(texts):
    r = random.Random(1)
    made = ["".join(r.choice("a1.@-+ ()") for _ in range(60)) for _ in range(2000)]
    made += ["".join(r.choice("0123456789. -") for _ in range(60)) for _ in range(500)]
    for t in [t or "" for t in texts] + made:
        assert pii.base_spans(t) == plain_spans(t), t[:80]


def test_pii_query_and_redaction(docs, texts, nothing):
    got = {r.doc_id: r for r in pii.found(docs).collect()}
    for i, t in enumerate(texts):
        want = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in plain_spans(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    last = {r.doc_id: r for r in out.collect()}[len(texts) - 1]
    assert "@" not in last.text and "[PHONE]" in last.text and last.n_chars == len(last.text)
    assert pii.found(nothing).count() == 0


def test_tagger_on_held_out_texts():
    p = pii.trained_tagger()
    data = pii.labelled_texts(300, seed=4711)
    got = pii.tagged_spans([t for t, _ in data], p)
    right = sum(len(set(g) & set(s)) for g, (_, s) in zip(got, data, strict=True))
    assert right >= 0.9 * sum(len(s) for _, s in data) and right >= 0.9 * sum(map(len, got))
    assert pii.tagged_spans(["Licensed under the Apache License, Version 2.0.", 'token = "8b7b7ebadd0a6c91de764263600241f1767a83f0"'], p) == [[], []]


def test_windows_are_reconciled_globally():
    assert pii.reconciled([(0, 3, 10, 10.0), (8, 3, 20, 11.0), (20, 3, 30, 9.0), (0, 3, 30, 20.0)]) == [(0, 3, 10), (20, 3, 30)] or pii.reconciled([(0, 3, 10, 10.0), (8, 3, 20, 11.0), (20, 3, 30, 9.0), (0, 3, 30, 20.0)]) == [(8, 3, 20), (20, 3, 30)]
    long = "x " * 500 + "call (555) 123-4567 now " + "y " * 500
    (found,) = pii.tagged_spans([long], pii.trained_tagger())
    assert [long[a:b] for a, _, b in found] == ["(555) 123-4567"]


@pytest.mark.parametrize("n", [58, 95, 110, 250])
def test_long_addresses_are_found_whole_at_every_offset(n):
    r = random.Random(n)
    plain = lambda k: "".join(r.choice("aeionrstlducmphgbk") for _ in range(k))
    texts, want = [], []
    for offset in range(0, pii.STEP, 5):
        before = " ".join(plain(5) for _ in range(16 + offset // 6)) + " " + "x" * (offset % 6) + " "
        tail = f" [at] {plain(6)} [dot] example [dot] com"
        name = plain((n - len(tail)) // 2) + "_"
        name += plain(n - len(tail) - len(name))
        texts.append(before + name + tail + " " + " ".join(plain(5) for _ in range(20)))
        want.append([(len(before), 0, len(before) + n)])
    assert pii.tagged_spans(texts, pii.trained_tagger()) == want


def test_tagger_finds_what_no_pattern_writes_down():
    texts = ["please write to anna_mueller at example dot com today", "the server 10[.]20[.]30[.]40 was down", "card 4111/1111/1111/1111 ok", "it was at home at noon. At last the dot"]
    got = pii.tagged_spans(texts, pii.trained_tagger())
    assert [[(t[a:b], k) for a, k, b in g] for t, g in zip(texts, got, strict=True)] == [[("anna_mueller at example dot com", 0)], [("10[.]20[.]30[.]40", 1)], [("4111/1111/1111/1111", 2)], []]


def test_decoding_of_busy_stretches_is_that_of_whole_texts():
    p = pii.trained_tagger() | {"least": np.zeros(4)}
    texts = [" ".join(t for t, _ in pii.labelled_texts(12, seed=k)) for k in range(15)] + ["", "a", "plain words " * 200]
    edge = (pii.WINDOW - pii.STEP) // 2
    got = {(i, a, k, b) for i, a, k, b, _ in pii.proposals(texts, p)}
    want = set()
    for i, t in enumerate(texts):
        if t:
            e = pii.scores_of(p, pii.windows([t])[0])[edge : edge + pii.STEP].transpose(2, 0, 1).reshape(-1, pii.LABELS)[: len(t)]
            runs = list(pii.decoded([(0, 0, e)], p["trans"]))
            for _, a, k, b, margin in runs:
                if not any(b == x[1] or a == x[3] for x in runs):  # outside on both sides
                    plain = []
                    for first in (1 + 2 * k, 2 + 2 * k):
                        path = [0, first, *[2 + 2 * k] * (b - a - 1), 0]
                        plain.append(sum(p["trans"][x, y] - p["trans"][0, 0] for x, y in zip(path[:-1], path[1:], strict=True)) + sum(e[x, path[x - a + 1]] - e[x, 0] for x in range(a, b)))
                    assert margin == pytest.approx(max(plain), abs=0.01)
                s = t[a:b]
                if s.strip():
                    want.add((i, a + len(s) - len(s.lstrip()), k, b - len(s) + len(s.rstrip())))
    assert got == want and len(want) > 100


def test_spans_apart_from_others():
    r = random.Random(8)
    for _ in range(300):
        cuts = sorted(r.sample(range(60), 8))
        spans = [(cuts[i], 0, cuts[i + 1]) for i in range(0, 8, 2)]
        others = sorted((a := r.randrange(60), 1, a + r.randint(1, 12)) for _ in range(r.randint(0, 6)))
        assert pii.apart_from(spans, others) == [s for s in spans if not any(s[0] < o[2] and o[0] < s[2] for o in others)]


def test_redaction_with_columns_of_our_names(spark):
    kind = "doc_id long, spans string, n_email int, redacted string, row int, text string, text__ int, base_sha256 string, n_chars long"
    d = spark.createDataFrame([(1, "s", 1, "r", 2, "a.b@example.com", 3, "x", 15), (1, None, None, None, None, None, None, None, None), (2, "s", 1, "r", 2, "", 3, "x", 0)], kind)
    out = pii.redacted(d)
    assert out.columns == d.columns
    rows = sorted(map(tuple, out.collect()), key=str)
    assert rows == sorted([(1, "s", 1, "r", 2, "[EMAIL]", 3, "x", 7), (1, *[None] * 8), (2, "s", 1, "r", 2, "", 3, "x", 0)], key=str)
    assert pii.found(d).count() == 3


# 2


def test_main_text(spark):
    art = "<article><h1>T &amp; x</h1><p>Some   words\n here &lt;ok&gt;<br>more <b>bold</b> text.</p><aside>no</aside><ul><li>one two three</li><li>four five six</li></ul></article>"
    page = f"<html><head><title>no</title><style>p{{}}</style></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy this now</div>{art}<div class=comments><p>nice post</p></div><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (1, "u", page)]
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = "T & x\nSome words here <ok> more bold text.\none two three\nfour five six"
    assert [r.text for r in sorted(got, key=lambda r: r.page_id)] == [want, want, "", "", ""]
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("opening, closing", [("<article>", "</article>"), ("<main><div>", "</div></main>"), ('<div id="post">', "</div>"), ("", "")])
@pytest.mark.parametrize("furniture", ["<aside><p>{}</p></aside>", '<div class="ad">{}</div>', '<form class="newsletter"><label>{}</label><input></form>', '<div class="notice"><p>{}</p><ul><li>one</li></ul></div>'])
def test_long_furniture_does_not_split_an_article(opening, closing, furniture):
    n = lambda k, word: " ".join([word] * k)
    long = furniture.format(n(200, "sale"))
    start, end = f"<h1>{n(6, 'head')}</h1><p>{n(20, 'lead')}</p>", f"<p>{n(20, 'tail')}</p><p>{n(6, 'last')}</p>"
    page = f"<html><head><title>no</title></head><body><nav><a href=x>menu</a></nav>{opening}{start}{long}<p>{n(300, 'text')}</p>{long}{end}{closing}<div class=comments><p>{n(30, 'nice')}</p></div><footer>me</footer></body></html>"
    assert html_text.main_text(page) == "\n".join((n(6, "head"), n(20, "lead"), n(300, "text"), n(20, "tail"), n(6, "last")))


@pytest.mark.parametrize("wrap", ["<div class='social-science'>{}</div>", "<div id='share-price-news'>{}</div>", "<div class='article hidden-print'>{}</div>", "<div class='comments'>{}</div>", "<section class='menu'><main>{}</main></section>"])
def test_names_never_empty_a_page(wrap):
    body = f"<h1>Some title</h1><p>{'one two ' * 20}</p><p>{'three four ' * 9}</p><p>last words</p>"
    page = f"<html><head><title>no</title></head><body><nav><a href=x>menu</a></nav>{wrap.format(body)}<footer>me</footer></body></html>"
    assert html_text.main_text(page).split("\n")[0] == "Some title" and html_text.main_text(page).endswith("last words")
    short = f"<html><body>{wrap.format('<p>only these words stand here</p>')}<footer>me</footer></body></html>"
    assert html_text.main_text(short) == "only these words stand here"


def test_names_are_learned():
    names = html_text.trained_names()
    assert all(names.get(w, 0) < -1 for w in html_text.ASIDE_NAMES) and all(names.get(w, 0) > 1 for w in html_text.OWN_NAMES)
    assert html_text.name_tokens("mainContent-2_box") == ("main", "content", "box")


def test_pages_of_unclosed_tags_take_linear_time():
    import time

    def took(n):
        began = time.process_time()
        html_text.main_text("<div><span>" + "<b>x <i>y </u></em>" * n + "<p>word " * n)
        return time.process_time() - began

    took(500)
    assert took(16000) < 12 * max(took(4000), 0.02)


def test_pages_of_any_shape(spark):
    kind = "page_id long, url string, html string, text string, n_chars int"
    long = "<p>" + "word " * 200_000 + "</p>"
    rows = [(1, "u", long, "x", 1), (2, "u", "no tags at all", None, None), (3, "u", "<script>var a = '<p>no</p>'</script>", "x", 1), (3, "u", "<div>&lt;p&gt; &amp;</div>", "x", 1)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.main_texts(spark.createDataFrame(rows, kind)).collect())
    assert got == [(1, ("word " * 200_000).strip(), 999_999), (2, "no tags at all", 14), (3, "", 0), (3, "<p> &", 5)]
    assert html_text.main_texts(spark.createDataFrame([], kind)).count() == 0


def test_best_run_against_all_runs():
    r = random.Random(2)
    for _ in range(100):
        s = [r.randint(-5, 5) for _ in range(r.randint(0, 12))]
        a, b = html_text.best_run(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


def test_pages_of_the_generator(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {x.page_id: x.text for x in html_text.main_texts(pages).collect()}
    for r in pages.collect():
        text = texts[r.page_id]
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1|h2|li|ul|div)\b[^>]*>", re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", body.replace("<br>", " "))))
        assert text == "\n".join(x for x in blocks if x)


# 3


def test_shards(docs, texts, nothing):
    got = sharding.sharded(docs, 4).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    for k in range(4):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(4)]
    assert max(sizes) < 1.15 * min(sizes)
    assert sharding.sharded(nothing, 4).count() == 0


# 4


def test_token_counts_against_a_plain_search(docs, texts):
    scores = token_count.piece_scores(token_count.default_path())
    low = token_count.byte_score(scores)

    def plain(w):
        best = [(0.0, 0)]
        for end in range(1, len(w) + 1):
            n = len(w[end - 1].encode())
            options = [(best[end - 1][0] + low * n, best[end - 1][1] + n)]
            options += [(best[a][0] + scores[w[a:end]], best[a][1] + 1) for a in range(end) if w[a:end] in scores]
            best.append(max(options, key=lambda o: (o[0], -o[1])))
        return best[-1][1]

    short = [i for i, t in enumerate(texts) if len(t or "") < 700]
    got = {r.doc_id: r for r in token_count.token_counts(docs, token_count.default_path()).collect()}
    for i in short:
        w = [x.decode() for x in (texts[i] or "").encode().split()]
        assert (got[i].n_pretokens, got[i].n_tokens) == (len(w), sum(plain("▁" + x) for x in w))


# 5


def test_scores(docs, texts, nothing):
    got = {r.doc_id: r for r in lm_score.scored(docs).collect()}
    tokens = [WORD.findall(lower(t)) + ["\n"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = c.total(), len(c)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    moved = {r.doc_id: r for r in lm_score.scored(docs.repartition(7)).collect()}
    assert all(moved[i].score == pytest.approx(got[i].score, rel=1e-9) for i in got)
    # the score by hand: the model's class sequence and the words inside their classes
    pi, a, e = lm_score.trained(docs, lm_score.blocks(docs, "doc_id", "text"))
    cls = {w: lm_score.word_class(w.encode()) for t in tokens for w in t}
    in_class = Counter()
    kinds = Counter(cls[w] for w in c)
    for w, k in c.items():
        in_class[cls[w]] += k
    for i, t in enumerate(tokens):
        s = [cls[w] for w in t]
        v = pi * e[s[0]]
        total = math.log10(v.sum())
        for x in s[1:]:
            v = (v / v.sum()) @ a * e[x]
            total += math.log10(v.sum())
        total += sum(math.log10((c[w] + 0.1) / (in_class[cls[w]] + 0.1 * (kinds[cls[w]] + 1))) for w in t)
        assert got[i].score == pytest.approx(total, rel=1e-7)
    assert lm_score.scored(nothing).count() == 0


@pytest.mark.parametrize("size", [3, 7, 64, 1024])
def test_recursions_are_exact_across_stretches(size, monkeypatch):
    monkeypatch.setattr(lm_score, "TOGETHER", 50)
    r = np.random.default_rng(1)
    pi, a, e = lm_score.first_model(3)
    pi, a = np.array([0.6, 0.3, 0.1]), np.array([[0.8, 0.15, 0.05], [0.2, 0.5, 0.3], [0.3, 0.3, 0.4]])
    lengths = np.array([1, 13, 50, 12, 25, 64, 65, 3, 1])
    seq = r.integers(0, 9, lengths.sum())
    likes, at = [], 0
    firsts, trans, out = np.zeros(3), np.zeros((3, 3)), np.zeros_like(e)
    for n in lengths:
        s = seq[at : at + n]
        at += n
        alpha, beta = np.zeros((n, 3)), np.ones((n, 3))
        alpha[0] = pi * e[s[0]]
        for t in range(1, n):
            alpha[t] = alpha[t - 1] @ a * e[s[t]]
        for t in range(n - 2, -1, -1):
            beta[t] = a @ (e[s[t + 1]] * beta[t + 1])
        z = alpha[-1].sum()
        likes.append(math.log(z))
        gamma = alpha * beta / z
        firsts += gamma[0]
        for t in range(n):
            out[s[t]] += gamma[t]
            if t:
                trans += alpha[t - 1][:, None] * a * (e[s[t]] * beta[t]) / z
    got = lm_score.expected(seq, lengths, (pi, a, e), size)
    assert lm_score.log_likelihoods(seq, lengths, (pi, a, e), size) == pytest.approx(likes, rel=1e-9)
    for x, y in zip(got, (firsts, trans, out), strict=True):
        assert np.allclose(x, y, rtol=1e-9)


def test_training_raises_the_likelihood():
    r = np.random.default_rng(2)
    model, lengths = lm_score.first_model(3), np.array([90] * 40)
    seq = np.concatenate([r.integers(k % 2 * 50, k % 2 * 50 + 50, 90) for k in range(40)])
    likes = []
    for _ in range(6):
        likes.append(lm_score.log_likelihoods(seq, lengths, model).sum())
        model = lm_score.from_counts(*lm_score.expected(seq, lengths, model))
    assert likes == sorted(likes) and likes[-1] > likes[0] + 100


# 6 and 8


def test_packing(docs, texts, nothing):
    want = ids_of(texts, 1)
    got = packing.packed(docs, bpe.default_path()).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    for i, ids in enumerate(want):
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine])[:-1]) and sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
    assert packing.packed(nothing, bpe.default_path()).count() == 0


def test_token_files(docs, texts, nothing):
    want = ids_of(texts, 0)
    got = sorted(token_files.read_ids(token_files.write_ids(docs, bpe.default_path())).collect(), key=lambda r: r.doc_id)
    starts = np.cumsum([0] + [len(x) for x in want])
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [(i, starts[i], len(x), crc(x)) for i, x in enumerate(want)]
    assert token_files.read_ids(token_files.write_ids(nothing, bpe.default_path())).count() == 0


def test_compression_round_trip_and_gain():
    r = np.random.default_rng(3)
    ids = np.concatenate([np.tile([5, 6, 7, 8], 500), r.integers(0, 50000, 300), np.full(200, 9)])
    rules, lengths, seq, ends = token_files.compress(ids, np.array([1000, 2300, len(ids)]))
    assert len(seq) < 0.5 * len(ids) and len(ends) == 3
    assert (token_files.expand(seq, rules, lengths) == ids).all()
    assert (token_files.expand(seq[ends[0] : ends[1]], rules, lengths) == ids[1000:2300]).all()


# 7


@pytest.mark.parametrize("size", [2, 5])
def test_near_components(docs, texts, nothing, size):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in near_dup.near_components(docs, size).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]
    assert near_dup.near_components(nothing, size).count() == 0


def all_links(texts, size, percent=80):
    """doc -> smallest doc reachable, by all pairs of full sets."""
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if (w := WORD.findall(lower(t))) else set() for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_a_cluster_around_the_limit(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK", 7)
    r = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(110):  # pairs from 0.6 to 0.9: some are linked, many share buckets and are not
        w = list(base)
        for k in r.sample(range(150), r.randint(3, 9)):
            w[k] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in near_dup.near_components(docs, 2).collect()}
    want = all_links(texts, 2)
    assert [got[i] for i in range(len(texts))] == want and 1 < len(set(want)) < 100


def test_repeated_ids_and_clashing_columns(spark):
    kind = "doc_id long, text string, id string, key int, bits string, bucket int, component string, kept int"
    d = spark.createDataFrame([(1, "a b c d", "x", 1, "y", 2, "z", 3), (1, "a b c d", "x", 1, "y", 2, "z", 3), (2, "A B C D", "x", 1, "y", 2, "z", 3), (None, "a b c d", None, None, None, None, None, None), (3, None, "x", 1, "y", 2, "z", 3)], kind)
    got = sorted(map(tuple, near_dup.near_components(d, 2).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, None, True), (3, 0, 3, True)], key=str)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_min_max_values_are_unbiased():
    a, b = near_dup._permutations()
    x = hashing.mixed(np.arange(1, 1801, dtype=np.uint64) * hashing.P)
    same = (near_dup.min_max_values(x[:1000], a, b) == near_dup.min_max_values(x[200:1250], a, b)).mean()
    assert abs(same - 800 / 1250) < 0.12


# 9


def test_decontamination(spark, nothing):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (30, 20, 9, 5)]
    fill = lambda n: [word() for _ in range(n)]
    sub = list(items[0][5:18])
    sub[1], sub[12] = "other", "words"
    three = list(items[0][5:18])
    three[0], three[5], three[11] = "x", "y", "z"
    made = [fill(50) + items[0] + fill(9), fill(3) + sub + fill(30), fill(9) + three + fill(9), fill(8) + [w.upper() + "," for w in items[1]], fill(4) + items[2], fill(4) + items[3], fill(60), [], fill(5) + items[2][:8] + fill(4), fill(5) + items[2][:7] + fill(4)]
    rows = [(i, " ".join(w) or None) for i, w in enumerate(made)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (0, " ".join(items[0]))], "item_id long, text string")
    got = decontaminate.contamination(docs, bench).collect()
    assert Counter(r.doc_id for r in got if r.contaminated) == {0: 2, 1: 1, 3: 1, 4: 1, 5: 1, 8: 1}
    assert {r.doc_id: (r.item_id, r.substitutions) for r in got if r.contaminated} == {0: (0, 0), 1: (0, 2), 3: (1, 0), 4: (2, 0), 5: (3, 0), 8: (2, 1)}
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    assert decontaminate.contamination(nothing, bench).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination_against_all_windows(spark, seed):
    r = random.Random(seed)
    words = lambda n: [r.choice("abcdefghij") for _ in range(n)]
    items = [words(n) for n in (*range(0, 20), 7, 9, 12, 30)]
    texts = [words(r.randint(0, 60)) for _ in range(40)]
    for w in items:
        if w:
            copy = [r.choice("abcdefghij") if r.random() < 0.1 else x for x in w]
            texts.append(words(r.randint(0, 9)) + copy + words(r.randint(0, 9)))
    items = items[5:]  # shorter ones of so few letters stand everywhere
    want = Counter()
    for i, t in enumerate(texts):
        for k, w in enumerate(items):
            n = min(len(w), 13)
            for a in range(len(w) - n + 1):
                for b in range(len(t) - n + 1):
                    wrong = sum(x != y for x, y in zip(w[a : a + n], t[b : b + n], strict=True))
                    if wrong <= 2 * n // 13:
                        want[i, b, n] = max(want[i, b, n], 9 - wrong)
    docs = spark.createDataFrame([(i, ", ".join(t).upper() if i % 2 else " ".join(t), 5, None) for i, t in enumerate(texts)], "doc_id long, text string, place int, item_id string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = decontaminate.hits(docs, bench).collect()
    sizes = [min(len(w), 13) for w in items]
    got = {}
    for x in found:
        key = (x.doc_id, x.place, sizes[x.item_id])
        got[key] = max(got.get(key, 0), 9 - x.substitutions)
    assert got == dict(want) and len({n for _, _, n in got}) > 6
    per_doc = {x.doc_id: x.contaminated for x in decontaminate.contamination(docs, bench).collect()}
    assert per_doc == {i: any(k[0] == i for k in want) for i in range(len(texts))}


# 10


def test_quality(docs, texts, nothing):
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        c = Counter(windows)
        repeat = len({k + d for k, x in enumerate(windows) if c[x] > 1 for d in range(8)})
        failed = len(w) < 20 or 100 * repeat > 30 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, failed)
        assert not (r.kept and failed)
    assert quality.judged(nothing).count() == 0 and quality.passing(nothing).count() == 0


def test_order_of_rules_is_stable(docs):
    orders = {tuple(quality.cascade_order(docs)) for _ in range(5)}
    assert len(orders) == 1 and sorted(orders.pop()) == sorted(quality.RULES)


def test_quality_verdicts_rule_by_rule(spark):
    prose = "the quick brown fox jumps over some lazy dogs and runs far away from every other animal that lives in this wood".split()
    made = {
        "good": " ".join(prose), "many_symbols": " ".join(w + "#" if i < 5 else w for i, w in enumerate(prose)), "word_length": " ".join(["a"] * 5 + list("bcdefghijklmnopqrstu")),
        "repeated_lines": "\n".join(["one two " + prose[0]] * 2 + ["same"] * 30 + [" ".join(prose)]), "shouting": " ".join(w.upper() if i < 12 else w for i, w in enumerate(prose)),
        "few_letters": " ".join(f"{w[:2]}1234" for w in prose), "stuttering": " ".join(w for i, w in enumerate(prose) for _ in range(1 + (i % 2))), "few_kinds": " ".join(f"w{i * i % 11 % 4}" for i in range(60)),
        "short": "one two three", "none": None,
    }
    kind = "doc_id long, text string, kept string, n_words int, base_failed boolean, __h int"
    d = spark.createDataFrame([(i, t, name, 3, True, 1) for i, (name, t) in enumerate(made.items())] * 2, kind)
    kept = {r.doc_id: r.kept for r in quality.judged(d).collect()}
    assert [n for i, n in enumerate(made) if kept[i]] == ["good"]
    out = quality.passing(d)
    assert out.columns == d.columns and [tuple(r) for r in out.collect()] == [(0, made["good"], "good", 3, True, 1)] * 2


def test_quality_query_matches_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    ours = catalog.op10_quality(spark, sf).toPandas()
    theirs = duckdb.sql(catalog.ORACLE["op10_quality"].replace("FROM documents", f"FROM '{sf}/documents.parquet'")).df()
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    assert ours[order].sort_values("doc_id").values.tolist() == theirs[order].sort_values("doc_id").values.tolist()
