"""Main text of web pages: the maximum-scoring run of words and tags.

A page is read as a sequence of words and tags.  Each has a score, a log-odds weight from
labelled pages: words inside running text score positive; tags, and words inside menus,
links, forms, notices, adverts and the like, score negative.  One linear scan finds the
contiguous run with the highest sum (the first of equal ones).  Its words, without
those of an element inside it that is page furniture, are the text.  Furniture is told by its tag
or role, or by the weights of the words of its class and id, which the labelled pages give too.

A furniture element counts as one cost with all it holds.  Below ``article`` or ``main``, or
nested in another element on a page that has neither, that is the learned cost of one tag, so
the run goes on behind it however long it is.  Elsewhere its words count, up to the worth of
``BRIDGE`` words of text.

The labelled pages are made by :func:`labelled_pages` from a fixed seed (``LABELLED`` of
them, the bound of the training sample), so the weights are the same everywhere and at every
size.  All pages are scanned whole.

Character references are decoded; white space inside a block becomes one space; blocks
follow in page order with one newline between.  Null, empty and text-free pages give the
empty text.  Repeated rows give repeated rows.  Columns but those named in ``keep`` are not read.  The
scan is linear in a page's length, also where tags are never closed.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from rillspark.llm.common import sliced

LABELLED = 240
BRIDGE = 20

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg math select object title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend", "body", "html", "head", "dt", "dd", "li"}
FURNITURE = frozenset("nav footer aside form button dialog menu head fieldset label input".split())
#: Furniture that may also be put around a whole page, and how many of them may stand inside each other around an article.
WRAPPERS, DEEPEST = frozenset("form fieldset dialog label".split()), 8

# Names by which the labelled pages mark what is not the article, and names of its own parts.
ASIDE_NAMES = "ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice alert sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead comment comments replies reply respond discussion disqus share sharing social related recommended newsletter subscribe signup login search popup modal overlay skip pagination pager toolbar copyright legal hidden tags".split()
OWN_NAMES = "article post story content entry body text main page news print detail section lead chapter item block".split()
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ARTICLE = re.compile(r"<(?:article|main)[\s>]", re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<=\s)(hidden)(?=\s|/|$)", re.S)


@lru_cache(maxsize=100_000)
def name_tokens(value: str) -> tuple[str, ...]:
    """Words of a class or id: split at marks, digits and inner capitals."""
    return tuple(re.sub("([a-z])([A-Z])", r"\1 \2", value).lower().replace("_", " ").translate(_NO_MARKS).split())


_NO_MARKS = str.maketrans({c: " " for c in "-.:/|,;#0123456789"})
#: Names of elements that are looked at together weigh less than this: furniture.
NAMED_BELOW = -1.0


def furniture_kind(tag: str, attributes: str, inside_article: bool, names: dict[str, float]) -> str:
    """``tag`` if an element is furniture by its tag or role, ``wrap`` if it may hold a page for all that, ``name`` if by the
    learned weights of its class and id, else empty."""
    own = "tag" if tag in FURNITURE - WRAPPERS or tag == "header" and not inside_article else "wrap" if tag in WRAPPERS else ""
    if own == "tag" or not attributes or tag in ("html", "body", "article", "main"):
        return own
    weight = 0.0
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c)
        if hidden or name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "tag"
        if name in ("class", "id"):
            weight += sum(names.get(w, 0.0) for w in name_tokens(value))
    return own or ("name" if weight < NAMED_BELOW else "")


def events(page: str, names: dict[str, float], trusted: frozenset[int] = frozenset()) -> Iterator[tuple[str, str, int, tuple[str, int] | None]]:
    """(kind, what, words, element) in page order: kinds are ``tag``, ``text`` and ``furniture`` (text inside it).

    ``what`` of a text is the raw text; of a tag, its class for scoring.  ``element`` is the
    place and number (where it starts) of the outermost furniture that the event belongs to; an element that is furniture
    by its names alone has a place that ends in ``?``, a wrapper one that ends in ``!``; neither is if its number is trusted.
    """
    at, stack = 0, []  # of open elements: (tag, outermost furniture here or above)
    open_tags: Counter = Counter()

    def close(i: int) -> None:
        for t, _ in stack[i:]:
            open_tags[t] -= 1
        del stack[i:]

    plain = not ARTICLE.search(page)
    depth_article = 0
    raw_end = None
    while at < len(page):
        m = TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            text = page[at:stop]
            marked = stack[-1][1] if stack else None
            in_link = any(t == "a" for t, _ in stack[-3:])
            n = len(text.split())
            if n:
                yield ("furniture" if marked else "link" if in_link else "text", text, n, marked)
            else:
                yield ("space", text, 0, marked)
        if not m:
            return
        at = m.end()
        closing, tag, attributes = m[1], (m[2] or "").lower(), m[3] or ""
        if not tag:
            continue
        if closing:
            # only what is open is searched for, and what is passed over is closed: linear in all
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if open_tags[tag] else None
            marked = stack[-1][1] if stack else None
            if open_at is not None:
                marked = stack[open_at][1]
                depth_article -= sum(t in ("article", "main") for t, _ in stack[open_at:])
                close(open_at)
            yield ("tag", "/" + tag, 0, marked)
            continue
        if tag in RAW:
            marked = stack[-1][1] if stack else None
            yield ("tag", tag, 0, marked)
            raw_end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = raw_end.end() if raw_end else len(page)
            yield ("tag", "/" + tag, 0, marked)
            continue
        if tag in CLOSES_P and open_tags["p"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if tag == "li" and open_tags["li"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "li":
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "menu"):
                    break
        marked = stack[-1][1] if stack else None
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            place = "article" if depth_article else "nested" if plain and stack and stack[-1][0] not in ("html", "body") else "top"
            depth_article += tag in ("article", "main")
            if not marked and (how := furniture_kind(tag, attributes, depth_article > 0, names)) and m.start() not in trusted:
                marked = (place + {"name": "?", "wrap": "!"}.get(how, ""), m.start())
            stack.append((tag, marked))
            open_tags[tag] += 1
        yield ("tag", tag, 0, marked)


# -- labelled pages ---------------------------------------------------------------------


def labelled_pages(n: int = LABELLED, seed: int = 20240501) -> list[tuple[str, tuple[int, int]]]:
    """Pages of several layouts with the span (first and last character) of their article."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeionrstlducmph") for _ in range(r.randint(1, 9)))
    prose = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + "."
    links = lambda n: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))
    q = random.Random(seed + 1)
    out = []
    for _ in range(n):
        body = f"<h1>{prose(3, 9)}</h1>" + "".join(r.choice((f"<p>{prose(8, 90)}</p>", f"<p>{prose(8, 60)} <a href='/x'>{word()}</a> {prose(3, 20)}</p>", f"<h2>{prose(2, 6)}</h2>", f"<ul><li>{prose(4, 12)}</li><li>{prose(4, 12)}</li></ul>", f"<p><b>{prose(1, 30)}<br><p>{prose(5, 40)}</p>", f"<blockquote>{prose(5, 30)}</blockquote>")) for _ in range(r.randint(1, 14)))
        opening, closing = r.choice((("<article>", "</article>"), ("<main><div class='content'>", "</div></main>"), ('<div id="post">', "</div>"), ('<section class="story">', "</section>")))
        if q.random() < 0.4:  # furniture inside the article, behind one of its headings, paragraphs or lists
            places = [m.end() for m in re.finditer("</(?:h1|h2|p|ul|blockquote)>", body)]
            at = q.choice(places)
            some = lambda a, b: " ".join(q.choice(("aside", "offer", "sale", "read", "more", "today")) for _ in range(q.randint(a, b)))
            body = body[:at] + q.choice((f'<div class="ad">{some(3, 80)}</div>', f"<aside><p>{some(5, 80)}</p></aside>", f'<form class="newsletter"><label>{some(2, 30)}</label><input><button>{some(1, 2)}</button></form>', f'<div class="notice"><p>{some(5, 60)}</p></div>')) + body[at:]
        article = opening + body + closing
        before = r.choice((f"<nav><ul>{links(r.randint(3, 12))}</ul></nav>", f'<div class="menu">{links(5)}</div>', f"<header><a href='/'>{word()}</a><p>{prose(2, 5)}</p></header>")) + r.choice(("", f'<div class="ad">{prose(3, 14)}</div>', f'<div class="cookie-notice">{prose(5, 20)}</div>', f"<form><label>{word()}</label><input><button>{word()}</button></form>"))
        after = r.choice(("", f"<aside class='sidebar'><p>{prose(5, 25)}</p><ul>{links(4)}</ul></aside>", f"<div class='comments'><p>{prose(5, 30)}</p><p>{prose(5, 30)}</p></div>")) + f"<footer>&copy; {word()} &middot; {prose(2, 12)}</footer>"
        named = lambda inner: "".join(f'<div class="{q.choice(ASIDE_NAMES)}{q.choice(("", "-box", " box", "_" + word()))}">{word()} {word()}</div>' for _ in range(inner))  # noqa: B023, E731
        before, after = before + named(q.randint(2, 5)), named(q.randint(2, 5)) + after
        article = "".join(f'<span class="{q.choice(OWN_NAMES)}{q.choice(("", "-" + word(), " " + word()))}"></span>' for _ in range(q.randint(3, 8))) + article
        head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{prose(3, 9)}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>{before}'
        out.append((f"{head}{article}{after}</body></html>", (len(head), len(head) + len(article))))
    return out


@lru_cache(maxsize=1)
def trained_names() -> dict[str, float]:
    """Log-odds of words of classes and ids: inside the article, or around it, against outside; with add-one smoothing."""
    inside: Counter = Counter()
    outside: Counter = Counter()
    for page, (a, b) in labelled_pages():
        for m in TOKEN.finditer(page):
            for name, x, y, z, _ in ATTRIBUTE.findall(m[3] or ""):
                if name.lower() in ("class", "id"):
                    # furniture inside an article is furniture: labelled by its names there too
                    words = name_tokens(x or y or z)
                    mine = a <= m.start() < b and not (m[2] or "").lower() in FURNITURE and not any(w in ASIDE_NAMES for w in words)
                    (inside if mine else outside).update(words)
    known = {w for w in inside.keys() | outside.keys() if inside[w] + outside[w] >= 5}
    return {w: math.log((inside[w] + 1) / (outside[w] + 1)) for w in sorted(known)}


@lru_cache(maxsize=1)
def trained_weights() -> dict[tuple[str, str], float]:
    """Log-odds of lying inside the article, with add-one smoothing, for tags and kinds of words.

    Tags keep at most zero: they are costs, as words are the only gain.  So do the furniture
    elements of each place; what they hold counts by itself only at the top.
    """
    inside: Counter = Counter()
    outside: Counter = Counter()
    names = trained_names()
    for page, (a, b) in labelled_pages():
        for part, where in ((page[:a], outside), (page[a:b], inside), (page[b:], outside)):
            known: set[tuple[str, int]] = set()
            for kind, what, n, element in events(part, names):
                place = element[0].rstrip("?!") if element else ""
                if element and element not in known:
                    known.add(element)
                    where["element", place] += 1
                if element and place != "top":
                    continue
                if kind == "tag":
                    where["tag", what.lstrip("/")] += 1
                elif n:
                    where[kind, ""] += n
    weights = {}
    for key in sorted(inside.keys() | outside.keys()):
        w = math.log((inside[key] + 1) / (outside[key] + 1))
        weights[key] = min(w, -0.05) if key[0] in ("tag", "element") else w
    return weights


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest sum; empty where no score is positive."""
    top, best, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > top:
            top, best = total, (start, i + 1)
    return best


def _held(seen: list[tuple[str, str, int, tuple[str, int] | None]]) -> dict[tuple[str, int], Counter]:
    """Tags, and words as ``""``, of the elements that need not be furniture."""
    held: dict[tuple[str, int], Counter] = {}
    for kind, what, n, element in seen:
        if element and element[0][-1] in "?!":
            held.setdefault(element, Counter())[what if kind == "tag" else ""] += 1 if kind == "tag" else n
    return held


def whole_pages(seen: list[tuple[str, str, int, tuple[str, int] | None]]) -> frozenset[int]:
    """Numbers of elements that are furniture by their names alone, or wrappers, and yet hold an article: ``article`` or
    ``main``, or a first heading and three paragraphs; of a wrapper also menus, heads or feet of a page with a paragraph."""
    found = set()
    for (place, k), tags in _held(seen).items():
        page = place[-1] == "!" and tags["p"] and (tags["nav"] or tags["header"] or tags["footer"] or tags["aside"])
        if tags["article"] or tags["main"] or tags["h1"] and tags["p"] >= 3 or page:
            found.add(k)
    return frozenset(found)


def _chosen(seen: list[tuple[str, str, int, tuple[str, int] | None]], w: dict[tuple[str, str], float]) -> str:
    other_tag, none = -0.2, 0.0
    scores = [w.get(("tag", what.lstrip("/")), other_tag) if kind == "tag" else w.get((kind, ""), none) * n for kind, what, n, _ in seen]
    # an element's cost stands at its first event
    most = -BRIDGE * w.get(("text", ""), none)
    first: dict[tuple[str, int], int] = {}
    for i, (*_, element) in enumerate(seen):
        if element and (at := first.setdefault(element, i)) != i:
            scores[at] += scores[i]
            scores[i] = 0.0
    for (place, _), at in first.items():
        place = place.rstrip("?!")
        scores[at] = max(scores[at], most) if place == "top" else w.get(("element", place), other_tag)
    a, b = best_run(scores)
    blocks, now = [], []
    for kind, what, *_ in seen[a:b]:
        if kind == "tag":
            if what.lstrip("/") in BLOCKS:
                blocks.append("".join(now))
                now = []
            elif what in ("br", "img"):
                now.append(" ")
        elif kind != "furniture":
            now.append(what)
    blocks.append("".join(now))
    lines = (" ".join(html.unescape(x).split()) for x in blocks)
    return "\n".join(x for x in lines if x)


def main_text(page: str | None, weights: dict[tuple[str, str], float] | None = None, names: dict[str, float] | None = None) -> str:
    """The article of a page.  Neither names nor a wrapper (a form, fieldset, dialog or label around all) empty a page: an
    element that holds an article is read as one, and where nothing else is left, the one with the most words is."""
    if not page:
        return ""
    w, names = weights or trained_weights(), names or trained_names()
    seen, trusted = list(events(page, names)), frozenset()
    for _ in range(DEEPEST):
        found = whole_pages(seen)
        if not found:
            break
        trusted |= found
        seen = list(events(page, names, trusted))
    text = _chosen(seen, w)
    if not text:
        # a form is read for want of anything else only if it has paragraphs
        sizes = {k: tags[""] for (place, k), tags in _held(seen).items() if place[-1] == "?" or tags["p"] >= 2}
        if sizes:
            text = _chosen(list(events(page, names, trusted | {max(sizes, key=lambda k: (sizes[k], -k))})), w)
    return text


def main_texts(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars of every row."""
    weights, names = trained_weights(), trained_names()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, html_col):
            texts = [main_text(x, weights, names) for x in b.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html_col).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", text string, n_chars long")
