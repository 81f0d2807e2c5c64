"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions beside them.

The patterns (:func:`base_spans`) are always kept.  The tagger adds spans that they miss:
addresses with a spelled-out at sign or dots, phone numbers without a plus, cards and network
addresses with other separators.  It is trained in numpy, at the start of a run, on ``LABELLED`` texts
with labelled spans that a fixed seed makes (the bound of the sample), so it is the same everywhere.

Every character of every text is read: windows of ``WINDOW`` characters, every ``STEP`` of them, cover the
whole text.  Windows overlap, and each character takes its scores from the window in which it
lies most central.  These joined scores are decoded under the CRF by Viterbi, so a span may
cross any number of windows.  Where no label can beat "outside" (a bound on scores and
transitions says so, see :func:`busy`), the best path is "outside" and the pass over it
is left out.

A run of labels is accepted by its margin: how much the path through it scores above the path
that stays outside.  The least margin of each kind is learned from a second labelled sample.
What is accepted is then checked for what makes its kind: the number of digits and the check
digit of a card, four numbers of a network address.  An address around a plain or bracketed at sign
is taken whole by its shape, as the scores of a character far from the at sign do not tell.
All proposals are reconciled over the whole text: the set of spans without overlap that has
the highest sum of margins, after what overlaps a pattern's span is taken away.

Null and empty texts have no spans.  Repeated rows give repeated rows, ties between equal
sums go to the span that ends first.  No text is cut: the scan is linear in its length.  Other columns, whatever their
names, are not read by :func:`found` and come through :func:`redacted` unchanged.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.common import sliced

KINDS = ("email", "ip", "card", "phone")
LABELLED, EPOCHS, BATCH, RATE, SEED = 1400, 5, 32, 0.02, 20240613
HIDDEN, EMBED = 12, 8
TRAINED_ON, WINDOW, STEP = 96, 512, 416

# -- patterns -----------------------------------------------------------------------------

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive, and not from the middle of a run of digits: the same matches in linear time
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without overlap: the run before each at sign, and the domain behind it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the patterns' matches, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- labelled texts -----------------------------------------------------------------------


def labelled_texts(n: int = LABELLED, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Short texts with (start, kind, end) of what is personal in them, and look-alikes that are not."""
    r = random.Random(seed)
    word = lambda a=2, b=9: "".join(r.choice("aeionrstlducmphgbäéñ") for _ in range(r.randint(a, b)))
    plain = lambda a=2, b=9: "".join(r.choice("aeionrstlducmphgbk") for _ in range(r.randint(a, b)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    common = "the of and to in a is at that it on for an as with de la les des der die und el los en at by dot".split()
    prose = lambda k: " ".join(r.choice((r.choice(common), word())) for _ in range(k))

    def card() -> str:
        d = r.choice("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(("", " ", "-", ".", "/", "_", " - "))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def ip() -> str:
        return r.choice((".", ".", "[.]", "(.)", " . ", "[dot]")).join(str(r.randint(0, 255)) for _ in range(4))

    def email() -> str:
        name = plain() + r.choice(("", "." + num(2), "_" + plain(), num(2)))
        at, dot = r.choice((("@", "."), (" @ ", "."), ("[at]", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" {at} ", "."), (" at ", " dot "), (" AT ", " DOT ")))
        return name + at + dot.join([plain(), r.choice(("example", "mail" + num(1))), r.choice(("com", "org", "net"))][r.randint(0, 1) :])

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"+{num(2)} {a} {b}{num(2)}", f"{a}.{b}.{c}", f"00{num(2)} {a} {b}{c}"))

    def other() -> str:
        hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
        return r.choice((f'token = "{hexa(40)}"', f"password={hexa(18)}", "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"Version {num(1)}.{num(1)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(1)}.{num(2)}", f"in {num(4)}", f"{num(2)}:{num(2)}", f"no. {num(5)}", f"[{num(2)}]", f"{num(1)},{num(3)},{num(3)}", f"v{num(1)}.{num(1)}.{num(1)}", f"@{plain()}", f"{num(10)}", "(at) " + word(), f"#{num(6)}", f"at {word()}, {word()}", f"{word()} at {word()} {word()}.", f"{word()}.\n{word().capitalize()}", r.choice("#$%&*") * 3, f"{word()}{r.choice('#$%&*') * 3} {word()}", f"https://{plain()}.{plain()}/{plain()}", f"({word()} {word()})", f'"{word()}" {word().upper()}', f"{num(1)}. {word()}", f"{num(2)} {num(3)}", f"{word()}-{word()}'s | {word()}", f"dot {word()} at {num(2)}:{num(2)}", prose(12), f"{prose(4)} at {prose(3)}. {prose(3).capitalize()}", " ".join([r.choice(common)] * 9)))

    make = (email, ip, card, phone)
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += prose(r.randint(0, 5)) + r.choice((" ", " ", "\n", ": ", ", "))
            k = r.randint(0, 8)
            piece = make[k]() if k < 4 else other()
            if k < 4:
                spans.append((len(text), k, len(text) + len(piece)))
            text += piece + r.choice((" ", ". ", ", ", "\n"))
        # a cut text ends before a span that it would cut
        stop = min([TRAINED_ON, len(text), *(a for a, _, b in spans if b > TRAINED_ON)])
        out.append((text[:stop], [s for s in spans if s[2] <= stop]))
    return out


# -- the tagger ---------------------------------------------------------------------------

#: Labels: 0 outside; 1 + 2k begins kind k, 2 + 2k continues it.
LABELS = 1 + 2 * len(KINDS)
_CLASSES = np.full(0x250, 3, np.int64)
for _i in range(0x21, 0x7F):
    _CLASSES[_i] = _i - 0x21 + 4
for _c in "\t\n\r \v\f":
    _CLASSES[ord(_c)] = 2
_CLASSES[ord("0") : ord("9") + 1] = 100
SYMBOLS = 101  # 0 pads, 1 unused


def codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return _CLASSES[np.minimum(c, 0x24F)]


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray):
    """Hidden states over time (time x rows x HIDDEN), and what the gradient needs.

    Gates and cells have piecewise linear activations, which cost a fifth of the smooth ones.
    """
    steps, rows, _ = x.shape
    h, c, out, saved = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32), np.empty((steps, rows, HIDDEN), np.float32), []
    xw = x @ w + b
    for t in range(steps):
        z = xw[t] + h @ u
        g = np.clip(0.25 * z[:, : 3 * HIDDEN] + 0.5, 0, 1)
        i, f, o, n = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.clip(z[:, 3 * HIDDEN :], -1, 1)
        c2 = f * c + i * n
        tc = np.clip(c2, -1, 1)
        h2 = o * tc
        saved.append((i, f, o, n, c, tc, h))
        h, c = h2, c2
        out[t] = h
    return out, saved


def _lstm_back(d_out: np.ndarray, x: np.ndarray, w: np.ndarray, u: np.ndarray, saved):
    dz_all = np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
    dh, dc, du = np.zeros_like(d_out[0]), np.zeros_like(d_out[0]), np.zeros_like(u)
    inner = lambda g: 0.25 * ((g > 0) & (g < 1))
    for t in range(len(x) - 1, -1, -1):
        i, f, o, n, c, tc, h = saved[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (np.abs(tc) < 1)
        dz = np.concatenate([dc * n * inner(i), dc * c * inner(f), dh * tc * inner(o), dc * i * (np.abs(n) < 1)], 1)
        dz_all[t] = dz
        du += h.T @ dz
        dh, dc = dz @ u.T, dc * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return dz_all @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def _states(p: dict, d: str, ids: np.ndarray, out: np.ndarray) -> None:
    """Hidden states of one direction into ``out`` (time x HIDDEN x rows), in the order of ``ids``.

    The same recursion as :func:`_lstm`, with rows last, so that each gate is one block of memory, and with
    what a character adds to the gates looked up.
    """
    steps, rows = ids.shape
    # the gates' slope and offset are put into the weights; one product takes in state, character and offset
    scale = np.r_[np.full(3 * HIDDEN, 0.25), np.ones(HIDDEN)].astype(np.float32)
    offset = p["b" + d] * scale + np.r_[np.full(3 * HIDDEN, 0.5), np.zeros(HIDDEN)]
    weights = np.ascontiguousarray(np.concatenate([p["u" + d] * scale, p["w" + d] * scale, offset[None]]).T.astype(np.float32))
    embed = np.ascontiguousarray(p["embed"].T)
    given = np.zeros((HIDDEN + EMBED + 1, rows), np.float32)
    given[-1] = 1
    h, x = given[:HIDDEN], given[HIDDEN:-1]
    c, z = np.zeros((HIDDEN, rows), np.float32), np.empty((4 * HIDDEN, rows), np.float32)
    g, n = z[: 3 * HIDDEN], z[3 * HIDDEN :]
    i, f, o = g[:HIDDEN], g[HIDDEN : 2 * HIDDEN], g[2 * HIDDEN :]
    for t in range(steps):
        np.take(embed, ids[t], axis=1, out=x, mode="clip")
        np.matmul(weights, given, out=z)
        g.clip(0, 1, out=g)
        n.clip(-1, 1, out=n)
        c *= f
        n *= i
        c += n
        c.clip(-1, 1, out=h)
        h *= o
        out[t] = h


def scores_of(p: dict, ids: np.ndarray) -> np.ndarray:
    """time x LABELS x rows scores; ids: time x rows."""
    steps, rows = ids.shape
    both = np.empty((2, steps, HIDDEN, rows), np.float32)
    _states(p, "1", ids, both[0])
    _states(p, "2", ids[::-1], both[1])
    out = np.matmul(p["out"][:HIDDEN].T, both[0])
    out += np.matmul(p["out"][HIDDEN:].T, both[1][::-1])
    out += p["bias"][:, None]
    return out


def _emissions(p: dict, ids: np.ndarray):
    """time x rows x LABELS scores; ids: time x rows."""
    x = p["embed"][ids]
    ahead, s1 = _lstm(x, p["w1"], p["u1"], p["b1"])
    behind, s2 = _lstm(x[::-1], p["w2"], p["u2"], p["b2"])
    both = np.concatenate([ahead, behind[::-1]], 2)
    return both @ p["out"] + p["bias"], (x, both, s1, s2)


def _crf_gradient(e: np.ndarray, gold: np.ndarray, mask: np.ndarray, trans: np.ndarray):
    """Gradient of the negative log-likelihood by emissions and transitions (forward-backward)."""
    steps, rows, k = e.shape
    log_sum = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = np.where(mask[t][:, None], log_sum(alpha[t - 1][:, :, None] + trans, 1) + e[t], alpha[t - 1])
    for t in range(steps - 2, -1, -1):
        beta[t] = np.where(mask[t + 1][:, None], log_sum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2), 0)
    z = log_sum(alpha[-1], 1)
    de = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
    d_trans = np.zeros_like(trans)
    r = np.arange(rows)
    for t in range(steps):
        de[t, r, gold[t]] -= mask[t]
        if t:
            pair = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None])
            d_trans += (pair * mask[t][:, None, None]).sum(0)
            np.subtract.at(d_trans, (gold[t - 1][mask[t]], gold[t][mask[t]]), 1)
    return de / rows, d_trans / rows


@lru_cache(maxsize=1)
def trained_tagger() -> dict[str, np.ndarray]:
    """Weights after ``EPOCHS`` passes over the labelled texts with Adam."""
    r = np.random.default_rng(SEED)
    init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"embed": r.standard_normal((SYMBOLS, EMBED)).astype(np.float32) * np.float32(0.5), "out": init(2 * HIDDEN, LABELS), "bias": np.zeros(LABELS, np.float32), "trans": np.zeros((LABELS, LABELS), np.float32)}
    for d in "12":
        p |= {"w" + d: init(EMBED, 4 * HIDDEN), "u" + d: init(HIDDEN, 4 * HIDDEN), "b" + d: np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    data = labelled_texts()
    for epoch in range(EPOCHS):
        for at in np.split(r.permutation(len(data)), range(BATCH, len(data), BATCH)):
            batch = [data[i] for i in at]
            ids, gold = np.zeros((TRAINED_ON, len(batch)), np.int64), np.zeros((TRAINED_ON, len(batch)), np.int64)
            for k, (text, spans) in enumerate(batch):
                ids[: len(text), k] = codes(text)
                for a, kind, b in spans:
                    gold[a:b, k] = 2 + 2 * kind
                    gold[a, k] = 1 + 2 * kind
            mask = ids > 0
            steps = int(mask.any(1).sum())
            ids, gold, mask = ids[:steps], gold[:steps], mask[:steps]
            e, (x, both, s1, s2) = _emissions(p, ids)
            de, d_trans = _crf_gradient(e, gold, mask, p["trans"])
            flat = de.reshape(-1, LABELS)
            g = {"out": both.reshape(-1, 2 * HIDDEN).T @ flat, "bias": flat.sum(0), "trans": d_trans}
            d_both = de @ p["out"].T
            dx1, g["w1"], g["u1"], g["b1"] = _lstm_back(d_both[:, :, :HIDDEN], x, p["w1"], p["u1"], s1)
            dx2, g["w2"], g["u2"], g["b2"] = _lstm_back(d_both[::-1, :, HIDDEN:], x[::-1], p["w2"], p["u2"], s2)
            g["embed"] = np.zeros_like(p["embed"])
            np.add.at(g["embed"], ids, dx1 + dx2[::-1])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * np.float32(min(1, 5 / (size + 1e-9)))
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                p[k] = (p[k] - rate * m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    p["least"] = np.zeros(len(KINDS))
    p["least"] = least_margins(p, labelled_texts(LABELLED // 2, SEED + 1))
    return p


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels (time x rows) of emissions (time x rows x LABELS)."""
    steps, rows, _ = e.shape
    now, back = e[0], np.empty(e.shape, np.int8)
    for t in range(1, steps):
        s = now[:, :, None] + trans
        back[t] = s.argmax(1)
        now = s.max(1) + e[t]
        now -= now[:, :1]  # only differences matter; large sums would lose them
    out = np.empty((steps, rows), np.int8)
    out[-1] = now.argmax(1)
    r = np.arange(rows)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t][r, out[t]]
    return out


AT = re.compile(r"@|[\[({]\s?at\s?[\])}]", re.I)
BEHIND = re.compile(r"\s?[A-Za-z0-9-]++(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)[A-Za-z0-9-]++)++", re.I)
SPELLED = re.compile(r"\S\s+at\s+\S+?(?:\s+dot\s+|\.)\S", re.I)
#: Characters before and behind an at sign that are looked at for an address.
LONGEST = 320


def is_kind(kind: int, s: str) -> bool:
    """Whether an accepted span has what makes its kind."""
    d = _digits(s)
    if kind == 0:
        return AT.search(s) is not None or SPELLED.search(s) is not None
    if kind == 1:
        numbers = re.findall("[0-9]+", s)
        return len(numbers) == 4 and all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in numbers)
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15


def reconciled(proposed: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of (start, kind, end, score) those without overlap that have the highest sum of scores."""
    spans = sorted(proposed, key=lambda x: (x[2], x[0], x[1]))
    ends = [s[2] for s in spans]
    best: list[tuple[float, int]] = [(0.0, -1)]
    for i, s in enumerate(spans):
        before = bisect_right(ends, s[0], 0, i)
        best.append(max((best[before][0] + s[3], before), (best[i][0], -1)))
    out, i = [], len(spans)
    while i:
        if best[i][1] >= 0:
            out.append(spans[i - 1][:3])
            i = best[i][1]
        else:
            i -= 1
    return sorted(out)


def addresses(text: str, first: int, end: int) -> list[tuple[int, int]]:
    """Whole addresses around the at signs in ``text[first:end]`` by their shape, of any length that has it."""
    out = []
    for m in AT.finditer(text, first, end):
        stop = m.start() - (m.start() > 0 and text[m.start() - 1].isspace())
        start = stop
        while start > 0 and stop - start < LONGEST and text[start - 1] in LOCAL:
            start -= 1
        behind = BEHIND.match(text, m.end(), m.end() + LONGEST) if start < stop else None
        if behind:
            out.append((start, behind.end()))
    return out


def windows(texts: list[str]) -> tuple[np.ndarray, list[int]]:
    """Codes of the windows that cover all texts (time x windows), and each text's first window.

    A window holds the ``STEP`` characters that take their scores from it and the margins around them.
    """
    margin = (WINDOW - STEP) // 2
    firsts, n = [], 0
    for t in texts:
        firsts.append(n)
        n += -(-len(t) // STEP)
    out = np.zeros((n, WINDOW), np.int64)
    for t, first in zip(texts, firsts, strict=True):
        k = -(-len(t) // STEP)
        if k:
            row = np.zeros(k * STEP + 2 * margin, np.int64)
            row[margin : margin + len(t)] = codes(t)
            out[first : first + k] = np.lib.stride_tricks.sliding_window_view(row, WINDOW)[::STEP]
    return np.ascontiguousarray(out.T), [*firsts, n]


def busy(over: np.ndarray, trans: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Which characters of a row of texts may be in a run, of a margin over ``least``, on the best path.

    ``over`` is, for each character, how much its best label scores above "outside".  A path that is not
    outside from one character to another gains at most the sum of ``over`` between them and,
    for each transition, the best one over staying outside.  Where no stretch that holds a
    character can gain as much, the best path is outside there or its run is not accepted.
    """
    rest = trans - trans[0, 0]
    enter, leave, stay = rest[0, 1:].max(), rest[1:, 0].max(), rest[1:, 1:].max()
    s = np.r_[0.0, np.cumsum(over.astype(np.float64) + stay)]
    return np.maximum.accumulate(s[:0:-1])[::-1] - np.minimum.accumulate(s[:-1]) > stay - enter - leave + least


def stretches(texts: list[str], p: dict[str, np.ndarray], rows: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, start, scores of each character) of every stretch of busy characters."""
    margin = (WINDOW - STEP) // 2
    ids, firsts = windows(texts)
    n = firsts[-1]
    if not n:
        return
    parts, over = [], np.empty((n, STEP), np.float32)
    for at in range(0, n, rows):
        some = scores_of(p, ids[:, at : at + rows])[margin : margin + STEP]
        over[at : at + rows] = (some[:, 1:].max(1) - some[:, 0]).T
        parts.append(some)
    ends = np.zeros(n * STEP, bool)
    for i, t in enumerate(texts):
        over.ravel()[firsts[i] * STEP + len(t) : firsts[i + 1] * STEP] = -1e4
        ends[firsts[i] * STEP] = len(t) > 0
    flags = busy(over.ravel(), p["trans"], float(p["least"].min())) & (over.ravel() > -1e4)
    where = np.flatnonzero(flags)
    if not len(where):
        return
    e = np.empty((len(where), LABELS), np.float32)
    window, step = where // STEP, where % STEP
    for k, some in enumerate(parts):
        at = slice(*np.searchsorted(window, (k * rows, (k + 1) * rows)))
        e[at] = some[step[at], :, window[at] - k * rows]
    cuts = np.flatnonzero((np.diff(where) > 1) | ends[where[1:]]) + 1
    owner = np.searchsorted(np.array(firsts), window, side="right") - 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)], strict=True):
        i = int(owner[a])
        yield i, int(where[a]) - firsts[i] * STEP, e[a:b]


def decoded(found: list[tuple[int, int, np.ndarray]], trans: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, start, kind, end, margin) of the labelled runs of stretches; those of about the same length are decoded together."""
    found = sorted(found, key=lambda x: len(x[2]))
    while found:
        steps = len(found[0][2]) * 5 // 4 + 16
        n = next((k for k, x in enumerate(found) if len(x[2]) > steps or k * steps > 400_000), len(found))
        group, found = found[:n], found[n:]
        # before a stretch and behind it the path is outside
        e = np.zeros((len(group[-1][2]) + 2, n, LABELS), np.float32)
        e[:, :, 1:] = -1e4
        for k, x in enumerate(group):
            e[1 : 1 + len(x[2]), k] = x[2]
        for k, a, kind, b, margin in label_runs(viterbi(e, trans), e, trans):
            yield group[k][0], group[k][1] + a - 1, kind, group[k][1] + b - 1, margin


def label_runs(labels: np.ndarray, e: np.ndarray, trans: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, start, kind, end, margin over the path that stays outside) of the runs of labels (time x rows).

    First and last labels are "outside".
    """
    path = labels.astype(np.int64)
    own = np.take_along_axis(e, path[:, :, None], 2)[:, :, 0] - e[:, :, 0]
    own[1:] += trans[path[:-1], path[1:]] - trans[0, 0]
    gain = np.cumsum(own, 0, dtype=np.float64)
    kind = (path + 1) // 2
    # a run ends where another begins or the path is outside again
    starts = (path[1:] > 0) & ((path[1:] % 2 == 1) | (kind[1:] != kind[:-1]))
    stops = (path[:-1] > 0) & (starts | (path[1:] == 0))
    row, a = np.nonzero(starts.T)
    _, b = np.nonzero(stops.T)
    back = np.where(path[b + 1, row] == 0, own[b + 1, row], 0)
    margin = gain[b, row] - gain[a, row] + back
    yield from zip(row.tolist(), (a + 1).tolist(), (kind[a + 1, row] - 1).tolist(), (b + 1).tolist(), margin.tolist(), strict=True)


def proposals(texts: list[str], p: dict[str, np.ndarray], rows: int = 1024) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, start, kind, end, margin) of all labelled runs, without white space at their ends."""
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def take() -> Iterator[tuple[int, int, int, int, float]]:
        for i, a, kind, b, margin in decoded(held, p["trans"]):
            s = texts[i][a:b]
            a += len(s) - len(s.lstrip())
            b -= len(s) - len(s.rstrip())
            if a < b:
                yield i, a, kind, b, margin

    for at, some in portions(texts):
        for i, a, e in stretches(some, p, rows):
            held.append((at + i, a, e))
            size += len(e)
            if size >= 400_000:
                yield from take()
                held, size = [], 0
    yield from take()


def portions(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of about so many characters together; a longer text is one by itself."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def least_margins(p: dict[str, np.ndarray], data: list[tuple[str, list[tuple[int, int, int]]]], precision: float = 0.99) -> np.ndarray:
    """For each kind the least margin above which so many of the runs in labelled texts overlap a span of their kind."""
    seen: list[list[tuple[float, bool]]] = [[] for _ in KINDS]
    for i, a, kind, b, margin in proposals([t for t, _ in data], p):
        if is_kind(kind, data[i][0][a:b]):
            seen[kind].append((margin, any(k == kind and a < y and x < b for x, k, y in data[i][1])))
    out = []
    for runs in seen:
        runs.sort(reverse=True)
        right = np.cumsum([good for _, good in runs])
        good = np.flatnonzero(right >= precision * np.arange(1, len(runs) + 1))
        out.append(runs[good[-1]][0] if len(good) else np.inf)
    return np.array(out)


def tagged_spans(texts: list[str], p: dict[str, np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """What the tagger finds in each text, reconciled over the text."""
    votes: list[dict] = [{} for _ in texts]
    for i, a, kind, b, margin in proposals(texts, p):
        text = texts[i]
        if margin < p["least"][kind]:
            continue
        whole = [x for x in addresses(text, max(0, a - LONGEST), b + LONGEST) if x[0] < b and a < x[1]] if kind == 0 else []
        for first, end in whole or ([(a, b)] if is_kind(kind, text[a:b]) else []):
            votes[i][first, kind, end] = max(margin, votes[i].get((first, kind, end), 0.0))
    return [reconciled([(*k, v) for k, v in found.items()]) if found else [] for found in votes]


def apart_from(spans: list[tuple[int, int, int]], others: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of sorted spans without overlap that overlap none of the others (sorted by start)."""
    out, k, reach = [], 0, -1
    for s in spans:
        while k < len(others) and others[k][0] < s[2]:
            reach = max(reach, others[k][2])
            k += 1
        # others that start before this span's end: the farthest of them must end before it starts
        if reach <= s[0]:
            out.append(s)
    return out


def all_spans(texts: list[str], p: dict[str, np.ndarray]) -> list[tuple[list, list]]:
    """(patterns' spans, those of the tagger that overlap none of them) of each text."""
    out = []
    for t, tagged in zip(texts, tagged_spans(texts, p), strict=True):
        base = base_spans(t)
        out.append((base, apart_from(tagged, base)))
    return out


def written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the base counts and digest, spans and n_added of every row."""
    p = trained_tagger()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "__text"):
            rows = all_spans([t or "" for t in b.column("__text").to_pylist()], p)
            counts = [[sum(s[1] == k for s in base) for base, _ in rows] for k in range(len(KINDS))]
            cols = [
                b.column("__id"),
                *(pa.array(c, pa.int64()) for c in counts),
                pa.array([hashlib.sha256(written_out(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                pa.array([written_out(base + more) for base, more in rows], pa.string()),
                pa.array([len(more) for _, more in rows], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = ", ".join([f"`{id_col}` {kind}", *(f"n_{k} long" for k in KINDS), "base_sha256 string, spans string, n_added long"])
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with spans, overlapping ones as one, replaced by the kind of the first."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with personal data replaced in the text, and its length made right.

    All other columns travel in one struct, so their names clash with nothing.
    """
    p = trained_tagger()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.lit(0))
    packed = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            texts = b.column("text").to_pylist()
            rows = all_spans([t or "" for t in texts], p)
            new = [t if t is None else replaced(t, base + more) for t, (base, more) in zip(texts, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(new, pa.string())], names=["row", "text"])

    out = packed.mapInArrow(run, packed.schema)
    new = {text_col: F.col("text")} | ({chars_col: F.length("text").cast("long")} if chars_col in docs.columns else {})
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
